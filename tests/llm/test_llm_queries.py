"""The registered training-data queries, and the pipeline next to plain Python."""

import os
import sys
from pathlib import Path

import pytest
from test_scan import WORD
from test_spark_ops import near, repeats

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from locusmill.llm import decontaminate, queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    message, _, _, ok = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, message


def test_all_are_registered():
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in found if q[:2] == "op" and q[2].isdigit()}
    assert "pipeline" in found


def test_rows_of_whole_tables(spark):
    """Operators that judge documents return every one of them once."""
    docs = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    for name in ("op3_language_id", "op6_simhash", "op7_sentence_pieces", "op8_token_counts", "op9_quality_classifier", "op10_quality_rules", "op12_minhash", "op13_manifest"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).collect()) == docs, name


def test_held_out_languages(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, SF).collect()}
    held = [(r.lang, found[r.doc_id].lang_pred) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if found[r.doc_id].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_pipeline(spark):
    """Language keeps all here; copies, repeats and leaks are looked for by brute force."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    _, comp = near([docs[i] for i in ids], 3)
    texts = {i: docs[i] for n, i in enumerate(ids) if comp[n] == n}
    cut = repeats(texts, 50)
    left = {i: [w for at, w in enumerate(WORD.findall(t)) if at not in cut.get((i, False), ())] for i, t in texts.items()}
    left = {i: w for i, w in left.items() if w}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    leaked = {i for i, w in left.items() if any(f" {plain(b)} " in f" {plain(' '.join(w))} " for b in bench)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(left) - leaked and all(r.round_trip for r in got)


def test_stages_return_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
    assert decontaminate.THRESHOLD == 0.5
