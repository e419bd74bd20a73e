import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from locusmill.session import local_session

    session = local_session("8", shuffle_partitions=4, app="locusmill-tests")
    yield session
    session.stop()


def feature_rows(spark, rows):
    """Flat features from dicts; missing columns are NULL."""
    schema = (
        "genome string, record_ord long, record_id string, feat_ord long, type string, start0 int, `end` int,"
        " strand int, locus_tag string, gene string, product string, protein_id string, transcript_id string,"
        " translation string, note string, ncRNA_class string, gene_kind string, gene_functions array<string>,"
        " sec_met_domain array<string>, GO_function array<string>, GO_process array<string>"
    )
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]
    base = {"genome": "g", "record_ord": 0, "record_id": "c", "type": "CDS", "start0": 0, "end": 9, "strand": 1}
    data = []
    for i, r in enumerate(rows):
        full = {**base, "feat_ord": i, **r}
        data.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(data, schema)


def contig_rows(spark, rows):
    data = [
        (r.get("genome", "g"), r.get("record_ord", 0), r.get("record_id", "c"), r.get("organism", ""),
         r.get("topology", "linear"), len(r["seq"]), r["seq"])
        for r in rows
    ]
    return spark.createDataFrame(
        data,
        "genome string, record_ord long, record_id string, organism string, topology string, length int, seq string",
    )
