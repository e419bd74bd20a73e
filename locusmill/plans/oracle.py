"""DuckDB SQL for the registered queries.

``CTE`` holds the same derived tables as ``bioviews``; every query below names the
ones it needs through ``sql``.
"""

from __future__ import annotations

from ..functions.align import RESIDUES, protein_scheme
from ..operators.annotation import PREVIEW
from .bioviews import ALPHABET, CONTIG_LENGTH, PEPTIDE, TO_DNA, TO_PROTEIN

_LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"
_DNA = f"translate({_LETTERS}, '{ALPHABET}', '{TO_DNA}')"
_PROT = f"translate({_LETTERS}, '{ALPHABET}', '{TO_PROTEIN}')"
_PRODUCT = (
    "(CASE WHEN p_size % 4 = 0 THEN 'Putative ' WHEN p_size % 4 = 1 THEN 'predicted ' ELSE '' END"
    " || p_name || '-' || p_brand || CASE WHEN p_size % 5 = 0 THEN ' (plasmid)' ELSE '' END)"
)

CTE = {
    "contigs": f"""
  contigs AS MATERIALIZED (
    SELECT source AS genome, doc_id AS record_ord, 'doc' || doc_id AS record_id,
           lang || ' ' || source AS organism,
           CASE WHEN lang IN ('de', 'fr') THEN 'circular' ELSE 'linear' END AS topology,
           length({_DNA}) AS length, {_DNA} AS seq
    FROM documents)""",
    "proteins": f"""
  proteins AS MATERIALIZED (
    SELECT source AS genome, doc_id AS record_ord, 'doc' || doc_id AS record_id,
           'D' || doc_id AS locus_tag, 'protein of ' || lang AS product, {_PROT} AS translation
    FROM documents)""",
    "probes": f"""
  probes AS MATERIALIZED (
    SELECT item_id AS record_ord, 'Q' || item_id AS locus_tag, {_PROT} AS translation FROM benchmark)""",
    "features": f"""
  features AS MATERIALIZED (
    SELECT genome, record_ord, record_id, topology, contig_length, type, start0, start0 + 3 * (qty + 10) AS "end",
           strand, locus_tag, gene, product, protein_id, translation, note, gene_kind, gene_functions
    FROM (SELECT 'genome_' || s_nationkey AS genome, l_suppkey AS record_ord, 'ctg_' || l_suppkey AS record_id,
             CASE WHEN l_suppkey % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology,
             {CONTIG_LENGTH}::BIGINT AS contig_length,
             CASE p_type WHEN 'ECONOMY' THEN 'tRNA' WHEN 'SMALL' THEN 'mRNA' ELSE 'CDS' END AS type,
             (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 2000000 AS start0,
             CAST(floor(l_quantity) AS BIGINT) AS qty,
             CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS strand,
             'L' || l_orderkey || '_' || l_linenumber AS locus_tag,
             CASE WHEN l_linenumber = 1 THEN 'g' || (l_partkey % 100) END AS gene,
             CASE WHEN p_size % 7 <> 0 THEN {_PRODUCT} END AS product,
             CASE WHEN l_partkey % 3 = 0 THEN 'P' || l_partkey || '_' || l_suppkey END AS protein_id,
             translate(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z]', '', 'g'),
                       '{ALPHABET}', '{TO_PROTEIN}') AS translation,
             CASE WHEN l_returnflag = 'R' THEN 'resistance near ' || p_name END AS note,
             CASE p_size % 3 WHEN 0 THEN 'biosynthetic' WHEN 1 THEN 'transport' END AS gene_kind,
             CASE WHEN p_size % 6 = 0 THEN ['biosynthetic (rule-based) ' || p_name, 'other'] END AS gene_functions
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey))""",
    "genes": f"""
  genes AS MATERIALIZED (
    SELECT *, substr(prot, start0 + 1,
                     greatest(("end" - start0) // 3 - CASE WHEN feat_ord % 17 = 0 THEN 5 ELSE 0 END, 0)) AS translation
    FROM (SELECT genome, record_ord, record_id, len AS contig_length, o_orderkey AS feat_ord,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'mRNA'
                  WHEN o_orderpriority = '5-LOW' THEN 'tRNA' ELSE 'CDS' END AS type,
             start0, least(start0 + 3 * (10 + o_orderkey % 90), len) AS "end",
             CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 END AS strand,
             CASE WHEN o_orderkey % 11 <> 0 THEN 'G' || o_custkey END AS locus_tag,
             CASE WHEN o_orderkey % 5 = 0 THEN 'gene' || (o_custkey % 97) END AS gene,
             CASE WHEN o_orderkey % 13 <> 0 THEN {_PRODUCT} END AS product,
             CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_orderkey END AS protein_id,
             CASE WHEN o_orderkey % 4 = 0 THEN 'T' || o_orderkey END AS transcript_id, prot
          FROM (SELECT o.*, p.*, d.source AS genome, d.doc_id AS record_ord, 'doc' || d.doc_id AS record_id,
                       length(d.letters) AS len, d.prot,
                       (o_orderkey * 7919 + o_custkey * 104729) % greatest(length(d.letters), 1) AS start0
                FROM orders o
                JOIN part p ON p_partkey = (o_orderkey * 17 + o_custkey) % (SELECT count(*) FROM part)
                JOIN (SELECT doc_id, source, {_LETTERS} AS letters, {_PROT} AS prot FROM documents) d
                  ON doc_id = o_custkey % (SELECT count(*) FROM documents))))""",
}

REVCOMP = "reverse(translate({0}, 'ACGTNRYSWKMBDHVacgtnryswkmbdhv', 'TGCANYRSWMKVHDBtgcanyrswmkvhdb'))"


def sql(uses: str, body: str, extra: str = "") -> str:
    parts = [CTE[u] for u in uses.split()]
    if extra:
        parts.append(extra)
    return "WITH " + ",".join(parts) + "\n" + body


def _strand(c="strand"):
    return f"CASE WHEN {c} = 1 THEN '+' ELSE '-' END"


_REPORTED = "type IN ('CDS','tRNA','rRNA','tmRNA','ncRNA','misc_RNA','miRNA','snoRNA','snRNA','scRNA','siRNA')"
_DISPLAY = (
    "CASE WHEN coalesce(product,'') <> '' THEN product"
    " WHEN gene_kind IS NOT NULL AND gene_functions IS NOT NULL THEN gene_kind || ' [' || gene_functions[1] || ']'"
    " WHEN gene_kind IS NOT NULL THEN gene_kind || ' (antiSMASH)'"
    " WHEN gene_functions IS NOT NULL THEN gene_functions[1] ELSE '(no annotation)' END"
)
_GENE_DISPLAY = "coalesce(product, '(no annotation)')"
_TEXT = "lower(concat_ws(' ', product, gene_kind, array_to_string(gene_functions, ' '), note))"
_VIEW = (
    'record_id AS "Sequence_ID", coalesce(locus_tag, \'\') AS "Locus_Tag", coalesce(gene, \'\') AS "Gene",'
    ' start0 + 1 AS "Start", "end" AS "End", ' + _strand() + ' AS "Strand",'
    f' {_DISPLAY} AS "Product", coalesce(protein_id, \'\') AS "Protein_ID", length(translation) AS "Length_aa"'
)
_NORM = (
    "CASE WHEN nw = '' THEN raw ELSE nw END"
)

_NORM_EXTRA = """
  normed AS (
    SELECT *, array_to_string(list_filter(regexp_split_to_array(
        regexp_replace(regexp_replace(regexp_replace(trim(lower(product)), '\\s*\\[.*?\\]\\s*$', ''),
                       '\\s*\\(.*?\\)\\s*$', ''), '[-_/,;]+', ' ', 'g'), '\\s+'),
        lambda w: w <> '' AND w NOT IN ('putative','probable','predicted','possible','potential',
                                        'uncharacterized','candidate')), ' ') AS nw,
      trim(lower(product)) AS raw
    FROM features WHERE type = 'CDS' AND trim(coalesce(product, '')) <> ''),
  keyed AS (SELECT *, CASE WHEN nw = '' THEN raw ELSE nw END AS norm_key FROM normed),
  grp AS (
    SELECT norm_key, count(DISTINCT genome) AS genomes,
           count(DISTINCT genome || '|' || coalesce(locus_tag, 'UNKNOWN')) AS copies
    FROM keyed WHERE NOT contains(norm_key, 'hypothetical') GROUP BY norm_key
    HAVING count(DISTINCT genome) >= {n})"""


def _kw_union(words, text, cols, where="type = 'CDS'", src="features"):
    return " UNION ALL ".join(
        f"SELECT '{w}' AS keyword, {cols} FROM {src} WHERE {where} AND contains({text}, '{w.lower()}')"
        for w in words
    )


KEYWORDS = ["widget", "Ring-Brand", "resistance", "absent term"]


def annotation_sql() -> dict[str, str]:
    out = {}
    out["conserved_products"] = sql(
        "features", "SELECT * FROM grp", _NORM_EXTRA.format(n=20)
    )
    out["conserved_product_rows"] = sql(
        "features",
        """SELECT norm_key AS "Conserved_Product_Group", genomes AS "Genomes_Found", genome AS "Genome_File",
             record_id AS "Locus", coalesce(locus_tag, 'UNKNOWN') AS "Locus_Tag",
             trim(product) AS "Original_Product", translation AS "Protein_Sequence"
           FROM keyed JOIN grp USING (norm_key)""",
        _NORM_EXTRA.format(n=24),
    )
    kw_text = "lower(coalesce(product,'') || ' ' || coalesce(gene,'') || ' ' || coalesce(note,''))"
    union = _kw_union(KEYWORDS, kw_text, "genome, locus_tag, record_id, product, translation")
    out["keyword_conservation"] = sql(
        "features",
        f"""SELECT w.keyword, count(DISTINCT genome) AS genomes,
              count(DISTINCT genome || '|' || locus_tag) AS copies, count(DISTINCT genome) >= 2 AS conserved
            FROM (SELECT unnest({KEYWORDS}) AS keyword) w LEFT JOIN ({union}) h USING (keyword) GROUP BY 1""",
    )
    out["keyword_conservation_rows"] = sql(
        "features",
        f"""SELECT keyword AS "Keyword", genomes AS "Genomes_Found", genome AS "Genome_File", record_id AS "Locus",
              locus_tag AS "Locus_Tag", coalesce(product, '') AS "Product", translation AS "Protein_Sequence"
            FROM ({union}) h JOIN (SELECT keyword, count(DISTINCT genome) AS genomes FROM ({union}) GROUP BY 1
              HAVING count(DISTINCT genome) >= 2) USING (keyword)""",
    )
    scan = _kw_union(
        ["biosynthetic", "Hot Ring"],
        _TEXT,
        "genome, record_id, locus_tag, gene, start0, \"end\", strand, product, protein_id, translation, gene_kind, gene_functions",
    )
    role = (
        "CASE WHEN gene_functions IS NULL THEN coalesce(gene_kind, 'unassigned') ELSE coalesce(gene_kind, 'unassigned')"
        " || ' [' || trim(regexp_extract(gene_functions[1], '\\)\\s*([^)]+)$', 1)) || ']' END"
    )
    out["keyword_scan"] = sql(
        "features",
        f"""SELECT keyword AS "Keyword", genome AS "Source_File", record_id AS "Sequence_ID", '' AS "Organism",
              '' AS "Cluster_Type", locus_tag AS "Locus_Tag", coalesce(gene, '') AS "Gene", start0 + 1 AS "Start",
              "end" AS "End", {_strand()} AS "Strand", {_DISPLAY} AS "Product",
              coalesce(protein_id, '') AS "Protein_ID", length(translation) AS "Length_aa",
              coalesce(gene_kind, '') AS "Gene_Kind", {role} AS "Role_in_BGC", translation AS "Protein_Sequence",
              CASE WHEN contains(lower({role}), 'biosynthetic') THEN '>>> '
                   WHEN contains(lower({role}), 'transport') THEN ' -> ' ELSE '    ' END AS marker
            FROM ({scan})""",
    )
    out["scan_summary"] = sql(
        "features",
        f"""SELECT w.keyword AS "Keyword", count(genome) AS hits, count(DISTINCT genome) AS files_hit
            FROM (SELECT unnest(['biosynthetic', 'Hot Ring', 'no such thing']) AS keyword) w
            LEFT JOIN ({scan}) h USING (keyword) GROUP BY 1""",
    )
    ks = []
    for w, cond in (
        ("ring", "regexp_matches({t}, '(?i)\\bring\\b')"),
        ("old", "regexp_matches({t}, '(?i)\\bold\\b')"),
    ):
        ks.append(f"SELECT '{w}' AS \"Keyword\", {_VIEW} FROM features WHERE {_REPORTED} AND " + cond.format(t=_TEXT))
    out["keyword_search_word"] = sql("features", " UNION ALL ".join(ks))
    out["keyword_search_regex"] = sql(
        "features",
        f"SELECT '^(hot|red) \\w+-brand#1\\d' AS \"Keyword\", {_VIEW} FROM features WHERE {_REPORTED} AND "
        f"regexp_matches({_TEXT}, '(?i)^(hot|red) \\w+-brand#1\\d')",
    )
    out["locus_search"] = sql(
        "features",
        f"SELECT 'l12_' AS \"Keyword\", {_VIEW} FROM features WHERE {_REPORTED} AND contains(lower(locus_tag), 'l12_')"
        f" UNION ALL SELECT '_7', {_VIEW} FROM features WHERE {_REPORTED} AND contains(lower(locus_tag), '_7')",
    )
    out["product_counts"] = sql(
        "features",
        f"""SELECT {_DISPLAY} AS "Product", count(*) AS "Count" FROM features
            WHERE {_REPORTED} AND NOT contains(lower({_DISPLAY}), 'hypothetical') GROUP BY 1 HAVING count(*) >= 3""",
    )
    out["product_totals"] = sql(
        "features",
        f"""SELECT count(*) AS total_features, count(*) FILTER (contains(lower({_DISPLAY}), 'hypothetical')) AS hypothetical,
              count(DISTINCT {_DISPLAY}) FILTER (NOT contains(lower({_DISPLAY}), 'hypothetical')) AS distinct_products
            FROM features WHERE {_REPORTED}""",
    )
    bnd = (
        "CASE WHEN start0 + 1 >= {a} AND \"end\" <= {b} THEN 'full' WHEN start0 + 1 < {a} AND \"end\" > {b}"
        " THEN 'spans-window' WHEN start0 + 1 < {a} THEN 'clipped-left' ELSE 'clipped-right' END"
    )
    for name, cond in (
        ("coord_overlap", 'start0 + 1 <= 400000 AND "end" >= 250000'),
        ("coord_strict", 'start0 + 1 >= 250000 AND "end" <= 400000'),
    ):
        out[name] = sql(
            "features",
            f"SELECT {_VIEW}, {bnd.format(a=250000, b=400000)} AS \"Boundary\" FROM features WHERE {_REPORTED} AND {cond}",
        )
    out["sequence_dump"] = sql(
        "features",
        f"""SELECT {_VIEW}, '' AS "GO_Function", '' AS "GO_Process", coalesce(note, '') AS "Note",
              coalesce(gene_kind, '') AS "Gene_Kind", coalesce(array_to_string(gene_functions, '; '), '') AS "Gene_Functions"
            FROM features WHERE {_REPORTED}""",
    )
    out["type_counts"] = sql(
        "features", "SELECT upper(type) AS type, count(*) AS genes FROM features GROUP BY 1"
    )
    out["isoform_list"] = sql(
        "genes",
        f"""SELECT genome, record_id, locus_tag, coalesce(protein_id, '') AS protein_id, start0 + 1 AS start, "end",
              "end" - start0 AS length_bp, {_strand()} AS strand, count(*) OVER w AS isoforms,
              min(start0) OVER w + 1 AS envelope_start, max("end") OVER w AS envelope_end
            FROM genes WHERE {_REPORTED} AND locus_tag IS NOT NULL
            WINDOW w AS (PARTITION BY genome, record_id, locus_tag) QUALIFY count(*) OVER w > 1""",
    )
    out["isoform_collapse"] = sql(
        "genes",
        f"""SELECT genome, record_ord, feat_ord, record_id, start0, "end", coalesce(locus_tag, '') AS locus_tag,
              {_GENE_DISPLAY} AS product, count(*) OVER w - 1 AS collapsed
            FROM genes WHERE {_REPORTED}
            WINDOW w AS (PARTITION BY genome, coalesce(locus_tag, '#' || record_ord || '_' || feat_ord))
            QUALIFY row_number() OVER (PARTITION BY genome, coalesce(locus_tag, '#' || record_ord || '_' || feat_ord)
                                       ORDER BY record_ord, feat_ord) = 1""",
    )
    out["contig_stats"] = sql(
        "contigs genes",
        """SELECT c.genome, c.record_id AS "Sequence_ID", c.length AS "Length_bp", organism AS "Organism",
             coalesce(ncds, 0) AS "CDS_Count", coalesce(nrna, 0) AS "RNA_Count",
             CASE WHEN coalesce(ncds, 0) + coalesce(nrna, 0) = 0 THEN '(no features)'
                  WHEN ncds > 0 THEN coalesce(cf, '(none)') ELSE coalesce(rf, '(none)') END AS "First_Tag",
             CASE WHEN coalesce(ncds, 0) + coalesce(nrna, 0) = 0 THEN '(no features)'
                  WHEN ncds > 0 THEN coalesce(cl, '(none)') ELSE coalesce(rl, '(none)') END AS "Last_Tag",
             CASE WHEN coalesce(ncds, 0) + coalesce(nrna, 0) = 0 THEN 0 WHEN ncds > 0 THEN cmin ELSE rmin END AS "Gene_Start",
             CASE WHEN coalesce(ncds, 0) + coalesce(nrna, 0) = 0 THEN 0 WHEN ncds > 0 THEN cmax ELSE rmax END AS "Gene_End"
           FROM contigs c LEFT JOIN (
             SELECT genome, record_id, count(*) FILTER (type = 'CDS') AS ncds, count(*) FILTER (type = 'tRNA') AS nrna,
               arg_min(locus_tag, feat_ord) FILTER (type = 'CDS' AND locus_tag IS NOT NULL) AS cf,
               arg_max(locus_tag, feat_ord) FILTER (type = 'CDS' AND locus_tag IS NOT NULL) AS cl,
               arg_min(locus_tag, feat_ord) FILTER (type = 'tRNA' AND locus_tag IS NOT NULL) AS rf,
               arg_max(locus_tag, feat_ord) FILTER (type = 'tRNA' AND locus_tag IS NOT NULL) AS rl,
               min(start0 + 1) FILTER (type = 'CDS') AS cmin, max("end") FILTER (type = 'CDS') AS cmax,
               min(start0 + 1) FILTER (type = 'tRNA') AS rmin, max("end") FILTER (type = 'tRNA') AS rmax
             FROM genes GROUP BY 1, 2) g ON c.genome = g.genome AND c.record_id = g.record_id""",
    )
    return out


def _cluster_extra(gap):
    return f"""
  cds AS (SELECT *, start0 + 1 AS start FROM features WHERE type = 'CDS'),
  flagged AS (SELECT *, coalesce(start - lag("end") OVER w > {gap}, true) AS opens FROM cds
    WINDOW w AS (PARTITION BY genome, record_id ORDER BY start, "end", locus_tag)),
  numbered AS (SELECT *, CAST(sum(CAST(opens AS BIGINT)) OVER (PARTITION BY genome, record_id
      ORDER BY start, "end", locus_tag ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS cluster FROM flagged),
  marks AS (SELECT genome, record_id, max(cluster) AS last, min(start) AS first_start,
      arg_max("end", (start, "end", locus_tag)) AS last_end, any_value(topology) AS topology FROM numbered GROUP BY 1, 2),
  merged AS (SELECT n.*,
      topology_c AND last > 0 AND first_start + contig_length - last_end BETWEEN 0 AND {gap} AND cluster IN (0, last) AS wraps
    FROM (SELECT numbered.*, marks.last, marks.first_start, marks.last_end, marks.topology = 'circular' AS topology_c
          FROM numbered JOIN marks USING (genome, record_id)) n)"""


def interval_sql() -> dict[str, str]:
    out = {}
    spans = (
        'CAST(count(*) AS BIGINT) AS hits, {w} AS wraps_origin, {c1} AS c1, {c2} AS c2, round(({span}) / 1000.0::DOUBLE, 6) AS span_kb'
    )
    out["proximity_clusters"] = sql(
        "features",
        "SELECT genome, record_id, cluster, "
        + spans.format(w="false", c1="min(start)", c2='max("end")', span='max("end") - min(start)')
        + " FROM numbered GROUP BY 1, 2, 3",
        _cluster_extra(5000),
    )
    c1 = "CASE WHEN bool_or(wraps) THEN min(start) FILTER (start > contig_length / 2) ELSE min(start) END"
    c2 = 'CASE WHEN bool_or(wraps) THEN max("end") FILTER (start <= contig_length / 2) ELSE max("end") END'
    out["circular_wrap"] = sql(
        "features",
        f"""SELECT genome, record_id, cluster, hits, wraps_origin, c1, c2,
              round(CASE WHEN wraps_origin THEN len - c1 + c2 ELSE c2 - c1 END / 1000.0::DOUBLE, 6) AS span_kb,
              'extract-region -i genomes.gbk --c1 ' || c1 || ' --c2 ' || c2 ||
                CASE WHEN wraps_origin THEN ' --circular' ELSE '' END || ' --seq ' || record_id AS command
            FROM (SELECT genome, record_id, CASE WHEN wraps THEN 0 ELSE cluster END AS cluster, count(*) AS hits,
                    bool_or(wraps) AS wraps_origin, {c1} AS c1, {c2} AS c2, any_value(contig_length) AS len
                  FROM merged GROUP BY 1, 2, 3)""",
        _cluster_extra(5000),
    )
    out["cluster_members"] = sql(
        "features",
        'SELECT genome, record_id, locus_tag, start, "end", cluster, false AS wraps_origin FROM numbered',
        _cluster_extra(5000),
    )
    wins = """
  anchors AS (SELECT DISTINCT locus_tag FROM features WHERE type = 'tRNA' AND gene IS NOT NULL),
  spans AS (SELECT genome, record_ord, record_id, locus_tag, min(start0) + 1 AS a, max("end") AS b
    FROM features SEMI JOIN anchors USING (locus_tag) WHERE {rep} GROUP BY 1, 2, 3, 4),
  firsts AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY genome, locus_tag ORDER BY record_ord) = 1),
  wins AS (SELECT genome, record_id, locus_tag AS anchor, greatest((a + b) // 2 - win, 1) AS w1, (a + b) // 2 + win AS w2
    FROM (SELECT *, {win} AS win FROM firsts))"""
    bnd = (
        "CASE WHEN start0 + 1 >= w1 AND \"end\" <= w2 THEN 'full' WHEN start0 + 1 < w1 AND \"end\" > w2"
        " THEN 'spans-window' WHEN start0 + 1 < w1 THEN 'clipped-left' ELSE 'clipped-right' END"
    )
    for name, win, cond in (
        (
            "context_window",
            "CASE WHEN b - a > 5000 AND (b - a) * 3 > 10000 THEN (b - a) * 3 ELSE 10000 END",
            'start0 + 1 <= w2 AND "end" >= w1',
        ),
        ("context_strict", "3000", "start0 + 1 >= w1 AND start0 + 1 <= w2"),
    ):
        out[name] = sql(
            "features",
            f"""SELECT f.genome, anchor, CASE WHEN locus_tag = anchor THEN 'yes' ELSE 'no' END AS "Is_Anchor",
                  {_VIEW.replace('record_id AS', 'f.record_id AS')}, {bnd} AS "Boundary"
                FROM features f JOIN wins w ON f.genome = w.genome AND f.record_id = w.record_id
                WHERE {_REPORTED} AND {cond}""",
            wins.format(rep=_REPORTED, win=win),
        )
    ident = (
        "coalesce({0}.locus_tag, {0}.protein_id, {0}.gene, 'UNANNOTATED_' || {0}.record_id || '_' || {0}.start0 || '_' || {0}.\"end\")"
    )
    out["mrna_contains_cds"] = sql(
        "genes",
        f"""SELECT m.genome, m.record_id, m.feat_ord, arg_min({ident.format('c')}, c.feat_ord) AS inner_id
            FROM genes m JOIN genes c ON m.genome = c.genome AND m.record_id = c.record_id
             AND m.start0 <= c.start0 AND c."end" <= m."end"
            WHERE m.type = 'mRNA' AND c.type = 'CDS' GROUP BY 1, 2, 3""",
    )
    out["feature_overlaps"] = sql(
        "features",
        """SELECT m.genome, m.record_id, m.locus_tag AS m_locus, m.start0 AS m_start, m."end" - 1 AS m_end,
             c.locus_tag AS c_locus, c.start0 AS c_start, c."end" - 1 AS c_end
           FROM features m JOIN features c ON m.genome = c.genome AND m.record_id = c.record_id
            AND m.start0 <= c."end" - 1 AND m."end" - 1 >= c.start0 WHERE m.type = 'mRNA' AND c.type = 'CDS'""",
    )
    return out


def _up(src, u, name="ups"):
    """CTE with ws, we and the oriented upstream sequence of every row of ``src``."""
    piece = "substr(seq, ws + 1, we - ws)"
    return f"""
  {name}_w AS (SELECT *, CASE WHEN strand = 1 THEN greatest(start0 - {u}, 0) ELSE "end" END AS ws,
      CASE WHEN strand = 1 THEN start0 ELSE least("end" + {u}, contig_length) END AS we FROM {src}),
  {name} AS MATERIALIZED (SELECT w.*, we - ws AS actual,
      CASE WHEN strand = 1 THEN {piece} ELSE {REVCOMP.format(piece)} END AS upstream
    FROM {name}_w w JOIN contigs c ON w.genome = c.genome AND w.record_id = c.record_id)"""


_IDENT = "coalesce(locus_tag, protein_id, gene, 'UNANNOTATED_' || record_id || '_' || start0 || '_' || \"end\")"
_KW = "(contains(lower(coalesce(product, '')), 'ring') OR contains(lower(coalesce(product, '')), 'bolt'))"
_REGION = 'genome, record_ord, record_id, locus, product, start0, "end", strand, actual, upstream'

_MODELS = f"""
  cds AS (SELECT genome, record_id, ident, arg_max(product, feat_ord) AS product, min(feat_ord) AS ford,
      arg_max(start0, feat_ord) AS cs, arg_max("end", feat_ord) AS ce
    FROM (SELECT *, {_IDENT} AS ident FROM genes WHERE type = 'CDS') WHERE {_KW} GROUP BY 1, 2, 3),
  mrna AS (SELECT *, {_IDENT} AS ident FROM genes WHERE type = 'mRNA'),
  placed AS (SELECT m.genome, m.record_id, m.feat_ord, arg_min(c.ident, c.ford) AS locus
    FROM mrna m JOIN cds c ON m.genome = c.genome AND m.record_id = c.record_id
     AND m.start0 <= c.cs AND c.ce <= m."end"
    WHERE starts_with(m.ident, 'UNANNOTATED_') AND starts_with(c.ident, 'UNANNOTATED_')
      AND NOT EXISTS (SELECT 1 FROM cds d WHERE d.genome = m.genome AND d.record_id = m.record_id AND d.ident = m.ident)
    GROUP BY 1, 2, 3),
  models AS (SELECT m.* EXCLUDE (product), c.product, c.ident AS locus FROM mrna m
      JOIN cds c ON m.genome = c.genome AND m.record_id = c.record_id AND m.ident = c.ident
    UNION ALL
    SELECT m.* EXCLUDE (product), c.product, p.locus FROM mrna m
      JOIN placed p ON m.genome = p.genome AND m.record_id = p.record_id AND m.feat_ord = p.feat_ord
      JOIN cds c ON c.genome = p.genome AND c.record_id = p.record_id AND c.ident = p.locus)"""


def upstream_sql() -> dict[str, str]:
    out = {}
    out["upstream_extract"] = sql(
        "contigs genes",
        "SELECT genome, record_id, feat_ord, ws, we, actual, actual < 150 AS truncated, upstream FROM ups",
        "\n  src AS (SELECT * FROM genes WHERE type = 'CDS')," + _up("src", 150),
    )
    out["organism_mode"] = sql(
        "genes",
        """SELECT genome, CASE WHEN arg_min(m, record_ord) THEN 'eukaryote' ELSE 'prokaryote' END AS mode,
             bool_or(m) AS eukaryotic
           FROM (SELECT genome, record_ord, bool_or(type = 'mRNA') AS m FROM genes GROUP BY 1, 2) GROUP BY 1""",
    )
    first = "QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord, feat_ord) = 1"
    out["keyword_promoters"] = sql(
        "contigs genes",
        f"SELECT {_REGION} FROM ups",
        f"""
  src AS (SELECT * REPLACE (coalesce(product, '') AS product), {_IDENT} AS locus FROM genes WHERE type = 'CDS' AND {_KW} {first}),"""
        + _up("src", 120),
    )
    merged = """
  tss AS (SELECT genome, record_ord, record_id, locus, any_value(product) AS product, 0 AS feat_ord,
      any_value(contig_length) AS contig_length,
      least(arg_min(start0, feat_ord), coalesce(min(start0) FILTER (strand = 1), 1000000000)) AS start0,
      greatest(arg_min("end", feat_ord), coalesce(max("end") FILTER (strand IS DISTINCT FROM 1), -1)) AS "end",
      arg_min_null(strand, feat_ord) AS strand
    FROM models GROUP BY 1, 2, 3, 4),
  src AS (SELECT * FROM tss QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord) = 1),"""
    out["tss_merge"] = sql("contigs genes", f"SELECT {_REGION} FROM ups", _MODELS + "," + merged + _up("src", 120))
    iso = """
  named AS (SELECT * EXCLUDE (locus), locus || '#' || coalesce(transcript_id, 'isoform' ||
      CAST(sum(CASE WHEN transcript_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY genome, record_id, locus
        ORDER BY feat_ord ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS locus FROM models),
  src AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord, feat_ord) = 1),"""
    out["isoform_promoters"] = sql("contigs genes", f"SELECT {_REGION} FROM ups", _MODELS + "," + iso + _up("src", 120))
    rank = "CASE type WHEN 'CDS' THEN 1 WHEN 'mRNA' THEN 2 WHEN 'tRNA' THEN 3 END"
    out["locus_promoters"] = sql(
        "contigs genes",
        'SELECT genome, record_id, locus, type, start0, "end", strand, other_coords, actual, upstream FROM ups',
        f"""
  wanted AS (SELECT DISTINCT locus_tag FROM genes WHERE contains(product, 'gear') AND locus_tag IS NOT NULL),
  cand AS (SELECT *, locus_tag AS locus, {rank} AS rk FROM genes SEMI JOIN wanted USING (locus_tag)),
  oth AS (SELECT genome, locus, record_ord, rk, count(DISTINCT (start0, "end", coalesce(strand, 0))) - 1 AS other_coords
    FROM cand GROUP BY 1, 2, 3, 4),
  best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord, rk, feat_ord) = 1),
  src AS (SELECT b.*, o.other_coords FROM best b JOIN oth o ON b.genome = o.genome AND b.locus = o.locus
      AND b.record_ord = o.record_ord AND b.rk = o.rk),"""
        + _up("src", 100),
    )
    return out


def _motif_hits(src, regex, width, idcols, n):
    """Hits of a fixed-width motif by trying every position on both strands."""
    rc = REVCOMP.format("s")

    def tried(strand, so, seq, at):
        names = idcols.replace("strand AS gstrand", "gstrand")
        return f"""(SELECT {names}, n, {at} AS pos0, w AS text, '{strand}' AS strand, {so} AS so
      FROM (SELECT {idcols}, {n} AS n, length(s) AS len, unnest(range(0, length(s) - {width} + 1)) AS i,
              unnest(list_transform(range(0, length(s) - {width} + 1), lambda i: substr(q, i + 1, {width}))) AS w
            FROM (SELECT *, {seq} AS q FROM {src} WHERE length(s) >= {width}))
      WHERE regexp_full_match(w, '{regex}'))"""

    return f"""
  hits AS MATERIALIZED (SELECT *, pos0 - n AS rel_pos FROM (
    SELECT * FROM {tried("+", 0, "s", "i")} UNION ALL SELECT * FROM {tried("-", 1, rc, f"len - i - {width}")}))"""


#: Far more frequent in the mapped texts than its letters make likely.
REPEATED_MOTIF = "TAGCGCAC"
_MOTIF_RE = "T[GT][GC]AC[AG]"


def _bg(src):
    return f"""
  counts AS (SELECT {", ".join(f"sum(length(s) - length(replace(s, '{b}', ''))) AS {b}" for b in "ACGT")} FROM {src}),
  bg AS (SELECT {", ".join(f"greatest({b} / CAST(A + C + G + T AS DOUBLE), 0.01::DOUBLE) AS {b}" for b in "ACGT")} FROM counts)"""


_P = "T * (G + T) * (C + G) * A * C * (A + G)"


def motif_sql() -> dict[str, str]:
    out = {}
    scan_of = lambda regex, width, p: (
        "\n  src AS (SELECT * FROM genes WHERE type = 'CDS'),"
        + _up("src", 150)
        + """,
  u AS (SELECT *, upper(upstream) AS s, coalesce(locus_tag, 'UNANNOTATED_' || record_id || '_' || start0 || '_' || "end") AS lt FROM ups),"""
        + _motif_hits("u", regex, width, "genome, record_id, feat_ord, lt, product, strand AS gstrand, ws, we", "actual")
        + ","
        + _bg("u")
        + f""",
  tot AS (SELECT sum(greatest(actual - {width} + 1, 0) * 2) AS windows FROM u),
  st AS (SELECT {p} AS p_value, windows, (SELECT count(*) FROM hits) AS hits,
           (SELECT count(DISTINCT feat_ord) FROM hits) AS genes FROM bg, tot)"""
    )
    scan = scan_of(_MOTIF_RE, 6, _P)
    agg = "string_agg({0}, ',' ORDER BY rel_pos, so, pos0)"
    table = lambda width: (
        f"""SELECT genome, lt AS "Locus_Tag", record_id AS "Contig", {_strand('gstrand')} AS "Gene_Strand",
              count(*) AS "Motif_Count", {agg.format("rel_pos || '(' || strand || ')'")} AS "Positions_Relative_to_TSS",
              {agg.format(f"CAST(CASE WHEN gstrand = 1 THEN ws + pos0 + 1 ELSE we - pos0 - {width} + 1 END AS VARCHAR)")} AS "Genomic_Start",
              {agg.format(f"CAST(CASE WHEN gstrand = 1 THEN ws + pos0 + {width} ELSE we - pos0 END AS VARCHAR)")} AS "Genomic_End",
              round(any_value(p_value), 6) AS "P_Value",
              round(any_value(least(p_value * windows / st.hits, 1.0)), 6) AS "Q_Value",
              {agg.format("text")} AS "Matched_Sequences", coalesce(product, 'hypothetical protein') AS "Product"
            FROM hits, st GROUP BY genome, lt, record_id, feat_ord, gstrand, product"""
    )
    out["motif_scan"] = sql("contigs genes", table(6), scan)
    letters = "T * A * G * C * G * C * A * C"
    out["regulon_alpha"] = sql("contigs genes", f'SELECT * FROM ({table(8)}) WHERE "Q_Value" <= 0.05', scan_of(REPEATED_MOTIF, 8, letters))
    out["scan_stats"] = sql(
        "contigs genes",
        f"""SELECT {", ".join(f"round(bg.{b}, 6) AS {b}" for b in "ACGT")}, CAST(windows AS BIGINT) AS windows, hits, genes,
              round(p_value, 6) AS p_value, round(least(p_value * windows / hits, 1.0), 6) AS q_value FROM st, bg""",
        scan,
    )
    fasta = "\n  fa AS (SELECT record_id AS id, seq AS s FROM contigs),"
    out["iupac_match"] = sql(
        "contigs",
        """SELECT id, n AS seq_len, rel_pos, text, strand, pos0 + 1 AS start, pos0 + 6 AS "end" FROM hits""",
        fasta + _motif_hits("fa", _MOTIF_RE, 6, "id", "length(s)"),
    )
    out["motif_merge"] = sql(
        "contigs",
        """SELECT id, strand, CAST(cl AS BIGINT) AS cluster, min(rel_pos) AS rel_pos, min(pos0) + 1 AS start,
             arg_min(text, rel_pos) AS text, count(*) AS merged
           FROM (SELECT *, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY id, strand ORDER BY pos0 ROWS UNBOUNDED PRECEDING) - 1 AS cl
                 FROM (SELECT *, coalesce(pos0 + 1 - lag(pos0 + 4) OVER (PARTITION BY id, strand ORDER BY pos0) > 0, true) AS opens
                       FROM hits)) GROUP BY 1, 2, 3""",
        fasta + _motif_hits("fa", "[AT][AT][AT][AT]", 4, "id", "length(s)"),
    )
    out["motif_whole_records"] = sql(
        "contigs",
        f"""SELECT id, count(*) AS "Motif_Count", min(rel_pos) AS "First_Position", round(any_value({_P}), 6) AS "P_Value",
              round(any_value(least({_P} * (SELECT sum(greatest(length(s) - 5, 0) * 2) FROM fa) / (SELECT count(*) FROM hits), 1.0)), 6) AS "Q_Value"
            FROM hits, bg GROUP BY id""",
        fasta + _motif_hits("fa", _MOTIF_RE, 6, "id", "length(s)") + "," + _bg("fa"),
    )
    out["promoter_motif"] = sql(
        "contigs genes",
        """SELECT record_id, feat_ord, rel_pos AS "Position_Relative_to_TSS", strand AS "Motif_Strand", text AS "Sequence" FROM hits""",
        "\n  src AS (SELECT * FROM genes WHERE type = 'CDS'),"
        + _up("src", 60)
        + ",\n  u AS (SELECT *, upstream AS s FROM ups),"
        + _motif_hits("u", "G[AT]TA[AG]", 5, "record_id, feat_ord", "length(s)"),
    )
    out["background_freq"] = sql(
        "contigs",
        f"""SELECT {", ".join(f"round({b}, 6) AS {b}" for b in "ACGT")} FROM bg""",
        "\n  fa AS (SELECT seq AS s FROM contigs)," + _bg("fa"),
    )
    out["window_total"] = sql(
        "contigs",
        "SELECT genome, CAST(sum(greatest(length(seq) - 5, 0) * 2) AS BIGINT) AS windows FROM contigs GROUP BY 1",
    )
    gc = "length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))"
    out["bh_qvalues"] = sql(
        "contigs",
        """SELECT record_id, round(p_value, 6) AS p_value, round(least(1.0, min(p_value * 200000.0::DOUBLE / rk) OVER (ORDER BY p_value RANGE
             BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value
           FROM (SELECT *, count(*) OVER (ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS rk FROM pv)""",
        f"\n  pv AS (SELECT record_id, ({gc}) / (length(seq) * 1000.0::DOUBLE + 1.0::DOUBLE) AS p_value FROM contigs)",
    )
    return out


def _kmers(src, k, extra=""):
    rc = REVCOMP.format("w")
    return f"""
  words AS (SELECT {extra}unnest(list_transform(range(0, length(seq) - {k} + 1), lambda i: substr(seq, i + 1, {k}))) AS w
      FROM {src} WHERE length(seq) >= {k}),
  canon AS (SELECT {extra}least(w, {rc}) AS kmer, n FROM (SELECT {extra}w, count(*) AS n FROM words GROUP BY ALL)
      WHERE NOT contains(w, 'N'))"""


def _entropy(col):
    terms = " + ".join(
        f"CASE WHEN contains({col}, '{b}') THEN ((length({col}) - length(replace({col}, '{b}', ''))) / CAST(length({col}) AS DOUBLE))"
        f" * log2((length({col}) - length(replace({col}, '{b}', ''))) / CAST(length({col}) AS DOUBLE)) ELSE 0 END"
        for b in "ACGTN"
    )
    return f"-({terms})"


def kmer_sql() -> dict[str, str]:
    out = {}
    out["kmer_counts"] = sql(
        "contigs", "SELECT kmer, CAST(sum(n) AS BIGINT) AS count FROM canon GROUP BY 1", _kmers("contigs", 6)
    )
    out["kmer_counts_entropy"] = sql(
        "contigs",
        f"SELECT genome, kmer, CAST(sum(n) AS BIGINT) AS count FROM canon WHERE {_entropy('kmer')} >= 1.5 GROUP BY 1, 2",
        _kmers("contigs", 5, "genome, "),
    )
    both = (
        "\n  sides AS (SELECT seq, starts_with(organism, 'de') AS tgt FROM contigs),"
        + _kmers("sides", 6, "tgt, ")
        + """,
  side AS (SELECT kmer, coalesce(sum(n) FILTER (tgt), 0) AS t, coalesce(sum(n) FILTER (NOT tgt), 0) AS r FROM canon GROUP BY 1),
  tot AS (SELECT sum(t) AS tw, sum(r) AS rw FROM side),
  cmp AS (SELECT *, log2(((t + 0.5::DOUBLE) / (tw + 1)) / ((r + 0.5::DOUBLE) / (rw + 1))) AS l2fc,
            CAST(t AS DOUBLE) / CAST(tw AS DOUBLE) * 1000.0::DOUBLE AS tc, CAST(r AS DOUBLE) / CAST(rw AS DOUBLE) * 1000.0::DOUBLE AS rc FROM side, tot)"""
    )
    out["kmer_l2fc"] = sql(
        "contigs",
        f"""SELECT kmer, {REVCOMP.format('kmer')} AS reverse_complement, CAST(t AS BIGINT) AS target_count,
              CAST(r AS BIGINT) AS regulator_count, round(tc, 6) AS target_cpk, round(rc, 6) AS regulator_cpk,
              round(abs(tc - rc), 6) AS cpk_diff, round(l2fc, 6) AS l2fc FROM cmp""",
        both,
    )
    out["kmer_topn"] = sql(
        "contigs", "SELECT kmer, round(l2fc, 6) AS l2fc FROM cmp ORDER BY round(abs(cmp.l2fc), 9) DESC, kmer LIMIT 20", both
    )
    out["revcomp"] = sql("contigs", f"SELECT record_id AS id, {REVCOMP.format('seq')} AS rc FROM contigs")
    out["seq_entropy"] = sql(
        "contigs",
        f"SELECT record_id AS id, round(CASE WHEN seq = '' THEN 0.0::DOUBLE ELSE {_entropy('seq')} END, 6) AS entropy FROM contigs",
    )
    rc = REVCOMP.format("'ACGTA'")
    out["kmer_distance"] = sql(
        "contigs",
        f"SELECT DISTINCT kmer, least(hamming(kmer, 'ACGTA'), hamming(kmer, {rc})) AS distance FROM canon",
        _kmers("contigs", 5),
    )
    aa = "ARNDCQEGHILKMFPSTWYV"
    kd = [18, -45, -35, -35, 25, -35, -35, -4, -32, 45, 38, -39, 19, 28, -16, -8, -7, -9, -13, 42]
    win = "+".join(f"({kd})[strpos('{aa}', substr(core, i + {d}, 1))]" for d in range(5))
    out["mature_core"] = sql(
        "proteins",
        """SELECT locus_tag, CASE WHEN gg = 0 THEN translation WHEN n <= 25 OR hit IS NULL THEN core
             WHEN substr(core, hit, 1) = 'P' THEN substr(core, 1, hit) ELSE substr(core, 1, hit - 1) END AS core FROM cut""",
        f"""
  c0 AS (SELECT locus_tag, translation, strpos(translation, 'GG') AS gg, substr(translation, strpos(translation, 'GG') + 2) AS core FROM proteins),
  c1 AS (SELECT *, length(core) AS n FROM c0),
  pos AS (SELECT locus_tag, min(i) AS hit FROM (SELECT locus_tag, core, gg, n, unnest(range(26, n + 1)) AS i FROM c1 WHERE gg > 0 AND n > 25)
    WHERE substr(core, i, 1) = 'P' OR (i + 4 <= n AND ({win}) < -25) GROUP BY 1),
  cut AS (SELECT c1.*, hit FROM c1 LEFT JOIN pos USING (locus_tag))""",
    )
    nuc = "length(s) > 0 AND NOT regexp_matches(s, '[EFILPQZJ]') AND length(translate(s, 'ACGTUN', '')) / CAST(length(s) AS DOUBLE) < 0.05"
    out["sequence_type"] = sql(
        "contigs proteins",
        f"""SELECT record_id, {nuc} AS nucleotide FROM (SELECT record_id, seq AS s FROM contigs
              UNION ALL SELECT locus_tag, translation FROM proteins)""",
    )
    out["wrap_fasta"] = sql(
        "contigs",
        """SELECT record_id AS id, array_to_string(list_transform(range(0, greatest((length(seq) + 59) // 60, 0)),
             lambda i: substr(seq, i * 60 + 1, 60)), chr(10)) AS wrapped FROM contigs""",
    )
    cols = ", ".join(
        f"round(count(*) FILTER (ch = '{b}') / CAST(count(*) AS DOUBLE), 6) AS p_{'gap' if b == '-' else b}" for b in "ACGT-"
    )
    ent = " + ".join(
        f"CASE WHEN {b} > 0 THEN {b} / CAST(acgt AS DOUBLE) * log2({b} / CAST(acgt AS DOUBLE)) ELSE 0 END" for b in "ACGT"
    )
    out["ppm_profile"] = sql(
        "contigs genes",
        f"""SELECT position, consensus, p_A, p_C, p_G, p_T, p_gap,
              round(CASE WHEN acgt > 0 THEN greatest(0.0, (2.0::DOUBLE + ({ent}) - 3.0::DOUBLE / (2 * ln(2.0::DOUBLE) * acgt)) * acgt / n) ELSE 0 END, 6) AS ic
            FROM prof""",
        "\n  src AS (SELECT * FROM genes WHERE type = 'CDS'),"
        + _up("src", 60)
        + f""",
  cells AS (SELECT i AS position, substr(upstream, i, 1) AS ch FROM (SELECT upstream, unnest(range(1, 61)) AS i FROM ups WHERE actual = 60)),
  prof AS (SELECT position, count(*) AS n, {", ".join(f"count(*) FILTER (ch = '{b}') AS {b}" for b in "ACGT")},
      count(*) FILTER (ch IN ('A', 'C', 'G', 'T')) AS acgt, {cols},
      CASE greatest(count(*) FILTER (ch = 'A'), count(*) FILTER (ch = 'C'), count(*) FILTER (ch = 'G'), count(*) FILTER (ch = 'T'), count(*) FILTER (ch = '-'))
        WHEN count(*) FILTER (ch = 'A') THEN 'A' WHEN count(*) FILTER (ch = 'C') THEN 'C' WHEN count(*) FILTER (ch = 'G') THEN 'G'
        WHEN count(*) FILTER (ch = 'T') THEN 'T' ELSE '-' END AS consensus
    FROM cells GROUP BY 1)""",
    )
    return out


def protein_sql() -> dict[str, str]:
    out = {}
    letters = "ACDEFGHIKLMNPQRSTVWY"
    terms = " + ".join(
        f"CASE WHEN contains(translation, '{b}') THEN ((length(translation) - length(replace(translation, '{b}', ''))) / CAST(length(translation) AS DOUBLE))"
        f" * log2((length(translation) - length(replace(translation, '{b}', ''))) / CAST(length(translation) AS DOUBLE)) ELSE 0 END"
        for b in letters
    )
    base = f"""
  prot AS (SELECT *, {_IDENT} AS ident, length(translation) AS n FROM genes WHERE type = 'CDS' AND length(translation) >= 10)"""
    out["longest_isoform"] = sql(
        "genes",
        f"""SELECT genome, ident AS locus, coalesce(product, 'Unknown product') AS product, n AS full_length, translation AS cmp_seq
            FROM prot WHERE -({terms}) >= 2.0
            QUALIFY row_number() OVER (PARTITION BY genome, ident ORDER BY n DESC, record_ord, feat_ord) = 1""",
        base,
    )
    out["all_isoforms"] = sql(
        "genes",
        """SELECT genome, locus, coalesce(product, 'Unknown product') AS product, n AS full_length, translation AS cmp_seq
           FROM (SELECT *, ident || '#' || coalesce(protein_id, 'isoform' || CAST(sum(CASE WHEN protein_id IS NULL THEN 1 ELSE 0 END)
                   OVER (PARTITION BY genome, ident ORDER BY record_ord, feat_ord ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS locus FROM prot)
           QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY n DESC, record_ord, feat_ord) = 1""",
        base,
    )
    kset = "(SELECT DISTINCT locus_tag, w FROM (SELECT locus_tag, unnest(list_transform(range(0, length(translation) - 3), lambda i: substr(translation, i + 1, 4))) AS w FROM {0} WHERE length(translation) >= 4))"
    out["kmer_jaccard"] = sql(
        "proteins probes",
        """SELECT q.locus_tag AS query_locus, r.locus_tag AS ref_locus
           FROM qk q JOIN rk r USING (w) JOIN qn ON q.locus_tag = qn.locus_tag JOIN rn ON r.locus_tag = rn.locus_tag
           GROUP BY 1, 2 HAVING count(*) / CAST(any_value(qn.n) + any_value(rn.n) - count(*) AS DOUBLE) >= pow(0.6::DOUBLE, 4) * 0.5::DOUBLE""",
        f"""
  qk AS MATERIALIZED {kset.format("probes")}, rk AS MATERIALIZED {kset.format("proteins")},
  qn AS (SELECT locus_tag, count(*) AS n FROM qk GROUP BY 1), rn AS (SELECT locus_tag, count(*) AS n FROM rk GROUP BY 1)""",
    )
    out["exact_match"] = sql(
        "proteins probes",
        """SELECT genome, locus_tag AS display_locus, record_id AS seq_id, product, n_targets, targets,
             '>' || locus_tag || ' | ' || record_id || ' | ' || product || ' | [Homolog_of_' || targets || ']' AS header
           FROM (SELECT p.genome, p.locus_tag, p.record_id, p.product, count(*) AS n_targets,
                   CASE WHEN count(*) > 3 THEN array_to_string(list(q.locus_tag ORDER BY q.record_ord)[1:3], ',') || ',_and_' || (count(*) - 3) || '_more'
                        ELSE string_agg(q.locus_tag, ',' ORDER BY q.record_ord) END AS targets
                 FROM proteins p JOIN probes q ON contains(p.translation, q.translation) WHERE q.translation <> '' GROUP BY 1, 2, 3, 4)""",
    )
    out["presence_matrix"] = sql(
        "proteins",
        """SELECT core AS "Query_Core", genome AS "Genome_File", locus_tag AS "Locus_Tag", product AS "Product", 'PRESENT' AS "Status"
           FROM hit UNION ALL
           SELECT core, genome, '-', '-', 'ABSENT' FROM (SELECT DISTINCT core, genome FROM proteins, cores) a
           WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.core = a.core AND hit.genome = a.genome)""",
        """
  cores AS (SELECT unnest(['ANDTHEREIN', 'INGTHETHE', 'LESSIRELLE', 'WWWWWWWW']) AS core),
  hit AS MATERIALIZED (SELECT core, p.* FROM proteins p JOIN cores ON contains(translation, core))""",
    )
    return out


def region_sql() -> dict[str, str]:
    out = {}
    ranges = """
  tags AS (SELECT genome, record_id, arg_min(locus_tag, feat_ord) AS ft, arg_max(locus_tag, feat_ord) AS lt
    FROM genes WHERE type = 'CDS' AND locus_tag IS NOT NULL GROUP BY 1, 2),
  idx AS (SELECT genome, record_id, locus_tag, arg_max(start0, feat_ord) + 1 AS s, arg_max("end", feat_ord) AS e, arg_max_null(strand, feat_ord) AS st
    FROM genes WHERE type = 'CDS' AND locus_tag IS NOT NULL GROUP BY 1, 2, 3),
  rr AS (SELECT t.genome, t.record_id, c.length, c.seq, c.topology = 'circular' AND (c.length - greatest(a.e, b.e) + least(a.s, b.s)) < (greatest(a.e, b.e) - least(a.s, b.s)) AS turn,
      least(a.s, b.s) AS lo, greatest(a.e, b.e) AS hi
    FROM tags t JOIN idx a ON a.genome = t.genome AND a.record_id = t.record_id AND a.locus_tag = t.ft
    JOIN idx b ON b.genome = t.genome AND b.record_id = t.record_id AND b.locus_tag = t.lt
    JOIN contigs c ON c.genome = t.genome AND c.record_id = t.record_id),
  reg AS (SELECT *, CASE WHEN turn THEN hi ELSE lo END AS c1, CASE WHEN turn THEN lo ELSE hi END AS c2 FROM rr)"""
    out["region_slice"] = sql(
        "contigs genes",
        """SELECT record_id, c1, c2, CASE WHEN c1 > c2 THEN 'wrap:' || c1 || '-end+start-' || c2 ELSE c1 || '-' || c2 END AS label,
             CASE WHEN c1 > c2 THEN substr(seq, c1, length - c1 + 1) || substr(seq, 1, c2) ELSE substr(seq, c1, c2 - c1 + 1) END AS sequence
           FROM reg""",
        ranges,
    )
    out["region_features"] = sql(
        "contigs genes",
        """SELECT r.record_id AS region_id, feat_ord, start0, start0 + 1 - c1 AS local_start0, "end" + 1 - c1 AS local_end
           FROM genes g JOIN reg r ON g.genome = r.genome AND g.record_id = r.record_id
           WHERE c1 <= c2 AND start0 + 1 >= c1 AND "end" <= c2
           UNION ALL
           SELECT r.record_id, feat_ord, start0, start0 + 1 - c1, "end" + 1 - c1 FROM genes g JOIN reg r ON g.genome = r.genome AND g.record_id = r.record_id
           WHERE c1 > c2 AND start0 + 1 >= c1 AND "end" <= length
           UNION ALL
           SELECT r.record_id, feat_ord, start0, start0 + length - c1 + 1, "end" + length - c1 + 1 FROM genes g
           JOIN reg r ON g.genome = r.genome AND g.record_id = r.record_id WHERE c1 > c2 AND "end" <= c2""",
        ranges,
    )
    body = 'substr(seq, start0 + 1, "end" - start0)'
    dna = f"CASE WHEN strand = -1 THEN {REVCOMP.format(body)} ELSE {body} END"
    out["gene_profile"] = sql(
        "contigs genes",
        f"""SELECT g.genome, g.record_id, coalesce(locus_tag, 'N/A') AS locus_tag, coalesce(gene, '') AS gene_name, type,
              coalesce(product, 'Unknown') AS product, start0 AS start, "end", {_strand()} AS strand,
              "end" - start0 AS length, {dna} AS sequence
            FROM genes g JOIN contigs c ON g.genome = c.genome AND g.record_id = c.record_id WHERE type = 'CDS'""",
    )
    gc = "(c.length - length(replace(replace(seq, 'G', ''), 'C', '')))"
    out["gc_density"] = sql(
        "contigs genes",
        f"""SELECT c.genome, c.record_id, c.length, round(CASE WHEN c.length > 0 THEN {gc} / CAST(c.length AS DOUBLE) * 100.0::DOUBLE ELSE 0 END, 6) AS gc_percent,
              coalesce(n, 0) AS genes, CAST(coalesce(bp, 0) AS BIGINT) AS coding_bp,
              round(CASE WHEN c.length > 0 THEN CAST(coalesce(bp, 0) AS DOUBLE) / c.length * 100.0::DOUBLE ELSE 0 END, 6) AS coding_density
            FROM contigs c LEFT JOIN (SELECT genome, record_id, count(*) AS n, sum("end" - start0) AS bp FROM genes WHERE type = 'CDS' GROUP BY 1, 2) g
              ON g.genome = c.genome AND g.record_id = c.record_id""",
    )
    loc = (
        "CASE WHEN i.s IS NOT NULL THEN ' [global_location=' || CASE WHEN i.st = -1 THEN 'complement(' || i.s || '..' || i.e || ')' ELSE i.s || '..' || i.e END"
        " ELSE ' [location=' || CASE WHEN g.strand = -1 THEN 'complement(' || (start0 + 1) || '..' || \"end\" || ')' ELSE (start0 + 1) || '..' || \"end\" END END || ']'"
    )
    joined = """FROM genes g JOIN contigs c ON g.genome = c.genome AND g.record_id = c.record_id
            LEFT JOIN idx i ON i.genome = g.genome AND i.record_id = g.record_id AND i.locus_tag = g.locus_tag
            WHERE type = 'CDS'"""
    trunc = 'length(translation) > 0 AND abs(length(translation) - ("end" - start0) // 3) > 1'
    out["protein_records"] = sql(
        "contigs genes",
        f"""SELECT g.record_id, feat_ord, translation, '>' || coalesce(protein_id, g.locus_tag, '?') || ' ' || coalesce(product, 'unknown product')
              || ' [' || organism || '] [locus_tag=' || coalesce(g.locus_tag, '?') || ']' || {loc}
              || CASE WHEN protein_id IS NOT NULL THEN ' [source=' || g.record_id || ']' ELSE '' END AS header
            {joined} AND length(translation) > 0 AND NOT ({trunc})""",
        ranges,
    )
    out["gene_dna_records"] = sql(
        "contigs genes",
        f"""SELECT g.record_id, feat_ord, {dna.replace('strand', 'g.strand')} AS dna, '>' || coalesce(g.locus_tag, '?') || ' ' || coalesce(product, 'unknown product')
              || ' [' || organism || ']' || {loc}
              || CASE WHEN protein_id IS NOT NULL THEN ' [protein_id=' || protein_id || ']' ELSE '' END AS header
            {joined} AND "end" > start0 AND NOT ({trunc})""",
        ranges,
    )
    return out


def search_sql() -> dict[str, str]:
    out = {}
    src = f"""
  lab AS (SELECT source, CAST(replace(source, 'src', '') AS BIGINT) AS file_ord, regexp_replace(source, '\\d$', '') AS stem FROM (SELECT DISTINCT source FROM documents)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY file_ord) AS n FROM lab),
  named AS (SELECT d.doc_id, file_ord, 'r' || (d.doc_id // 7) AS raw_id, lang, {_PROT} AS seq,
      CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END AS label FROM documents d JOIN rk ON rk.source = d.source),
  recs AS (SELECT *, label || '::' || raw_id AS id, row_number() OVER (ORDER BY file_ord, doc_id) AS seq_num FROM named)"""
    head = "WITH " + src.lstrip("\n")
    out["namespace_union"] = head + " SELECT id, raw_id, id || ' ' || lang AS description, length(seq) AS length FROM recs"
    out["id_collisions"] = head + " SELECT raw_id, count(DISTINCT label) AS sources FROM recs GROUP BY 1 HAVING count(DISTINCT label) > 1"
    out["sequence_list"] = head + " SELECT seq_num, id AS sequence_id, length(seq) AS length, lang AS description FROM recs"
    out["batching"] = head + """ SELECT (seq_num - 1) // 10 AS batch,
        CASE WHEN count(*) = 1 THEN min(id) ELSE arg_min(id, seq_num) || '..' || arg_max(id, seq_num) || ' (' || count(*) || ' seqs)' END AS label,
        count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS total_length, sum(length(seq)) > 100000 AS too_long FROM recs GROUP BY 1"""
    out["range_selection"] = sql(
        "probes",
        "SELECT * FROM (SELECT row_number() OVER (ORDER BY record_ord) AS seq_num, locus_tag AS id FROM probes) WHERE seq_num BETWEEN 6 AND 32",
    )
    out["picked_ids"] = sql(
        "probes",
        """SELECT pick_ord, seq_num, id FROM (SELECT row_number() OVER (ORDER BY record_ord) AS seq_num, locus_tag AS id FROM probes)
           JOIN (VALUES (0::BIGINT, 'Q31'), (1, 'Q5'), (2, 'Q7')) v(pick_ord, id) USING (id)""",
    )
    out["resume_antijoin"] = sql(
        "proteins",
        "SELECT locus_tag AS id, length(translation) AS length FROM proteins WHERE record_ord NOT IN (SELECT doc_id FROM labels)",
    )
    out["species_match"] = """
      SELECT 'genome_' || l_suppkey || '.fna' AS "Query", 'genome_' || l_partkey || '.fna' AS "Reference", round(ani, 6) AS "ANI",
        m AS "Matched", t AS "Total", round(af, 6) AS "AF", ani >= 95 AND af >= 60 AS "Is_Match"
      FROM (SELECT *, CASE WHEN t > 0 THEN m / CAST(t AS DOUBLE) * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS af
            FROM (SELECT *, CAST(printf('%.2f', 90 + l_discount * 100) AS DOUBLE) AS ani, CAST(floor(l_quantity) AS BIGINT) AS m,
                    CAST(l_linenumber * 9 - 9 AS BIGINT) AS t FROM lineitem))"""
    num = "feat_ord % 100"
    colour = (
        f"CASE WHEN {num} BETWEEN 46 AND 48 THEN '#a5d6a7' WHEN {num} BETWEEN 49 AND 51 THEN '#ef5350' WHEN {num} BETWEEN 52 AND 64 THEN '#90caf9'"
        f" WHEN {num} BETWEEN 65 AND 67 THEN '#ef5350' WHEN {num} BETWEEN 68 AND 72 THEN '#ce93d8' WHEN {num} BETWEEN 73 AND 74 THEN '#ffb74d' ELSE '#cccccc' END"
    )
    role = (
        f"CASE WHEN {num} BETWEEN 46 AND 48 THEN 'Flanking/accessory' WHEN {num} BETWEEN 49 AND 51 THEN 'Immunity/regulation' WHEN {num} BETWEEN 52 AND 64 THEN 'Core biosynthetic'"
        f" WHEN {num} BETWEEN 65 AND 67 THEN 'Immunity/regulation' WHEN {num} BETWEEN 68 AND 72 THEN 'Ancestral lactobin' WHEN {num} BETWEEN 73 AND 74 THEN 'Transport' END"
    )
    out["locus_map"] = sql(
        "genes",
        f"""SELECT record_id, 'G_' || ({num}) AS locus_tag, start0 - min(start0) OVER (PARTITION BY record_id) AS start,
              "end" - min(start0) OVER (PARTITION BY record_id) AS "end", strand, {colour} AS color, {role} AS role
            FROM genes WHERE strand IS NOT NULL""",
    )
    return out


def graph_sql() -> dict[str, str]:
    """Greedy k-mer clusters as the smallest rank that reaches a word over rising edges."""
    both = (
        "\n  sides AS (SELECT seq, starts_with(organism, 'de') AS tgt FROM contigs),"
        + _kmers("sides", 5, "tgt, ")
        + """,
  side AS (SELECT kmer, coalesce(sum(n) FILTER (tgt), 0) AS t, coalesce(sum(n) FILTER (NOT tgt), 0) AS r FROM canon GROUP BY 1),
  tot AS (SELECT sum(t) AS tw, sum(r) AS rw FROM side),
  ranked AS MATERIALIZED (SELECT kmer, row_number() OVER (ORDER BY round(abs(log2(((t + 0.5::DOUBLE) / (tw + 1)) / ((r + 0.5::DOUBLE) / (rw + 1)))), 9) DESC, kmer) AS rank
    FROM side, tot),
  near AS MATERIALIZED (SELECT a.rank AS lo, b.rank AS hi FROM ranked a JOIN ranked b ON a.rank < b.rank
    WHERE hamming(a.kmer, b.kmer) <= 1 OR hamming(a.kmer, """
        + REVCOMP.format("b.kmer")
        + """) <= 1),
  reach(root, node) AS (SELECT rank, rank FROM ranked UNION SELECT root, hi FROM reach JOIN near ON node = lo),
  lab AS (SELECT node, min(root) AS label FROM reach GROUP BY 1)"""
    )
    text = sql(
        "contigs",
        "SELECT kmer, rank, dense_rank() OVER (ORDER BY label) AS cluster_id FROM ranked JOIN lab ON rank = node",
        both,
    )
    return {"kmer_clusters": text.replace("WITH ", "WITH RECURSIVE ", 1)}


def loci_sql() -> dict[str, str]:
    """Promoters of given loci: every genome of the test tables is read as a eukaryote or not by its first record."""
    modes = f"""
  tagged AS (SELECT *, {_IDENT} AS ident FROM genes),
  wanted AS (SELECT DISTINCT ident FROM tagged WHERE contains(product, 'gear')),
  mode AS (SELECT genome, arg_min(m, record_ord) AS euk FROM (SELECT genome, record_ord, bool_or(type = 'mRNA') AS m FROM genes GROUP BY 1, 2) GROUP BY 1),
  cds AS (SELECT genome, record_id, ident, arg_max(coalesce(product, 'Unknown product'), feat_ord) AS product, min(feat_ord) AS ford,
      arg_max(start0, feat_ord) AS cs, arg_max("end", feat_ord) AS ce
    FROM tagged SEMI JOIN wanted USING (ident) WHERE type = 'CDS' GROUP BY 1, 2, 3),
  names AS (SELECT genome, record_id, ident, product FROM cds UNION ALL
    SELECT DISTINCT genome, record_id, ident, 'Unknown product' FROM tagged m SEMI JOIN wanted USING (ident) WHERE type = 'mRNA'
      AND NOT EXISTS (SELECT 1 FROM cds c WHERE c.genome = m.genome AND c.record_id = m.record_id AND c.ident = m.ident)),
  mrna AS (SELECT * FROM tagged WHERE type = 'mRNA'),
  placed AS (SELECT m.genome, m.record_id, m.feat_ord, arg_min(c.ident, c.ford) AS locus
    FROM mrna m JOIN cds c ON m.genome = c.genome AND m.record_id = c.record_id AND m.start0 <= c.cs AND c.ce <= m."end"
    WHERE starts_with(m.ident, 'UNANNOTATED_') AND starts_with(c.ident, 'UNANNOTATED_')
      AND NOT EXISTS (SELECT 1 FROM names d WHERE d.genome = m.genome AND d.record_id = m.record_id AND d.ident = m.ident)
    GROUP BY 1, 2, 3),
  models AS (SELECT m.* EXCLUDE (product), c.product, c.ident AS locus FROM mrna m
      JOIN names c ON m.genome = c.genome AND m.record_id = c.record_id AND m.ident = c.ident
    UNION ALL
    SELECT m.* EXCLUDE (product), c.product, p.locus FROM mrna m
      JOIN placed p ON m.genome = p.genome AND m.record_id = p.record_id AND m.feat_ord = p.feat_ord
      JOIN cds c ON c.genome = p.genome AND c.record_id = p.record_id AND c.ident = p.locus),
  tss AS (SELECT genome, record_ord, record_id, locus, any_value(product) AS product, any_value(contig_length) AS contig_length,
      least(arg_min(start0, feat_ord), coalesce(min(start0) FILTER (strand = 1), 1000000000)) AS start0,
      greatest(arg_min("end", feat_ord), coalesce(max("end") FILTER (strand IS DISTINCT FROM 1), -1)) AS "end",
      arg_min_null(strand, feat_ord) AS strand
    FROM models JOIN mode USING (genome) WHERE euk GROUP BY 1, 2, 3, 4),
  src AS (SELECT * FROM tss QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord) = 1
    UNION ALL BY NAME
    SELECT genome, record_ord, record_id, ident AS locus, coalesce(product, 'Unknown product') AS product, contig_length, start0, "end", strand
    FROM tagged SEMI JOIN wanted USING (ident) JOIN mode USING (genome) WHERE type = 'CDS' AND NOT euk
    QUALIFY row_number() OVER (PARTITION BY genome, ident ORDER BY record_ord, feat_ord) = 1),"""
    return {"promoters_by_loci": sql("contigs genes", f"SELECT {_REGION} FROM ups", modes + _up("src", 100))}


def record_sql() -> dict[str, str]:
    ident = _IDENT
    return {
        "record_meta": sql("contigs", "SELECT genome, record_id, length, topology FROM contigs"),
        "missing_loci": sql(
            "genes",
            f"""SELECT DISTINCT {ident} AS locus FROM genes WHERE contains(product, 'gear') AND {ident} NOT IN
                (SELECT {ident} FROM genes WHERE type = 'CDS' AND strand IS NOT NULL)""",
        ),
        "genome_labels": sql(
            "contigs",
            """SELECT genome, record_id, CASE WHEN strain IS NOT NULL AND NOT contains(org, strain) THEN org || ' ' || strain ELSE org END AS label
               FROM (SELECT genome, record_id,
                       CASE WHEN record_ord % 3 <> 0 THEN 'Genus ' || organism WHEN record_ord % 2 = 0 THEN NULL ELSE organism END AS org0,
                       coalesce(org0, genome) AS org,
                       CASE WHEN org0 IS NULL THEN NULL WHEN record_ord % 4 = 0 THEN 'S' || (record_ord % 10)
                            WHEN record_ord % 5 = 0 THEN genome END AS strain
                     FROM contigs)""",
        ),
    }


def _local_alignments(score: str, gap_open: int, gap_more: int) -> str:
    """Tables of the pairs ``placed`` (id, a, b and their letters ac, bc), filled a row a step, and
    the ways back, walked a cell a step: ``ends`` and ``walked``. ``score``: of letters i + 1 and j."""
    low = -100000000
    pair = f"(h[j + 1] + {score})"
    f = f"greatest(h[j + 2] + {gap_open}, f[j + 1] + {gap_more})"
    e = f"(CASE WHEN j = 0 THEN {low} ELSE greatest(s.h[j + 1] + {gap_open}, s.e + {gap_more}) END)"
    cell = f"greatest(0, {pair}, {f}, {e})"
    bits = (
        f"((({cell}) = 0)::INT + 2 * (({cell}) = {pair})::INT + 4 * (({cell}) = {f})::INT + 8 * ({f} = h[j + 2] + {gap_open})::INT"
        f" + 16 * ({e} = s.h[j + 1] + {gap_open})::INT)"
    )
    return f"""
  filled AS (
    SELECT id, -1 AS i, list_transform(range(len(bc) + 1), lambda x: 0::INT) AS h, list_transform(range(len(bc)), lambda x: {low}::INT) AS f,
      0::INT AS best, -1 AS bi, -1 AS bj, []::INT[] AS bits FROM placed
    UNION ALL
    SELECT id, i + 1, t.h, t.f, greatest(best, list_max(t.h)), CASE WHEN list_max(t.h) > best THEN i + 1 ELSE bi END,
      CASE WHEN list_max(t.h) > best THEN list_position(t.h, list_max(t.h)) - 2 ELSE bj END, t.bits
    FROM (
      SELECT id, i, best, bi, bj, list_reduce(range(len(bc)), lambda s, j: {{
          'h': s.h || [{cell}::INT], 'f': s.f || [({f})::INT], 'e': ({e})::INT, 'bits': s.bits || [{bits}::INT]}},
        {{'h': [0::INT], 'f': []::INT[], 'e': {low}::INT, 'bits': []::INT[]}}) AS t
      FROM filled JOIN placed USING (id) WHERE i + 1 < len(ac))),
  tables AS MATERIALIZED (SELECT id, i, bits FROM filled),
  ends AS MATERIALIZED (SELECT id, best, bi, bj FROM filled JOIN placed USING (id) WHERE i + 1 = len(ac)),
  walked AS (
    SELECT id, best, bi AS i, bj AS j, 0 AS st, 0 AS same, 0 AS other, 0 AS ga, 0 AS gb, false AS done FROM ends WHERE best > 0
    UNION ALL
    SELECT id, best,
      CASE WHEN st = 1 OR (st = 0 AND bit & 3 = 2) THEN i - 1 ELSE i END, CASE WHEN st = 2 OR (st = 0 AND bit & 3 = 2) THEN j - 1 ELSE j END,
      CASE WHEN st = 0 THEN CASE WHEN bit & 3 <> 0 THEN 0 WHEN bit & 4 <> 0 THEN 1 ELSE 2 END
           WHEN st = 1 THEN CASE WHEN bit & 8 <> 0 THEN 0 ELSE 1 END ELSE CASE WHEN bit & 16 <> 0 THEN 0 ELSE 2 END END,
      same + (st = 0 AND bit & 3 = 2 AND x = y)::INT, other + (st = 0 AND bit & 3 = 2 AND x <> y)::INT, ga + (st = 2)::INT, gb + (st = 1)::INT,
      st = 0 AND (bit & 1 = 1 OR (bit & 2 = 2 AND (i = 0 OR j = 0)))
    FROM (SELECT w.*, t.bits[j + 1] AS bit, ac[w.i + 1] AS x, bc[j + 1] AS y FROM walked w JOIN tables t ON t.id = w.id AND t.i = w.i JOIN placed p ON p.id = w.id WHERE NOT done))"""


def alignment_sql() -> dict[str, str]:
    """Local alignments of short proteins at the default thresholds."""
    scores = ", ".join(str(int(x)) for x in protein_scheme().matrix.reshape(-1))
    code = f"list_transform(string_split({{0}}, ''), lambda x: (strpos('{RESIDUES}', x) - 1)::INT)"
    word = f"translate(w, '{ALPHABET}', '{TO_PROTEIN}')"

    def peptides(name, source, genome, number):
        return f"""
  {name} AS MATERIALIZED (
    SELECT genome, w AS locus, 'peptide of ' || genome AS product, min((n, pos)) AS ord, {word} AS s
    FROM (SELECT {genome} AS genome, {number} AS n, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w,
            generate_subscripts(string_split_regex(lower(text), '[^a-z]+'), 1) AS pos FROM {source})
    WHERE length(w) >= {PEPTIDE} GROUP BY genome, w)"""

    words = "(SELECT DISTINCT s, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) AS k FROM {0})"
    floor = 0.30**4 * 0.5
    base = f"""WITH RECURSIVE{peptides("qp", "benchmark", "'bench'", "item_id")},{peptides("rp", "documents", "source", "doc_id")},
  qk AS {words.format("qp")}, rk AS {words.format("rp")},
  qn AS (SELECT s, count(*) AS n FROM qk GROUP BY s), rn AS (SELECT s, count(*) AS n FROM rk GROUP BY s),
  near AS (
    SELECT q, r FROM (SELECT qk.s AS q, rk.s AS r, count(*) AS n FROM qk JOIN rk USING (k) GROUP BY 1, 2) x
    JOIN qn ON qn.s = q JOIN rn ON rn.s = r WHERE x.n / (qn.n + rn.n - x.n) >= {floor!r}),
  -- the shorter of a pair makes the rows, of equal ones the one searched with
  placed AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY a, b) AS id, a, b, {code.format("a")} AS ac, {code.format("b")} AS bc, [{scores}] AS mat
    FROM (SELECT DISTINCT a, b FROM (
      SELECT CASE WHEN length(q) <= length(r) THEN q ELSE r END AS a, CASE WHEN length(q) <= length(r) THEN r ELSE q END AS b FROM near
      UNION ALL SELECT r, q FROM near WHERE length(q) = length(r)))),
  {_local_alignments("mat[ac[i + 2] * 24 + bc[j + 1] + 1]", -11, -1).strip()},
  found AS MATERIALIZED (
    SELECT a, b, best AS score, same + other + ga + gb AS len, same, other AS mismatches, (same + other + gb) / length(a) AS a_cov, (same + other + ga) / length(b) AS b_cov,
      list_sum(list_transform(ac, lambda x: mat[x * 25 + 1])) AS top
    FROM walked JOIN placed USING (id) WHERE done),
  passed AS MATERIALIZED (SELECT *, same / len AS identity FROM found WHERE score >= top * 0.30 * 0.40 AND same / len >= 0.30),
  -- searched with q or, on the way back, with r
  forward AS MATERIALIZED (
    SELECT q, r, identity, len, mismatches, CASE WHEN length(q) <= length(r) THEN a_cov ELSE b_cov END AS q_cov, CASE WHEN length(q) <= length(r) THEN b_cov ELSE a_cov END AS r_cov
    FROM near JOIN passed ON a = CASE WHEN length(q) <= length(r) THEN q ELSE r END AND b = CASE WHEN length(q) <= length(r) THEN r ELSE q END),
  backward AS MATERIALIZED (
    SELECT q, r, identity, a_cov, b_cov FROM near JOIN passed ON a = CASE WHEN length(r) <= length(q) THEN r ELSE q END AND b = CASE WHEN length(r) <= length(q) THEN q ELSE r END),
  hits AS MATERIALIZED (
    SELECT qp.locus AS query_locus, qp.product AS query_product, qp.ord AS q_ord, rp.locus AS ref_locus, rp.product AS ref_product, rp.genome AS ref_file, rp.ord AS r_ord,
      q AS query_sequence, r AS ref_sequence, mismatches, identity, greatest(q_cov, r_cov) AS coverage, least(q_cov, r_cov) AS worse, len AS alignment_length,
      length(q) AS query_length, length(r) AS ref_length
    FROM forward JOIN qp ON qp.s = q JOIN rp ON rp.s = r)"""
    report = (
        "query_locus, query_product, ref_locus, ref_product, ref_file, query_sequence, ref_sequence, mismatches,"
        " round(identity * 100, 2) AS identity_pct, round({0} * 100, 2) AS coverage_pct, alignment_length, query_length, ref_length"
    )
    best = "SELECT * FROM hits WHERE coverage >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_locus, ref_file ORDER BY identity DESC, r_ord) = 1"
    back = """SELECT rp.genome AS ref_file, rp.locus AS ref_locus, qp.locus AS query_locus FROM backward JOIN qp ON qp.s = q JOIN rp ON rp.s = r
              WHERE greatest(a_cov, b_cov) >= 0.5 QUALIFY row_number() OVER (PARTITION BY rp.genome, rp.locus ORDER BY identity DESC, qp.ord) = 1"""
    return {
        "peptide_homologs": f"{base} SELECT {report.format('coverage')} FROM hits WHERE coverage >= 0.5",
        "peptide_homologs_max": f"{base} SELECT {report.format('worse')} FROM hits WHERE worse >= 0.5 AND query_length / ref_length BETWEEN 0.5 AND 2.0",
        "peptide_best_hits": f"{base} SELECT query_locus, ref_file, ref_locus, round(identity, 6) AS identity, alignment_length, mismatches, round(coverage, 6) AS coverage FROM ({best})",
        "peptide_rbh": f"{base} SELECT {report.format('coverage')} FROM ({best}) JOIN ({back}) USING (ref_file, ref_locus, query_locus)",
        "peptide_summary": f"""{base} SELECT (SELECT count(*) FROM qp) AS queries, (SELECT min(length(s)) FROM qp) AS min_length, (SELECT max(length(s)) FROM qp) AS max_length,
            count(*) AS hits, count(DISTINCT query_locus) AS queries_with_hits, round(count(DISTINCT query_locus) / (SELECT count(*) FROM qp) * 100, 6) AS pct_with_hits,
            round(min(identity), 6) AS min_identity, round(max(identity), 6) AS max_identity, round(min(coverage), 6) AS min_coverage, round(max(coverage), 6) AS max_coverage
            FROM hits WHERE coverage >= 0.5""",
    }


def em_sql() -> dict[str, str]:
    """Motif discovery step by step: words scored, weighed and added up in SQL."""
    word, out = "TATAAT", {}
    rc = REVCOMP.format("word")
    letter = lambda b: f"CASE {b} WHEN 'A' THEN bg.A WHEN 'C' THEN bg.C WHEN 'G' THEN bg.G ELSE bg.T END"

    def base(w):
        return f"""
  u AS MATERIALIZED (SELECT record_ord AS ord, record_id AS id, seq AS s FROM contigs WHERE length >= {w}),{_bg("u")},
  win AS (
    SELECT ord, i, word FROM (
      SELECT ord, unnest(range(1, length(s) - {w} + 2)) AS i, unnest(list_transform(range(1, length(s) - {w} + 2), lambda i: substr(s, i, {w}))) AS word FROM u)
    WHERE regexp_full_match(word, '[ACGT]+')),
  ws AS MATERIALIZED (SELECT ord, word, count(*) AS n FROM win GROUP BY 1, 2),
  words AS MATERIALIZED (SELECT word, {rc} AS rc, n FROM (SELECT word, sum(n) AS n FROM ws GROUP BY 1))"""

    def scores(k, w):
        one = f"(SELECT x.word, sum(ln(p / ({letter('base')}))) AS f FROM (SELECT word, {{0}} AS t, unnest(range(1, {w + 1})) AS k FROM words) x JOIN pwm{k} ON position = k AND base = t[k], bg GROUP BY 1)"
        return f"""
  sc{k} AS MATERIALIZED (SELECT a.word, a.f, b.f AS r, greatest(a.f, b.f) AS best FROM {one.format("word")} a JOIN {one.format("rc")} b ON a.word = b.word),
  tot{k} AS MATERIALIZED (SELECT ord, sum(n * exp(best)) AS total FROM ws JOIN sc{k} USING (word) GROUP BY 1 HAVING max(best) > 0)"""

    seed = f"SELECT unnest(range(1, 7)) AS position, base, unnest(list_transform(range(1, 7), lambda k: CASE WHEN substr('{word}', k, 1) = base THEN 1.1::DOUBLE ELSE 0.1 END / 1.4)) AS p FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(base)"
    first = base(6) + f",\n  pwm0 AS MATERIALIZED ({seed})," + scores(0, 6)
    match = " + ".join(f"ln((CASE WHEN {{0}}[{k}] = z.word[{k}] THEN 1.1::DOUBLE ELSE 0.1 END / 1.4) / ({letter(f'{{0}}[{k}]')}))" for k in (1, 2, 3))
    out["em_seeds"] = sql(
        "contigs",
        f"""SELECT seed AS word, round(sum(CASE WHEN top > 0 THEN ln(total) ELSE 0 END), 3) AS score
            FROM (SELECT seed, ord, max(best) AS top, sum(n * exp(best)) AS total
                  FROM ws JOIN (SELECT z.word AS seed, y.word, greatest({match.format("y.word")}, {match.format("y.rc")}) AS best FROM words z, words y, bg) USING (word)
                  GROUP BY 1, 2) GROUP BY 1""",
        base(3),
    )
    out["em_step"] = sql(
        "contigs",
        "SELECT position, base, round(p, 6) AS p, (SELECT round(sum(ln(total)), 3) FROM tot1) AS log_likelihood FROM pwm1",
        first + """,
  share AS (SELECT word, sum(n * exp(best) / total) AS x FROM ws JOIN sc0 USING (word) JOIN tot0 USING (ord) GROUP BY 1),
  read AS (SELECT x, CASE WHEN r > f + 1e-9 THEN rc ELSE word END AS w FROM share JOIN sc0 USING (word) JOIN words USING (word)),
  grown AS (
    SELECT position, base, 0.1 + coalesce(c, 0) AS c FROM (SELECT position, base FROM pwm0)
    LEFT JOIN (SELECT k AS position, w[k] AS base, sum(x) AS c FROM (SELECT *, unnest(range(1, 7)) AS k FROM read) GROUP BY 1, 2) USING (position, base)),
  pwm1 AS MATERIALIZED (SELECT position, base, c / sum(c) OVER (PARTITION BY position) AS p FROM grown),""" + scores(1, 6),
    )
    instance = first + """,
  spots AS (SELECT ord, i, word, f, r, best FROM win JOIN sc0 USING (word)),
  inst AS MATERIALIZED (
    SELECT a.ord, min(i) AS i FROM spots a JOIN (SELECT ord, max(best) AS m FROM spots GROUP BY 1) x ON a.ord = x.ord AND best >= m - 1e-9 GROUP BY 1),
  chosen AS MATERIALIZED (SELECT spots.* FROM spots JOIN inst USING (ord, i))"""
    out["em_instances"] = sql(
        "contigs",
        """SELECT ord, id, i AS position, CASE WHEN r > f + 1e-9 THEN '-' ELSE '+' END AS strand, word AS sequence, round(best, 6) AS score, best <= 0 AS low_confidence
           FROM chosen JOIN u USING (ord)""",
        instance,
    )
    out["em_mask"] = sql(
        "contigs",
        """SELECT id, md5(CASE WHEN best > 0 THEN substr(s, 1, i - 1) || repeat('N', 6) || substr(s, i + 6) ELSE s END) AS masked
           FROM u LEFT JOIN chosen USING (ord)""",
        instance,
    )
    return out


def redundancy_sql() -> dict[str, str]:
    """Complete linkage, a region a step: the first cluster all of whose members are alike."""
    near = _local_alignments("CASE WHEN ac[i + 2] = bc[j + 1] THEN 1 ELSE -1 END", -2, -1).strip()
    body = """SELECT genome, record_id, feat_ord, own AS representative,
                CASE WHEN own <> feat_ord THEN round(CASE WHEN first = own THEN 1.0 ELSE identity END, 6) END AS identity,
                CASE WHEN own <> feat_ord THEN round(CASE WHEN first = own THEN 1.0 ELSE coverage END, 6) END AS coverage
              FROM (SELECT g.*, first, coalesce(rep, first) AS own FROM rows g JOIN firsts USING (s) LEFT JOIN reps ON node = first) x
              LEFT JOIN alike ON lo = own AND hi = first"""
    # 18 letters or more, of which one in twenty may be in error: ten in a row are shared
    extra = "\n  src AS (SELECT * FROM genes WHERE type = 'CDS')," + _up("src", 30) + f""",
  rows AS MATERIALIZED (SELECT genome, record_id, feat_ord, upstream AS s FROM ups WHERE actual >= 20),
  firsts AS MATERIALIZED (SELECT s, min(feat_ord) AS first FROM rows GROUP BY s),
  tens AS (SELECT DISTINCT first, s, unnest(list_transform(range(1, length(s) - 8), lambda i: substr(s, i, 10))) AS k FROM firsts),
  placed AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY lo, hi) AS id, *, string_split(a, '') AS ac, string_split(b, '') AS bc
    FROM (SELECT DISTINCT x.first AS lo, y.first AS hi, CASE WHEN length(x.s) <= length(y.s) THEN x.s ELSE y.s END AS a, CASE WHEN length(x.s) <= length(y.s) THEN y.s ELSE x.s END AS b
          FROM tens x JOIN tens y ON x.k = y.k AND x.first < y.first)),
  {near},
  alike AS MATERIALIZED (
    SELECT lo, hi, same / (same + other + ga + gb) AS identity, least((same + other + gb) / length(a), (same + other + ga) / length(b)) AS coverage
    FROM walked JOIN placed USING (id) WHERE done AND same / (same + other + ga + gb) >= 0.95 AND least((same + other + gb) / length(a), (same + other + ga) / length(b)) >= 0.90),
  nodes AS MATERIALIZED (
    SELECT node, row_number() OVER (ORDER BY node) AS k, coalesce(near, []) AS near
    FROM (SELECT lo AS node FROM alike UNION SELECT hi FROM alike) LEFT JOIN (SELECT hi AS node, list(lo) AS near FROM alike GROUP BY hi) USING (node)),
  grown AS (
    SELECT 0::BIGINT AS k, []::STRUCT(rep BIGINT, members BIGINT[])[] AS c
    UNION ALL
    SELECT k, CASE WHEN fit = 0 THEN c || [{{'rep': node, 'members': [node]}}]
                   ELSE list_transform(c, lambda x, i: CASE WHEN i = fit THEN {{'rep': x.rep, 'members': x.members || [node]}} ELSE x END) END
    FROM (SELECT n.k, c, node, coalesce(list_position(list_transform(c, lambda x: list_has_all(near, x.members)), true), 0) AS fit
          FROM grown g JOIN nodes n ON n.k = g.k + 1)),
  reps AS MATERIALIZED (
    SELECT unnest(x.members) AS node, x.rep FROM (SELECT unnest(c) AS x FROM grown WHERE k = (SELECT count(*) FROM nodes)))"""
    return {"promoter_dedup_short": sql("contigs genes", body, extra).replace("WITH ", "WITH RECURSIVE ", 1)}


def plain_sql() -> dict[str, str]:
    """Modes of operators whose main mode is registered elsewhere."""
    out = {}
    rc = REVCOMP.format("fwd")
    out["spliced_parts"] = sql(
        "contigs genes",
        f"""SELECT record_id, feat_ord, CASE WHEN strand = -1 THEN {rc} ELSE fwd END AS dna
            FROM (SELECT g.record_id, g.feat_ord, g.strand,
                    CASE g.feat_ord % 3
                      WHEN 0 THEN substr(seq, start0 + 1, n // 3) || substr(seq, "end" - n // 3 + 1, n // 3)
                      WHEN 1 THEN substr(seq, start0 + 1, n // 5) || substr(seq, start0 + 2 * (n // 5) + 1, n // 5) || substr(seq, "end" - n // 5 + 1, n // 5)
                      ELSE substr(seq, start0 + 1, n) END AS fwd
                  FROM (SELECT *, "end" - start0 AS n FROM genes WHERE type = 'CDS' AND "end" - start0 >= 5) g
                  JOIN contigs c ON c.genome = g.genome AND c.record_id = g.record_id)""",
    )
    out["first_record"] = sql(
        "features", "SELECT genome, gene AS locus_tag, arg_min(record_id, record_ord) AS record_id FROM features WHERE gene IS NOT NULL GROUP BY 1, 2"
    )
    out["picked_contig"] = sql("contigs", "SELECT genome, record_id, length FROM contigs WHERE contains(record_id, 'doc0')")
    mature = kmer_sql()["mature_core"].replace(CTE["proteins"], CTE["probes"]).replace("FROM proteins)", "FROM probes)")
    shown = """CASE WHEN n > 3 THEN array_to_string(thrice[1:3], ',') || ',_and_' || (n - 3) || '_more' ELSE array_to_string(thrice[1:n], ',') END"""
    head = "'>' || display_locus || ' | ' || seq_id || ' | ' || product || ' | [Homolog_of_' || targets || ']'"
    out["exact_match_mature"] = sql(
        "proteins probes",
        f"""SELECT genome, display_locus, seq_id, product, n AS n_targets, targets, {head} AS header
            FROM (SELECT genome, locus_tag AS display_locus, record_id AS seq_id, product, n, {shown} AS targets
              FROM (SELECT p.genome, p.locus_tag, p.record_id, p.product, count(*) AS n, list(q.locus_tag ORDER BY q.record_ord) AS thrice
                    FROM proteins p JOIN (SELECT c.locus_tag, c.core, q.record_ord FROM cores c JOIN probes q USING (locus_tag) WHERE core <> '') q
                      ON contains(p.translation, q.core) GROUP BY 1, 2, 3, 4))""",
        f"\n  cores AS ({mature})",
    )
    out["exact_variants"] = sql(
        "proteins probes",
        f"""SELECT genome, display_locus, seq_id, product, n AS n_targets, targets, {head} AS header
            FROM (SELECT genome, CASE WHEN variants = 1 THEN locus ELSE locus || '_isoform' || number END AS display_locus, seq_id, product, n, {shown} AS targets
              FROM (SELECT *, len(names) * copies AS n, names || names || names AS thrice, count(*) OVER (PARTITION BY genome, locus) AS variants,
                      row_number() OVER (PARTITION BY genome, locus ORDER BY place) AS number
                    FROM (SELECT genome, 'L' || (record_ord % 7) AS locus, s, min(record_ord) AS place, arg_min(record_id, record_ord) AS seq_id,
                            arg_min(product, record_ord) AS product, count(*) AS copies, any_value(names) AS names
                          FROM proteins JOIN held ON translation = s GROUP BY 1, 2, 3)))""",
        """
  held AS (SELECT p.s, list(q.locus_tag ORDER BY q.record_ord) AS names FROM (SELECT DISTINCT translation AS s FROM proteins) p
    JOIN probes q ON contains(p.s, q.translation) AND q.translation <> '' GROUP BY 1)""",
    )
    out["upstream_any_type"] = sql(
        "contigs genes",
        'SELECT genome, record_id, locus, type, start0, "end", strand, other_coords, actual, upstream FROM ups',
        """
  wanted AS (SELECT DISTINCT locus_tag FROM genes WHERE contains(product, 'gear') AND locus_tag IS NOT NULL),
  cand AS (SELECT *, locus_tag AS locus FROM genes SEMI JOIN wanted USING (locus_tag)),
  oth AS (SELECT genome, locus, record_ord, count(DISTINCT (record_id, type, start0, "end", coalesce(strand, 0))) - 1 AS other_coords FROM cand GROUP BY 1, 2, 3),
  best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY genome, locus ORDER BY record_ord, feat_ord) = 1),
  src AS (SELECT b.*, o.other_coords FROM best b JOIN oth o ON b.genome = o.genome AND b.locus = o.locus AND b.record_ord = o.record_ord WHERE strand IN (1, -1)),"""
        + _up("src", 100),
    )
    folded = annotation_sql()["isoform_collapse"]
    out["locus_listing"] = folded[: folded.rindex("SELECT genome, record_ord, feat_ord")] + (
        "SELECT *, count(*) OVER () AS total_loci, CAST(sum(collapsed) OVER () AS BIGINT) AS total_folded FROM ("
        + folded[folded.rindex("SELECT genome, record_ord, feat_ord") :] + f") ORDER BY genome, record_ord, feat_ord LIMIT {PREVIEW}"
    )
    out["tsv_sink"] = annotation_sql()["product_counts"]
    out["ani_file"] = search_sql()["species_match"]
    out["locus_files"] = sql(
        "genes",
        """SELECT 'list' AS file, locus_tag AS locus FROM (SELECT DISTINCT locus_tag FROM genes WHERE locus_tag IS NOT NULL)
           UNION ALL SELECT 'done', locus_tag FROM (SELECT DISTINCT locus_tag FROM genes WHERE locus_tag IS NOT NULL AND feat_ord % 2 = 0)""",
    )
    out["gene_mode"] = sql(
        "contigs genes",
        """SELECT r.genome, r.record_id || ':' || tag AS region_id, c1, c2,
             count(*) FILTER (f.type = 'CDS') AS cds, count(*) AS features, md5(any_value(substr(seq, c1, c2 - c1 + 1))) AS sequence
           FROM reg r JOIN contigs c ON c.genome = r.genome AND c.record_id = r.record_id
           JOIN genes f ON f.genome = r.genome AND f.record_id = r.record_id AND f.start0 + 1 >= c1 AND f."end" <= c2 GROUP BY 1, 2, 3, 4""",
        """
  wanted AS (SELECT DISTINCT locus_tag AS tag FROM genes WHERE type = 'CDS' AND contains(product, 'gear') AND locus_tag IS NOT NULL),
  home AS (SELECT genome, locus_tag AS tag, arg_min(record_id, record_ord) AS record_id FROM genes JOIN wanted ON locus_tag = tag GROUP BY 1, 2),
  reg AS MATERIALIZED (
    SELECT h.genome, h.record_id, tag, arg_max(start0, feat_ord) + 1 AS c1, arg_max("end", feat_ord) AS c2
    FROM home h JOIN genes g ON g.genome = h.genome AND g.record_id = h.record_id AND g.locus_tag = tag AND type = 'CDS' GROUP BY 1, 2, 3)""",
    )
    slices = region_sql()["region_slice"]
    wrapped = "array_to_string(list_transform(range(0, (length(sequence) + 59) // 60), lambda i: substr(sequence, i * 60 + 1, 60)), chr(10))"
    out["region_fasta"] = slices[: slices.rindex("SELECT record_id, c1, c2")] + (
        f"""SELECT s.record_id AS region_id, '>' || s.record_id || ':' || label || ' ' || format('{{:,}}', length(sequence)) || ' bp ' || organism || ' genomic region' || chr(10) || {wrapped} AS value
            FROM ({slices[slices.rindex("SELECT record_id, c1, c2") :]}) s JOIN contigs c ON c.record_id = s.record_id"""
    )
    return out


def file_sql() -> dict[str, str]:
    records = sql("proteins", "SELECT locus_tag AS id, locus_tag || ' ' || product AS description, translation AS seq FROM proteins WHERE translation <> ''")
    genbank = sql(
        "contigs genes",
        """SELECT record_id || ':1-' || length AS record_id, -1 AS feat_ord, organism, 'linear' AS topology, md5(seq) AS value, 0 AS start0, length AS "end", 0 AS strand
           FROM contigs WHERE length > 0
           UNION ALL
           SELECT record_id || ':1-' || contig_length, row_number() OVER (PARTITION BY record_id ORDER BY start0, feat_ord) - 1, locus_tag, type,
             concat_ws('|', coalesce(gene, '-'), coalesce(product, '-'), coalesce(protein_id, '-')), start0, "end", coalesce(strand, 1)
           FROM genes WHERE "end" > start0""",
    )
    words = sql(
        "contigs",
        """SELECT word, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4))) AS word FROM contigs)
           WHERE regexp_full_match(word, '[ACGT]+') GROUP BY word""",
    )
    hits = sql(
        "contigs", """SELECT id, strand, pos0 + 1 AS start, pos0 + 6 AS "end", text FROM hits""",
        "\n  fa AS (SELECT record_id AS id, seq AS s FROM contigs)," + _motif_hits("fa", _MOTIF_RE, 6, "id", "length(s)"),
    )
    return {
        "fasta_records": records, "fasta_source": records, "genbank_records": genbank, "genbank_source": genbank,
        "kmers_lateral": words, "motif_hits_lateral": hits,
    }


def all_sql() -> dict[str, str]:
    return {
        **annotation_sql(), **interval_sql(), **upstream_sql(), **motif_sql(), **kmer_sql(),
        **protein_sql(), **region_sql(), **search_sql(), **graph_sql(), **loci_sql(), **record_sql(), **file_sql(), **alignment_sql(), **plain_sql(), **em_sql(), **redundancy_sql(),
    }
