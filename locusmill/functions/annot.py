"""Functions on the flattened feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LIST_QUALIFIERS, SCALAR_QUALIFIERS
from .seq import blank_to_null

# Qualifying words that do not change what a product is.
NOISE_WORDS = (
    "putative", "probable", "predicted", "possible", "potential",
    "uncharacterized", "candidate",
)


def flatten(features: DataFrame) -> DataFrame:
    """Promote the qualifiers the operators read to top-level columns.

    Do this once at ingest and write Parquet: pruning and pushdown then work per
    qualifier, which they cannot do inside a map.
    """
    q = F.col("qualifiers")
    scalars = [F.get(F.try_element_at(q, F.lit(k)), F.lit(0)).alias(k) for k in SCALAR_QUALIFIERS]
    lists = [F.try_element_at(q, F.lit(k)).alias(k) for k in LIST_QUALIFIERS]
    base = [c for c in features.columns if c != "qualifiers"]
    return features.select(*base, *scalars, *lists)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def scalar(df: DataFrame, name: str) -> Column:
    """A qualifier column, NULL where the table does not carry it."""
    return F.col(name) if has_column(df, name) else F.lit(None).cast("string")


def listed(df: DataFrame, name: str) -> Column:
    return F.col(name) if has_column(df, name) else F.lit(None).cast("array<string>")


def strand_symbol(c="strand") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.eqNullSafe(F.lit(1)), "+").otherwise("-")


def _joined(df, name) -> Column:
    return blank_to_null(F.array_join(listed(df, name), " "))


def annotation_text(df: DataFrame, with_go: bool = True) -> Column:
    """Lower-case text searched by keyword; empty qualifiers leave no gap.

    ``with_go=False`` is the narrower variant without ncRNA class and GO terms.
    """
    if with_go:
        parts = [
            blank_to_null(scalar(df, "product")),
            blank_to_null(scalar(df, "ncRNA_class")),
            blank_to_null(scalar(df, "gene_kind")),
            _joined(df, "gene_functions"),
            _joined(df, "sec_met_domain"),
            blank_to_null(scalar(df, "note")),
            _joined(df, "GO_function"),
            _joined(df, "GO_process"),
        ]
    else:
        parts = [
            blank_to_null(scalar(df, "product")),
            blank_to_null(scalar(df, "gene_kind")),
            _joined(df, "gene_functions"),
            _joined(df, "sec_met_domain"),
            blank_to_null(scalar(df, "note")),
        ]
    return F.lower(F.concat_ws(" ", *parts))


def product_gene_note_text(df: DataFrame) -> Column:
    """Variant that keeps its separators when a qualifier is missing."""
    return F.lower(
        F.concat(
            F.coalesce(scalar(df, "product"), F.lit("")), F.lit(" "),
            F.coalesce(scalar(df, "gene"), F.lit("")), F.lit(" "),
            F.coalesce(scalar(df, "note"), F.lit("")),
        )
    )


def display_product(df: DataFrame, with_ncrna: bool = True) -> Column:
    product = blank_to_null(scalar(df, "product"))
    ncrna = blank_to_null(scalar(df, "ncRNA_class"))
    kind = blank_to_null(scalar(df, "gene_kind"))
    func = blank_to_null(
        F.replace(
            F.replace(F.get(listed(df, "gene_functions"), F.lit(0)), F.lit("\n"), F.lit(" ")),
            F.lit("  "), F.lit(" "),
        )
    )
    out = F.when(product.isNotNull(), product)
    if with_ncrna:
        out = out.when(ncrna.isNotNull(), F.concat(F.lit("ncRNA ("), ncrna, F.lit(")")))
    return (
        out.when(kind.isNotNull() & func.isNotNull(), F.concat(kind, F.lit(" ["), func, F.lit("]")))
        .when(kind.isNotNull(), F.concat(kind, F.lit(" (antiSMASH)")))
        .when(func.isNotNull(), func)
        .otherwise("(no annotation)")
    )


def role(df: DataFrame) -> Column:
    """Gene kind with the text behind the last bracket of its first function."""
    kind = F.coalesce(scalar(df, "gene_kind"), F.lit("unassigned"))
    first = F.get(listed(df, "gene_functions"), F.lit(0))
    pattern = r"\)\s*([^)]+)$"
    detail = F.when(first.rlike(pattern), F.regexp_extract(first, pattern, 1)).otherwise(first)
    detail = blank_to_null(F.regexp_replace(detail, r"(?U)^\s+|\s+$", ""))
    return F.when(detail.isNull(), kind).otherwise(F.concat(kind, F.lit(" ["), detail, F.lit("]")))


def row_marker(role_col) -> Column:
    text = F.lower(F.col(role_col) if isinstance(role_col, str) else role_col)
    return (
        F.when(F.contains(text, F.lit("biosynthetic")), ">>> ")
        .when(F.contains(text, F.lit("transport")), " -> ")
        .otherwise("    ")
    )


def identifier(df: DataFrame) -> Column:
    """locus_tag, else protein_id, else gene, else a name built from the place."""
    return F.coalesce(
        blank_to_null(scalar(df, "locus_tag")),
        blank_to_null(scalar(df, "protein_id")),
        blank_to_null(scalar(df, "gene")),
        F.concat_ws("_", F.lit("UNANNOTATED"), "record_id", "start0", "end"),
    )


def normalize_product(c) -> Column:
    """Bring spellings of one product together.

    Lower-case, drop one trailing bracket of each kind, turn punctuation into
    spaces, drop noise words; a name with nothing left keeps its lower-case form.
    """
    col = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_replace(F.lower(col), r"(?U)^\s+|\s+$", "")
    name = F.regexp_replace(raw, r"(?U)\s*\[.*?\]\s*$", "")
    name = F.regexp_replace(name, r"(?U)\s*\(.*?\)\s*$", "")
    name = F.regexp_replace(name, r"[-_/,;]+", " ")
    words = F.filter(
        F.split(name, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*NOISE_WORDS)
    )
    return F.coalesce(blank_to_null(F.array_join(words, " ")), raw)


def query_matches(text: Column, query: str, regex: bool = False, whole_word: bool = False) -> Column:
    """Keyword test: substring, whole word or regular expression, never case-sensitive."""
    if regex:
        return text.rlike("(?iu)" + query)
    if whole_word:
        quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return text.rlike("(?iuU)\\b" + quoted + "\\b")
    return F.contains(F.lower(text), F.lit(query.lower()))


def boundary_status(start1, end, c1, c2) -> Column:
    """How a 1-based feature lies to a window: full, spans-window or clipped."""
    s, e, a, b = [F.col(x) if isinstance(x, str) else x for x in (start1, end, c1, c2)]
    return (
        F.when((s >= a) & (e <= b), "full")
        .when((s < a) & (e > b), "spans-window")
        .when(s < a, "clipped-left")
        .otherwise("clipped-right")
    )


def location_string(start1, end, strand) -> Column:
    s, e, st = [F.col(x) if isinstance(x, str) else x for x in (start1, end, strand)]
    coords = F.concat(s.cast("string"), F.lit(".."), e.cast("string"))
    return F.when(
        st.eqNullSafe(F.lit(-1)), F.concat(F.lit("complement("), coords, F.lit(")"))
    ).otherwise(coords)


def safe_header(c) -> Column:
    """Replace everything but letters, digits, underscore and dash."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, r"(?U)[^\w\-]", "_")


def target_list(names) -> Column:
    """Up to three probe names, then how many more."""
    clean = F.transform(
        F.col(names) if isinstance(names, str) else names,
        lambda t: F.translate(F.translate(t, " /", "__"), ",", ""),
    )
    more = F.size(clean) - 3
    return F.when(
        more > 0,
        F.concat(
            F.array_join(F.slice(clean, 1, 3), ","),
            F.lit(",_and_"), more.cast("string"), F.lit("_more"),
        ),
    ).otherwise(F.array_join(clean, ","))
