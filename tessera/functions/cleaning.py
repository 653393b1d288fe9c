"""Scalar cleaning as Column functions: all of them compile to JVM expressions but nfkc()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


def clean_sequence(c: Column) -> Column:
    """Upper case, letters only; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")


def strip_parens(c: Column) -> Column:
    """Without parenthesised parts; an unbalanced parenthesis stays."""
    return F.regexp_replace(c, r"\s*\(.*?\)", "")


@F.pandas_udf(StringType())
def nfkc(s):  # no JVM expression normalises Unicode
    """NFKC, typographic dashes and Greek letters spelled in ASCII, white space collapsed."""
    import re
    import unicodedata

    table = str.maketrans({"–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "μ": "mu", "®": ""})
    return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).translate(table)).strip())


def normalize_na(c: Column) -> Column:
    """Trimmed; words for missing values become null."""
    return F.when(F.lower(F.trim(c)).isin(V.NULL_WORDS), F.lit(None)).otherwise(F.trim(c))


def link_key(c: Column) -> Column:
    """Lower case, underscores and white space runs as one space."""
    return F.regexp_replace(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))), r"\s+", " ")


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def relax_suffix(c: Column) -> Column:
    """norm_name without a final ' cell', ' cells', ' cell line' or ' cell lines'."""
    return F.trim(F.regexp_replace(norm_name(c), r"\s+(cell lines?|cells?)\.?$", ""))


def sanitize_xml(c: Column) -> Column:
    """Only characters that XML 1.0 allows."""
    return F.regexp_replace(c, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def curie_to_iri(c: Column) -> Column:
    return F.concat(F.lit(V.OBO), F.replace(c, F.lit(":"), F.lit("_")))


def local_name(c: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def uri_fragment(c: Column) -> Column:
    """After the last '#', else after the last '/', else all; a separator at the end does not count."""
    pick = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(pick("#([^#]+)$"), pick("/([^/]+)$"), c)


def canon_search(c: Column, prefix: str) -> Column:
    """PREFIX:digits found anywhere, or null."""
    digits = F.nullif(F.regexp_extract(c, rf"(?i){prefix}[:_]?(\d+)", 1), F.lit(""))
    return F.concat(F.lit(prefix.upper() + ":"), digits)


def canon_replaced(c: Column, prefix: str) -> Column:
    """As canon_search, with underscores as colons first and the colon required."""
    digits = F.nullif(F.regexp_extract(F.replace(c, F.lit("_"), F.lit(":")), rf"(?i){prefix}:(\d+)", 1), F.lit(""))
    return F.concat(F.lit(prefix.upper() + ":"), digits)


def canon_anchored(c: Column) -> Column:
    """A whole CLO_n or CHEBI_n becomes a CURIE; other text stays."""
    return F.regexp_replace(F.trim(c), r"^(CLO|CHEBI)_(\d+)$", "$1:$2")


def canon_or_null(c: Column) -> Column:
    """As canon_anchored in any case; NIL becomes null."""
    t = F.trim(c)
    fixed = F.upper(F.regexp_replace(t, r"(?i)^(CLO|CHEBI)[_:](\d+)$", "$1:$2"))
    return F.when(F.upper(t).isin("NIL", ""), F.lit(None)).when(t.rlike(r"(?i)^(CLO|CHEBI)[_:]\d+$"), fixed).otherwise(t)


def canon_or_nil(c: Column, prefix: str) -> Column:
    """canon_replaced; null becomes NIL."""
    return F.coalesce(canon_replaced(c, prefix), F.lit("NIL"))


def first_candidate(c: Column) -> Column:
    """The first of a list split by semicolons, trimmed; null if blank."""
    return F.nullif(F.trim(F.split(c, ";")[0]), F.lit(""))


def candidates(c: Column, prefix: str) -> Column:
    """Valid ids of a list split by semicolons, in order."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: canon_search(x, prefix)), lambda x: x.isNotNull())


def all_ids(c: Column, prefix: str) -> Column:
    """All distinct ids in free text, sorted."""
    found = F.regexp_extract_all(c, F.lit(rf"(?i){prefix}[:_]?(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.concat(F.lit(prefix.upper() + ":"), d))))


def scheme_repair(c: Column) -> Column:
    """https:/x as https://x."""
    return F.regexp_replace(c, r"^(https?):/+", "$1://")


def is_safe_iri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^<>\s\"]+$")


def search_url(c: Column, base: str = "https://example.org/search?q=") -> Column:
    return F.concat(F.lit(base), F.url_encode(c))


def publication_iri(pubmed: Column, patent: Column) -> Column:
    """The PubMed IRI unless the number is missing or zero; else the patent without spaces; else null."""
    number = pubmed.try_cast("double").try_cast("bigint")
    ok = pubmed.isNotNull() & ~F.trim(pubmed).isin("", "0", "0.0") & number.isNotNull()
    other = F.nullif(F.replace(F.trim(patent), F.lit(" "), F.lit("")), F.lit(""))
    return F.when(ok, F.concat(F.lit("http://identifiers.org/pubmed:"), number.cast("string"))).otherwise(other)


def occurrences(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, letters, ""))


def net_charge(c: Column) -> Column:
    return (occurrences(c, "KR") - occurrences(c, "DE")).cast("long")


def max_residue_fraction(c: Column, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Share of the most frequent letter; 0 for an empty text."""
    most = F.greatest(*[occurrences(c, a) for a in alphabet])
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(most / F.length(c))


def padded_id(prefix: str, n: Column) -> Column:
    """prefix and at least four digits; more digits are kept."""
    return F.concat(F.lit(prefix), F.format_string("%04d", n))


def coalesce_choice(first: Column, other: Column) -> Column:
    """first unless it is blank."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), other)


def zip_with_default(ids: Column, labels: Column) -> Column:
    """Pairs by position; an id without a label gets its local name."""
    i, n = F.transform(F.split(ids, ","), lambda v: F.trim(v)), F.transform(F.split(labels, ","), lambda v: F.trim(v))
    return F.transform(i, lambda x, k: F.struct(x.alias("id"), F.coalesce(F.get(n, k), local_name(x)).alias("label")))


def is_valid(c: Column, alphabet: str = V.STANDARD_ALPHABET) -> Column:
    return c.rlike(f"^[{alphabet}]+$")


def is_blank(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(V.BLANK_WORDS)


def contains_text(c: Column, term: str) -> Column:
    return F.contains(F.lower(c), F.lit(term.lower()))


def any_keyword(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


# -- JSON replies


def json_repaired(c: Column) -> Column:
    """Without code fences; a reply that was cut off is closed after its last whole entry."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^```(?:json)?\s*$", ""))
    body = F.regexp_extract(bare, r"(?s)^(.*\}),", 1)
    return F.when(F.json_object_keys(bare).isNotNull(), bare).when(body != "", F.concat(body, F.lit("}"))).otherwise(F.lit("{}"))


REPLY = "map<string,struct<curie:string,label:string>>"


def json_reply(c: Column) -> Column:
    """The entries of a possibly damaged reply."""
    return F.coalesce(F.from_json(json_repaired(c), REPLY), F.from_json(F.lit("{}"), REPLY))
