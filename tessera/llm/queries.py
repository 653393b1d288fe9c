"""Queries of the subpackage: one opN_<name> per operator, and the pipeline."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .fingerprints import op3_fingerprints
from .html_extract import op10_html
from .jaccard_join import op5_jaccard
from .licenses import op4_licenses
from .pii import op7_pii
from .quality import op2_quality
from .sentencepiece_codec import op9_sentencepiece
from .sharding import op8_sharding
from .warc import op6_warc


def pipeline(spark, sf_dir: str):
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict:
    return {
        "pipeline": pipeline,
        "op10_html": op10_html,
        "op1_decontamination": op1_decontamination,
        "op2_quality": op2_quality,
        "op3_fingerprints": op3_fingerprints,
        "op4_licenses": op4_licenses,
        "op5_jaccard": op5_jaccard,
        "op6_warc": op6_warc,
        "op7_pii": op7_pii,
        "op8_sharding": op8_sharding,
        "op9_sentencepiece": op9_sentencepiece,
    }


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN = r"regexp_extract_all(regexp_replace(lower(text), '[\p{P}\p{Z}]+', ' ', 'g'), '" + WORDS + "')"
GRAMS = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
OP1_SQL = f"""
with item as (select item_id, w, least(5, len(w)) k from (select item_id, {PLAIN} w from benchmark) where len(w) > 0),
doc as (select doc_id, k, w from (select doc_id, {PLAIN} w from documents), (select distinct k from item) where len(w) >= k),
i as (select distinct item_id, k, {GRAMS} g from item),
d as (select distinct doc_id, k, {GRAMS} g from doc),
n as (select item_id, count(*) n_item from i group by item_id),
c as (select doc_id, item_id, count(*) n_shared from d join i using (k, g) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from c join n using (item_id) where n_shared >= 0.75 * n_item"""

OP5_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) b from r group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) as component_id from w left join n on w.doc_id = n.doc_id left join m on w.doc_id = m.a"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_jaccard": OP5_SQL}
