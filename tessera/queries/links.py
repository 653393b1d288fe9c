"""Entity linking over the part names and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import linking as L
from ..operators import metrics as M
from ..plans.graph_build import dense_number
from ..plans.runtime import table as T
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: lexicon of the distinct part names: label, a synonym ("the <name>"), and "<name> cell" for every third
TERMS_SQL = """
terms as (select row_number() over (order by p_name) as ord, p_name from (select distinct p_name from part)),
lex as (select 'T:' || ord as curie, case when ord % 3 = 0 then p_name || ' cell' else p_name end as label, ord, 'the ' || p_name as synonym from terms)"""
LEX_SQL = (
    TERMS_SQL
    + """,
keys as (select lower(label) as key, curie, label, 'exact_pref' as match_type, 0 tier, -ord place from lex
  union all select lower(synonym), curie, label, 'exact_syn', 1, ord from lex
  union all select regexp_replace(lower(label), ' cell$', ''), curie, label, 'exact_pref', 2, ord from lex where label like '% cell'),
lexicon as (select key, curie, label, match_type from keys qualify row_number() over (partition by key order by tier, place) = 1)"""
)
MENTIONS_SQL = """
mentions as (select distinct case p_partkey % 6 when 0 then upper(p_name) when 1 then p_name || '_10nM_treatment' when 2 then 'The  ' || p_name when 3 then 'zzz ' || p_name when 4 then ' ' else p_name || ' cell' end as mention from part)"""
KEYED_SQL = r"""
keyed as (select mention, regexp_replace(lower(replace(mention, '_', ' ')), '\s+', ' ', 'g') as key from mentions),
parts as (select mention, string_split(key, ' ') w from keyed),
tries as (select mention, array_to_string(w[1:len(w) - i], ' ') as key, i as stage from (select mention, w, unnest(range(0, len(w))) i from parts)),
all_tries as (select mention, key, 2 * stage as stage from tries union all select mention, key || ' cell', 2 * stage + 1 from tries),
hit as (select b.mention, b.stage, l.curie, l.label, l.match_type from all_tries b join lexicon l on b.key = l.key qualify row_number() over (partition by b.mention order by stage) = 1),
exact as (select m.mention, case when trim(m.mention) = '' then null else curie end curie, case when trim(m.mention) = '' then null else label end as label,
  case when curie is null or trim(m.mention) = '' then 0.0::double else 1.0::double end as score, case when curie is null or trim(m.mention) = '' then 'NIL' when stage < 2 then match_type else 'prefix_truncated' end match_type, 'exact' as method
  from mentions m left join hit h on m.mention = h.mention)"""


def lex_parts(s, d):
    """terms and synonyms: the distinct names, numbered in order."""
    terms = dense_number(T(s, d, "part").select("p_name").distinct(), ["p_name"], "ord").withColumn("ord", F.col("ord").cast("long"))
    base = terms.select("ord", F.concat(F.lit("T:"), "ord").alias("curie"), F.when(F.col("ord") % 3 == 0, F.concat("p_name", F.lit(" cell"))).otherwise(F.col("p_name")).alias("label"), "p_name")
    return base.select("ord", "curie", "label"), base.select("ord", "curie", "label", F.concat(F.lit("the "), "p_name").alias("synonym"))


def lexicon(s, d):
    return L.lexicon(*lex_parts(s, d))


def mentions(s, d):
    return T(s, d, "part").select(F.expr("case p_partkey % 6 when 0 then upper(p_name) when 1 then p_name || '_10nM_treatment' when 2 then 'The  ' || p_name when 3 then 'zzz ' || p_name when 4 then ' ' else p_name || ' cell' end").alias("mention")).distinct()


COLS = ["mention", "curie", "label", "score", "match_type", "method"]
add("lexicon_build", lexicon, f"with {LEX_SQL} select * from lexicon")
add("exact_link", lambda s, d: L.link_exact(mentions(s, d), lexicon(s, d)).select(*COLS), f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select * from exact")
add("suffix_link", lambda s, d: L.link_exact(mentions(s, d), lexicon(s, d)).filter("match_type like 'exact%' and label like '% cell'").select("mention", "curie"), f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select mention, curie from exact where match_type like 'exact%' and label like '% cell'")
add("prefix_link", lambda s, d: L.link_exact(mentions(s, d), lexicon(s, d)).filter("match_type = 'prefix_truncated'").select("mention", "curie"), f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select mention, curie from exact where match_type = 'prefix_truncated'")
add("blank_guard", lambda s, d: L.link_exact(mentions(s, d), lexicon(s, d)).groupBy("match_type").agg(F.count("*").alias("n")), f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select match_type, count(*) n from exact group by match_type")


def typos(s, d):
    """One letter more, or one letter other, than a name; and the words swapped."""
    names = T(s, d, "part").select("p_name").distinct()
    return names.select(F.explode(F.array(F.concat("p_name", F.lit("s")), F.concat(F.lit("q"), F.expr("substring(p_name, 2)")), F.concat_ws(" ", F.reverse(F.split("p_name", " "))))).alias("mention")).distinct()


TYPO_SQL = "typos as (select distinct unnest([p_name || 's', 'q' || substr(p_name, 2), array_to_string(list_reverse(string_split(p_name, ' ')), ' ')]) mention from part)"
add("fuzzy_link", lambda s, d: L.link_fuzzy(typos(s, d), lexicon(s, d)).select("mention", "curie", "score", "match_type"))
add(
    "fuzzy_blocking",
    lambda s, d: L.fuzzy_blocks(typos(s, d).select(C.link_key(F.col("mention")).alias("key")), lexicon(s, d)).select("a", "b").distinct(),
    f"with {LEX_SQL}, {TYPO_SQL}, x as (select distinct array_to_string(list_sort(string_split(lower(mention), ' ')), ' ') a from typos), y as (select distinct array_to_string(list_sort(string_split(key, ' ')), ' ') b from lexicon) select a, b from x, y where abs(length(a) - length(b)) <= floor(0.08 * (length(a) + length(b)) + 1e-9) and levenshtein(a, b) <= floor(0.08 * (length(a) + length(b)) + 1e-9)",
)


def vectors(s, d):
    e = T(s, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("concept"), F.col("embedding").alias("vec"))


TOP_SQL = """
q as (select vec_id as query_id, embedding::double[] v from embeddings where vec_id % 50 = 0),
c as (select vec_id as row_id, cast(label as varchar) as concept, embedding::double[] v from embeddings),
s as (select query_id, row_id, concept, list_inner_product(q.v, c.v) as score from q, c),
n as (select *, row_number() over (partition by query_id order by score desc, row_id) rn from s),
p as (select query_id, concept, max(score) as score, min(rn) rn from n where rn <= {rows} group by query_id, concept),
k as (select query_id, concept, round(score, 4) as score, row_number() over (partition by query_id order by p.score desc, rn) as rank from p)"""
add("dense_topk", lambda s, d: L.dense_topk(*vectors(s, d), k=5), f"with {TOP_SQL.format(rows=15)} select * from k where rank <= 5")
add("dense_1best", lambda s, d: L.dense_1best(*vectors(s, d)).select("query_id", "concept", "score", "match_type"), f"with {TOP_SQL.format(rows=15)} select query_id, concept, score, 'dense_nn' match_type from k where rank = 1")


def encoder_scores(s, d):
    """A pluggable encoder: part names against themselves; every name finds its own."""
    enc = L.hashed_encoder()
    names = T(s, d, "part").select("p_name").distinct()
    q = names.select(F.crc32(F.col("p_name").cast("binary")).alias("query_id"), enc("p_name").alias("qvec"))
    c = names.select(F.crc32(F.col("p_name").cast("binary")).alias("row_id"), F.col("p_name").alias("concept"), enc("p_name").alias("vec"))
    best = L.dense_topk(q, c, k=1, rows=3).join(names.select(F.crc32(F.col("p_name").cast("binary")).alias("query_id"), "p_name"), "query_id")
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("concept") == F.col("p_name")).alias("right"))


add("encoder_baseline", encoder_scores, 'select count(*) n, count(*) "right" from (select distinct p_name from part)')


def hierarchy(s, d):
    n, r = T(s, d, "nation"), T(s, d, "region")
    edges = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    edges = edges.unionByName(r.select(F.col("r_name").alias("child"), F.lit("Place").alias("parent")))
    labels = edges.select(F.col("child").alias("curie")).union(s.createDataFrame([("Place",)], "curie string")).distinct().withColumn("label", F.lower("curie"))
    return edges, labels


def seeds(s, d):
    return T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("n_name").alias("curie"))


#: a nation, its region, the region's other nations, the top, the other regions: the walk's order from a nation
CONTEXT_SQL = """
met as (select n_nationkey query_id, 0 step, n_name curie, 'seed' relation from nation
  union all select n_nationkey, 1, r_name, 'parent' from nation join region on n_regionkey = r_regionkey
  union all select a.n_nationkey, 2, b.n_name, 'sibling' from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey
  union all select n_nationkey, 3, 'Place', 'parent' from nation
  union all select n_nationkey, 4, r_name, 'sibling' from nation join region on n_regionkey <> r_regionkey),
placed as (select query_id, curie, lower(curie) as label, relation, row_number() over (partition by query_id order by step, curie) - 1 as place from met)"""
add("bfs_context", lambda s, d: L.bfs_context(seeds(s, d), *hierarchy(s, d)), f"with {CONTEXT_SQL} select * from placed where place < 15")
add(
    "context_block",
    lambda s, d: L.context_block(L.bfs_context(seeds(s, d), *hierarchy(s, d), cap=4).withColumn("score", F.when(F.col("relation") == "seed", F.lit(0.5)))),
    f"""with {CONTEXT_SQL} select query_id, 'Candidates:' || chr(10) || string_agg('- ' || label || ' (' || curie || ') similarity=0.5000', chr(10) order by place) filter (where place = 0)
  || chr(10) || 'Related:' || chr(10) || string_agg('- ' || label || ' (' || curie || ')', chr(10) order by place) filter (where place between 1 and 3) as block from placed where place < 4 group by query_id""",
)

ANSWERS = [("a", "X:1", True), ("b", "X:9", True), ("c", "Z:0", False), ("d", "NONE", False), ("e", None, False)]
add(
    "llm_resolve",
    lambda s, d: L.resolve(
        s.createDataFrame(ANSWERS, "mention string, answer string, in_graph boolean").selectExpr("*", "array(named_struct('curie','X:0','label','t','score',0.9D), named_struct('curie','X:1','label','u','score',0.8D)) candidates", "case when mention = 'd' then named_struct('curie','B:1','score',0.7D) end fallback")
    ),
    "select * from (values ('a','X:1',0.8::double,'rag_selected'), ('b','X:9',0.0,'rag_graph_selected'), ('c','X:0',0.9,'rag_hallucinated'), ('d','B:1',0.7,'rag_abstained'), ('e','X:0',0.9,'rag_abstained')) t(mention, curie, score, match_type)",
)
add("llm_batches", lambda s, d: L.ask(T(s, d, "part").select(F.col("p_name").alias("mention"), F.lit("ctx").alias("block")).distinct(), lambda rows: [m.upper() for m, _ in rows]), "select distinct p_name mention, upper(p_name) reply from part")


def _cascade(s, d):
    exact = L.link_exact(mentions(s, d), lexicon(s, d))
    base = mentions(s, d).select("mention", F.lit("D:1").alias("curie"), F.lit("dense").alias("label"), F.lit(0.5).alias("score"), F.lit("dense_nn").alias("match_type"), F.lit("biosyn").alias("method"))
    return L.cascade(base, exact).select("mention", "curie", "score", "match_type")


add("cascade", _cascade, f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select mention, case when match_type = 'NIL' then 'D:1' else curie end curie, case when match_type = 'NIL' then 0.5::double else score end score, case when match_type = 'NIL' then 'dense_nn' else match_type end match_type from exact")


def _rates(s, d):
    e = L.link_exact(mentions(s, d), lexicon(s, d)).select(F.col("curie").alias("exact_curie"), F.col("score").alias("exact_score"), F.expr("case when length(mention) % 2 = 0 then curie end").alias("biosyn_curie"), F.lit(0.5).alias("biosyn_score"))
    return L.hit_rates(e, ["exact", "biosyn"])


add("hit_rates", _rates, f"with {LEX_SQL}, {MENTIONS_SQL}, {KEYED_SQL} select 'exact' as method, avg((curie is not null)::int::double) rate, avg(score) filter (where curie is not null) mean_score from exact union all select 'biosyn', avg((curie is not null and length(mention) % 2 = 0)::int::double), 0.5 from exact")
names = lambda s, d: T(s, d, "part").select(F.initcap("p_name").alias("name"), F.concat(F.lit("CLO:"), F.col("p_size")).alias("id")).distinct()
asked = lambda s, d: T(s, d, "part").select(F.concat(F.upper("p_name"), F.expr("case when p_size % 2 = 0 then ' cells' else '' end")).alias("mention")).distinct()
DICT = "n as (select lower(p_name) k, array_to_string(list_sort(list(distinct 'CLO:' || p_size)), ';') ids from part group by 1), a as (select distinct upper(p_name) || case when p_size % 2 = 0 then ' cells' else '' end mention from part)"
add("dict_baseline", lambda s, d: L.dictionary_lookup(asked(s, d), names(s, d)).select("mention", F.array_join("ids", ";").alias("ids")), f"with {DICT} select mention, coalesce(ids, '') ids from a left join n on lower(mention) = k")
add("dict_baseline_relaxed", lambda s, d: L.dictionary_lookup(asked(s, d), names(s, d), relaxed=True).select("mention", F.array_join("ids", ";").alias("ids")), f"with {DICT} select mention, coalesce(ids, '') ids from a left join n on regexp_replace(lower(mention), ' cells$', '') = k")
add("service_selection", lambda s, d: T(s, d, "part").select("p_partkey", L.service_selection(F.expr("array(named_struct('label', 'x', 'synonyms', array('y'), 'id', 'I:0'), named_struct('label', upper(p_name), 'synonyms', array('z'), 'id', 'I:1'), named_struct('label', 'q', 'synonyms', array(p_name), 'id', 'I:2'))"), F.expr("case when p_size % 2 = 0 then p_name else 'none' end")).alias("v")), "select p_partkey, case when p_size % 2 = 0 then 'I:1' end v from part")
add("annotator_pref", lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(L.annotator_ids(F.expr("array(named_struct('type','PREF','id','I:' || p_size), named_struct('type','SYN','id','I:0'), named_struct('type','PREF','id','I:1'))"), True), ";").alias("v")), "select p_partkey, array_to_string(list_sort(list_distinct(['I:' || p_size, 'I:1'])), ';') v from part")


def _internal(s, d):
    gold = lex_parts(s, d)[0].select(F.lower("label").alias("mention"), F.col("curie").alias("gold"))
    pred = L.link_exact(gold.select("mention"), lexicon(s, d)).select("mention", F.col("curie").alias("pred"))
    return M.prf(M.confusion_nil_aware(gold.join(pred, "mention", "left"), "gold", "pred")).select("tp", "fp", "fn", "tn", "f1")


add("link_evaluation", _internal, f"with {LEX_SQL} select count(*) tp, 0::bigint fp, 0::bigint fn, 0::bigint tn, 1.0::double f1 from lex")
