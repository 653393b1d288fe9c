"""Evaluation metrics and report aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import metrics as M
from ..plans.runtime import table as T
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

GOLD_SQL = "gp as (select doc_id, quality as gold, case when n_chars % 3 = 0 then null when n_chars > 1000 then 1 else 0 end as pred from documents left join labels using (doc_id))"


def gold_pred(s, d):
    """Gold quality (null: NIL) and a rule's prediction (null: abstains)."""
    docs = T(s, d, "documents").select("doc_id", F.expr("case when n_chars % 3 = 0 then null when n_chars > 1000 then 1 else 0 end").alias("pred"))
    return docs.join(T(s, d, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id", "left")


NIL = "select count(*) filter (where gold = pred) tp, count(*) filter (where pred is not null and gold is distinct from pred) fp, count(*) filter (where gold is not null and pred is null) fn, count(*) filter (where gold is null and pred is null) tn from gp"
LEGACY = "select count(*) filter (where gold = pred) tp, count(*) filter (where pred is not null and gold is distinct from pred) fp, count(*) filter (where pred is null) fn from gp"
PRF = "select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end as f1"
add("confusion_legacy", lambda s, d: M.confusion_legacy(gold_pred(s, d), "gold", "pred"), f"with {GOLD_SQL} {LEGACY}")
add("confusion_nil_aware", lambda s, d: M.confusion_nil_aware(gold_pred(s, d), "gold", "pred"), f"with {GOLD_SQL} {NIL}")
add("prf", lambda s, d: M.prf(M.confusion_nil_aware(gold_pred(s, d), "gold", "pred")), f"with {GOLD_SQL}, c as ({NIL}) {PRF}, (tp + tn) / (tp + fp + fn + tn) as accuracy from c")
add("prf_legacy", lambda s, d: M.prf(M.confusion_legacy(gold_pred(s, d), "gold", "pred")), f"with {GOLD_SQL}, c as ({LEGACY}) {PRF} from c")
lists = "case n_chars % 4 when 0 then array() when 1 then array(1) when 2 then array(0, 1) else array(0) end"
lists_sql = "case n_chars % 4 when 0 then [] when 1 then [1] when 2 then [0, 1] else [0] end"
add(
    "confusion_set",
    lambda s, d: M.set_scores(T(s, d, "documents").join(T(s, d, "labels"), "doc_id").select("quality", F.expr(lists).alias("preds")), "quality", "preds"),
    f"with t as (select quality g, {lists_sql} p from documents join labels using (doc_id)), c as (select count(*) n, count(*) filter (where len(p) > 0) covered, count(*) filter (where list_contains(p, g)) hits from t) select n, covered, hits, covered / n as coverage, hits / n as accuracy, hits / covered as precision from c",
)
add(
    "accepted_set",
    lambda s, d: M.accepted(T(s, d, "documents").join(T(s, d, "labels"), "doc_id").select(F.expr(lists).alias("acc"), F.expr("case when n_chars % 4 = 0 and n_chars % 8 = 0 then null else quality end").alias("p")), "acc", "p"),
    f"select count(*) n, count(*) filter (where case when len(a) = 0 then p is null else list_contains(a, p) end) as \"right\" from (select {lists_sql} a, case when n_chars % 4 = 0 and n_chars % 8 = 0 then null else quality end p from documents join labels using (doc_id))",
)
add(
    "cohen_kappa",
    lambda s, d: M.cohen_kappa(T(s, d, "labels"), "quality", "toxic").select("n", *[F.round(c, 10).alias(c) for c in ("po", "pe", "kappa")]),
    "with t as (select count(*)::double n, avg((quality = toxic)::int) po, avg(quality) a, avg(toxic) b from labels), k as (select n, po, a * b + (1 - a) * (1 - b) pe from t) select n::bigint n, round(po, 10) po, round(pe, 10) pe, round(case when pe = 1 then 1.0 else (po - pe) / (1 - pe) end, 10) kappa from k",
)
add("agreement_rate", lambda s, d: T(s, d, "labels").agg(F.avg(F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)).alias("rate")), "select avg((quality = toxic)::int::double) rate from labels")
add("abstention", lambda s, d: M.abstention(gold_pred(s, d), "gold", "pred"), f"with {GOLD_SQL} select count(*) n_nil, count(*) filter (where pred is null) abstained, count(*) filter (where pred is not null) answered from gp where gold is null")
add(
    "bucket_rates",
    lambda s, d: M.bucket_rates(T(s, d, "events"), "event_type", ["click", "purchase"], ["click", "purchase"]),
    "with c as (select count(*) n_rows, count(*) filter (where event_type in ('click','purchase')) n_asked, count(*) filter (where event_type = 'click') n_click, count(*) filter (where event_type = 'purchase') n_purchase from events) select *, round(100 * n_click / greatest(n_asked, 1), 2) pct_click, round(100 * n_purchase / greatest(n_asked, 1), 2) pct_purchase from c",
)
add("value_counts_null", lambda s, d: M.value_counts(gold_pred(s, d), "gold", "NIL"), f"with {GOLD_SQL} select coalesce(cast(gold as varchar), 'NIL') as value, count(*) n from gp group by 1")
add(
    "multilabel_share",
    lambda s, d: M.multilabel_share(T(s, d, "part").select(F.expr("case when p_size % 2 = 0 then p_type || ', ' || p_brand else p_type end").alias("v")), "v"),
    "with t as (select unnest(case when p_size % 2 = 0 then [p_type, p_brand] else [p_type] end) as label from part) select label, count(*) n, count(*) / (select count(*) from t) as share from t group by label",
)
kw = {"ring": "ring", "plate": "plate", "red": "red"}
add(
    "venn3_regions",
    lambda s, d: M.set_regions(T(s, d, "part"), {k: C.contains_text(F.col("p_name"), w) for k, w in kw.items()}),
    "select contains(lower(p_name), 'ring') ring, contains(lower(p_name), 'plate') plate, contains(lower(p_name), 'red') red, count(*) n from part group by all",
)
add("venn2_regions", lambda s, d: M.set_regions(T(s, d, "labels"), {"q": F.col("quality") == 1, "t": F.col("toxic") == 1}), "select quality = 1 q, toxic = 1 t, count(*) n from labels group by all")
add("quantiles", lambda s, d: M.quantiles(T(s, d, "part"), "p_retailprice", [0.25, 0.5, 0.75, 0.99]), "select quantile_cont(p_retailprice, 0.25) q25, quantile_cont(p_retailprice, 0.5) q50, quantile_cont(p_retailprice, 0.75) q75, quantile_cont(p_retailprice, 0.99) q99 from part")
charge_sql = "(length(upper(p_name)) - length(translate(upper(p_name), 'KR', ''))) - (length(upper(p_name)) - length(translate(upper(p_name), 'DE', '')))"
add("sign_share", lambda s, d: M.sign_share(T(s, d, "part"), C.net_charge(F.upper("p_name"))), f"with t as (select {charge_sql} c from part) select avg(case when c > 0 then 100.0 else 0.0 end)::double positive, avg(case when c < 0 then 100.0 else 0.0 end)::double negative, avg(case when c = 0 then 100.0 else 0.0 end)::double zero from t")
add("char_composition", lambda s, d: M.char_composition(T(s, d, "part"), C.clean_sequence(F.col("p_name"))), "with t as (select unnest(string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '')) letter from part) select letter, count(*) n, count(*) / (select count(*) from t where letter <> '') share from t where letter <> '' group by letter")
add("top_letters", lambda s, d: M.char_composition(T(s, d, "part"), C.clean_sequence(F.col("p_name")), 5), "with t as (select unnest(string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '')) letter from part) select letter, count(*) n, count(*) / (select count(*) from t where letter <> '') share from t where letter <> '' group by letter order by n desc, letter limit 5")
add("hist2d", lambda s, d: M.hist2d(T(s, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 5, 10000), "select cast(floor(l_quantity / 5) as bigint) bx, cast(floor(l_extendedprice / 10000) as bigint) \"by\", count(*) n from lineitem group by all")
add("length_histogram", lambda s, d: T(s, d, "documents").groupBy(F.floor(F.length("text") / 100).cast("long").alias("bin")).agg(F.count("*").alias("n")), "select cast(floor(length(text) / 100) as bigint) bin, count(*) n from documents group by 1")
add(
    "missingness",
    lambda s, d: M.missingness(gold_pred(s, d), ["gold", "pred", "absent"]),
    f"with {GOLD_SQL}, c as (select count(*) n, count(*) filter (where gold is null) g, count(*) filter (where pred is null) p from gp) select 'gold' as \"column\", g missing, g / n fraction, null::varchar note from c union all select 'pred', p, p / n, null from c union all select 'absent', null, null, 'column_missing' from c",
)
add("count_distinct_metrics", lambda s, d: T(s, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("pairs")), "select count(*) n, count(distinct l_partkey) parts, count(distinct (l_partkey, l_suppkey)) pairs from lineitem")
add("completeness", lambda s, d: gold_pred(s, d).filter("gold is not null and pred is not null").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("u")), f"with {GOLD_SQL} select count(*) n, count(distinct doc_id) u from gp where gold is not null and pred is not null")
add("tolerance_check", lambda s, d: T(s, d, "part").agg(F.avg("p_retailprice").alias("v")).select((F.abs(F.col("v") - 500) <= 400).alias("ok")), "select abs(avg(p_retailprice) - 500) <= 400 ok from part")
