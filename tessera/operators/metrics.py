"""Evaluation and report aggregations: each is one pass of conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def confusion_legacy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, fn. A missing prediction is fn whatever the gold value."""
    g, p = F.col(gold), F.col(pred)
    return df.agg(_n(p.isNotNull() & g.eqNullSafe(p), "tp"), _n(p.isNotNull() & ~g.eqNullSafe(p), "fp"), _n(p.isNull(), "fn"))


def confusion_nil_aware(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn. Without a gold value, no prediction is right."""
    g, p = F.col(gold), F.col(pred)
    return df.agg(
        _n(g.isNotNull() & (g == p), "tp"),
        _n(p.isNotNull() & ~g.eqNullSafe(p), "fp"),
        _n(g.isNotNull() & p.isNull(), "fn"),
        _n(g.isNull() & p.isNull(), "tn"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and (where tn is known) accuracy, zero-guarded."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    if "tn" in counts.columns:
        out = out.withColumn("accuracy", ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn")))
    return out


def set_scores(df: DataFrame, gold: str, preds: str) -> DataFrame:
    """Membership scores of candidate lists: coverage, accuracy, precision (null without predictions)."""
    hit = F.array_contains(F.col(preds), F.col(gold))
    some = F.size(F.coalesce(F.col(preds), F.array())) > 0
    return df.agg(F.count("*").alias("n"), _n(some, "covered"), _n(hit, "hits")).select(
        "n", "covered", "hits", ratio(F.col("covered"), F.col("n")).alias("coverage"), ratio(F.col("hits"), F.col("n")).alias("accuracy"), F.try_divide("hits", "covered").alias("precision")
    )


def accepted(df: DataFrame, accepted_ids: str, pred: str) -> DataFrame:
    """A prediction is right if it is among the accepted ids, or if there are neither."""
    a, p = F.col(accepted_ids), F.col(pred)
    right = F.when(F.size(a) == 0, p.isNull()).otherwise(F.array_contains(a, p))
    return df.agg(F.count("*").alias("n"), _n(right, "right"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, po, pe, kappa of two raters (1 where chance agreement is total)."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    sides = rows.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("v")), F.struct(F.lit("b").alias("side"), F.col(b).alias("v")))).alias("x"))
    marginal = sides.groupBy("x.v").agg(F.count_if(F.col("x.side") == "a").alias("na"), F.count_if(F.col("x.side") == "b").alias("nb"))
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    chance = marginal.agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    both = total.crossJoin(chance)  # one row each
    n = F.col("n").cast("double")
    out = both.select("n", ratio(F.col("same").cast("double"), n).alias("po"), ratio(F.coalesce("chance", F.lit(0)).cast("double"), n * n).alias("pe"))
    return out.withColumn("kappa", F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def abstention(df: DataFrame, gold: str, pred: str) -> DataFrame:
    nil = df.filter(F.col(gold).isNull())
    return nil.agg(F.count("*").alias("n_nil"), _n(F.col(pred).isNull(), "abstained"), _n(F.col(pred).isNotNull(), "answered"))


def bucket_rates(df: DataFrame, bucket: str, asked: list[str], names: list[str]) -> DataFrame:
    """Counts of buckets and their share of what was asked, in percent with two digits."""
    denominator = F.greatest(F.count_if(F.col(bucket).isin(asked)), F.lit(1))
    counts = [F.count_if(F.col(bucket) == x).alias(f"n_{x}") for x in names]
    shares = [F.round(100 * F.count_if(F.col(bucket) == x) / denominator, 2).alias(f"pct_{x}") for x in names]
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(bucket).isin(asked)).alias("n_asked"), *counts, *shares)


def value_counts(df: DataFrame, col: str, null_name: str | None = None) -> DataFrame:
    c = F.col(col) if null_name is None else F.coalesce(F.col(col).cast("string"), F.lit(null_name))
    return df.groupBy(c.alias("value")).agg(F.count("*").alias("n"))


def multilabel_share(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """label, n, share of all labels."""
    labels = df.select(F.explode(F.split(col, sep)).alias("x")).select(F.trim("x").alias("label")).filter("label <> ''")
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"))), how="cross").select("label", "n", (F.col("n") / F.col("all")).alias("share"))


def set_regions(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Rows of each exclusive region of two or more sets (those in no set too)."""
    return df.groupBy(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]).agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, col: str, at: list[float]) -> DataFrame:
    """Exact, linearly interpolated."""
    return df.agg(*[F.percentile(col, q).alias(f"q{round(q * 100):02d}") for q in at])


def sign_share(df: DataFrame, c: Column) -> DataFrame:
    share = lambda cond: F.avg(F.when(cond, 100.0).otherwise(0.0))
    return df.agg(share(c > 0).alias("positive"), share(c < 0).alias("negative"), share(c == 0).alias("zero"))


def char_composition(df: DataFrame, c: Column, top: int | None = None) -> DataFrame:
    """letter, n, share."""
    letters = df.select(F.explode(F.split(c, "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    out = letters.join(F.broadcast(letters.agg(F.sum("n").alias("all"))), how="cross").select("letter", "n", (F.col("n") / F.col("all")).alias("share"))
    return out.orderBy(F.desc("n"), "letter").limit(top) if top else out


def hist2d(df: DataFrame, x: Column, y: Column, wx: float, wy: float) -> DataFrame:
    return df.groupBy(F.floor(x / wx).cast("long").alias("bx"), F.floor(y / wy).cast("long").alias("by")).agg(F.count("*").alias("n"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, fraction, note; columns the table lacks get the note column_missing. One pass."""
    here = [c for c in columns if c in df.columns]
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in here])
    rows = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in here else F.lit(None).cast("long")).alias("missing")) for c in columns]
    out = counts.select("_n", F.explode(F.array(*rows)).alias("r"))
    return out.select(
        "r.column", "r.missing", F.when(F.col("r.missing").isNotNull(), ratio(F.col("r.missing"), F.col("_n"))).alias("fraction"), F.when(F.col("r.missing").isNull(), "column_missing").alias("note")
    )
