"""Proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded hash within their stratum, ranked there, ordered
by the fractional rank (rank - 1/2) / stratum size, and the resulting sequence
is cut into equal pieces, so each piece has the mixture of the whole.

No global sort: ranks come from row_number inside small hash cells plus the
summed counts of the cells before, so a stratum that holds a third of all rows
is spread over as many tasks as it has cells.

Defined results
- null text: size 1, crc32 of the empty string; null stratum: a stratum of its
  own; null ids take part with the hash of their text.
- the draw is of id and text, so rows that share an id, or have none, lie apart.
  Ties (equal hash): broken by id, size and crc32; rows with equal id and text are
  interchangeable, so the set of results is fixed.
- empty table: no rows. Extra columns are ignored and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut

MAX_CELLS = 1 << 16


def _offsets(cells: DataFrame, part: list[str], order: str) -> DataFrame:
    """Adds before: the rows in the cells before this one. Cell tables have at most MAX_CELLS rows for a part."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def proportional_shards(
    df: DataFrame,
    n_shards: int = 8,
    seed: str = "tessera-shards-1",
    stratum: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_cell: int = 4096,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, stratum, rank, fraction, position, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(F.col(stratum).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string")))
    draw = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), text))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        key.alias("stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(draw, 1, 15), 16, 10).cast("long").alias("draw"),
    )
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n_stratum"))
    total, strata = counts.agg(F.sum("n_stratum"), F.count("*")).first()
    total = total or 0
    if strata <= MAX_CELLS:  # a join by shuffle would deal the rows out by stratum alone
        counts = F.broadcast(counts)

    per = F.least(F.lit(MAX_CELLS), F.ceil(F.col("n_stratum") / rows_per_cell))
    celled = rows.join(counts, "stratum").withColumn(
        "cell", F.floor(F.col("draw") / F.lit(float(1 << 60)) * per).cast("int")
    )
    cells = _offsets(celled.groupBy("stratum", "cell").agg(F.count("*").alias("n")), ["stratum"], "cell")
    inside = Window.partitionBy("stratum", "cell").orderBy("draw", "doc_id", "size", "text_crc32")
    n_buckets = int(min(MAX_CELLS, max(1, -(-total // rows_per_cell))))
    ranked = (
        celled.withColumn("rn", F.row_number().over(inside))
        .join(cells.drop("n"), ["stratum", "cell"])
        .withColumn("rank", F.col("before") + F.col("rn"))
        .withColumn("bucket", F.expr(f"cast(((2 * rank - 1) * {n_buckets}) div (2 * n_stratum) as int)"))
        .select("doc_id", "stratum", "size", "text_crc32", "draw", "n_stratum", "rank", "bucket")
    )
    ranked = cut(ranked)  # read twice: for the counts of the buckets and for the rows

    buckets = _offsets(ranked.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket")
    fraction = (F.col("rank") - 0.5) / F.col("n_stratum")
    inside = Window.partitionBy("bucket").orderBy("fraction", "stratum", "rank")
    placed = (
        ranked.withColumn("fraction", fraction)
        .withColumn("rn", F.row_number().over(inside))
        .join(F.broadcast(buckets.drop("n")), "bucket")  # at most MAX_CELLS rows
        .withColumn("position", F.col("before") + F.col("rn") - 1)
    )
    n = max(total, 1)
    return (
        placed.withColumn("shard", F.expr(f"cast((position * {n_shards}L) div {n}L as int)"))
        .withColumn("slot", F.expr(f"position - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)"))
        .select("doc_id", "size", "text_crc32", "stratum", "rank", "fraction", "position", "shard", "slot")
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Law: rows (the counts of the shards are at most one apart)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return proportional_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.expr("substring(stratum, 2)").alias("source"), "fraction",
    )
