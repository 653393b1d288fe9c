"""Merkle fingerprints of documents (DataFrame functions only).

A text is a tree: the root has sections of eight paragraphs, a section has
paragraphs (lines), a paragraph has leaves. A word's leaf is the start of the
MD5 of its text; texts of SHORT code points and more print folded leaves, each
the start of the MD5 of a run of words' leaves. A run ends after a word whose own
leaf says so (one in eight), so words put in or taken out change the runs around
them alone. A paragraph hashes its whole line, a section its paragraphs, the root
its sections, so equal roots mean equal texts, and where two trees differ, the
branches that differ locate the edit (differences()).

The fingerprint is the printed tree, marked where its leaves are folded:
    root|section/paragraph:leaf.leaf,paragraph:leaf.leaf;section/paragraph:leaf
    root|8|section/paragraph:leaf.leaf,paragraph:leaf.leaf;section/paragraph:leaf
Likeness of two fingerprints: 1 where they are equal, else the Dice
coefficient of their sets of leaves. Where only one of them is folded, the other
is folded first, so texts on either side of SHORT are compared like with like.

Defined results
- null text counts as empty; an empty text has a root and no leaves; two empty
  texts are alike (1), an empty and another text are not (0).
- the next document of op3 goes by descending id, equal ids by descending
  text, null ids last; after the last comes the first. One document alone is
  its own next document.
- extra columns are ignored and cannot clash; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT = 1024
PARAGRAPHS = 8
FOLDED = "|8|"
RUN = r"(?<![0-9a-f])(?:[2-9a-f][0-9a-f]{7}\.){0,31}+[0-9a-f]{8}(?![0-9a-f])"
WORD = r"(?s)\s*+\S++\s*+|\s++"
MAX_CUTS = 4096
COARSE = 64
MAX_HEADS = 2_000_000


def _fold(printed: Column) -> Column:
    """The folded leaves of printed leaves of words: runs of at most 32, none over two paragraphs."""
    return F.transform(F.regexp_extract_all(printed, F.lit(RUN), F.lit(0)), lambda x: F.substring(F.md5(x), 1, 8))


def _paragraph_leaves(par: Column, short: Column) -> Column:
    words = F.array_join(F.transform(F.regexp_extract_all(par, F.lit(WORD), F.lit(0)), lambda x: F.substring(F.md5(x), 1, 8)), ".")
    return F.when(short, words).otherwise(F.array_join(_fold(words), "."))


def fingerprint(text: Column) -> Column:
    """The printed Merkle tree of a text column (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    short = F.length(text) < SHORT
    pars = F.split(text, "\n", -1)
    hashed = F.transform(pars, lambda p: F.struct(F.sha2(p, 256).alias("h"), _paragraph_leaves(p, short).alias("l")))
    starts = F.sequence(F.lit(0), F.floor((F.size(pars) - 1) / PARAGRAPHS).cast("int"))

    def sections(tree: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(tree, i * PARAGRAPHS + 1, F.lit(PARAGRAPHS))
            return F.struct(
                F.sha2(F.array_join(F.transform(part, lambda p: p["h"]), "\n"), 256).alias("h"),
                F.array_join(F.transform(part, lambda p: F.concat(F.substring(p["h"], 1, 12), F.lit(":"), p["l"])), ",").alias("l"),
            )

        return F.transform(starts, one)

    # each level is computed once: a one-element array is the local variable
    def printed(secs: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(secs, lambda s: s["h"]), "\n"), 256)
        body = F.transform(secs, lambda s: F.concat(F.substring(s["h"], 1, 16), F.lit("/"), s["l"]))
        return F.concat(root, F.when(short, F.lit("|")).otherwise(F.lit(FOLDED)), F.array_join(body, ";"))

    return F.element_at(F.transform(F.array(hashed), lambda t: F.element_at(F.transform(F.array(sections(t)), printed), 1)), 1)


def leaves(print_: Column) -> Column:
    """The distinct leaves of a printed tree."""
    return F.array_distinct(F.filter(F.split(F.substring_index(print_, "|", -1), "[^0-9a-f]+"), lambda x: F.length(x) == 8))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; uses nothing but the two fingerprints."""
    fold_a, fold_b = F.contains(a, F.lit(FOLDED)), F.contains(b, F.lit(FOLDED))

    def alike(x: Column, fold: Column) -> Column:
        return F.when(fold, F.array_distinct(_fold(F.substring_index(x, "|", -1)))).otherwise(leaves(x))

    both = F.struct(alike(a, fold_b & ~fold_a).alias("a"), alike(b, fold_a & ~fold_b).alias("b"))
    dice = F.transform(
        F.array(both),
        lambda x: F.coalesce(
            F.try_divide(2.0 * F.size(F.array_intersect(x["a"], x["b"])), (F.size(x["a"]) + F.size(x["b"])).cast("double")),
            F.lit(0.0),
        ),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(F.element_at(dice, 1))


def differences(a: Column, b: Column) -> Column:
    """Where two trees differ, from the root down: array<struct<paragraph int, leaf int>>, in order.

    Equal roots: none. Only sections with different hashes are entered, and in them only paragraphs with different
    hashes. leaf is the first leaf that differs (of the words where neither tree is folded, of the runs where one is); null
    where a paragraph differs beyond its leaves or is in one tree alone.
    """
    one = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    fold_a, fold_b = F.contains(a, F.lit(FOLDED)), F.contains(b, F.lit(FOLDED))
    split = lambda x: F.split(F.substring_index(x, "|", -1), ";")
    hash_of = lambda x, sep: F.substring_index(x, sep, 1)
    text_of = lambda x, sep: F.substring_index(x, sep, -1)

    def leaves_of(par: Column, fold: Column) -> Column:
        text = text_of(par, ":")
        return F.when(text == "", F.array().cast("array<string>")).when(fold, _fold(text)).otherwise(F.split(text, "[.]"))

    def first_leaf(pair: Column) -> Column:
        x, y = leaves_of(pair["x"], fold_b & ~fold_a), leaves_of(pair["y"], fold_a & ~fold_b)
        unlike = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
        at = F.array_position(unlike, True)
        return F.when(pair["x"].isNull() | pair["y"].isNull() | (at == 0), None).otherwise((at - 1).cast("int"))

    def in_section(pair: Column, i: Column) -> Column:
        pars = F.zip_with(
            F.coalesce(F.split(text_of(pair["x"], "/"), ","), F.array().cast("array<string>")),
            F.coalesce(F.split(text_of(pair["y"], "/"), ","), F.array().cast("array<string>")),
            lambda x, y: F.struct(x.alias("x"), y.alias("y")),
        )
        numbered = F.transform(pars, lambda p, j: F.struct((i * PARAGRAPHS + j).alias("paragraph"), p.alias("p")))
        other = F.filter(numbered, lambda n: ~hash_of(n["p"]["x"], ":").eqNullSafe(hash_of(n["p"]["y"], ":")))
        return F.transform(other, lambda n: F.struct(n["paragraph"].alias("paragraph"), first_leaf(n["p"]).alias("leaf")))

    sections = F.zip_with(split(a), split(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    numbered = F.transform(sections, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    other = F.filter(numbered, lambda n: ~hash_of(n["p"]["x"], "/").eqNullSafe(hash_of(n["p"]["y"], "/")))
    found = F.flatten(F.transform(other, lambda n: in_section(n["p"], n["i"])))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<struct<paragraph:int,leaf:int>>")).otherwise(found)


def _bucket(df: DataFrame, key: str, rows_per_bucket: int) -> Column:
    """An order-preserving bucket number of key: at most MAX_CUTS quantiles, and within them equal widths, so that buckets grow in number with the rows; null keys get -1."""
    n = df.count()
    cuts_n = int(min(MAX_CUTS, n // rows_per_bucket))
    cuts = []
    if cuts_n:
        at = [0.0, *(round((i + 1) / (cuts_n + 1), 8) for i in range(cuts_n)), 1.0]
        low, *cuts, high = df.agg(F.percentile_approx(key, at, 10000)).first()[0] or [0, 0]
        cuts = sorted(set(cuts))
    if not cuts:
        return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    k = F.col(key)
    coarse = F.array(*[F.lit(c) for c in cuts[COARSE - 1 :: COARSE]])
    fine = F.array(*[F.lit(c) for c in cuts])
    first = F.when(F.lit(len(cuts) < COARSE), F.lit(0)).otherwise(F.size(F.filter(coarse, lambda c: c < k)))
    cell = first * COARSE + F.size(F.filter(F.slice(fine, first * COARSE + 1, F.lit(COARSE)), lambda c: c < k))
    parts = -(-n // (10 * rows_per_bucket * (len(cuts) + 1)))  # of a cell
    if parts > 1:  # a cell holds the keys over the cut below it, up to its own
        edges = F.array(*[F.lit(c) for c in (low, *cuts, high)])
        lo, hi = F.get(edges, cell), F.get(edges, cell + 1)
        inside = F.floor(F.try_divide(k.cast("double") - lo, hi.cast("double") - lo) * parts)
        cell = cell.cast("long") * parts + F.greatest(F.lit(0), F.least(F.coalesce(inside, F.lit(0)), F.lit(parts - 1)))
    return F.when(k.isNull(), F.lit(-1)).otherwise(cell).cast("long")


def with_next(df: DataFrame, key: str, cols: list[str], order: list[str], derive: dict[str, Column], rows_per_bucket: int = 2000) -> DataFrame:
    """Adds next_<col>: the cols of the row after this one by descending key, then descending order cols; the first follows the last.

    One shuffle: rows go to order-preserving buckets, and each bucket gets a copy of the first row of the bucket after it.
    derive: columns made once of each row and copy, before the shuffle.
    """
    rows = df.withColumn("_bucket", _bucket(df, key, rows_per_bucket)).withColumn("_ghost", F.lit(0))
    heads = rows.groupBy("_bucket").agg(F.max(key).alias("_head"))  # a row for each 2,000 rows or, beyond MAX_CUTS, 20,000
    w = Window.orderBy("_bucket")
    heads = heads.withColumn("_to", F.coalesce(F.lead("_bucket").over(w), F.min("_bucket").over(Window.partitionBy())))
    heads = heads.select("_head", "_to", F.col("_bucket").alias("_of"))
    if heads.count() <= MAX_HEADS:
        heads = F.broadcast(heads)
    tops = rows.join(heads, (F.col(key).eqNullSafe(F.col("_head"))) & (F.col("_bucket") == F.col("_of")))
    first = F.max(F.struct(*[F.col(c) for c in order]))
    ghosts = tops.groupBy("_to").agg(first.alias("_x")).select(
        F.col("_to").alias("_bucket"), F.lit(1).alias("_ghost"), *[F.col(f"_x.{c}").alias(c) for c in order]
    )
    both = rows.unionByName(ghosts, allowMissingColumns=True).withColumns(derive)
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.col(key).desc_nulls_last(), *[F.col(c).desc() for c in order])
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return out.filter("_ghost = 0").drop("_ghost", "_bucket")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every text, and the text with its last third replaced by the start of the next document; edited_from: the first paragraph that differs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text", "fingerprint"], ["text"], {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k))
    )
    # built once, before the hashes: Catalyst would otherwise repeat the tree for each use of it
    prints = edited.withColumn("_e", F.explode(F.array(F.struct(F.sha2("edited", 256).alias("s"), fingerprint(F.col("edited")).alias("f")))))
    return prints.select(
        "doc_id", "n_chars", F.col("_e.s").alias("edited_sha256"), "fingerprint", F.col("_e.f").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_e.f")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.get(differences(F.col("fingerprint"), F.col("_e.f")), F.lit(0))["paragraph"].cast("long").alias("edited_from"),
    )
