"""Entity linking: lexicon, staged lookup, fuzzy and vector matches, context, cascade."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import cleaning as C
from ..plans.runtime import cut, ship

RESULT = ["curie", "label", "score", "match_type", "method"]
OVERRIDES = ["exact_pref", "exact_syn", "prefix_truncated"]


def lexicon(terms: DataFrame, synonyms: DataFrame, suffixes: tuple[str, ...] = (" cell", " cells")) -> DataFrame:
    """key -> curie, label, match_type: one row a key.

    terms: ord, curie, label; synonyms: ord, curie, label, synonym. A preferred label beats all else (the last one
    wins); synonyms and labels without a suffix fill the keys that are left (the first one wins).
    """
    pref = terms.select(C.link_key(F.col("label")).alias("key"), "curie", "label", F.lit("exact_pref").alias("match_type"), F.lit(0).alias("tier"), (-F.col("ord")).alias("place"))
    syn = synonyms.select(C.link_key(F.col("synonym")).alias("key"), "curie", "label", F.lit("exact_syn").alias("match_type"), F.lit(1).alias("tier"), F.col("ord").alias("place"))
    both, out = pref.unionByName(syn), [pref, syn]
    for i, s in enumerate(suffixes):
        bare = both.filter(F.col("key").endswith(s)).withColumn("key", F.expr(f"substring(key, 1, length(key) - {len(s)})"))
        out.append(bare.select("key", "curie", "label", "match_type", F.lit(2 + i).alias("tier"), F.abs("place").alias("place")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    best = rows.filter("key <> ''").groupBy("key").agg(F.min(F.struct("tier", "place", "curie", "label", "match_type")).alias("b"))
    return best.select("key", "b.curie", "b.label", "b.match_type")


def exact_candidates(mentions: DataFrame, text: str = "mention") -> DataFrame:
    """Distinct mentions with their keys to try in order: the key, the key with ' cell', then shorter and shorter word prefixes, each both ways."""
    keyed = mentions.select(F.col(text).alias("mention")).distinct().withColumn("key", C.link_key(F.col("mention")))
    words = F.split("key", " ")
    prefixes = F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.size(words) - 1, F.lit(1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")),
    ).otherwise(F.array().cast("array<string>"))
    tries = F.flatten(F.transform(F.concat(F.array("key"), prefixes), lambda k: F.array(k, F.concat(k, F.lit(" cell")))))
    return keyed.select("mention", F.posexplode(tries).alias("stage", "key"))


def link_exact(mentions: DataFrame, lex: DataFrame, text: str = "mention") -> DataFrame:
    """mention -> result of the first key that hits; NIL for blank texts and those without a hit."""
    tries = exact_candidates(mentions, text)
    hits = tries.join(lex, "key").groupBy("mention").agg(F.min(F.struct("stage", "curie", "label", "match_type")).alias("h"))
    kind = F.when(F.col("h.stage") < 2, F.col("h.match_type")).otherwise("prefix_truncated")
    found = hits.select("mention", "h.curie", "h.label", F.lit(1.0).alias("score"), kind.alias("match_type"), F.lit("exact").alias("method"))
    everyone = mentions.select(F.col(text).alias("mention")).distinct()
    return with_nil(everyone.join(found, "mention", "left"), "exact")


def with_nil(df: DataFrame, method: str) -> DataFrame:
    """Rows without an id, and blank mentions, become NIL."""
    nil = F.col("curie").isNull() | (F.trim(F.coalesce("mention", F.lit(""))) == "")
    pick = lambda c, x: F.when(nil, F.lit(x)).otherwise(F.col(c)).alias(c)
    return df.select("mention", pick("curie", None), pick("label", None), pick("score", 0.0), pick("match_type", "NIL"), pick("method", method))


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda x: x != "")), " ")


def indel_ratio(a: str, b: str) -> float:
    """2 * (longest common subsequence) / (total length), by bit-parallel rows."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = mask = (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & mask
    return 2 * (mask ^ s).bit_count() / (len(a) + len(b))


def fuzzy_blocks(keys: DataFrame, lex: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Candidate pairs: sorted tokens of similar length that share a signature, within the Levenshtein distance that the ratio allows.

    An edit spoils at most three runs of three characters (numbered where they repeat). So of its rarest 3k + 1 runs a text
    within k edits has one, among its own rarest ones. Rarity is counted over both sides; runs that most texts share are
    thus no blocks. Thresholds below 0.87 allow more edits than a short text has runs for.
    """
    if threshold < 0.87:
        raise ValueError("fuzzy blocks need a threshold of at least 0.87")

    def runs(df: DataFrame, key: str, side: str) -> DataFrame:
        rows = df.select(F.col(key).alias("key")).distinct().withColumn("sorted", token_sorted(F.col("key")))
        n = F.length("sorted")
        # positions of runs; a text of under three characters is its own run
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring("sorted", i, F.lit(3)))
        each = rows.select("key", "sorted", F.posexplode(grams).alias("at", "gram"))
        numbered = F.row_number().over(Window.partitionBy("key", "gram").orderBy("at"))
        return each.select("key", "sorted", F.concat_ws("#", "gram", numbered.cast("string")).alias("run"), F.lit(side).alias("side"))

    both = runs(keys, "key", "a").unionByName(runs(lex, "key", "b"))
    counts = both.groupBy("run").agg(F.count("*").alias("n"))
    allow = F.floor((1 - F.lit(threshold)) * 2.2 * F.length("sorted")).cast("int")
    ranked = both.join(counts, "run").groupBy("side", "key", "sorted").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("runs"))
    signed = ranked.select("side", "key", "sorted", F.explode(F.slice(F.transform("runs", lambda x: x["run"]), F.lit(1), 3 * allow + 1)).alias("sig"))
    a = signed.filter("side = 'a'").select("key", F.col("sorted").alias("a"), "sig")
    b = signed.filter("side = 'b'").select(F.col("key").alias("lex_key"), F.col("sorted").alias("b"), "sig")
    total = F.length("a") + F.length("b")
    most = F.floor((1 - F.lit(threshold)) * total + 1e-9).cast("int")
    near = (F.abs(F.length("a") - F.length("b")) <= most) & (F.levenshtein("a", "b") <= most)
    return a.join(b, "sig").filter(near).select("key", "lex_key", "a", "b").distinct()


def link_fuzzy(mentions: DataFrame, lex: DataFrame, threshold: float = 0.92, text: str = "mention") -> DataFrame:
    """mention -> best lexicon key by token-sorted ratio, if it reaches the threshold."""
    ship(mentions.sparkSession)
    keyed = mentions.select(F.col(text).alias("mention")).distinct().withColumn("key", C.link_key(F.col("mention")))

    def score(batches):
        for pdf in batches:
            pdf["score"] = [indel_ratio(x, y) for x, y in zip(pdf.pop("a"), pdf.pop("b"), strict=True)]
            yield pdf[pdf.score >= threshold]

    scored = fuzzy_blocks(keyed, lex, threshold).mapInPandas(score, "key string, lex_key string, score double")
    best = scored.groupBy("key").agg(F.min(F.struct(-F.col("score"), F.col("lex_key"))).alias("b")).select("key", F.col("b.lex_key").alias("lex_key"), F.round(-F.col("b.col1"), 4).alias("score"))
    found = best.join(lex.select(F.col("key").alias("lex_key"), "curie", "label"), "lex_key")
    out = keyed.join(found, "key", "left").select("mention", "curie", "label", "score", F.lit("fuzzy").alias("match_type"), F.lit("fuzzy").alias("method"))
    return with_nil(out, "fuzzy")


def link_staged(mentions: DataFrame, lex: DataFrame, threshold: float = 0.92, text: str = "mention") -> DataFrame:
    """All stages of the exact method: the key, word prefixes, and for mentions that these miss the nearest key. RESULT by mention."""
    exact = cut(link_exact(mentions, lex, text))
    missed = exact.filter((F.col("match_type") == "NIL") & (F.trim(F.coalesce("mention", F.lit(""))) != "")).select("mention")
    near = link_fuzzy(missed, lex, threshold).filter("curie is not null").select("mention", F.struct(*RESULT).alias("near"))
    own = F.struct(*RESULT)
    both = exact.join(near, "mention", "left").withColumn("r", F.when(F.col("match_type") == "NIL", F.coalesce("near", own)).otherwise(own))
    return both.select("mention", *[F.lit("exact").alias(c) if c == "method" else F.col(f"r.{c}").alias(c) for c in RESULT])


# -- vectors

MAX_SCORES = 1_000_000  # that a task holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_encoder(dim: int = 64):
    """A deterministic text encoder: signed character trigrams, unit length. Any pandas UDF of the same kind can stand in."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(s: pd.Series) -> pd.Series:
        # the runs of three characters of the whole batch at once
        texts = [f"  {t or ''} " for t in s]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        whole = np.flatnonzero(row[:-2] == row[2:])
        h = np.zeros(len(whole), np.uint64)
        for k in range(3):
            h = (h ^ points[whole + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        at = row[whole] * dim + (h % np.uint64(dim)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * dim).reshape(-1, dim)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(n == 0, 1, n)).astype(np.float32)))

    return encode


def dense_topk(queries: DataFrame, concepts: DataFrame, k: int = 5, rows: int | None = None) -> DataFrame:
    """query_id, concept, score, rank: the k best concepts of each query, each by its best synonym among the top rows.

    queries: query_id, qvec. concepts: row_id, concept, vec. The query block is sent to the concepts, never the other way:
    each task keeps the best rows of its share for each query, so what is shuffled is tasks x queries x rows.
    """
    rows = rows or 3 * k
    ship(queries.sparkSession)
    spark = queries.sparkSession
    best, last = None, None
    for block in query_blocks(queries):
        if last is not None:  # another block follows: this one's rows are kept, its vectors go before the next come
            found, old = last
            found = cut(found)
            old.unpersist(blocking=True)
            best = found if best is None else best.unionByName(found)
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            ids, matrix = sent.value
            held: pd.DataFrame | None = None
            for pdf in batches:
                if pdf.empty or not len(ids):
                    continue
                vectors = np.stack(pdf.vec.map(lambda v: np.asarray(v, np.float64)).to_list())
                n = min(rows, len(pdf))
                found = []
                for some in tiles(len(ids), len(pdf)):  # never all scores of the batch at once
                    scores = vectors @ matrix[some].T
                    order = np.lexsort((np.repeat(pdf.row_id.to_numpy()[:, None], scores.shape[1], 1), -scores), axis=0)[:n]
                    found.append(
                        pd.DataFrame(
                            {
                                "query_id": np.repeat(np.asarray(ids[some]), n),
                                "row_id": pdf.row_id.to_numpy()[order.T.ravel()],
                                "concept": pdf.concept.to_numpy()[order.T.ravel()],
                                "score": np.take_along_axis(scores, order, 0).T.ravel(),
                            }
                        )
                    )
                held = pd.concat(found if held is None else [held, *found])
                held = held.sort_values(["query_id", "score", "row_id"], ascending=[True, False, True]).groupby("query_id").head(rows)
            if held is not None:
                yield held

        part = concepts.select("row_id", "concept", "vec").mapInPandas(search, "query_id long, row_id long, concept string, score double")
        last = part, sent
    best = last[0] if best is None else best.unionByName(last[0])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    near = best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows)
    per = near.groupBy("query_id", "concept").agg(F.max("score").alias("score"), F.min("rn").alias("rn"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rn")
    return per.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "concept", F.round("score", 4).alias("score"), "rank")


def tiles(queries: int, vectors: int) -> list[slice]:
    """Slices of the queries with at most MAX_SCORES scores against the vectors of a batch (or one query)."""
    step = max(1, MAX_SCORES // max(1, vectors))
    return [slice(i, i + step) for i in range(0, queries, step)]


def query_blocks(queries: DataFrame, size: int = 20_000):
    """Blocks of query vectors of bounded size (20,000 x 64 doubles: 10 MB)."""
    queries = cut(queries)
    n = max(1, -(-queries.count() // size))
    for i in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).select("query_id", "qvec").orderBy("query_id").toPandas()
        yield rows.query_id.to_list(), np.stack([np.asarray(v, np.float64) for v in rows.qvec]) if len(rows) else np.zeros((0, 1))


def dense_1best(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """The best concept of each query by its best synonym."""
    return dense_topk(queries, concepts, k=1, rows=15).withColumn("match_type", F.lit("dense_nn"))


# -- graph context


def bfs_context(seeds: DataFrame, edges: DataFrame, labels: DataFrame, cap: int = 15) -> DataFrame:
    """query_id, curie, label, relation, place: nodes met from the seeds in order - seed, its parents, children and siblings; at most cap.

    seeds: query_id, rank, curie. Levels around the seeds are joined one after the other, for those queries alone whose
    last but one level still leaves the walk short of cap, until none is or nothing new is met; so a walk down a long
    chain is whole, and a query holds a few levels of at most about cap nodes with 2 * cap neighbours each.
    """
    ship(seeds.sparkSession)
    first = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, cap + 1)  # noqa: E731  more can't be met
    parents = edges.groupBy(F.col("child").alias("curie")).agg(first("parent").alias("parents"))
    children = edges.groupBy(F.col("parent").alias("curie")).agg(first("child").alias("children"))
    near = cut(parents.join(children, "curie", "full_outer"))
    known = cut(seeds.groupBy("query_id", "curie").agg(F.min("rank").alias("rank")).withColumn("level", F.lit(0)))
    level = 0
    while True:
        level += 1
        short = known.groupBy("query_id").agg(F.count_if(F.col("level") <= level - 2).alias("n")).filter(F.col("n") < cap).select("query_id")
        edge = known.filter(F.col("level") == level - 1).join(short, "query_id", "left_semi").join(near, "curie")
        both = F.concat(F.coalesce("parents", F.array().cast("array<string>")), F.coalesce("children", F.array().cast("array<string>")))
        met = edge.select("query_id", F.explode(both).alias("curie")).distinct().join(known.select("query_id", "curie"), ["query_id", "curie"], "left_anti")
        met = cut(met.select("query_id", "curie", F.lit(None).cast("int").alias("rank"), F.lit(level).alias("level")))
        if met.isEmpty():
            break
        known = known.unionByName(met)
    facts = known.join(near, "curie", "left").join(labels, "curie", "left")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {r.curie: list(r.parents) if r.parents is not None else [] for r in pdf.itertuples()}
        down = {r.curie: list(r.children) if r.children is not None else [] for r in pdf.itertuples()}
        name = {r.curie: r.label for r in pdf.itertuples()}
        first = pdf.dropna(subset=["rank"]).sort_values(["rank", "curie"]).curie.drop_duplicates().tolist()
        met: dict[str, str] = {}
        queue = []
        for s in first:
            if len(met) < cap:
                met.setdefault(s, "seed")
                queue.append(s)
        while queue and len(met) < cap:
            node = queue.pop(0)
            steps = [(p, "parent", True) for p in up.get(node, [])] + [(c, "child", True) for c in down.get(node, [])]
            steps += [(s, "sibling", False) for p in up.get(node, []) for s in down.get(p, []) if s != node]
            for other, relation, go in steps:
                if len(met) >= cap:
                    break
                if other not in met:
                    met[other] = relation
                    if go:
                        queue.append(other)
        return pd.DataFrame(
            {"query_id": pdf.query_id.iloc[0], "curie": list(met), "label": [name.get(c) for c in met], "relation": list(met.values()), "place": range(len(met))}
        )

    return facts.groupBy("query_id").applyInPandas(walk, "query_id long, curie string, label string, relation string, place long")


def context_block(rows: DataFrame) -> DataFrame:
    """query_id, block: the printed context, from query_id, place, curie, label, score (null: from the graph)."""
    line = F.when(F.col("score").isNotNull(), F.format_string("- %s (%s) similarity=%.4f", "label", "curie", "score")).otherwise(F.format_string("- %s (%s)", "label", "curie"))
    listed = rows.withColumn("line", line).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", F.col("score").isNotNull().alias("top")))).alias("x"))
    part = lambda keep: F.array_join(F.transform(F.filter("x", keep), lambda r: r["line"]), "\n")
    return listed.select("query_id", F.concat(F.lit("Candidates:\n"), part(lambda r: r["top"]), F.lit("\nRelated:\n"), part(lambda r: ~r["top"])).alias("block"))


def ask(contexts: DataFrame, client, batch: int = 20) -> DataFrame:
    """mention, reply: calls client(list of (mention, block)) -> list of replies, batch by batch; a failure gives null."""

    def call(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    replies = client(list(zip(part.mention, part.block, strict=True)))
                except Exception:  # the rows fall back to other methods
                    replies = [None] * len(part)
                yield pd.DataFrame({"mention": part.mention, "reply": replies})

    return contexts.select("mention", "block").mapInPandas(call, "mention string, reply string")


def resolve(answers: DataFrame) -> DataFrame:
    """What an answer means. answers: mention, answer, candidates (array<struct<curie,label,score>>), in_graph, fallback (struct or null)."""
    picked = F.filter("candidates", lambda c: c["curie"] == F.col("answer"))
    top = F.get("candidates", F.lit(0))
    none = F.col("answer").isNull() | F.upper("answer").isin("NONE", "")
    kind = F.when(none, "rag_abstained").when(F.size(picked) > 0, "rag_selected").when(F.col("in_graph"), "rag_graph_selected").otherwise("rag_hallucinated")
    score = (
        F.when(none, F.coalesce(F.col("fallback.score"), top["score"])).when(F.size(picked) > 0, F.get(picked, F.lit(0))["score"]).when(F.col("in_graph"), F.lit(0.0)).otherwise(top["score"])
    )
    curie = F.when(none, F.coalesce(F.col("fallback.curie"), top["curie"])).when((F.size(picked) > 0) | F.col("in_graph"), F.col("answer")).otherwise(top["curie"])
    return answers.select("mention", curie.alias("curie"), score.alias("score"), kind.alias("match_type"))


def cascade(base: DataFrame, exact: DataFrame) -> DataFrame:
    """An exact result overrides, a fuzzy one does not. Both: mention and RESULT."""
    e = exact.select("mention", F.struct(*RESULT).alias("e"))
    pick = F.when(F.col("e.match_type").isin(OVERRIDES), F.col("e")).otherwise(F.struct(*RESULT))
    return base.join(e, "mention", "left").withColumn("r", pick).select("mention", *[F.col(f"r.{c}").alias(c) for c in RESULT])


def plan_methods(methods: list[str]) -> list[str]:
    """exact, biosyn, rag in this order; rag needs biosyn."""
    wanted = {*methods, *(["biosyn"] if "rag" in methods else [])}
    if unknown := wanted - {"exact", "biosyn", "rag"}:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    return [m for m in ("exact", "biosyn", "rag") if m in wanted]


def link_dense(mentions: DataFrame, names: DataFrame, encoder, k: int = 5) -> DataFrame:
    """mention, curie, label, score, rank: the k best concepts by their best name. names: curie, label, name; encoder: a pandas UDF of text."""
    asked = cut(mentions.select("mention").distinct().filter(F.trim(F.coalesce("mention", F.lit(""))) != "").withColumn("query_id", F.xxhash64("mention")))
    rows = names.select("curie", "label", "name").distinct()
    queries = asked.select("query_id", encoder("mention").alias("qvec"))
    concepts = rows.select(F.xxhash64("curie", "name").alias("row_id"), F.col("curie").alias("concept"), encoder("name").alias("vec"))
    labels = rows.groupBy("curie").agg(F.min("label").alias("label"))
    best = dense_topk(queries, concepts, k)
    return asked.join(best, "query_id").join(labels, F.col("concept") == F.col("curie")).select("mention", "curie", "label", "score", "rank")


def link_reranked(top: DataFrame, client, edges: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """RESULT by mention: what client(list of (mention, context)) answers, from the candidates of link_dense and their surroundings."""
    ids = top.select("mention").distinct().withColumn("query_id", F.xxhash64("mention"))
    seeds = top.join(ids, "mention").select("query_id", F.col("rank").cast("int").alias("rank"), "curie")
    met = bfs_context(seeds, edges, names).join(top.join(ids, "mention").select("query_id", "curie", "score"), ["query_id", "curie"], "left")
    answers = ask(context_block(met).join(ids, "query_id").select("mention", "block"), client)
    listed = top.groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "curie", "label", "score"))), lambda x: F.struct(x["curie"].alias("curie"), x["label"].alias("label"), x["score"].alias("score"))).alias("candidates"))
    there = known.select(F.col("curie").alias("answer")).distinct().withColumn("in_graph", F.lit(True))
    rows = listed.join(answers.withColumnRenamed("reply", "answer"), "mention", "left").join(there, "answer", "left")
    rows = rows.select("mention", "answer", "candidates", F.coalesce("in_graph", F.lit(False)).alias("in_graph"), F.expr("cast(null as struct<curie:string,score:double>)").alias("fallback"))
    out = resolve(cut(rows)).join(names.groupBy("curie").agg(F.min("label").alias("label")), "curie", "left")
    return out.select("mention", "curie", "label", "score", "match_type", F.lit("rag").alias("method"))


def link_all(mentions: DataFrame, terms: DataFrame, synonyms: DataFrame, edges: DataFrame, methods: list[str], threshold: float = 0.92, encoder=None, client=None) -> DataFrame:
    """mention, and <method>_curie, _label, _score, _match_type of each method. What the exact method finds by key or prefix overrides the others.

    terms: ord, curie, label; synonyms: ord, curie, label, synonym; edges: child, parent.
    """
    plan = plan_methods(methods)
    if "rag" in plan and client is None:
        raise ValueError("rag needs a client")
    asked = cut(mentions.select("mention").distinct())
    exact = cut(link_staged(asked, lexicon(terms, synonyms), threshold))
    found = {"exact": exact} if "exact" in plan else {}
    if "biosyn" in plan:
        names = terms.select("curie", "label", F.col("label").alias("name")).unionByName(synonyms.select("curie", "label", F.col("synonym").alias("name"))).filter("name is not null")
        top = cut(link_dense(asked, names, encoder or hashed_encoder()))
        first = top.filter("rank = 1").select("mention", "curie", "label", "score", F.lit("dense_nn").alias("match_type"), F.lit("biosyn").alias("method"))
        found["biosyn"] = cascade(with_nil(asked.join(first, "mention", "left"), "biosyn"), exact)
        if "rag" in plan:
            picked = link_reranked(top, client, edges, terms.select("curie", "label"), terms.select("curie"))
            found["rag"] = cascade(with_nil(asked.join(picked, "mention", "left"), "rag"), exact)
    out = asked
    for name, rows in found.items():
        named = rows.select(F.col("mention").alias("_m"), *[F.col(c).alias(f"{name}_{c}") for c in RESULT if c != "method"])
        out = out.join(named, F.col("mention").eqNullSafe(F.col("_m")), "left").drop("_m")
    return out


def http_client(url: str, model: str, key: str | None = None, timeout: int = 60):
    """A client for ask(): one chat request a mention to a service with the common completions interface; the answer is the first CURIE or NONE in its reply."""

    def client(rows: list[tuple[str, str]]) -> list[str | None]:
        import json
        import re
        from urllib.request import Request, urlopen

        out = []
        for mention, block in rows:
            text = f"Which concept does {mention!r} mean? Answer with one id of the list, or NONE.\n{block}"
            body = {"model": model, "temperature": 0, "messages": [{"role": "user", "content": text}]}
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            with urlopen(Request(url, json.dumps(body).encode(), head), timeout=timeout) as reply:
                said = json.load(reply)["choices"][0]["message"]["content"]
            hit = re.search(r"\b[A-Za-z]+:\d+\b|\bNONE\b", said or "")
            out.append(hit[0] if hit else None)
        return out

    return client


def hit_rates(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """method, rate, mean score of hits."""
    rows = [F.struct(F.lit(p).alias("method"), F.col(f"{p}_curie").alias("curie"), F.col(f"{p}_score").alias("score")) for p in prefixes]
    return df.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.method").agg(F.avg(F.when(F.col("r.curie").isNotNull(), 1.0).otherwise(0.0)).alias("rate"), F.avg(F.when(F.col("r.curie").isNotNull(), F.col("r.score"))).alias("mean_score"))


def dictionary_lookup(mentions: DataFrame, names: DataFrame, relaxed: bool = False) -> DataFrame:
    """mention -> sorted distinct ids of all names that are equal (or equal without cell suffixes). names: name, id."""
    key = C.relax_suffix if relaxed else C.norm_name
    ids = names.select(key(F.col("name")).alias("k"), "id").filter("k <> ''").groupBy("k").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return mentions.withColumn("k", key(F.col("mention"))).join(ids, "k", "left").select("mention", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def service_selection(docs: Column, query: Column) -> Column:
    """Of a search service's ranked docs (label, synonyms, id), the first whose label or a synonym equals the query."""
    q = C.norm_name(query)
    hit = F.filter(docs, lambda d: (C.norm_name(d["label"]) == q) | F.exists(d["synonyms"], lambda s: C.norm_name(s) == q))
    return F.get(hit, F.lit(0))["id"]


def annotator_ids(matches: Column, preferred_only: bool) -> Column:
    kept = F.filter(matches, lambda m: m["type"] == "PREF") if preferred_only else matches
    return F.array_sort(F.array_distinct(F.transform(kept, lambda m: m["id"])))
