"""N-gram Jaccard join with count-vector R-trees: components of near-copies.

Two documents link when the Jaccard similarity of their sets of word 5-grams is
at least 3/4. The result is exact; it names each document's component.

1. Equal sets become one representative (an aggregation by set digest).
2. Each representative names its rarest shingles - so many that two linked sets
   must share one. Rarity comes from a table of counts of hashed shingles over
   all documents; any order is exact, a good one keeps common passages out. The
   sets that name one shingle go to the block of the smallest of them (its
   pivot), so any two of them share a block, and a set that many shingles lead
   to one block is there once.
3. A block indexes its members as points: the counts of their shingles in
   GROUPS hash groups, packed into an R-tree. The overlap of two sets is at most
   the sum of the coordinate minima of their points (for a node: of a point and
   the node's upper corner), which prunes pairs that cannot reach the
   threshold. Pairs that are left meet the same bound over FINE groups;
   survivors are verified on the sets, each pair once.
4. Links are found in three rounds, so a large group of near-copies costs rows
   in proportion to its members, not their pairs: every member against the first
   few of its block; what is still apart, against its best-bounded partners; at
   last every surviving pair that still lies in two components. No link between
   different components is left unverified. Blocks of many members are cut into
   slices: all meet the same first ones, and in the last round members outside a
   block's largest component visit all of its slices.
5. Components: by one task up to MAX_LINKS links, else by repeated contraction
   of all links to the smallest neighbour.

A tree alone, without blocks, would compare each document with a share of all
others, as high-dimensional points hardly separate: that grows with the square.

Shingles and sets go by 64-bit hashes: exact as long as no two of them collide.

Defined results
- words are split at ASCII white space, A-Z lower-cased; fewer than five words
  are one shingle; no words: an empty set, linked with nothing.
- rows without an id have no component and make no links; rows that share an id
  are each taken by their own text, under that id.
- ties and repeated rows share a component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import cut, ship, stored
from .bytewords import Words, chunks, mix

WIDTH = 5
NUM, DEN = 3, 4  # the threshold
GROUPS, MANY, FINE = 16, 128, 512  # hash groups in small blocks, in large ones, of pairs
LEAF = 32
PIVOTS, BEST = 8, 6
SLICE = 2000  # members of a block; larger blocks are cut into slices
HOT = 16_384  # documents of a token for each part that its rows are dealt to
PARTS = 64  # of the count table
MAX_BROADCAST = 1_000_000
MAX_LINKS = 2_000_000  # that one task joins up
DOCS = "doc_id long, n int, h1 long, h2 long, vec binary, many binary, fine binary, part int, counts binary"


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def point(s: np.ndarray, groups: int) -> bytes:
    """Group counts as bytes, after the step that they are in (32 bits); never rounded down."""
    counts = np.bincount(((s >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    step = 1 + int(counts.max()) // 255 if len(s) else 1
    return np.uint32(step).tobytes() + (-(-counts // step)).astype(np.uint8).tobytes()


def points(column: pa.Array, groups: int) -> np.ndarray:
    """The counts of many points of equal size, rounded up to their steps."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 + groups)
    step = raw[:, :4].copy().view(np.uint32).astype(np.int32)
    return raw[:, 4:] * step


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, raw, offsets in chunks(batch.column(column)):
        for r, s in enumerate(Words(raw, offsets, "space").sets(WIDTH)):
            yield at + r, s


def _profile(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents, then the task's part of the count table."""
    import zlib

    counts = np.zeros(1 << bits, np.int32)
    names = [c.split(" ")[0] for c in DOCS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out, pending, held = [], [], 0
        for row, s in _sets(batch, 1):
            h1, h2 = digest(s) if len(s) else (None, None)
            out.append((ids[row], len(s), h1, h2, point(s, GROUPS), point(s, MANY), point(s, FINE), None, None))
            pending.append(s)
            held += len(s)
            if held > 1_000_000:
                counts += np.bincount((np.concatenate(pending) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
                pending, held = [], 0
        if held:
            counts += np.bincount((np.concatenate(pending) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    blobs = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(PARTS, -1)]
    empty = [pa.nulls(PARTS, t) for t in types[:7]]
    yield pa.RecordBatch.from_arrays([*empty, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the parts of the count table that come to this task."""
    import zlib

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
            sums[part] = sums[part] + got if part in sums else got
    cols = [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(s, 2**31 - 1).astype(np.int32).tobytes(), 1) for s in sums.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["part", "counts"])


def count_table(profiled: DataFrame, bits: int) -> np.ndarray:
    """Document counts of hashed shingles: at most 2^24 numbers."""
    import zlib

    rows = profiled.filter("part is not null").select("part", "counts")
    total = np.zeros((PARTS, (1 << bits) // PARTS), np.int32)
    for r in rows.repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").toLocalIterator():
        total[r[0]] += np.frombuffer(zlib.decompress(r[1]), np.int32)
    return total.reshape(-1)


def prefix_length(n: int) -> int:
    """Two sets that link share one of so many first elements, in any common order."""
    return n - -(-NUM * n // DEN) + 1


def _prefixes(bits: int, counts: np.ndarray, hot: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, sid, part: the rarest shingles of each set; copies that one task meets come once.

    part deals out the sets of a token that very many documents have (from 1); it is 0 where there is nothing to deal out.
    """
    seen: set = set()
    for batch in batches:
        tokens, sids, parts = [], [], []
        for _, s in _sets(batch, 0):
            if not len(s):
                continue
            key = digest(s)
            if key in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(key)
            k = prefix_length(len(s))
            own = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
            at = np.lexsort((s, own))[:k]
            tokens.append(s[at])
            sids.append(np.full(k, key[0]))
            many = own[at] // hot
            parts.append(np.where(many > 0, 1 + (key[0] & 0x7FFFFFFF) % (many + 1), 0))
        if tokens:
            cols = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(parts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["token", "sid", "part"])


class CountTree:
    """A packed R-tree over count vectors: every node knows the upper corner and the smallest set below it."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        order = np.lexsort((*vec.T[:2], n))  # sizes first: they bound the overlap most
        self.order, self.vec, self.n = order, vec[order], n[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hi, lo_n, hi_n = self.vec, self.n, self.n
        while len(hi) > LEAF:
            cuts = np.arange(0, len(hi), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cuts), np.minimum.reduceat(lo_n, cuts), np.maximum.reduceat(hi_n, cuts)
            self.levels.append((hi, lo_n, hi_n))

    def query(self, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Members whose overlap with (v, n) can reach the threshold, and their bound over what is needed."""
        nodes = None
        for hi, lo_n, hi_n in reversed(self.levels):
            at = np.arange(len(hi)) if nodes is None else nodes[nodes < len(hi)]
            bound = np.minimum(hi[at], v).sum(1)
            fits = (DEN * lo_n[at] * NUM <= DEN * DEN * n) & (DEN * hi_n[at] >= NUM * n) & ((NUM + DEN) * bound >= NUM * (n + lo_n[at]))
            nodes = (at[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
        at = np.arange(len(self.n)) if nodes is None else nodes[nodes < len(self.n)]
        bound, need = _bounds(v[None], np.array([n]), self.vec[at], self.n[at])
        ok = bound >= need
        return self.order[at[ok]], bound[ok] / np.maximum(need[ok], 1)


def _bounds(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bound of the overlaps, and the overlap a link needs: NUM * (a + b) / (NUM + DEN), and no less than 3/4 of the larger."""
    bound = np.minimum(np.minimum(va, vb).sum(1), np.minimum(na, nb))
    need = np.maximum(-(-NUM * (na + nb) // (NUM + DEN)), -(-NUM * np.maximum(na, nb) // DEN))
    return bound, need


def _small_pairs(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside of runs."""
    reps = np.repeat(lens, lens)
    local = np.arange(len(reps)) - np.repeat(np.cumsum(lens) - lens, lens)
    base = np.repeat(starts, lens)
    left = reps - 1 - local
    i = np.repeat(base + local, left)
    step = np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
    return i, i + 1 + step


def _candidates(mode: str, rep: np.ndarray, n: np.ndarray, vec: np.ndarray, comp: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers to verify, of runs of rows (blocks); in mode pivots, the first rows of a run are its pivots."""
    if mode == "pivots":
        lead = np.repeat(starts, lens)
        place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        me = lead + place
        best, who = np.zeros(len(me)), np.full(len(me), -1)
        second, who2 = np.zeros(len(me)), np.full(len(me), -1)
        for p in range(PIVOTS):
            at = np.flatnonzero(place > p)
            if not len(at):
                break
            a, b = me[at], lead[at] + p
            bound, need = _bounds(vec[a], n[a], vec[b], n[b])
            score = np.where((bound >= need) & (rep[a] != rep[b]), bound / np.maximum(need, 1), 0)
            up = score > best[at]
            mid = ~up & (score > second[at])
            second[at[up]], who2[at[up]] = best[at[up]], who[at[up]]
            best[at[up]], who[at[up]] = score[up], b[up]
            second[at[mid]], who2[at[mid]] = score[mid], b[mid]
        one, two = who >= 0, who2 >= 0
        return np.r_[me[one], me[two]], np.r_[who[one], who2[two]]
    out_a, out_b = [], []
    # blocks whose rows lie in one component have nothing left to find
    mixed = (np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)) if len(starts) else np.zeros(0, bool)
    starts, lens = starts[mixed], lens[mixed]
    small = lens <= LEAF
    if small.any():
        a, b = _small_pairs(starts[small], lens[small])
        for k in range(0, len(a), 2_000_000):
            x, y = a[k : k + 2_000_000], b[k : k + 2_000_000]
            apart = comp[x] != comp[y]
            x, y = x[apart], y[apart]
            bound, need = _bounds(vec[x], n[x], vec[y], n[y])
            out_a.append(x[bound >= need])
            out_b.append(y[bound >= need])
    for start, size in zip(starts[~small], lens[~small], strict=True):
        here = slice(start, start + size)
        tree = CountTree(vec[here], n[here])
        names, inverse, sizes = np.unique(comp[here], return_inverse=True, return_counts=True)
        main = sizes.argmax()
        for x in np.flatnonzero(inverse != main):  # every pair across components has a side outside the largest
            found, score = tree.query(vec[start + x], n[start + x])
            apart = (inverse[found] != inverse[x]) & ((inverse[found] == main) | (found < x))
            found, score = found[apart], score[apart]
            if mode == "best" and len(found) > BEST:
                found = found[np.argsort(-score, kind="stable")[:BEST]]
            out_a.append(np.full(len(found), start + x))
            out_b.append(start + found)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _blocks_to_pairs(mode: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: pairs to verify, of rows (block, rep, n, vec, comp) in which blocks lie together, their pivots first; each pair once per flush."""
    held = None
    found: list[np.ndarray] = []

    def work(cols):
        key, rep, n, vec, comp = cols
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lens = np.diff(np.r_[starts, len(key)])
        many = vec[starts, -1] >= 0  # blocks whose points have MANY groups
        for groups, kind in ((GROUPS, ~many), (MANY, many)):
            keep = (lens > 1) & kind
            a, b = _candidates(mode, rep, n, vec[:, :groups], comp, starts[keep], lens[keep])
            if len(a):
                x, y = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
                found.append(np.unique(np.stack([x, y], 1)[x != y], axis=0))

    def flush():
        pairs = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        n = batch.column(2).to_numpy().astype(np.int64)
        few = np.array([len(x) == 4 + GROUPS for x in batch.column(3).to_pylist()], bool)
        vec = np.full((batch.num_rows, MANY), -1, np.int32)  # -1 where a point has fewer groups
        vec[few, :GROUPS] = points(batch.column(3).filter(pa.array(few)), GROUPS)
        vec[~few] = points(batch.column(3).filter(pa.array(~few)), MANY)
        rep = batch.column(1).to_numpy()
        comp = batch.column(4).to_numpy()
        cols = [batch.column(0).to_numpy(), rep, n, vec, comp]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = np.flatnonzero(cols[0] != cols[0][-1])
        cut_at = int(last[-1]) + 1 if len(last) else 0  # the last block may go on
        held = [x[cut_at:] for x in cols]
        if cut_at:
            work([x[:cut_at] for x in cols])
        if sum(map(len, found)) > 1_000_000:
            found[:] = [np.unique(np.concatenate(found), axis=0)]
            if len(found[0]) > 500_000:
                yield flush()
    if held is not None and len(held[0]):
        work(held)
    if found:
        yield flush()


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bound over the fine groups reaches the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (na, va), (nb, vb) = ((batch.column(i).to_numpy().astype(np.int64), points(batch.column(i + 1), FINE)) for i in (2, 4))
        bound, need = _bounds(va, na, vb, nb)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(bound >= need))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, set: the sets of texts; copies that one task meets come once."""
    seen: set = set()
    for batch in batches:
        out = {}
        for _, s in _sets(batch, 0):
            key = digest(s)[0]
            if len(s) and key not in seen:
                seen.add(key)
                out[key] = s.tobytes()
        if len(seen) > 500_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["rep", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = (batch.column(i) for i in range(4))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = DEN * shared >= NUM * (len(x) + len(y) - shared)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def small(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """Marked for broadcast where it has few enough rows; else it joins by shuffle. df is counted, so it should be cut."""
    return F.broadcast(df) if df.count() <= limit else df


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link. Only texts of documents that the fine bound leaves are shingled again."""
    paired = cut(reps.select("rep", "doc", "n", "fine").join(small(_ends(pairs)), "rep", "left_semi"))
    side = lambda x: paired.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    fitting = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "fa", "nb", "fb")
    pairs = cut(fitting.mapInArrow(_fitting, "a long, b long").distinct())
    ids = cut(paired.join(small(_ends(pairs)), "rep", "left_semi").select(F.col("doc").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").select("text")
    sets = cut(texts.mapInArrow(_packed, "rep long, set binary"))
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")).hint("shuffle_hash"), "a")
    both = one.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")).hint("shuffle_hash"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long").distinct()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the links of one task: smallest labels spread, and labels of labels are taken, until nothing changes."""
    cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not cols:
        return
    nodes, at = np.unique(np.concatenate([x for ab in cols for x in ab]), return_inverse=True)
    sizes = [len(a) for a, _ in cols]
    cuts = np.cumsum([n for n in sizes for _ in (0, 1)])[:-1]
    parts = np.split(at, cuts)
    a, b = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "comp"])


def components(links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """node, comp: the smallest node reachable.

    Up to max_links links one task joins them up; more are contracted to the smallest neighbour, all together, until no
    link is left.
    """
    if links.count() <= max_links:
        return cut(links.select("a", "b").coalesce(1).mapInArrow(_joined_up, "node long, comp long"))
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    total = None
    while links.count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
        if total is None:
            total = to
        else:
            step = to.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
            total = total.join(step, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp"))
            old = total.select("node")
            total = cut(total.unionByName(to.join(old, "node", "left_anti")))
        a = to.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = to.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        links = links.join(a, "a").join(b, "b").filter("ca <> cb")
        links = cut(links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if total is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return total


def _block(slice_col: str) -> Column:
    """The block of a pivot, or of a slice of it."""
    return F.when(F.col("slices") == 1, F.col("pivot")).otherwise(F.xxhash64("pivot", slice_col))


def _guests(rows: DataFrame) -> DataFrame:
    """The rows as guests of the other slices of their blocks."""
    out = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).filter("other <> own")
    return out.withColumn("block", _block("other"))


def _pivots(rows: DataFrame) -> DataFrame:
    """The first members of the first slice of a sliced block, as guests of its other slices, which so have the same pivots."""
    first = rows.filter("slices > 1 and own = 0").withColumn("rn", F.expr("row_number() over (partition by block order by rep)")).filter(F.col("rn") <= PIVOTS)
    return _guests(first).withColumn("lead", F.lit(0)).select(*rows.columns)


def _visitors(rows: DataFrame) -> DataFrame:
    """Members of sliced blocks that lie outside the block's largest component, as guests of its other slices.

    Of any two members in different components at least one is outside, so they meet in a slice; members of the largest
    component, however many, are not copied.
    """
    large = rows.filter("slices > 1")
    counts = large.groupBy("pivot", "comp").agg(F.count("*").alias("k"))
    main = counts.groupBy("pivot").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    return _guests(large.join(main, "pivot").filter("comp <> main")).select(*rows.columns)


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks in tasks of even size."""
    return rows.repartitionByRange("block").sortWithinPartitions("block", "lead", "rep")


def _by_set(docs: DataFrame, slice_size: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, h1, h2: the digest of the set), and the sets that have words and an id: h1, h2, doc (the
    smallest id that has it), comp (its component), low (the smallest id in the component).

    Sets are named by their first 64 bits (rep = h1), not by ids, which several texts may share.
    """
    spark: SparkSession = docs.sparkSession
    bits = int(min(24, max(16, (4 * docs.count()).bit_length())))
    profiled = stored(docs.mapInArrow(lambda it: _profile(bits, it), DOCS), "profile")
    rows = profiled.filter("part is null").select("doc_id", "n", "h1", "h2")
    first = rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"))
    own = profiled.filter("part is null and n > 0").select(F.col("doc_id").alias("doc"), "h1", "h2", "n", "vec", "many", "fine")
    reps = stored(first.join(own, ["h1", "h2", "doc"]).dropDuplicates(["h1", "h2"]).withColumnRenamed("h1", "rep"), "sets")
    counts = spark.sparkContext.broadcast(count_table(profiled, bits))
    prefixes = docs.filter("doc_id is not null").select("text").mapInArrow(lambda it: _prefixes(bits, counts.value, hot, it), "token long, sid long, part int")
    # tokens of at least two sets, and each set once in a block; rows of a token that very many documents have are dealt out, and all of them stay
    by_token = prefixes.withColumn("lo", F.expr("min(sid) over (partition by token, part)")).withColumn("hi", F.expr("max(sid) over (partition by token, part)"))
    members = stored(by_token.filter("lo <> hi or part > 0").select("token", F.col("sid").alias("rep")).distinct(), "members")
    # a token's sets go to the block of the smallest of them: two sets that share a token share a block, and once for all tokens that lead there
    pivots = members.groupBy("token").agg(F.count("*").alias("k"), F.min("rep").alias("pivot")).filter("k > 1").select("token", "pivot")
    met = stored(members.join(pivots, "token").select("pivot", "rep").distinct(), "met")
    large = cut(met.groupBy("pivot").agg(F.count("*").alias("size")).filter(F.col("size") > min(LEAF, slice_size)))
    sized = met.join(small(large), "pivot", "left").withColumn("size", F.coalesce("size", F.lit(1))).join(reps.select("rep", "n", "vec", "many"), "rep")
    sized = sized.withColumn("vec", F.when(F.col("size") > LEAF, F.col("many")).otherwise(F.col("vec"))).withColumn("lead", F.lit(1))
    # blocks beyond slice_size members are cut into slices
    sized = sized.withColumn("slices", F.ceil(F.col("size") / slice_size).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    blocks = cut(_dealt(sized.withColumn("block", _block("own")).select("block", "rep", "n", "vec", "pivot", "slices", "own", "lead")))
    sliced = not blocks.filter("slices > 1").isEmpty()

    links, comps, tested = None, None, None
    for mode in ("pivots", "best", "rest"):
        if comps is None:
            rows_in = blocks.withColumn("comp", F.col("rep"))
        else:
            at = small(comps.select(F.col("node").alias("rep"), "comp"))
            rows_in = blocks.join(at, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        moved = comps is not None and comps.count() > MAX_BROADCAST
        if sliced and mode != "best":
            rows_in, moved = rows_in.unionByName((_pivots if mode == "pivots" else _visitors)(rows_in)), True
        rows_in = (_dealt(rows_in) if moved else rows_in).select("block", "rep", "n", "vec", "comp")
        pairs = rows_in.mapInArrow(lambda it, mode=mode: _blocks_to_pairs(mode, it), "a long, b long").distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = verified(docs, reps, pairs)
        links = cut(new if links is None else links.unionByName(new).distinct())
        comps = components(links)
    sets = reps.select(F.col("rep").alias("h1"), "h2", "doc")
    if comps is None:
        return rows, sets.withColumns({"comp": F.col("h1"), "low": F.col("doc")})
    linked = comps.withColumnRenamed("node", "h1").join(sets, "h1")
    low = small(cut(linked.groupBy("comp").agg(F.min("doc").alias("low"))))
    at = cut(linked.select("h1", "comp").join(low, "comp"))
    sets = sets.join(small(at), "h1", "left")
    return rows, sets.select("h1", "h2", "doc", F.coalesce("comp", "h1").alias("comp"), F.coalesce("low", "doc").alias("low"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id (the smallest id with an equal set) of every row."""
    ship(docs.sparkSession)
    rows, sets = _by_set(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), slice_size, hot)
    out = rows.join(sets, ["h1", "h2"], "left")
    none = F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(none, None).otherwise(F.coalesce("low", "doc_id")).alias("component_id"),
        F.when(none, None).otherwise(F.coalesce("doc", "doc_id")).alias("set_id"),
    )


def _digested(column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns in one, and the digest of the row's set."""
    for batch in batches:
        keys = [digest(s) if len(s) else (None, None) for _, s in _sets(batch, column)]
        row = pa.StructArray.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
        yield pa.RecordBatch.from_arrays([row, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], names=["row", "h1", "h2"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component stays, decided row by row.

    It is one with the component's smallest id; where rows share that id, the first by their columns printed as JSON. Rows
    without an id or without words stay.
    """
    ship(docs.sparkSession)
    rows, sets = _by_set(docs.select("doc_id", "text"), SLICE, HOT)
    found = cut(rows.filter("doc_id is not null").join(sets, ["h1", "h2"], "left"))
    shared = cut(found.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    gone = found.filter("low <> doc_id").select("doc_id")
    if shared.isEmpty():
        return docs.join(small(cut(gone)), "doc_id", "left_anti").select(*docs.columns)
    # ids that several rows have say nothing of a row: those are decided by their sets
    apart = small(shared)
    single = docs.join(small(cut(gone.unionByName(shared).distinct())), "doc_id", "left_anti").select(*docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    several = plain.join(apart.withColumnRenamed("doc_id", f"c{at}"), f"c{at}", "left_semi").select(*plain.columns)
    digests = several.mapInArrow(lambda it: _digested(text, it), f"row {plain.schema.simpleString()}, h1 long, h2 long")
    known = digests.join(found.filter("comp is not null").select("h1", "h2", "comp", "low").distinct(), ["h1", "h2"], "left")
    blank = known.filter("comp is null").select("row")
    first = known.filter(F.col("low") == F.col(f"row.c{at}")).groupBy("comp").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(blank.unionByName(first).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_id")
