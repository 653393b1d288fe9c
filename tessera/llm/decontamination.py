"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document when at least THRESHOLD of its distinct
word 5-grams occur there. Items are partitioned by the size of their shingle
sets (powers of two); every partition keeps the k smallest hash values of each
item, k being what the partition's largest size needs: a document that holds
enough of the item cannot miss all of its k minima, so no match is lost
whatever the document's length. Survivors are verified on the words themselves.

Documents are never shuffled. Items are searched in blocks of at most
BLOCK_BYTES of text; one block is broadcast at a time, so what is broadcast is
bounded and a larger benchmark takes more passes (decontaminated() makes one
pass with all blocks, 16 MB of item text each).

Defined results
- words: runs of letters and digits (anything beyond ASCII but punctuation
  counts), lower case; null or wordless texts and items match nothing.
- an item of fewer than five words is one shingle of its own length.
- repeated documents or items give repeated rows; ids may be null; extra
  columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import ship, stored
from .bytewords import Words, chunks

WIDTH, THRESHOLD = 5, 0.75
BLOCK_BYTES = 16_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _plain(texts: pa.Array) -> pa.Array:
    """Lower case; punctuation and spaces beyond ASCII become spaces. Each text by itself: texts of ASCII alone have none."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    beyond = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(beyond).as_py():
        return texts
    return pc.replace_with_mask(texts, beyond, pc.replace_substring_regex(texts.filter(beyond), r"[\p{P}\p{Z}]+", " "))


def minima_needed(size: int, threshold: float = THRESHOLD) -> int:
    """So many smallest hashes of an item of this size, at the top of its size partition, can't all be missing."""
    top = 1 << (size - 1).bit_length() if size > 1 else 1
    return min(size, top - math.ceil(threshold * top) + 1)


class Index:
    """The minima of a block of items, by shingle width."""

    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.ids, self.threshold = ids, threshold
        self.words = [WORD.findall(t) for t in texts]
        sigs: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.size = []
        self.shingles = []
        whole = Words(*_one(texts), "alnum")
        for i, words in enumerate(self.words):
            width = min(WIDTH, len(words))
            grams = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if words else set()
            self.shingles.append((width, grams))
            self.size.append(len(grams))
            if grams:
                own = whole.hash[whole.first[i] : whole.first[i + 1]]
                hashes = np.unique(_grams(own, width))
                sigs.setdefault(width, []).append((hashes[: minima_needed(len(grams), threshold)], i))
        self.by_width = {}
        for width, found in sigs.items():
            keys = np.concatenate([h for h, _ in found])
            items = np.concatenate([np.full(len(h), i) for h, i in found])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[width] = (keys[order], items[order], seen)

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(row, item) pairs that share one of the item's minima."""
        out = set()
        for width, (keys, items, seen) in self.by_width.items():
            grams, at = words.grams(width)
            hit = np.flatnonzero(seen[(grams >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, grams[hit], "left"), np.searchsorted(keys, grams[hit], "right")
            for j in np.flatnonzero(hi > lo):
                row = int(words.row[at[hit[j]]])
                out.update((row, int(i)) for i in items[lo[j] : hi[j]])
        return out


def _one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    w = Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), "alnum")
    w.hash, w.row = hashes, np.zeros(len(hashes), np.int64)
    return w.grams(width)[0]


def _matches(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """Verified matches: row, item, shingles shared, shingles of the item."""
    texts = _plain(texts)
    for at, _, raw, offsets in chunks(texts):
        by_row: dict[int, list[int]] = {}
        for row, i in index.candidates(Words(raw, offsets, "alnum", lower=False)):
            by_row.setdefault(row, []).append(i)
        for row, found in sorted(by_row.items()):
            own = WORD.findall(texts[at + row].as_py())
            sets: dict[int, set] = {}
            for i in sorted(found):
                width, grams = index.shingles[i]
                if width not in sets:
                    sets[width] = {tuple(own[j : j + width]) for j in range(len(own) - width + 1)}
                shared = len(grams & sets[width])
                if shared >= index.threshold * len(grams):
                    yield at + row, i, shared, len(grams)


def _clean(index: Index, column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        keep[[row for row, *_ in _matches(index, batch.column(column))]] = False
        yield batch.filter(pa.array(keep))


def _search(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        out = [(ids[row].as_py(), index.ids[i], n, size, n / size) for row, i, n, size in _matches(index, batch.column(1))]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])


def _blocks(items: DataFrame, threshold: float) -> Iterator[Index]:
    """Indexes of at most about BLOCK_BYTES of item texts each."""
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(-(-n_bytes // BLOCK_BYTES)) or 1
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        rows = part.select(F.col("item_id").cast("long"), "text").toArrow()
        yield Index(rows.column(0).to_pylist(), _plain(rows.column(1).combine_chunks()).to_pylist(), threshold)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item of which it holds at least threshold: SCHEMA. items: item_id, text."""
    ship(docs.sparkSession)
    rows, out, last = docs.select(F.col(id_col).cast("long"), text_col), None, None
    for index in _blocks(items, threshold):
        if last is not None:  # another block follows: this one's matches are kept, its index goes before the next comes
            found, sent = last
            found = stored(found, "matches")
            sent.unpersist(blocking=True)
            out = found if out is None else out.unionByName(found)
        sent = docs.sparkSession.sparkContext.broadcast(index)
        last = rows.mapInArrow(lambda it, sent=sent: _search(sent.value, it), SCHEMA), sent
    return last[0] if out is None else out.unionByName(last[0])


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; decided row by row, whatever the ids."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    for index in _blocks(items, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(lambda it, sent=sent: _clean(sent.value, at, it), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """All matches of benchmark items in documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


