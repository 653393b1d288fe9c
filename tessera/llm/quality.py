"""Quality classifier: supervised subword embeddings.

Every word has a learned vector for its hash, for the hashes of its character
n-grams (word edges marked), and for the hash of it and the word before it; a
word that repeats the one before it shares one bucket of its own. A document is
the average of its words' vectors, a softmax layer gives the probability of
each label. Training is plain stochastic gradient descent in numpy, a document
a step, with a linearly falling rate.

Fitting uses at most MAX_FIT labelled documents (by hash order of the id), the
rest of the job - scoring - covers every row. The model is of fixed size
(BUCKETS x DIM floats, about 4 MB), so its broadcast is bounded.

Defined results
- empty, wordless and null texts average to the zero vector: the bias decides.
- labels that are null, or not 0 or 1, do not teach; a document with several
  labels teaches with the largest. With no labels, or one label alone, scores
  are the share of label 1 (0.5 with none).
- scores depend on the text alone; repeated rows score alike; extra columns
  are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import ship, trim
from .bytewords import _BYTE, _MUL, Words, chunks, mix

BUCKETS, DIM, NGRAMS = 1 << 16, 16, (2, 3, 4)  # bucket numbers fit 16 bits
MAX_FIT, EPOCHS, RATE = 6000, 5, 0.6
CUT = 0.3
REPEAT = 0  # the bucket of a repeated word


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _word_features(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the picked words: their own and all of their character n-grams; and the number of each."""
    starts, lens = words.starts[pick], words.ends[pick] - words.starts[pick]
    padded = lens + 2
    at = np.cumsum(padded) - padded
    owner = np.repeat(np.arange(len(pick)), padded)
    place = np.arange(int(padded.sum())) - at[owner]
    source = np.clip(starts[owner] + place - 1, 0, max(len(words.raw) - 1, 0))
    flat = _BYTE[words.raw[source]] if len(words.raw) else np.zeros(0, np.uint64)
    flat[place == 0] = np.uint64(11)
    flat[place == padded[owner] - 1] = np.uint64(13)
    feats, owners = [_bucket(words.hash[pick])], [np.arange(len(pick))]
    for n in NGRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * _MUL + flat[i : i + m]
        ok = np.flatnonzero(owner[:m] == owner[n - 1 :])
        feats.append(_bucket(mix(h[ok] + np.uint64(n))))
        owners.append(owner[ok])
    feats, owners = np.concatenate(feats), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return feats[order], np.bincount(owners, minlength=len(pick))


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word with the one before it, and the index of the later word."""
    same_row = np.flatnonzero(words.row[1:] == words.row[:-1]) + 1
    a, b = words.hash[same_row - 1], words.hash[same_row]
    return np.where(a == b, REPEAT, _bucket(mix(a * _MUL + b))), same_row


class Model:
    def __init__(self, table: np.ndarray, out: np.ndarray, bias: float):
        self.table, self.out, self.bias = table, out, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        scores = []
        # the softmax over two labels needs the difference of their logits alone, so each bucket has one number
        value = (self.table @ self.out).astype(np.float64)
        for _, _, raw, offsets in chunks(texts):
            words = Words(raw, offsets, "space", lower=False)
            rows = len(offsets) - 1
            if not len(words.hash):
                total = np.zeros(rows)
            else:
                _, pick, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                feats, counts = _word_features(words, pick)
                sums = np.add.reduceat(value[feats], np.cumsum(counts) - counts)
                pairs, later = _pairs(words)
                total = np.bincount(words.row, sums[inverse], rows) + np.bincount(words.row[later], value[pairs], rows)
                n = np.bincount(words.row, counts[inverse], rows) + np.bincount(words.row[later], minlength=rows)
                total = total / np.maximum(n, 1)
            scores.append(1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40))))
        return np.concatenate(scores) if scores else np.zeros(0)


def _documents(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Each text's distinct buckets, how often it has them (in as few bytes as hold them), and the sum of that."""
    out = []
    for _, _, raw, offsets in chunks(texts):
        words = Words(raw, offsets, "space", lower=False)
        for r in range(len(offsets) - 1):
            own = np.arange(words.first[r], words.first[r + 1])
            if not len(own):
                out.append((np.zeros(0, np.uint16), np.zeros(0, np.uint8), 1.0))
                continue
            _, pick, counts = np.unique(words.hash[own], return_index=True, return_counts=True)
            feats, lens = _word_features(words, own[pick])
            weight = np.repeat(counts, lens)
            a, b = words.hash[own[:-1]], words.hash[own[1:]]
            pairs = np.where(a == b, REPEAT, _bucket(mix(a * _MUL + b)))
            ids, back = np.unique(np.r_[feats, pairs], return_inverse=True)
            n = np.bincount(back, np.r_[weight, np.ones(len(pairs))])
            out.append((ids.astype(np.uint16), n.astype(np.min_scalar_type(int(n.max()))), float(n.sum())))
    return out


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent on the log loss."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, 2))
    bias = np.zeros(2)
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(DIM), float(np.log(share / (1 - share))))
    docs = _documents(texts)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, n, total = docs[i]
            w = (n / total).astype(np.float32)
            rate = RATE * (1 - done / steps)
            done += 1
            rows = table[ids]
            hidden = w @ rows if len(ids) else np.zeros(DIM)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            if len(ids):
                table[ids] = rows - (rate * len(ids) ** 0.5) * np.outer(w, grad)
    return Model(table.astype(np.float32), out[:, 1] - out[:, 0], float(bias[1] - bias[0]))


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit: int = MAX_FIT) -> Model:
    """Fits on at most max_fit labelled documents outside the held-out fold."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_fit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    model = fit(rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(int))
    del rows
    trim()
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _scored(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.score(batch.column(at))
        cols = [*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. No shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scored(sent.value, 1, it), "doc_id long, score double")


def _kept(model: Model, at: int, cut: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(model.score(batch.column(at)) >= cut))


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    ship(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _kept(sent.value, at, cut, it), docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
