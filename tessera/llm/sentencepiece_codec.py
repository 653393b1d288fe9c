"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words (a run of U+2581 and what follows it) are encoded together: their symbols
lie in one flat numpy array, each round finds the best-ranked pair of every
word by a segmented minimum, merges its occurrences from the left at once, and
compacts the array, until no word has a pair left. Within a batch every
distinct word is encoded once.

Where a merge could be overtaken - the merged piece takes part in a pair that
ranks as high as itself or higher - a round merges the leftmost occurrence
alone, which is the order of the library's agenda.

Defined results: null text encodes as empty (begin and end ids only); texts of
any length are whole; repeated rows give repeated rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import ship

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
NONE = np.int64(1 << 62)
BATCH_CHARS = 1_000_000
CACHE_WORDS = 250_000


class Codec:
    """Encodes and decodes as a BPE model with byte fallback, a dummy prefix and identity normalisation does."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        m = pb2.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation")
        if any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces are not covered")
        if any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces):
            raise ValueError("models with a space inside a piece are not covered: words are encoded by themselves")
        self.dummy = spec.add_dummy_prefix
        self.bos, self.eos, self.unk = m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.unk_id
        self.unk_surface = m.trainer_spec.unk_surface
        self.pieces = [p.piece for p in m.pieces]
        self.types = np.array([p.type for p in m.pieces])
        self.n = len(self.pieces)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_of = {}
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        scores = -np.array([p.score for p in m.pieces])
        ranks = np.searchsorted(np.unique(scores), scores)  # equal scores share a rank
        keys, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    made.append(i)
            if any(c not in self.ids for c in piece):
                raise ValueError(f"a character of {piece!r} is no piece")
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.made = np.array(made, np.int64)[order]
        self.rank = ranks.astype(np.int64)
        best = np.full(self.n, NONE)  # the best rank of the pairs that a piece is part of
        for side in (self.keys // self.n, self.keys % self.n):
            np.minimum.at(best, side, self.rank[self.made])
        self.single = best <= self.rank
        self.cache: dict[str, bytes] = {}
        # what a piece prints by itself; None where it depends on its neighbours
        self.prints: list[str | None] = [p.replace(SPACE, " ") for p in self.pieces]
        for i, b in self.byte_of.items():
            self.prints[i] = chr(b) if b < 128 else None
        for i in np.flatnonzero(np.isin(self.types, (UNKNOWN, CONTROL))):
            self.prints[i] = "" if self.types[i] == CONTROL else None
        self.plain = np.array([x is not None for x in self.prints])

    # -- encoding

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols (ids of pieces, or -1 - code point) and the word of each."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds, inverse = np.unique(points, return_inverse=True)
        table = np.array([self.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int64)
        return table[inverse], np.repeat(np.arange(len(words)), [len(w) for w in words])

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol but the last: the piece that it and the next one make (-1: none), and its rank."""
        a, b = sym[:-1], sym[1:]
        key = np.where((word[:-1] == word[1:]) & (a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        made = np.where(self.keys[at] == key, self.made[at], -1)
        return made, np.where(made >= 0, self.rank[made], NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by merge rounds, as little-endian 32-bit integers."""
        if not words:
            return []
        sym, word = self._symbols(words)
        done_sym, done_word = [], []
        while len(sym) > 1:
            made, rank = self._pairs(sym, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            full = np.r_[rank, NONE]
            best = np.minimum.reduceat(full, starts)  # the segmented minimum
            lens = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best < NONE, lens)
            if not live.all():  # finished words leave
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, full, made = sym[live], word[live], full[live], np.r_[made, -1][live]
                keep = best < NONE
                best, lens = best[keep], lens[keep]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(lens)[:-1]]
            else:
                made = np.r_[made, -1]
            hit = np.flatnonzero(full == np.repeat(best, lens))
            # runs of overlapping hits (same piece doubled): every second one from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            first = np.r_[True, word[hit][1:] != word[hit][:-1]]
            careful = np.zeros(len(words), bool)
            careful[word[hit][self.single[made[hit]]]] = True
            take = hit[np.where(careful[word[hit]], first, offset % 2 == 0)]
            sym[take] = made[take]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            sym, word = sym[stay], word[stay]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (sym < 0).any():
            sym, word = self._bytes(sym, word)
        ends = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        raw = sym.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        lens = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym < 0)
        coded = [chr(-1 - int(s)).encode("utf-8", "surrogatepass") for s in sym[odd]]
        lens[odd] = [len(c) for c in coded]
        out = np.repeat(sym, lens)
        at = np.cumsum(lens) - lens
        for i, c in zip(odd, coded, strict=True):
            out[at[i] : at[i] + len(c)] = self.byte_ids[list(c)]
        return out, np.repeat(word, lens)

    def words(self, text: str) -> list[str]:
        """A text's words; none where the text is empty."""
        if not text:
            return []
        return WORDS.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        split = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set().union(*split) if w not in cache] if split else []
        cache.update(zip(new, self.encode_words(new), strict=True))
        return [np.frombuffer(b"".join([cache[w] for w in ws]), "<u4") for ws in split]

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces are silent, one dummy space at the start goes, malformed bytes become U+FFFD."""
        if self.plain[ids].all():
            prints = self.prints
            text = "".join([prints[i] for i in ids.tolist()])
            if self.dummy and text.startswith(" "):
                lead = next(i for i in ids.tolist() if prints[i])
                text = text if lead in self.byte_of else text[1:]
            return text
        parts, run, first = [], bytearray(), True
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                first = False
                continue
            if run:
                parts.append(_lenient(bytes(run)))
                run.clear()
            kind = self.types[i]
            if kind == CONTROL:
                continue
            piece = self.unk_surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")
            if first and self.dummy and kind != UNKNOWN and piece.startswith(" "):
                piece = piece[1:]
            first = False
            parts.append(piece)
        if run:
            parts.append(_lenient(bytes(run)))
        return "".join(parts)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that starts no whole character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


SCHEMA = "doc_id long, ids binary, decoded string"


def _rows(path: str, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = _codec(path)
    bos, eos = np.array([codec.bos], np.uint32), np.array([codec.eos], np.uint32)
    for batch in batches:
        keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            coded = [np.concatenate([bos, x, eos]) for x in codec.encode_batch(texts[at:end])]
            text = [codec.decode(x) for x in coded]
            if digest:
                cols = [
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in text]),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                ends = np.r_[0, np.cumsum([len(x) for x in coded])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int64)))
                cols, names = [ids, pa.array(text, pa.string())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), *cols], ["doc_id", *names])
            at = end


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id with ids (begin and end included) and the decoded text, or with their digests. No shuffle."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<long>, decoded string"
    return rows.mapInArrow(lambda it: _rows(model_path, digest, it), out)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, default_model(), digest=True)
