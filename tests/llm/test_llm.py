"""The operators against brute force, the libraries, and the edge cases."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, fingerprints, html_extract, jaccard_join, licenses, pii, quality, sentencepiece_codec, sharding, warc

EDGES = [None, "", " ", "one", "a b c d e f", "A\tB\nC", "ß é 日本 😀"]


def docs(spark, texts, ids=None):
    """Texts with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "x", "y", 5) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, n long")


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# -- 1


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    items = [" ".join(word() for _ in range(rng.choice([2, 4, 5, 9, 30]))) for _ in range(12)] + [items_none := None, ""]
    assert items_none is None
    texts = list(EDGES)
    for t in items[:12]:
        words = t.split()
        filler = lambda n: " ".join(word() for _ in range(n))
        texts.append(f"{filler(400)} {t.upper()}, {filler(90)}")
        if len(words) > 8:
            k = rng.randrange(len(words))
            texts.append(f"{filler(50)} {' '.join([*words[:k], 'zzz', *words[k + 1:]])} {filler(50)}")
    texts += texts[-3:]
    item_df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    split = lambda t: decontamination.WORD.findall((t or "").lower())
    expected = collections.Counter()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            w, own = split(x), split(t)
            k = min(5, len(w))
            s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
            if s and len(s & {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}) >= 0.75 * len(s):
                expected[d, i] += 1
    got = collections.Counter((r.doc_id, r.item_id) for r in decontamination.contained_items(docs(spark, texts), item_df).collect())
    assert got == expected and expected
    kept = decontamination.decontaminated(docs(spark, texts), item_df)
    assert kept.columns == ["doc_id", "text", "source", "score", "n"]
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert decontamination.contained_items(docs(spark, texts).filter("false"), item_df).count() == 0
    assert decontamination.contained_items(docs(spark, texts), item_df.filter("false")).count() == 0


def test_a_text_is_read_alike_in_any_batch(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta"
    marked = ["alpha，beta，gamma、delta；epsilon：zeta", "“alpha” – beta… gamma delta — epsilon zeta", "alpha,beta,gamma,delta,epsilon,zeta", "alphaxbeta gamma delta epsilon zeta"]
    alone = [decontamination._plain(pa.array([t])).to_pylist()[0] for t in marked]
    assert decontamination._plain(pa.array(marked)).to_pylist() == alone and decontamination._plain(pa.array([None, *marked])).to_pylist() == ["", *alone]
    items = spark.createDataFrame([(i, item if i < 3 else f"word{i} " * 6) for i in range(9)], "item_id long, text string")
    whole = sorted(tuple(r) for r in decontamination.contained_items(docs(spark, marked), items).collect())
    assert {r[0] for r in whole} == {0, 1, 2} and {r[1] for r in whole} == {0, 1, 2}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert sorted(tuple(r) for r in decontamination.contained_items(docs(spark, marked), items).collect()) == whole
    assert [r.doc_id for r in decontamination.decontaminated(docs(spark, marked), items).collect()] == [3]


def test_minima_cannot_all_be_missing():
    for n in range(1, 200):
        allowed = n - int(np.ceil(0.75 * n))
        assert decontamination.minima_needed(n) >= min(n, allowed + 1)


# -- 2


def test_quality_held_out_accuracy(spark, sf):
    big = "/root/testdata/sf0.01"
    rows = quality.op2_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(docs(spark, EDGES), labels)
    got = quality.scored(docs(spark, [*EDGES, "x" * 200_000]), model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert len({round(r.score, 12) for r in got[:3]}) == 1  # null, empty, blank
    none = quality.fit_on(docs(spark, EDGES), labels.filter("false"))
    assert quality.scored(docs(spark, ["a"]), none).first().score == pytest.approx(0.5)
    assert quality.scored(docs(spark, []), none).count() == 0
    assert quality.accepted(docs(spark, EDGES), none).columns == ["doc_id", "text", "source", "score", "n"]


def test_quality_reads_long_words_whole():
    same = "日本語の文章" * 5
    good, bad = [same + "良い品質" * 60 + str(i) for i in range(30)], [same + "広告宣伝" * 60 + str(i) for i in range(30)]
    model = quality.fit(pa.array(good + bad), np.array([1] * 30 + [0] * 30))
    a, b = model.score(pa.array([same + "良い品質" * 50, same + "広告宣伝" * 50]))
    assert a > 0.6 and b < 0.4
    text = same + "良い品質" * 50
    words = quality.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), "space", lower=False)
    _, counts = quality._word_features(words, np.arange(1))
    n = len(text.encode()) + 2
    assert counts.tolist() == [1 + sum(n - k + 1 for k in quality.NGRAMS)]


# -- 3


@pytest.mark.parametrize("per_bucket", [1, 2, 1000])
def test_next_document_and_edit(spark, per_bucket, monkeypatch):
    monkeypatch.setattr(fingerprints, "MAX_CUTS", 1 if per_bucket == 1 else 4096)
    texts = [f"text number {i} " * (i % 7) for i in range(40)]
    ids = [(i * 37) % 101 - 20 for i in range(38)] + [None, 5_000_000_000]
    df = docs(spark, texts, ids).select("doc_id", "text")
    rows = fingerprints.with_next(df, "doc_id", ["text"], ["text"], {}, per_bucket).collect()
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    nexts = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert len(rows) == len(order)
    assert all(nexts[r.doc_id, r.text] == r.next_text for r in rows)


def test_fingerprint_edges(spark):
    texts = [*EDGES, "a b c d e f", "x\n\ny", "w " * 5000]
    got = docs(spark, texts).select("doc_id", fingerprints.fingerprint(F.col("text")).alias("f")).orderBy("doc_id").collect()
    prints = [r.f for r in got]
    assert prints[0] == prints[1] and prints[4] == prints[7] and len(set(prints)) == len(texts) - 2
    one = docs(spark, ["p q r\ns t u"]).select(fingerprints.fingerprint(F.col("text")).alias("f"))
    assert one.select(fingerprints.likeness(F.col("f"), F.col("f"))).first()[0] == 1.0
    root, _, tree = one.first().f.partition("|")
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    section = h(h("p q r") + "\n" + h("s t u"))
    assert root == h(section)
    assert tree == f"{section[:16]}/{h('p q r')[:12]}:{'.'.join(map(leaf, ['p ', 'q ', 'r']))},{h('s t u')[:12]}:{'.'.join(map(leaf, ['s ', 't ', 'u']))}"


def leaf(x):
    return hashlib.md5(x.encode()).hexdigest()[:8]


def word_leaves(par):
    return [leaf(w) for w in re.findall(r"\s*\S+\s*|\s+", par, re.ASCII)]


def folded(leaves):
    """Runs that end with a leaf that starts with 0 or 1, of at most 32."""
    out, run = [], []
    for i, x in enumerate(leaves):
        run.append(x)
        if x[0] in "01" or len(run) == 32 or i == len(leaves) - 1:
            out.append(leaf(".".join(run)))
            run = []
    return out


def alike(a, b):
    if a == b:
        return 1.0
    sets = [{x for p in t.split("\n") for x in (folded(word_leaves(p)) if max(len(a), len(b)) >= fingerprints.SHORT else word_leaves(p))} for t in (a, b)]
    return 2 * len(sets[0] & sets[1]) / n if (n := len(sets[0]) + len(sets[1])) else 0.0


def test_likeness_across_the_short_limit(spark):
    words = " ".join(f"w{i:03d}" for i in range(400))
    pairs = [(words[:1230], words[:870]), (words[:1025], words[:1023]), (words[:870], words[:1230]), ("a b c\n" + words[:1100], "a b c"), (words[:1200], "z " * 50), (words[:1200], ""), (words[:1900], "new " + words[:1900])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumns({"a": fingerprints.fingerprint(F.col("a")), "b": fingerprints.fingerprint(F.col("b"))})
    got = [r.n for r in df.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert got == pytest.approx([alike(a, b) for a, b in pairs])
    assert got[0] > 0.6 and got[1] > 0.9 and got[0] == got[2] and got[3] > 0 and got[4] == got[5] == 0 and got[6] > 0.9


def test_differences_descend_the_tree(spark):
    lines = [f"line {i} of the text with some words" for i in range(20)]
    other = list(lines)
    other[3], other[17] = "line 3 of another text with some words", "line 17"
    long = [x + " and more of it" * 12 for x in lines]
    cases = [("\n".join(a), "\n".join(b)) for a, b in ((lines, lines), (lines, other), (lines, lines[:19]), (lines, [*lines, ""]), (long, long[:5] + ["x"] + long[6:]), (lines, long))] + [("", ""), ("", "a"), ("a  b", "a  b "), (None, "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = df.select("i", fingerprints.differences(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("d")).orderBy("i").collect()
    found = [[tuple(x) for x in r.d] for r in got]
    assert found[:5] == [[], [(3, 3), (17, 1)], [(19, None)], [(20, None)], [(5, 0)]]
    assert [p for p, _ in found[5]] == list(range(20)) and found[6] == [] and found[7] == [(0, 0)] and found[8] == [(0, 1)] and found[9] == []


def test_op3_matches_brute_force(spark, sf):
    rows = fingerprints.op3_fingerprints(spark, sf).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(text, reverse=True)
    assert len(rows) == len(text)
    for r in rows:
        mine, following = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        k = len(mine) // 3
        edited = mine[: len(mine) - k] + following[:k]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == pytest.approx((alike(mine, edited), alike(mine, following)))
        lines = list(itertools.zip_longest(mine.split("\n"), edited.split("\n")))
        assert r.edited_from == next((i for i, (x, y) in enumerate(lines) if x != y), None)


def test_op3_on_one_and_no_document(spark, tmp_path):
    for texts in (["a b c d"], []):
        path = f"file://{tmp_path}/{len(texts)}"
        docs(spark, texts).write.parquet(f"{path}/documents.parquet")
        rows = fingerprints.op3_fingerprints(spark, path).collect()
        assert len(rows) == len(texts)
        assert all(r.edited_sha256 == hashlib.sha256(b"a b ca ").hexdigest() and r.near_next == 1.0 for r in rows)


# -- 4


def test_licenses_match_brute_force(spark):
    texts = [
        *EDGES, "Under the MIT License. under the mit license", "Apache License, Version 2.0", "apache license version 20", "CC BY-NC 4.0, cc by nc", "licensed under the GNU General Public License, version 3.",
        "mit der Apache und License", "SPDX-License-Identifier: Apache-2.0", ("word " * 3000 + "under the MIT license ") * 3, "All rights reserved",
    ]
    rows = licenses.scan(docs(spark, texts)).select("doc_id", "norm", "kept").orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
        assert r.norm.split(" ")[1:-1] == w if w else r.norm.strip() == ""
        base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert sorted(base) == sorted((d.start, d.label) for d in r.kept if d.base)
    labels = [{d.label for d in r.kept} for r in rows]
    assert "gpl-3" in labels[11] and "gpl" not in labels[11]  # the longer one suppresses
    assert labels[12] == set() and labels[13] == {"apache-2.0"}


def test_rules_compile_and_are_hundreds():
    table = licenses.rules()
    assert len(table) >= 300
    for _, _, keyword, pattern, confidence, _ in table:
        re.compile(pattern)
        assert keyword == keyword.lower() and 0 < confidence <= 1


def samples(parsed):
    """Texts that a parsed pattern matches: every alternative and every option, taken and left out, is in one of them."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            one = [chr(arg)]
        elif op == "IN":
            one = [chr(c) for _, c in arg]
        elif op == "BRANCH":
            one = [t for branch in arg[1] for t in samples(branch)]
        elif op == "SUBPATTERN":
            one = samples(arg[3])
        elif op == "MAX_REPEAT":
            one = ["", *samples(arg[2])]
        else:
            assert op == "ASSERT_NOT"
            continue
        n = max(len(out), len(one))
        out = [out[i % len(out)] + one[i % len(one)] for i in range(n)] + [out[0] + x for x in one]
    return list(dict.fromkeys(out))


def test_every_alternative_of_every_rule_fires_alone(spark):
    import re._parser as parser

    cases = [(p, label, t) for p, label, _, x, _, _ in licenses.rules() for t in samples(parser.parse(x))]
    df = spark.createDataFrame([(i, p, label, t) for i, (p, label, t) in enumerate(cases)], "i int, p int, label string, text string").repartition(8)
    lost = licenses.scan(df).filter(~F.exists("found", lambda d: (d["priority"] == F.col("p")) & (d["label"] == F.col("label"))))
    assert all(len(t.split()) <= licenses.LONGEST for _, _, t in cases)
    assert len(cases) > 1000 and [(r.label, r.text) for r in lost.select("label", "text").collect()] == []
    assert {n for _, _, names, _ in licenses.FAMILIES for n in names} <= {t for _, _, t in cases}


def test_many_detections_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    bits = ["under the MIT license", "licensed under the terms of the gnu general public license version 3", "gnu general public license", "mit license", "apache license version 2.0", "cc by nc sa 4.0", "word", "all rights reserved", "bsd 3 clause license"]
    texts = [" ".join(rng.choice(bits) for _ in range(n)) for n in (300, 900)]
    rows = licenses.scan(docs(spark, texts)).select("doc_id", "norm", "found", "kept").orderBy("doc_id").collect()
    for r in rows:
        found = sorted((m.start(), p, label, base, len(r.norm[: m.start()].split()), len(r.norm[: m.end()].split())) for p, label, _, x, _, base in licenses.rules() for m in re.finditer(f"(?<= )(?:{x})(?= )", r.norm))
        assert sorted((f[2], f[4], f[5]) for f in found) == sorted((d.label, d.start, d.end) for d in r.found) and len(found) > licenses.FEW
        keep = [f for f in found if f[3] or not any(e[4] <= f[4] and e[5] >= f[5] and not e[3] and (e[1] < f[1] or e[1] == f[1] and e[5] - e[4] > f[5] - f[4]) for e in found)]
        assert sorted((f[2], f[4], f[5]) for f in keep) == sorted((d.label, d.start, d.end) for d in r.kept)
    monkeypatch.setattr(licenses, "FEW", 10**9)
    again = licenses.scan(docs(spark, texts)).select("kept").collect()
    assert [sorted(map(tuple, r.kept)) for r in again] == [sorted(map(tuple, r.kept)) for r in rows]


def test_names_without_the_family_keyword(spark):
    texts = ["licensed under the GNU GPL v3", "released under the GNU LGPL v2.1", "the simplified BSD license", "this software is provided 'as-is', without any express or implied warranty. In no event", "Expat License"]
    rows = licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [{d.label for d in r.kept} for r in rows] == [{"gpl-3"}, {"lgpl-2.1"}, {"bsd-2-clause"}, {"zlib"}, {"mit"}]


# -- 5


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("slice_size", "hot"), [(7, 3), (7, 10_000), (2000, 10_000)])
def test_near_copies_match_brute_force(spark, slice_size, hot):
    rng = random.Random(5)
    texts = list(EDGES) + ["A B C D E F", "one", "b c"]
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    for k in range(45):  # one large group of near-copies at all distances
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(60)] = f"e{k}_{rng.randrange(99)}"
        texts.append(" ".join(t))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join(f"u{k}_{i}" for i in range(rng.choice([3, 12, 40]))) + " " + passage for k in range(40)]
    ids = [100 + (i * 7) % len(texts) for i in range(len(texts))] if len(texts) % 7 else list(range(len(texts)))
    rows = list(zip(ids, texts, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(docs(spark, texts, ids), slice_size=slice_size, hot=hot).collect()}
    assert got == brute_components(rows)
    kept = jaccard_join.deduplicated(docs(spark, texts, ids))
    assert kept.columns == ["doc_id", "text", "source", "score", "n"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}


def test_near_copies_edges(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None, "x"], [3, None, 4, 4])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_copies(df).collect()), key=str)
    assert got == sorted([(3, 2, 3), (None, 2, None), (4, 0, 4), (4, 1, 4)], key=str)
    assert jaccard_join.near_copies(df.filter("false")).count() == 0


def test_deduplication_goes_row_by_row(spark):
    a, b, c = "one two three four five six", "a text of its own that nothing else here is like", "seven eight nine ten eleven twelve"
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (4, ""), (4, ""), (4, None), (None, a), (None, a), (11, c), (3, b + " x"), (5, "w"), (5, "w v")]
    df = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, h1 string, row long")
    kept = jaccard_join.deduplicated(df)
    assert kept.schema == df.schema
    # b + " x" links to b: 3 is the smaller id
    expected = [(3, a), (9, c), (4, ""), (4, ""), (4, None), (None, a), (None, a), (3, b + " x"), (5, "w"), (5, "w v")]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(expected)
    assert jaccard_join.deduplicated(df.filter("false")).count() == 0


def test_tree_finds_all_that_the_bound_leaves():
    r = np.random.default_rng(1)
    for size in (5, 33, 1100, 3000):
        n = r.integers(1, 400, size)
        v = np.stack([np.bincount(r.integers(0, 16, x), minlength=16) for x in n])
        tree = jaccard_join.CountTree(v, n)
        for q in r.integers(0, size, 5):
            got, _ = tree.query(v[q], n[q])
            bound, need = jaccard_join._bounds(v[q][None], n[q : q + 1], v, n)
            assert set(got.tolist()) == set(np.flatnonzero(bound >= need).tolist())


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    links = [(1, 2), (2, 3), (5, 6), (9, 3), (7, 6), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long"), limit).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 5, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


# -- 6


def test_archives_round_trip(spark, tmp_path):
    pages = [(3, "http://a/ü", "same"), (1, "http://b", "same"), (7, None, None), (2, "http://c", ""), (9, "http://d\r\nX: y", "<p>ß 😀</p>\r\n\r\n" * 50), (None, "u", "same"), (4, "u", "x" * 300_000), (1, "http://b", "same")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, payload string")
    written = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    assert sum(r.n_records for r in written) == len(pages)
    got = warc.read_archives(spark.createDataFrame([(r.path,) for r in written if r.path], "path string")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, "": 2}
    expected = collections.Counter()
    for i, _, t in pages:
        f = first.get(t or "")
        kind = ("response", None) if f is None or f == i else ("revisit", f)
        expected[i, len((t or "").encode()), digest(t), *kind] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    for r in written:
        for fields, payload in warc.read_archive(r.path):
            assert fields["warc-type"] == "revisit" or digest_ok(fields, payload)
    assert warc.write_archives(df.filter("false"), f"file://{tmp_path}/e").filter("path is not null").count() == 0


def digest_ok(fields, payload):
    return fields["warc-payload-digest"] == "sha1:" + warc.digest_of(payload)


def test_archive_is_readable_by_its_dictionary(tmp_path):
    a = warc.Archive(str(tmp_path))
    raw = [warc.record(i, "u", f"<html>page {i} {'x' * (i % 50)}</html>".encode(), "D", 1, None) for i in range(3000)]
    for r in raw:
        a.add(r)
    path, n = a.close()
    assert n == 3000
    head = open(path, "rb").read(4)
    assert int.from_bytes(head, "little") == warc.SKIPPABLE
    assert [p for _, p in warc.read_archive(path)] == [warc.parse(r)[1] for r in raw]


# -- 7


def test_surrogates():
    k = pii.Keyed("secret")
    text = 'Call +1 (603) 555-8791 or +1-603-555-8791, mail Ann.b3@firm.co; card 4111 1111 1111 1111, ip 10.1.2.3, IBAN DE89 3704 0044 0532 0130 00, token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda". Mr John Smith met Smith and Mrs Jane Smith; господин Иван Петров.'
    new, kinds = pii.replaced(k, text)
    assert set(kinds) == {"phone", "email", "card", "ip", "iban", "secret", "name"}
    for original in ("555-8791", "Ann.b3", "4111 1111", "10.1.2.3", "3704 0044", "f3ef4d6b", "Smith", "John", "Jane", "Петров"):
        assert original not in new
    a, b = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", new)
    assert a == b  # one number in two notations
    card = re.sub(r"\D", "", re.search(r"card ([\d ]+)", new)[1])
    assert pii.is_card(card) and pii.iban_number(re.search(r"IBAN ([A-Z\d ]+),", new)[1].replace(" ", "")) == 1
    assert len(re.findall(r"\b" + re.search(r"Mr \w+ (\w+)", new)[1] + r"\b", new)) == 3
    assert re.search(r"Mrs (\w+)", new)[1].endswith("na") and re.search(r"господин (\w+)", new)[1] in pii.GIVEN["cyrillic", "m"]
    assert pii.replaced(k, text) == (new, kinds) and pii.replaced(pii.Keyed("other"), text)[0] != new


def test_surrogates_are_distinct_and_clean_texts_stay(spark):
    k = pii.Keyed("x")
    assert len({k.text("d", f"{i:04d}") for i in range(10_000)}) == 10_000
    for domain in ([f"{i:03d}" for i in range(1000)], [a + b for a in pii.ALPHABETS[1] for b in pii.ALPHABETS[1]], list("0123456789")):
        made = [k.text("e", x) for x in domain]
        assert sorted(made) == sorted(domain) and all(x != y for x, y in zip(domain, made, strict=True))  # a permutation without fixed points
    assert len({tuple(k.walk("ip", [1, 2, i // 256, i % 256], [256] * 4, lambda v: 1 <= v[0] <= 223)) for i in range(3000)}) == 3000
    clean = ["Order 1234567890123456 of 2024-01-05, v1.2.3.4.5 at 12:30; mit 3.5%", "", "Ms"]
    assert [pii.replaced(k, t) for t in clean] == [(t, []) for t in clean]
    got = pii.surrogates(docs(spark, [*EDGES, "a@b.co " * 3]), "x").orderBy("doc_id").collect()
    assert [r.text for r in got[:7]] == EDGES and got[7].n_entities == 3 and got[7].kinds == ["email"]
    assert pii.cleaned(docs(spark, EDGES), "x").columns == ["doc_id", "text", "source", "score", "n"]


def test_cards_stay_with_their_issuer():
    k = pii.Keyed("x")
    for card in ("4111 1111 1111 1111", "5105105105105100", "2223003122003222", "3782-822463-10005", "6011111111111117", "30569309025904", "36148900647913"):
        new, kinds = pii.replaced(k, f"pay {card} now")
        if kinds:
            a, b = (re.sub(r"\D", "", x) for x in (card, new))
            assert pii.is_card(b) and a != b and a[: pii.issuer(a)] == b[: pii.issuer(a)] and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"pay {card} now")
        else:
            assert not pii.is_card(re.sub(r"\D", "", card))


def test_names_are_distinct_and_one_in_all_documents():
    k = pii.Keyed("x")
    words = ["".join(w) for n in (2, 3) for w in itertools.product("abcdefgh", repeat=n)] + ["Müller", "Muller", "O'Neil", "Oneil", "Jean-Luc", "Иванов", "Петров", "Παππας"]
    made = [pii.surname(k, w.capitalize()) for w in words]
    assert len(set(made)) == len(words) and not set(made) & {w.capitalize() for w in words}
    assert all(pii._script(a) == pii._script(b) for a, b in zip(words, made, strict=True))
    for gender in "fmn":
        names = [*pii.GIVEN["latin", gender], "Jane", "Bob", "Kim-Lee", "Zoë"]
        given = [pii.given_name(k, n, gender) for n in names]
        assert len(set(given)) == len(names) and not any(a == b for a, b in zip(names, given, strict=True))
    one, two = (pii.replaced(k, t)[0] for t in ("Mrs Jane Smith is here.", "We met Dr Bob Smith and Ms Jane Miller"))
    assert re.search(r"Mrs (\w+) (\w+)", one).groups() == (re.search(r"Ms (\w+)", two)[1], re.search(r"Dr \w+ (\w+)", two)[1])


def test_mentions_of_names():
    k = pii.Keyed("x")
    rose, tall = pii.given_name(k, "Rose", "m"), pii.surname(k, "Tall")
    cases = {
        "Mr Rose Tall came. Rose will bloom; so Rose said, and Tall too.": f"Mr {rose} {tall} came. Rose will bloom; so {rose} said, and {tall} too.",
        "Mr Rose Tall and a rose. The Rose is red.": f"Mr {rose} {tall} and a rose. The Rose is red.",
        "Mr Tall came. Rose Tall went.": f"Mr {tall} came. Rose {tall} went.",
        "contact Alice Doe in Paris, or Doe": f"contact {pii.given_name(k, 'Alice', 'f')} {pii.surname(k, 'Doe')} in Paris, or {pii.surname(k, 'Doe')}",
        "Paris and Alice in a text": "Paris and Alice in a text",
    }
    assert {t: pii.replaced(k, t)[0] for t in cases} == cases


def test_surrogates_of_long_texts_take_linear_time():
    k = pii.Keyed("x")
    text = " ".join(f"Mr Ab{chr(97 + i % 26)} Cd said a{i}@b.co to Cd or 10.1.{i % 250}.9" for i in range(6000))
    began = time.time()
    new, kinds = pii.replaced(k, text)
    assert time.time() - began < 60 and len(new.split()) == len(text.split()) and "Cd" not in new.split()


def test_the_session_names_the_key(spark):
    one = pii.session_key(spark)
    assert len(one) == 64 and pii.session_key(spark) == one
    spark.conf.set(pii.KEY_CONF, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY_CONF)


# -- 8


@pytest.mark.parametrize("cell", [3, 4096])
def test_shards_keep_mixture_and_counts(spark, cell):
    rows = [(i, "t" * (i % 5) if i % 11 else None, None if i % 13 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(403)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.proportional_shards(df, 8, rows_per_cell=cell).collect()
    assert sorted(r.doc_id for r in got) == list(range(403))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    hot = [sum(r.stratum == "shot" for r in v) for v in by.values()]
    assert max(hot) - min(hot) <= 2
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    # brute force of the order
    draw = lambda i: int(hashlib.md5(f"tessera-shards-1|{i}|{text[i]}".encode()).hexdigest()[:15], 16)
    strata = collections.defaultdict(list)
    for i, _, s, _ in rows:
        strata["n" if s is None else "s" + s].append(i)
    place = [((k + 0.5) / len(v), s, k, i) for s, v in strata.items() for k, i in enumerate(sorted(v, key=draw))]
    assert [x[3] for x in sorted(place)] == [r.doc_id for r in sorted(got, key=lambda r: r.position)]


def test_shards_of_rows_without_ids_lie_apart(spark):
    rows = [(None if i % 2 else 7, f"text {i}", "one") for i in range(400)] + [(1, "same", "one")] * 30
    got = sharding.proportional_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8, rows_per_cell=5).collect()
    assert sorted(r.position for r in got) == list(range(430))
    by = collections.Counter(r.shard for r in got if r.doc_id == 7)
    assert len(by) == 8 and max(by.values()) < 45


def test_shards_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.proportional_shards(df).count() == 0


# -- 9


def test_codec_equals_the_library(spark):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_codec.Codec(open(path, "rb").read())
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "日", "😀", "the", "ing", "1", "23", "\0", "==", "aaaa", "<0x41>", "<s>", "ll", "ß", "한"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["", " ", "a" * 5000, " " * 77, "▁" * 40, "ab" * 900, "x" * 200_000]
    for t, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == lib.encode(t)
        assert codec.decode(ids) == lib.decode(lib.encode(t))
    for ids in ([1, 2], [0, 5, 300], [3 + 0xE2, 3 + 0x82, 300, 3 + 0xFF], [259, 262], [3 + 0x20, 262]):
        assert codec.decode(np.array(ids)) == lib.decode(ids)
    got = sentencepiece_codec.encode(docs(spark, EDGES), path).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [[1, *lib.encode(t or ""), 2] for t in EDGES]


# -- 10

PAGE = '<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/{i}">n{i}</a></li></ul></nav><!-- c --><div class="ad">Buy {i}</div><{main}><h1>H{i} &amp; co</h1><p><b>one&nbsp;{i}<br>two{i}<p>three{i}<script>var t="</p>";</script></p><form>f</form><div class="comments">no</div></{main}><footer>&copy; {i}</footer></body></html>'


def test_extraction(spark):
    pages = [(i, f"http://host{i % 2}.x/{i}", PAGE.format(i=i, main="article" if i % 2 else 'div class="body"')) for i in range(12)]
    pages += [(20, None, None), (21, "::bad", ""), (22, "http://one.x/", "plain <i>te</i>xt &lt;b&gt; <unclosed"), (23, "http://two.x", "<main>m<aside>a</aside></main> after"), (20, None, None)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert all(got[i] == f"H{i} & co one {i} two{i} three{i}" for i in range(12)), got
    assert got[20] == got[21] == "" and got[23] == "m"
    assert got[22].startswith("plain text <b>")
    assert html_extract.extract_pages(df.filter("false")).count() == 0


def test_vectors_group_tokens():
    one, list_ = (7, 1, 4, 4), (8, 1, 4, 9)
    rows = [("", one), (">a", one), (">a>b", one), (">a>b x", one), (">a>c", list_), (">a>c>d", list_), (">a>b>e", list_), (">a>f", (9, 1, 1, 1))]
    template = html_extract.Template([(t, *v, 0, 0) for t, v in rows])
    assert template.classes == {(one, ""): [">a", ">a>b", ">a>b x"], (list_, ">a"): [">a>c", ">a>b>e", ">a>c>d"]}
    assert template.parent == {">a": "", ">a>b": ">a"}


HOST = '<html><body><div class="top">Latest</div><{main}><h1>Title {i}</h1><p>Text <b>and</b> more of page {i}, said <i>and</i> done.</p><p>Subscribe to our <b>letter</b> today, it is free of charge</p><p>End {i}</p></{main}><div>We keep small files on your device to make this site work well</div></body></html>'


def templates_of(pages):
    parts = html_extract._statistics([pa.RecordBatch.from_pydict({"i": [i for i, _, _ in pages], "u": [u for _, u, _ in pages], "h": [h for _, _, h in pages]})])
    return {host: html_extract.Template([tuple(r.values())[1:] for b in parts for r in b.to_pylist() if r["host"] == host]) for host in {html_extract.host_of(u) for _, u, _ in pages}}


@pytest.mark.parametrize("main", ["article", "div"])
def test_template_text_goes_inside_the_slot(main):
    pages = [(i, f"http://a.x/{i}", HOST.format(i=i, main=main)) for i in range(4)]
    template = templates_of(pages)["a.x"]
    for i, _, page in pages:
        got, decided = html_extract.extract(page, template)
        assert decided == "slot" and got == f"Title {i} Text and more of page {i}, said and done. End {i}"
        template_words, template_blocks = template.words, template.blocks
        template.words, template.blocks = set(), set()
        assert "Subscribe to our letter today" in html_extract.extract(page, template)[0]
        template.words, template.blocks = template_words, template_blocks
    copies = [(i, "http://b.x/", HOST.format(i=1, main=main)) for i in range(4)]
    assert "Title 1" in html_extract.extract(copies[0][2], templates_of(copies)["b.x"])[0]


def test_sibling_containers_are_all_read():
    page = '<html><body><nav>n</nav><div class="top"><h1>Title {i}</h1><div class="lead">lead {i} of it</div><div class="text">{body}</div></div><footer>f {i}</footer></body></html>'
    pages = [(i, f"http://a.x/{i}", page.format(i=i, body=f"body {i} " * 40)) for i in range(4)]
    template = templates_of(pages)["a.x"]
    assert template.root == ">html>body>div.top"
    assert [html_extract.extract(h, template)[0].split(" body")[0] for _, _, h in pages] == [f"Title {i} lead {i} of it" for i in range(4)]


NAMELESS = '<html><body><div class="a1"><a href="/x{i}">first {i}</a> <a href="/y{i}">second link {i}</a></div><div class="a2">{ad}</div><div class="a3"><div class="b0">Set in lead {i}, and what this page is about is said in so many words</div><div class="b1">{text}</div><div class="b2">Ask us for more</div></div><div class="a4">{i} (c) a company</div></body></html>'


def test_slots_choose_where_names_say_nothing(spark):
    text = lambda i: "".join(f"<div>Part {k} of the text of page {i}, which goes on for a while.</div>" for k in range(40 + i))
    pages = [(i, f"http://a.x/{i}", NAMELESS.format(i=i, ad=f"Buy {i}", text=text(i))) for i in range(5)]
    want = {i: " ".join([f"Set in lead {i}, and what this page is about is said in so many words", *(f"Part {k} of the text of page {i}, which goes on for a while." for k in range(40 + i))]) for i in range(5)}
    df = spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string")
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == 7 and all(r.text == want[r.page_id] and r.decided == "slot" for r in rows)
    for i, _, page in pages:  # names alone would read all of the page
        got, decided = html_extract.extract(page)
        assert decided == "names" and got != want[i] and f"Buy {i}" in got and "second link" in got
    template = templates_of(pages)["a.x"]
    assert template.root == ">html>body>div.a3" and template.left_out == {">html>body>div.a3>div.b2"}


def test_deep_pages_and_stray_tags():
    deep = "<div>" * 3000 + "the text</p> within" + "</div>" * 2990 + " after" + "</div>" * 10
    counts, mass = html_extract.page_tokens(deep)
    assert max(map(len, counts)) < 200 and mass[""] == [len("the text within after"), 0]
    assert html_extract.extract(deep)[0] == "the text within after"
    stray = '<div class="ad">buy</p></div><div>kept</div>'
    assert html_extract.page_tokens(stray)[1][""][0] == 4 and html_extract.extract(stray)[0] == "kept"


def test_joined_templates_go_by_the_same_host(spark, monkeypatch):
    urls = ["http://under_score.x/{i}", "http://ü.x/{i}", "http://a.x/{i}|b c", "http://A.x/{i}", "{i}"]
    pages = [(10 * k + i, u.format(i=i), HOST.format(i=i, main="div")) for k, u in enumerate(urls) for i in range(4)]
    df = spark.createDataFrame([*pages, (99, None, "alone")], "page_id long, url string, html string")
    sent = html_extract.extract_pages(df).collect()
    monkeypatch.setattr(html_extract, "MAX_BROADCAST", 0)
    assert sorted(html_extract.extract_pages(df).collect(), key=lambda r: r.page_id) == sorted(sent, key=lambda r: r.page_id)
    assert all("Subscribe" not in r.text for r in sent if r.page_id < 40)


# -- pipeline


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    model = quality.fit_on(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.scored(documents, model).collect()}
    good = [(i, t) for i, t in rows if score[i] >= quality.CUT]
    comp = brute_components(good)
    left = [(i, t) for i, t in good if comp[i][1] == i]
    items = [decontamination.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def holds(t):
        own = decontamination.WORD.findall(t.lower())
        own = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
        return any(len(s & own) >= 0.75 * len(s) for s in ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in items) if s)

    keyed = pii.Keyed(pii.session_key(spark))
    expected = {i: pii.replaced(keyed, t)[0] for i, t in left if not holds(t)}
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == expected
