"""Scalar functions on the edge cases."""

from pyspark.sql import functions as F

from tessera.functions import cleaning as C
from tessera.operators import annotations as A


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_cleaning_edges(spark):
    assert values(spark, [None, "", "aB-1*", "x (a) (b"], C.clean_sequence) == ["", "", "AB", "XAB"]
    assert values(spark, ["x (a) (b", "a (b)c"], C.strip_parens) == ["x (b", "ac"]
    assert values(spark, [None, " ", "NA", "n/a", "None", " x "], C.normalize_na) == [None, None, None, None, None, "x"]
    assert values(spark, ["http://a/b#c", "http://a/b/", "plain"], C.uri_fragment) == ["c", "http://a/b/", "plain"]
    assert values(spark, ["CHEBI_1", "chebi:1", "http://x/CHEBI_1", "NIL", ""], lambda c: C.canon_search(c, "CHEBI")) == ["CHEBI:1"] * 3 + [None, None]
    assert values(spark, ["CLO:1;CLO:2", ";CLO:2"], C.first_candidate) == ["CLO:1", None]
    assert values(spark, ["", "AAB"], C.max_residue_fraction) == [0.0, 2 / 3]


def test_split_is_sequential(spark):
    got = values(spark, ["a and b or c", "a or and b", "And", " ; , ", None], A.split_values)
    assert got == [["a", "b", "c"], ["a or", "b"], ["And"], [None], [None]]
    assert values(spark, ["a, b and c"], lambda c: A.split_values(c, True)) == [["a, b", "c"]]


def test_classifiers(spark):
    assert values(spark, ["clathrin independent", "clathrin", "draft", None], A.classify_sub) == ["Clathrin and caveolae independent", "Clathrin-mediated endocytosis", None, None]
    assert values(spark, ["draft", "translocation and raft", "x"], A.classify_main) == ["Endocytosis", "Direct penetration, Endocytosis", None]


def test_padding_never_truncates(spark):
    df = spark.createDataFrame([(7,), (12345,)], "n int")
    assert [r[0] for r in df.select(C.padded_id("x", F.col("n"))).collect()] == ["x0007", "x12345"]


def test_json_repair(spark):
    whole = '```json\n{"a":{"curie":"X:1","label":"l"}}\n```'
    cut = '{"a":{"curie":"X:1","label":"l"},"b":{"curie":"X'
    got = values(spark, [whole, cut, "sorry", None], lambda c: F.map_keys(C.json_reply(c)))
    assert got == [["a"], ["a"], [], []]


def test_publication(spark):
    df = spark.createDataFrame([("12.0", "US 1"), ("0", "US 1"), ("x", " "), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(C.publication_iri(F.col("a"), F.col("b"))).collect()] == ["http://identifiers.org/pubmed:12", "US1", None, None]


def test_allocation_reaches_the_total():
    for sizes, total in (({"a": 500, "b": 300, "c": 40, "d": 10}, 300), ({"a": 5}, 10), ({}, 3), ({"a": 100, "b": 100}, 40)):
        got = A.allocate(sizes, total)
        assert sum(got.values()) == min(total, sum(sizes.values())) and all(got[k] <= n for k, n in sizes.items())


def test_preprocessor_report(spark):
    df = spark.createDataFrame([("aK", "x", "y"), ("BB", None, "z")], "Sequence string, a string, b string")
    p = A.Preprocessor(df, required=("a",)).clean_sequences().normalize()
    report = p.validate(columns=["a", "nope"], complete=["a", "b"])
    assert report["n"] == 2 and report["missing a"] == 1 and report["column_missing"] == ["nope"] and report["complete_count"] == 1
    assert [r.Sequence for r in p.filter_valid().df.collect()] == ["AK"]


def test_sample_has_the_smallest_draws_of_each_stratum(spark):
    import hashlib

    from tessera.operators import annotations as A

    rows = [("abc"[i % 3] if i % 10 else None, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "stratum string, value string")
    sizes = {"a": 7, "b": 100, "c": 0}
    draw = lambda v: (hashlib.md5(f"5|{v}".encode()).hexdigest(), v)
    expected = {(s, v) for s, n in sizes.items() for v in sorted((v for t, v in rows if t == s), key=draw)[:n]}
    assert {tuple(r) for r in A.stratified_sample(df, "stratum", "value", sizes, 5).collect()} == expected
    assert A.stratified_sample(df, "stratum", "value", {}, 5).count() == 0
