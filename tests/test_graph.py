"""Reasoner, construction, parsers and shapes on small graphs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import linking, metrics, shapes
from tessera.plans import graph_build as B
from tessera.plans import graph_query as Q
from tessera.plans import reasoner
from tessera.sources import readers, writers

TRIPLE = "s string, p string, o string, s_kind string, o_kind string, o_lang string, o_dt string"


def graph(spark, rows):
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    return spark.createDataFrame([(s, p, o, kind(s), kind(o), None, None) for s, p, o in rows], TRIPLE)


@pytest.mark.parametrize("limit", [0, 1000])
def test_closure_of_chain_diamond_and_cycle(spark, limit):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "q")], "child string, parent string")
    got = {tuple(r) for r in reasoner.closure(edges, max_local=limit).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y"), ("z", "z")}


def test_rules_in_order(spark):
    sub, typ, on, some = V.SUB_CLASS_OF, V.RDF_TYPE, V.ON_PROPERTY, V.SOME_VALUES_FROM
    g = graph(spark, [("C", sub, "D"), ("i", typ, "C"), ("D", sub, "_:r"), ("_:r", on, "p"), ("_:r", some, "V"), ("j", typ, "_:q"), ("_:q", on, "p"), ("_:q", some, "W"), ("k", typ, "_:h"), ("_:h", on, "p")])
    full, counts = reasoner.materialize(g)
    rows = {(r.s, r.p, r.o) for r in full.collect()}
    assert ("j", "p", "W") in rows and ("i", typ, "D") in rows and ("i", typ, "_:r") in rows
    assert ("i", "p", "V") not in rows  # inherited restrictions are not unfolded
    assert {r.rule: r.n for r in counts.collect()} == {"subclass_closure": 1, "unfold_restrictions": 1, "propagate_types": 2}


def test_star_matches_its_constant(spark):
    g = graph(spark, [("a", "p", "b")])
    assert {tuple(r) for r in Q.path_star(g, "p", "nowhere").collect()} == {("nowhere", "nowhere")}


def test_equal_restrictions_are_one(spark):
    df = spark.createDataFrame([("x",), ("x",)], "s string")
    assert B.union([B.triples_of(df, B.some_values(F.col("s"), "is_about", "m"))]).count() == 4


def test_ntriples_round_trip(spark):
    g = spark.createDataFrame([("a", "p", 'q "x"\n\\', "iri", "lit", "en", None), ("_:b", "p", "o", "bnode", "iri", None, None)], TRIPLE)
    back = readers.parse_ntriples(writers.ntriples(g))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in g.collect()}


def test_turtle(spark):
    text = '@prefix x: <http://x/> .\nx:a a x:C ; x:p [ x:q "v\\n"@en , 5 ] , x:b . # end\n'
    got = {(r.s, r.p, r.o, r.o_lang) for r in readers.turtle_to_triples(spark, text).collect()}
    assert got == {("http://x/a", V.RDF_TYPE, "http://x/C", None), ("_:b1", "http://x/q", "v\n", "en"), ("_:b1", "http://x/q", "5", None), ("http://x/a", "http://x/p", "_:b1", None), ("http://x/a", "http://x/p", "http://x/b", None)}


def test_nothing_inferred_raises(spark, tmp_path):
    g = graph(spark, [("a", "p", "b")])
    with pytest.raises(ValueError):
        writers.write_materialized(g, g, f"file://{tmp_path}/g")


def test_replace_keeps_one_backup(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    writers.replace_table(spark.range(5), path)
    writers.replace_table(spark.range(7), path)
    assert (spark.read.parquet(path).count(), spark.read.parquet(path + ".bak").count()) == (7, 3)


def test_shapes_report_counts_and_strangers(spark):
    good = [("d", V.RDF_TYPE, shapes.K["document"]), ("d", V.RELATIONS["describes"], "e")]
    assert shapes.validate(graph(spark, good)).count() == 0
    bad = graph(spark, [*good, ("d", V.RDF_TYPE, "Other")])
    assert [r.reason for r in shapes.validate(bad).collect()] == [f"{V.RDF_TYPE}: unexpected Other"]
    status = {r.shape: r.status for r in shapes.summary(bad).collect()}
    assert status["Document"] == "failed" and status["Gene"] == "skipped"


def test_golden_confusion_counts(spark):
    """Counts of a gold standard of 300 terms: 78 right, 26 wrong, 186 abstained, 10 rightly without an id."""
    rows = [("a", "a")] * 78 + [("a", "b")] * 26 + [("a", None)] * 186 + [(None, None)] * 10
    df = spark.createDataFrame(rows, "gold string, pred string")
    r = metrics.prf(metrics.confusion_nil_aware(df, "gold", "pred")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (78, 26, 186, 10)
    assert (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3), round(r.accuracy, 3)) == (0.75, 0.295, 0.424, 0.293)
    old = metrics.prf(metrics.confusion_legacy(df, "gold", "pred")).first()
    assert (old.fn, round(old.f1, 4)) == (196, 0.4127)


def test_kappa_of_one_label_is_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert metrics.cohen_kappa(df, "a", "b").first().kappa == 1.0


def test_indel_ratio():
    assert round(linking.indel_ratio("red plate", "red plates"), 3) == 0.947
    assert round(linking.indel_ratio("kitten", "sitting"), 3) == 0.615
    assert linking.indel_ratio("", "") == 1.0


def test_lexicon_conflicts(spark):
    terms = spark.createDataFrame([(1, "T:1", "alpha cell"), (2, "T:2", "beta"), (3, "T:3", "beta")], "ord long, curie string, label string")
    syn = spark.createDataFrame([(1, "T:1", "alpha cell", "beta"), (2, "T:2", "beta", "gamma"), (3, "T:3", "beta", "gamma")], "ord long, curie string, label string, synonym string")
    got = {r.key: (r.curie, r.match_type) for r in linking.lexicon(terms, syn).collect()}
    assert got == {"alpha cell": ("T:1", "exact_pref"), "alpha": ("T:1", "exact_pref"), "beta": ("T:3", "exact_pref"), "gamma": ("T:2", "exact_syn")}


def test_fuzzy_threshold(spark):
    lex = spark.createDataFrame([("red plates", "T:1", "red plates"), ("blue", "T:2", "blue")], "key string, curie string, label string")
    m = spark.createDataFrame([("plate red",), ("green",), ("",)], "mention string")
    got = {r.mention: (r.curie, r.score) for r in linking.link_fuzzy(m, lex).collect()}
    assert got == {"plate red": ("T:1", 0.9474), "green": (None, 0.0), "": (None, 0.0)}


@pytest.mark.parametrize("name", ["bfs_context", "context_block"])
def test_every_nation_is_a_seed(name, spark, sf):
    from tessera.queries import all_queries

    found = all_queries()[name](spark, sf)
    assert {r.query_id for r in found.select("query_id").collect()} == {r.n_nationkey for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}


def walk(seeds, edges, cap):
    """The capped walk over the whole graph, in one process."""
    up, down = {}, {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
        down.setdefault(p, set()).add(c)
    met = {s: "seed" for s in list(dict.fromkeys(seeds))[:cap]}
    queue = list(met)
    while queue and len(met) < cap:
        node = queue.pop(0)
        steps = [(p, "parent") for p in sorted(up.get(node, ()))] + [(c, "child") for c in sorted(down.get(node, ()))]
        steps += [(s, "sibling") for p in sorted(up.get(node, ())) for s in sorted(down.get(p, ())) if s != node]
        for other, relation in steps:
            if len(met) < cap and other not in met:
                met[other] = relation
                if relation != "sibling":
                    queue.append(other)
    return list(met.items())


@pytest.mark.parametrize("cap", [4, 15])
def test_context_has_no_depth_limit(spark, cap):
    import random

    rng = random.Random(cap)
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]  # a chain
    edges += [(f"w{i:03d}", "hub") for i in range(200)] + [("hub", "top"), ("other", "top")]  # a wide one
    edges += list({(f"r{rng.randrange(60):02d}", f"r{rng.randrange(60):02d}") for _ in range(70)})
    seeds = {0: ["n00"], 1: ["n14"], 2: ["w003"], 3: ["hub", "n29"], 4: ["alone"]} | {10 + i: [f"r{rng.randrange(60):02d}" for _ in range(rng.randrange(1, 4))] for i in range(12)}
    rows = [(q, k, c) for q, cs in seeds.items() for k, c in enumerate(cs)]
    names = {c for e in edges for c in e}
    got = linking.bfs_context(
        spark.createDataFrame(rows, "query_id long, rank int, curie string"), spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame([(n, n.upper()) for n in names], "curie string, label string"), cap
    ).collect()
    for q, cs in seeds.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.place)
        assert [(r.curie, r.relation) for r in mine] == walk(cs, edges, cap)
        assert all(r.label == (r.curie.upper() if r.curie in names else None) for r in mine)


def test_obo_keeps_to_terms(spark, tmp_path):
    text = "[Typedef]\nid: rel\nis_a: X:9\n\n[Term]\nid: X:1\nname: one\n\n[Instance]\nid: i\nsynonym: \"no\" EXACT []\n\n[Term]\nid: X:2\nname: two\nis_a: X:1 ! one\n\n[Typedef]\nid: part_of\nis_a: X:7\n"
    for name, t in (("a", text), ("b", text[text.index("[Term]") :])):
        (tmp_path / name).write_text(t)
        got = sorted((r.curie, r.label, r.synonyms, r.parents) for r in readers.read_obo(spark, f"file://{tmp_path}/{name}").collect())
        assert got == [("X:1", "one", [], []), ("X:2", "two", [], ["X:1"])]


def test_fuzzy_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    keys = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)} | {"aaaaaaaaaaaaaaaaaaaaaaaa", "a"})

    def typo(t):
        k = rng.randrange(len(t))
        return rng.choice([t[:k] + rng.choice("abc") + t[k:], t[:k] + t[k + 1 :], " ".join(reversed(t.split(" "))), t])

    asked = sorted({m for t in keys for m in (typo(t), typo(typo(t) or "x") if t else "x")} - {""})
    lex = spark.createDataFrame([(t, f"T:{i}", t) for i, t in enumerate(keys)], "key string, curie string, label string")
    got = {r.mention: (r.score, r.label) for r in linking.link_fuzzy(spark.createDataFrame([(m,) for m in asked], "mention string"), lex).collect()}
    sort = lambda t: " ".join(sorted(t.split()))
    for m in asked:
        scores = [(linking.indel_ratio(sort(" ".join(m.split())), sort(t)), t) for t in keys]
        best = max(x for x, _ in scores)
        if m.strip() and best >= 0.92:
            assert got[m] == (pytest.approx(best, abs=1e-4), min(t for x, t in scores if x == best))
        else:
            assert got[m] == (0.0, None)


def test_all_methods_of_linking(spark):
    terms = spark.createDataFrame([(1, "T:1", "red cell"), (2, "T:2", "blue plate"), (3, "T:3", "green thing")], "ord long, curie string, label string")
    syn = spark.createDataFrame([(1, "T:1", "red cell", "erythrocyte")], "ord long, curie string, label string, synonym string")
    edges = spark.createDataFrame([("T:2", "T:3")], "child string, parent string")
    m = spark.createDataFrame([(x,) for x in ("RED", "blue plates", "red_5nM", "a blue plat thing", "", "erythrocyte", "no idea")], "mention string")
    said = {"a blue plat thing": "T:2", "no idea": "NONE"}

    def client(rows):
        assert all("Candidates:" in block for _, block in rows)
        return [{"a blue plat thing": "T:2", "no idea": "NONE"}.get(x, "X:9") for x, _ in rows]

    rows = {r.mention: r for r in linking.link_all(m, terms, syn, edges, ["exact", "rag"], client=client).collect()}
    assert len(rows) == 7 and said
    assert [(rows[x].exact_curie, rows[x].exact_match_type) for x in ("RED", "blue plates", "red_5nM", "erythrocyte", "", "no idea")] == [("T:1", "exact_pref"), ("T:2", "fuzzy"), ("T:1", "prefix_truncated"), ("T:1", "exact_syn"), (None, "NIL"), (None, "NIL")]
    assert rows["RED"].biosyn_match_type == rows["RED"].rag_match_type == "exact_pref" and rows[""].biosyn_curie is None
    assert rows["a blue plat thing"].biosyn_match_type == "dense_nn" and (rows["a blue plat thing"].rag_curie, rows["a blue plat thing"].rag_match_type) == ("T:2", "rag_selected")
    assert rows["no idea"].rag_match_type == "rag_abstained" and rows["blue plates"].rag_match_type == "rag_hallucinated"
    with pytest.raises(ValueError):
        linking.link_all(m, terms, syn, edges, ["rag"])


def test_sparql_beyond_joins(spark):
    from tessera.plans.sparql import sparql

    lit = lambda s, p, o, lang=None: (s, p, o, "iri", "lit", lang, None)
    rows = [lit("x:a", "x:l", "red", "en"), lit("x:a", "x:l", "rot", "de-AT"), lit("x:b", "x:l", "blue"), lit("x:c", "x:n", "7"), ("x:a", "x:k", "x:b", "iri", "iri", None, None)]
    g = spark.createDataFrame(rows, TRIPLE)
    ask = lambda q: sorted(tuple(r) for r in sparql(g, q).collect())
    assert ask("SELECT ?l WHERE { ?s <x:l> ?l FILTER(LANG(?l) = 'en') }") == [("red",)]
    assert ask("SELECT ?l WHERE { ?s <x:l> ?l FILTER(LANGMATCHES(LANG(?l), 'DE')) }") == [("rot",)]
    assert ask("SELECT ?s ?l WHERE { ?s <x:k> ?o . ?s ?p ?l FILTER(LANG(?l) != '') }") == [("x:a", "red"), ("x:a", "rot")]
    assert ask("SELECT ?l ?n WHERE { ?s <x:l> ?l . ?t <x:n> ?n FILTER(LANG(?l) = '') }") == [("blue", "7")]
    assert ask("SELECT ?l ?z WHERE { ?s <x:l> ?l FILTER(?l = 'blue') OPTIONAL { ?t <x:none> ?z } }") == [("blue", None)]
    assert ask("SELECT ?s WHERE { ?s <x:l> ?l FILTER NOT EXISTS { ?s <x:k> ?o } }") == [("x:b",)]
    assert ask("SELECT DISTINCT ?s WHERE { ?s <x:l> ?l FILTER EXISTS { ?s <x:k> ?o } }") == [("x:a",)]
    assert ask("SELECT DISTINCT ?s WHERE { ?s <x:k> ?l MINUS { ?t <x:n> ?n } }") == [("x:a",)]
    assert ask("ASK { ?s <x:n> '7' }") == [(True,)] and ask("ASK WHERE { ?s <x:n> '8' }") == [(False,)]
    assert ask("SELECT (STRBEFORE(?s, ':') AS ?h) (STRAFTER(?s, ':') AS ?t) (SUBSTR(?s, 3) AS ?u) WHERE { ?s <x:n> ?n }") == [("x", "c", "c")]


def test_rdf_xml_in_and_out(spark, tmp_path):
    import xml.etree.ElementTree as ET

    text = """<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b">
    <owl:Class rdf:about="http://x/A"><rdfs:label xml:lang="en">a</rdfs:label><oboInOwl:hasExactSynonym>aa</oboInOwl:hasExactSynonym></owl:Class>
    <owl:Class rdf:about="http://x/B"><rdfs:label>b</rdfs:label><rdfs:subClassOf rdf:resource="http://x/A"/>
      <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/p"/><owl:someValuesFrom rdf:resource="http://x/C"/></owl:Restriction></rdfs:subClassOf></owl:Class>
    <owl:NamedIndividual rdf:about="http://x/i"><rdf:type rdf:resource="http://x/B"/></owl:NamedIndividual></rdf:RDF>"""
    (tmp_path / "g.owl").write_text(text)
    g = readers.load_graph(spark, [f"file://{tmp_path}/g.owl"])
    rows = {(r.s, r.p, "_" if r.o_kind == "bnode" else r.o, r.o_lang) for r in g.collect() if not r.s.startswith("_:")}
    sub, typ = V.SUB_CLASS_OF, V.RDF_TYPE
    assert rows == {
        ("http://x/A", typ, f"{V.OWL}Class", None), ("http://x/B", typ, f"{V.OWL}Class", None), ("http://x/A", V.RDFS_LABEL, "a", "en"), ("http://x/B", V.RDFS_LABEL, "b", None), ("http://x/A", V.EXACT_SYNONYM, "aa", None),
        ("http://x/B", sub, "http://x/A", None), ("http://x/B", sub, "_", None), ("http://x/i", typ, f"{V.OWL}NamedIndividual", None), ("http://x/i", typ, "http://x/B", None),
    }
    held = {(r.p, r.o) for r in g.collect() if r.s.startswith("_:")}
    assert held == {(typ, f"{V.OWL}Restriction"), (V.ON_PROPERTY, "http://x/p"), (V.SOME_VALUES_FROM, "http://x/C")}
    more = g.unionByName(spark.createDataFrame([("http://x/A?a=1&b", "http://x/q#z", 'a < "b" & c', "iri", "lit", None, "http://x/t")], TRIPLE))
    writers.write_rdf_xml(more.repartition(2), f"file://{tmp_path}/out")
    back = set()
    for part in (tmp_path / "out").glob("part-*"):
        for d in ET.fromstring(part.read_text()):
            ns = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
            (one,) = d
            back.add((d.get(f"{ns}about") or "_:" + d.get(f"{ns}nodeID")[1:], one.tag[1:].replace("}", ""), one.get(f"{ns}resource") or (one.get(f"{ns}nodeID") and "_:" + one.get(f"{ns}nodeID")[1:]) or one.text))
    assert back == {(r.s, r.p, r.o) for r in more.collect()}


def test_graph_of_parts_gives_what_a_table_of_triples_gives(spark):
    rows = spark.createDataFrame([("x", "m"), ("y", "n"), ("z", None), (None, "m")], "s string, o string")
    s, o = F.col("s"), F.col("o")
    up = B.triples_of(spark.createDataFrame([("m", "top"), ("C", "D")], "s string, o string"), [B.iri(s, V.SUB_CLASS_OF, o)])
    parts = B.together(B.triples_of(rows, [B.iri(s, V.RDF_TYPE, "C"), B.literal(s, V.RDFS_LABEL, o), *B.some_values(s, "is_about", o)]), up)
    table = spark.createDataFrame(parts.collect(), TRIPLE)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    for p in (V.RDF_TYPE, V.RDFS_LABEL, V.ON_PROPERTY, V.SOME_VALUES_FROM, V.SUB_CLASS_OF, "none"):
        assert same(B.of(parts, p), B.of(table, p))
    assert same(B.of(parts, V.RDF_TYPE, "C"), B.of(table, V.RDF_TYPE, "C"))
    assert same(Q.restricted_to(parts, "is_about", "top"), Q.restricted_to(table, "is_about", "top"))
    (full, counts), (full_table, counts_table) = reasoner.materialize(parts), reasoner.materialize(table)
    assert same(full.distinct(), full_table.distinct()) and same(counts, counts_table)
    assert same(B.of(full, V.RELATIONS["is_about"]), B.of(full_table, V.RELATIONS["is_about"])) and same(B.of(full, V.RDF_TYPE, "D").distinct(), B.of(full_table, V.RDF_TYPE, "D"))
    # restrictions of a table beside parts, and a foreign restriction of a subject of the parts
    foreign = graph(spark, [("x", V.RDF_TYPE, "_:q"), ("_:q", V.ON_PROPERTY, "p"), ("_:q", V.SOME_VALUES_FROM, "W"), ("v", V.RDF_TYPE, "_:u"), ("_:u", V.ON_PROPERTY, V.RELATIONS["is_about"]), ("_:u", V.SOME_VALUES_FROM, "m")])
    both = B.together(parts, foreign)
    assert same(reasoner.unfold_restrictions(both), reasoner.unfold_restrictions(spark.createDataFrame(both.collect(), TRIPLE)))


def test_graph_queries_build_only_what_they_name(spark, sf):
    from tessera.queries.graphs import located, molecular

    assert "sha2" not in Q.preview(Q.browse(molecular(spark, sf), V.CLASSES["peptide"], "ring", 2, 20)[0])
    assert "lineitem" not in Q.preview(B.of(located(spark, sf), V.SUB_CLASS_OF)) and "pairs-" not in Q.preview(B.of(located(spark, sf), V.SUB_CLASS_OF))
    assert "sha2" not in Q.preview(Q.subsumption(B.together(molecular(spark, sf)), "is_realized_in", "x"))  # stated by rows, not joined by blank nodes


def test_unique_keeps_what_rows_state(spark):
    rows = spark.createDataFrame([("x", "m"), ("x", "m")], "s string, o string")
    g = B.unique(B.triples_of(rows, [B.iri(F.col("s"), V.RDF_TYPE, "C"), *B.some_values(F.col("s"), "is_about", F.col("o"))]))
    assert g.count() == 5 and reasoner.unfold_restrictions(g).count() == 1


def test_shuffles_start_with_more_partitions_for_larger_tables(spark, sf, monkeypatch):
    from tessera.plans import runtime

    before = spark.conf.get(runtime.INITIAL_CONF, None)
    monkeypatch.setattr(runtime, "SPREAD_BYTES", 1000)
    runtime.table(spark, sf, "lineitem")
    try:
        assert int(spark.conf.get(runtime.INITIAL_CONF)) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(runtime.INITIAL_CONF, before) if before else spark.conf.unset(runtime.INITIAL_CONF)


def test_dense_search_holds_few_scores_and_finds_the_same(spark, sf, monkeypatch):
    from tessera.queries.links import vectors

    assert all(s.stop - s.start <= max(1, linking.MAX_SCORES // 10_000) for s in linking.tiles(20_000, 10_000))
    assert [i for s in linking.tiles(7, 400_000) for i in range(7)[s]] == list(range(7))
    whole = sorted(map(tuple, linking.dense_topk(*vectors(spark, sf), k=3).collect()))
    monkeypatch.setattr(linking, "tiles", lambda queries, n: [slice(i, i + 3) for i in range(0, queries, 3)])
    assert sorted(map(tuple, linking.dense_topk(*vectors(spark, sf), k=3).collect())) == whole


def _named(spark, rows, key):
    """A graph of complexes by names, and the same one by IRIs."""
    df = spark.createDataFrame(rows, "a long, b long, m long")
    n = lambda kind, *c: B.name(V.DATASET_NS + kind, *c)
    names = {"complex": n("c", B.Num("a"), "_", B.Num("b")), "peptide": n("part", B.Num("a")), "cargo": n("supp", B.Num("b")), "mechanism": n("mech", B.Num("m"))}
    peptides = lambda s: B.triples_of(spark.range(1, 3), B.individual(s, V.CLASSES["peptide"], F.concat(F.lit("label "), F.col("id").cast("string"))))
    named = B.together(B.complexes(df, names, key), peptides(n("part", B.Num("id"))))
    plain = B.complexes(df.select(*[names[k].column().alias(k) for k in ("complex", "peptide", "cargo")], F.array(names["mechanism"].column()).alias("mechanism")).filter("complex is not null"))
    return named, B.together(plain, peptides(F.concat(F.lit(f"{V.DATASET_NS}part"), F.col("id").cast("string"))))


@pytest.mark.parametrize(("rows", "key"), [([(1, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, -1)], ("a", "b")), ([(1, 1, 0), (1, 1, 0), (1, 1, 1), (2, None, 0), (None, 1, 1)], None)])
def test_names_give_what_iris_give(spark, rows, key):
    named, plain = _named(spark, rows, key)
    table = spark.createDataFrame(plain.collect(), TRIPLE)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    if key:  # else rows with a missing part, and repeated ones, are compared with the triples of the named graph
        assert same(named, plain)
    for t in (named,) if key else ():
        assert same(Q.instance_counts(t), Q.instance_counts(table)) and same(Q.void(t).filter(~F.col("s").contains("#")), Q.void(table).filter(~F.col("s").contains("#")))
        assert same(B.node_kinds(t), B.node_kinds(table)) and same(B.graph_stats(t), B.graph_stats(table))
        assert same(Q.describe(t, f"{V.DATASET_NS}part1"), Q.describe(table, f"{V.DATASET_NS}part1"))
    relations = [("has part", "complex", "has_part"), ("peptide in complex", "peptide", "is_part_of"), ("peptide role", "peptide", "has_attribute"), ("none", "gene", "has_part")]
    whole = spark.createDataFrame(named.collect(), TRIPLE)
    for t in (whole, plain if key else whole):
        assert same(B.relation_summary(named, relations), B.relation_summary(t, relations)) and same(Q.path_seq(named, V.RELATIONS["is_part_of"], V.RELATIONS["has_part"]), Q.path_seq(t, V.RELATIONS["is_part_of"], V.RELATIONS["has_part"]))
    asked = (("?c", V.RDF_TYPE, V.CLASSES["complex"]), ("?c", V.RELATIONS["has_part"], "?p"), ("?p", V.RDF_TYPE, V.CLASSES["peptide"]))
    assert same(Q.bgp(named, *asked).select("c", "p"), Q.bgp(whole, *asked).select("c", "p"))
    (full, counts), (full_whole, counts_whole) = reasoner.materialize(named), reasoner.materialize(whole)
    assert same(full.distinct(), full_whole.distinct()) and same(counts, counts_whole)
    assert same(B.build_summary(full), B.build_summary(full_whole)) and same(Q.association_counts(full), Q.association_counts(full_whole))
    for facet, term in (("mechanism", f"{V.DATASET_NS}mech1"), ("mechanism", "label"), ("cargo", f"{V.DATASET_NS}supp1"), ("cargo", "no type")):
        assert same(Q.FACETS[facet](full, term), Q.FACETS[facet](full_whole, term))


def test_names_that_never_meet():
    a, b = B.Num("a"), B.Num("b")
    assert B.apart(B.name("x/part", a), B.name("x/supp", a)) and B.apart(B.name("x/c", a), B.name("x/cell", B.ANY)) and B.apart(B.name("x/c", a, "_", b), B.name("x/c", a, "_", b, "_role"))
    assert not B.apart(B.name("x/c", a), B.name("x/c", b)) and not B.apart(B.name("x/c", a), B.name("x/c12")) and not B.apart(B.name("x/c", a), B.name("x/", B.ANY)) and not B.apart(B.name("x/c", a), None)
    assert not B.apart(B.name("x/c", a), B.name("x/c-", B.ANY)) and not B.apart(B.name("x/c", a), (B.name("y"), B.name("x/c1")))
    with pytest.raises(ValueError):
        B.name("x", a, b)


def test_counts_by_names_shuffle_no_iris(spark, sf):
    from tessera.queries.graphs import located, molecular

    assert "Exchange" not in Q.preview(reasoner.unfold_restrictions(located(spark, sf)))
    assert "hashpartitioning" not in Q.preview(B.relation_summary(molecular(spark, sf), [("complex has part", "complex", "has_part")]))
    assert "SortMergeJoin" not in Q.preview(Q.located_below(located(spark, sf), "https://example.org/top")) and "hashpartitioning(value" not in Q.preview(Q.located_below(located(spark, sf), "https://example.org/top"))
    assert "pairs-" not in Q.preview(Q.describe(molecular(spark, sf), "https://example.org/elsewhere"))


def test_pairs_are_shuffled_as_one_number(spark, sf):
    from tessera.plans import names, runtime
    from tessera.queries.graphs import pair_keys

    odd = [(a, b) for a in (0, 7, -1, 2**39 - 1, 2**39, 2**62, None) for b in (0, 3, 2**24 - 1, 2**24, -5, None)]
    got = names.distinct_pairs(spark.createDataFrame(odd * 2, "a long, b long"))
    assert len(got.collect()) == len(odd) and {tuple(r) for r in got.collect()} == set(odd)
    assert names.distinct_pairs(spark.createDataFrame([(1, 2), (1, 2)], "a int, b long")).schema.simpleString() == "struct<a:int,b:bigint>"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey")
    assert "hashpartitioning(k" in Q.preview(names.distinct_pairs(lines)) and "IsNull(l_partkey)" in Q.preview(names.distinct_pairs(lines))
    before = spark.conf.get(runtime.ADVISORY_CONF)
    t = runtime.stored(lines, order=("l_partkey", "l_suppkey"))
    assert spark.conf.get(runtime.ADVISORY_CONF) == before and t.count() == lines.count()
    for rows in (t, pair_keys(spark, sf)):  # each file is in order
        of_file = {}
        for f, *key in rows.select(F.input_file_name(), "l_partkey", "l_suppkey").collect():
            of_file.setdefault(f, []).append(key)
        assert all(x == sorted(x) for x in of_file.values())


def test_distinct_numbers_are_shuffled_as_words(spark, sf):
    from tessera.plans import names
    from tessera.queries.graphs import molecular

    for kind, numbers in (("long", [0, 1, 63, 64, -1, -64, -65, 2**62, -(2**63), 2**63 - 1]), ("int", [0, 5, -7, 2**31 - 1, -(2**31)])):
        got = names.distinct_numbers(spark.createDataFrame([(x,) for x in numbers * 2], f"x {kind}"))
        assert sorted(r.x for r in got.collect()) == sorted(numbers) and dict(got.dtypes)["x"] == {"long": "bigint"}.get(kind, kind)
    plan = Q.preview(Q.path_seq(molecular(spark, sf), V.RELATIONS["is_part_of"], V.RELATIONS["has_part"]))
    assert "hashpartitioning(w" in plan and "hashpartitioning(l_partkey" not in plan and "hashpartitioning(l_suppkey" not in plan


def test_queries_make_only_the_rows_that_they_read(spark, sf):
    from tessera.queries.graphs import _full, molecular

    full, ns = _full(spark, sf), V.DATASET_NS
    plan = lambda df: Q.preview(df)
    assert not any(x in plan(Q.FACETS["sequence"](full, "RING")) for x in ("lineitem", "pairs-", "experiments-"))
    for facet, term in (("mechanism", f"{ns}mech1"), ("cargo", f"{ns}supp3"), ("cargo", "type 1")):  # lines once, not pairs by pairs
        found = plan(Q.FACETS[facet](full, term))
        assert "pairs-" not in found and "experiments-" not in found and "sha2" not in found
    assert "pairs-" not in plan(Q.describe(molecular(spark, sf), f"{ns}part1"))
    for facet, term in (("cell_line", f"{ns}cell_BUILDING"), ("doc_id", "pubmed:1")):
        found = plan(Q.FACETS[facet](full, term))
        assert "experiments-" in found and "pairs-" not in found and "lineitem" not in found and "hashpartitioning(l_orderkey" not in found


@pytest.mark.parametrize("decided", [True, False])
def test_filters_pass_over_only_where_the_node_decides(spark, decided):
    """Experiments of several lines: with a cell line for each order, and with several for one."""
    n = lambda kind, *c: B.name(V.DATASET_NS + kind, *c)
    a, b = B.Num("a"), B.Num("b")
    names = {"complex": n("c", a, "_", b), "peptide": n("part", a), "cargo": n("supp", b), "mechanism": n("mech", B.Num("m"))}
    line = {"experiment": n("experiment_", B.Num("order"), "_", B.Num("line")), "complex": names["complex"], "mechanism": names["mechanism"], "location": n("loc", B.Num("m")), "cell_line": n("cell_", B.ANY)}
    cells = ["x", "x", "y", "x"] if decided else ["x", "y", "y", "x"]
    lines = [(1, 1, 1, 1), (1, 1, 2, 1), (2, 1, 3, 1), (3, 1, 4, 9)]  # the last one's cargo is not known
    rows = spark.createDataFrame([(*x, 0, f"{V.DATASET_NS}cell_{c}", "12", None) for x, c in zip(lines, cells, strict=True)], "order long, line long, a long, b long, m long, cell_line string, pubmed string, patent string")
    known = lambda df: df.filter("b < 9").withColumn("m", F.lit(0).cast("long"))
    origin = B.Origin(("lines",), ("a", "b"))
    pairs = known(rows.select("a", "b").distinct())
    loose = B.Loose(known(rows.select("a", "b")), ("a", "b", "m"), origin=origin._replace(all=known))
    fixed = {"m": frozenset({"a"}), **({"cell_line": frozenset({"order"}), "_doc": frozenset({"order"})} if decided else {})}
    peptides = B.triples_of(spark.range(1, 5), B.individual(n("part", B.Num("id")), V.CLASSES["peptide"]))
    labels = B.triples_of(spark.range(1), B.individual(f"{V.DATASET_NS}cell_x", V.CLASSES["cell_line"], F.lit("Cell X")))
    full = reasoner.materialized(B.together(B.complexes(pairs, names, ("a", "b"), loose), peptides, labels, B.experiments(rows, line, lambda: fixed, origin)))
    table = spark.createDataFrame(full.collect(), TRIPLE)
    for facet, term, found in (("cell_line", f"{V.DATASET_NS}cell_x", {1, 2}), ("cell_line", "cell x", {1, 2}), ("doc_id", "pubmed:12", {1, 2, 3}), ("subcell", f"{V.DATASET_NS}loc0", {1, 2, 3})):
        got = [sorted(r[0] for r in Q.FACETS[facet](t, term).collect()) for t in (full, table)]
        assert got[0] == got[1] == [f"{V.DATASET_NS}part{k}" for k in sorted(found)]
