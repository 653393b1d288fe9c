"""Graph queries as joins over a triple table (best stored partitioned by predicate)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V
from ..sources.writers import jsonld, ntriples
from .graph_build import about, apart, iri, literal, name, of, together, triples_of
from .names import Source, all_strings, count_distinct, distinct_strings, groups, nodes, once, predicate_counts, semi, stated, typed
from .reasoner import MAX_LOCAL, closure, restricted

R = V.RELATIONS


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one triple pattern. Names that start with ? are variables (s, p, o may share one); others are constants."""
    rows, cols = triples if p.startswith("?") else of(triples, p, None if o.startswith("?") else o), {}
    for place, x in (("s", s), ("p", p), ("o", o)):
        if not x.startswith("?"):
            rows = rows.filter(F.col(place) == x)
        elif x[1:] in cols:
            rows = rows.filter(F.col(place) == F.col(cols[x[1:]]))
        else:
            cols[x[1:]] = place
    return rows.select(*[F.col(c).alias(v) for v, c in cols.items()]) if cols else rows.select(F.lit(True).alias("_"))


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of patterns that share variables; Catalyst orders the joins. One relation between variables that have classes goes by names."""
    links = [x for x in patterns if not x[1].startswith("?") and x[0].startswith("?") and x[2].startswith("?") and x[0] != x[2]]
    kinds = [x for x in patterns if x[1] == V.RDF_TYPE and not x[2].startswith("?")]
    if "_parts" in triples.__dict__ and len(links) == 1 and len(links) + len(kinds) == len(patterns) and all(x[0] in links[0][::2] for x in kinds):
        return distinct_strings(linked(triples, links[0], kinds), [links[0][0][1:], links[0][2][1:]], triples.sparkSession)
    out = None
    for x in patterns:
        rows = pattern(triples, *x)
        if out is None:
            out = rows
            continue
        shared = [c for c in rows.columns if c in out.columns]
        if not shared:
            raise ValueError("patterns without a shared variable")
        out = out.join(rows, shared)
    return out.distinct()


def linked(triples: DataFrame, link: tuple[str, str, str], kinds: list[tuple[str, str, str]]) -> list[Source]:
    """Sources of a pattern between two variables that are of these classes."""
    found = stated(triples, link[1])
    for x, _, cls in kinds:
        found = typed(triples, found, 0 if x == link[0] else 1, cls)
    return found


def path_plus(triples: DataFrame, p: str) -> DataFrame:
    """a, b: one or more steps."""
    return closure(of(triples, p).select(F.col("s").alias("a"), F.col("o").alias("b")), "a", "b")


def path_star(triples: DataFrame, p: str, constant: str | None = None) -> DataFrame:
    """a, b: zero or more steps. A constant matches itself even if the graph lacks it."""
    steps = path_plus(triples, p)
    nodes = triples.select(F.col("s").alias("a")).union(triples.filter("o_kind <> 'lit'").select("o")).distinct() if constant is None else triples.sparkSession.createDataFrame([(constant,)], "a string")
    rows = steps if constant is None else steps.filter(F.col("b") == constant)
    return rows.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()


def path_seq(triples: DataFrame, *predicates: str) -> DataFrame:
    """a, b: the predicates one after the other."""
    if len(predicates) == 2 and (found := steps_of_rows(triples, *predicates)) is not None:
        return distinct_strings(found, ["a", "b"], triples.sparkSession)
    out = None
    for p in predicates:
        step = of(triples, p).select(F.col("s").alias("a"), F.col("o").alias("b"))
        out = step if out is None else out.withColumnRenamed("b", "_m").join(step.withColumnRenamed("a", "_m"), "_m").select("a", "b")
    return out.distinct()


def steps_of_rows(triples: DataFrame, first: str, second: str) -> list[Source] | None:
    """Two steps whose middle nodes are the keys of the same rows, so each row takes both; None where others may meet."""
    out = []
    for x in stated(triples, first):
        for y in stated(triples, second):
            if apart(x.names[1], y.names[0]):
                continue
            middle = x.pick(1)
            if x.rows is not y.rows or not x.named() or not y.named() or x.names[1] != y.names[0] or not middle.is_set():
                return None
            out.append(Source(x.rows, (x.columns[0], y.columns[1]), (x.names[0], y.names[1]), x.key, x.needs | y.needs, x.loose, x.steps + y.steps))
    return out


def labels(triples: DataFrame) -> DataFrame:
    """node, label: the smallest label."""
    return of(triples, V.RDFS_LABEL).groupBy(F.col("s").alias("node")).agg(F.min("o").alias("label"))


def few(rows: DataFrame) -> bool:
    """So few rows that they may be broadcast."""
    return rows.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL


def restricted_to(triples: DataFrame, relation: str, top: str) -> DataFrame:
    """s, value: subjects with a restriction (some relation value), the value being top or below it."""
    below = path_star(triples, V.SUB_CLASS_OF, top).select(F.col("a").alias("value"))
    below = F.broadcast(below) if few(below) else below  # subjects then stay where they are
    found_by = [x for _, x in restricted(triples, R[relation])]
    rows = reduce(DataFrame.unionByName, found_by or [of(triples, R[relation]).limit(0).select("s", "p", "o")])
    found = rows.select("s", F.col("o").alias("value")).join(below, "value").select("s", "value")
    return found if len(found_by) == 1 and getattr(found_by[0], "_set", False) else found.distinct()


def subsumption(triples: DataFrame, relation: str, top: str) -> DataFrame:
    """agent, role, value: agents whose role has such a restriction."""
    roles = restricted_to(triples, relation, top).withColumnRenamed("s", "role")
    has = of(triples, R["has_attribute"]).select(F.col("s").alias("agent"), F.col("o").alias("role"))
    return has.join(roles, "role").select("agent", "role", "value").distinct()


def located_below(triples: DataFrame, top: str) -> DataFrame:
    """complex, place, label (null without one)."""
    found = restricted_to(triples, "is_located_in", top).select(F.col("s").alias("complex"), F.col("value").alias("place"))
    names = labels(triples).select(F.col("node").alias("place"), "label")
    names = F.broadcast(names) if few(of(triples, V.RDFS_LABEL)) else names
    return found.join(names, "place", "left").select("complex", "place", "label")


def role_chain(triples: DataFrame, agent_class: str, role_class: str) -> DataFrame:
    """agent, role, process, value, label."""
    rows = bgp(triples, ("?agent", V.RDF_TYPE, agent_class), ("?agent", R["has_attribute"], "?role"), ("?role", V.RDF_TYPE, role_class), ("?role", R["is_realized_in"], "?process"))
    value = reduce(DataFrame.unionByName, [x for _, x in restricted(triples)] or [triples.limit(0).select("s", "p", "o")])
    out = rows.join(value.select(F.col("s").alias("process"), F.col("o").alias("value")), "process")
    return out.join(labels(triples).select(F.col("node").alias("agent"), "label"), "agent", "left").select("agent", "role", "process", "value", "label").distinct()


# -- facets: name -> function(triples, term) giving the matching subjects

FACETS: dict = {}


def facet(name: str):
    def add(f):
        FACETS[name] = f
        return f

    return add


def matches(triples: DataFrame, nodes: DataFrame, term: str) -> DataFrame:
    """Nodes (column node) that are the term's IRI, or carry its text in a label."""
    if "://" in term:
        return nodes.filter(F.col("node") == term)
    hit = of(triples, V.RDFS_LABEL).filter(C.contains_text(F.col("o"), term)).select(F.col("s").alias("node"))
    return nodes.join(hit, "node", "left_semi")


@facet("sequence")
def _sequence(t: DataFrame, term: str) -> DataFrame:
    return of(t, f"{V.SCHEMA_NS}sequence").filter(C.contains_text(F.col("o"), term)).select(F.col("s").alias("peptide")).distinct()


def _peptides(t: DataFrame, complexes: list[Source]) -> DataFrame:
    """Peptides of the complexes. The type test keeps cargo out, which is part of the complexes too."""
    return _among(t, stated(t, R["is_part_of"]), 1, complexes)


def _among(t: DataFrame, ends: list[Source], at: int, others: list[Source]) -> DataFrame:
    """peptide: the subjects of ends whose other node is one of the others; of peptides alone, when they are made one."""
    ends = [x for x in ends if typed(t, [x], 0, V.CLASSES["peptide"])]
    held = [once(x.pick(0)) for x in (semi(x, at, others) for x in ends) if x is not None]
    return distinct_strings(typed(t, held, 0, V.CLASSES["peptide"]), ["peptide"], t.sparkSession)


def _meant(t: DataFrame, ends: list[Source], at: int, term: str) -> list[Source]:
    """Those rows of ends whose node is the term's IRI, or carries its text in a label."""
    if "://" in term:
        return [_kept(x, x.columns[at] == term) for x in ends if not apart(x.names[at], name(term))]
    hit = [_kept(x, C.contains_text(x.columns[1], term)).pick(0) for x in stated(t, V.RDFS_LABEL)]
    return [x for x in (semi(x, at, hit, few) for x in ends) if x is not None]


def _kept(x: Source, wanted: Column) -> Source:
    return x.where(lambda df: df.filter(wanted))


@facet("subcell")
def _subcell(t: DataFrame, term: str) -> DataFrame:
    """Complexes located in the place (an IRI), or in one with the text in a label. On a materialized graph."""
    return _peptides(t, [x.pick(0) for x in _meant(t, stated(t, R["is_located_in"]), 1, term)])


def _of_experiments(t: DataFrame, held: list[Source]) -> DataFrame:
    """Peptides of complexes in the experiments."""
    ends = [x for x in (semi(x, 1, held) for x in stated(t, R["is_participant_in"])) if x is not None]
    return _peptides(t, [x.pick(0) for x in ends])


@facet("cell_line")
def _cell_line(t: DataFrame, term: str) -> DataFrame:
    """Complexes of experiments with the cell line (an IRI), or one with the text in a label. Peptides alone, for text too."""
    return _of_experiments(t, [x.pick(0) for x in _meant(t, stated(t, R["has_participant"]), 1, term)])


@facet("cargo")
def _cargo(t: DataFrame, term: str) -> DataFrame:
    """Complexes with the cargo (an IRI), or with cargo of a type that has the text."""
    ends = stated(t, R["is_part_of"])
    if "://" in term:
        return _peptides(t, [x.pick(1) for x in _meant(t, ends, 0, term)])
    hit = [_kept(x, C.contains_text(x.columns[1], term)).pick(0) for x in stated(t, f"{V.SCHEMA_NS}cargoType")]
    return _peptides(t, [x.pick(1) for x in (semi(x, 0, hit, few) for x in ends) if x is not None])


@facet("doc_id")
def _doc_id(t: DataFrame, term: str) -> DataFrame:
    """Complexes of experiments that a document with the text in its IRI describes."""
    return _of_experiments(t, [_kept(x, C.contains_text(x.columns[1], term)).pick(0) for x in stated(t, R["is_described_by"])])


@facet("mechanism")
def _mechanism(t: DataFrame, term: str) -> DataFrame:
    return _among(t, stated(t, R["has_attribute"]), 1, [x.pick(0) for x in _meant(t, stated(t, R["is_realized_in"]), 1, term)])


def faceted_search(triples: DataFrame, filters: dict[str, str], limit: int = 250) -> DataFrame:
    """peptide, label, sequence of the subjects that meet all filters; the first ones by IRI."""
    filters = {k: v for k, v in filters.items() if v and v.strip()}
    if not filters:
        raise ValueError("no filter")
    if unknown := set(filters) - set(FACETS):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    found = reduce(lambda a, b: a.join(b, "peptide", "left_semi"), [FACETS[k](triples, v.strip()) for k, v in filters.items()])
    found = found.orderBy("peptide").limit(limit)
    names = labels(triples).withColumnRenamed("node", "peptide")
    seqs = of(triples, f"{V.SCHEMA_NS}sequence").groupBy(F.col("s").alias("peptide")).agg(F.min("o").alias("sequence"))
    return found.join(names, "peptide", "left").join(seqs, "peptide", "left")


def preview(df: DataFrame) -> str:
    """The plan that a query would run by."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# -- counts and browsing


def class_counts(triples: DataFrame, catalogue: dict[str, str], by_subclass: list[str]) -> DataFrame:
    """name, iri, n: members by type, or by subClassOf for the classes named so; 0 where there are none."""
    typed = of(triples, V.RDF_TYPE).groupBy(F.col("o").alias("iri")).agg(F.countDistinct("s").alias("n")).filter(~F.col("iri").isin(by_subclass))
    sub = of(triples, V.SUB_CLASS_OF).filter(F.col("o").isin(by_subclass)).groupBy(F.col("o").alias("iri")).agg(F.countDistinct("s").alias("n"))
    spark = triples.sparkSession
    names = spark.createDataFrame([(k, v) for k, v in catalogue.items()], "name string, iri string")
    return F.broadcast(names).join(typed.unionByName(sub), "iri", "left").select("name", "iri", F.coalesce("n", F.lit(0)).alias("n"))


def instance_counts(triples: DataFrame) -> DataFrame:
    """class, label, n: members of each class and label; a class with several labels is counted under each. Classes that each row names alone, and nothing labels, need no grouping."""
    typed_as, labelled = stated(triples, V.RDF_TYPE), [x.pick(0) for x in stated(triples, V.RDFS_LABEL)]
    kinds = [x.pick(1) for x in typed_as]
    own = [g[0] for g in groups(kinds) if len(g) == 1 and sum(g[0].rows is x.rows and g[0].names == x.names for x in kinds) == 1 and g[0].is_set() and all(apart(g[0].names[0], x.names[0]) for x in labelled)]
    rest = [x for x in kinds if not any(x.rows is y.rows and x.names == y.names for y in own)]
    spark = triples.sparkSession
    names = of(triples, V.RDFS_LABEL).select(F.col("s").alias("class"), F.col("o").alias("label"))
    rows = all_strings(rest, ["class"], spark).groupBy("class").agg(F.count("*").alias("k")).join(names, "class", "left")
    grouped = rows.groupBy("class").agg(F.min("label").alias("label"), F.sum("k").alias("n"))
    single = [all_strings([x], ["class"], spark).select("class", F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("n")) for x in own]
    return reduce(DataFrame.unionByName, single, grouped)


def graph_metrics(triples: DataFrame) -> DataFrame:
    nodes = triples.select("s").union(triples.select("o")).distinct().agg(F.count("*").alias("total_nodes"))
    return triples.agg(F.count("*").alias("total_triples"), F.countDistinct("p").alias("total_predicates")).crossJoin(nodes)  # one row each


def browse(triples: DataFrame, cls: str, text: str = "", page: int = 1, per_page: int = 50, by_subclass: bool = False) -> tuple[DataFrame, DataFrame]:
    """One page of a class's members (node, label) by label, and total and pages. One filter, on the label or else the IRI, for both."""
    per_page, page = min(100, max(10, per_page)), max(1, page)
    members = of(triples, V.SUB_CLASS_OF if by_subclass else V.RDF_TYPE, cls).select(F.col("s").alias("node")).distinct()
    shown = F.coalesce("label", "node")
    rows = members.join(labels(triples), "node", "left").filter(C.contains_text(shown, text) if text else F.lit(True))
    counts = rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long"))
    return rows.orderBy(F.lower(shown), "node").offset((page - 1) * per_page).limit(per_page), counts


def autocomplete(triples: DataFrame, cls: str, text: str, limit: int | None = 250) -> DataFrame:
    """node, label by label."""
    members = of(triples, V.RDF_TYPE, cls).select(F.col("s").alias("node")).distinct()
    rows = members.join(labels(triples), "node").filter(C.contains_text(F.col("label"), text)).orderBy(F.lower("label"), "node")
    return rows.limit(limit) if limit else rows


def sitemap(triples: DataFrame, limit: int = 5000) -> DataFrame:
    return of(triples, V.RDF_TYPE).filter("s_kind = 'iri'").select("s").distinct().orderBy("s").limit(limit)


def void(triples: DataFrame, namespace: str = V.DATASET_NS, title: str = "graph") -> DataFrame:
    """Triples that describe the graph as a dataset: its title, space and numbers, and the triples of each predicate."""
    vo, dct = "http://rdfs.org/ns/void#", "http://purl.org/dc/terms/"
    me = namespace.rstrip("/#")
    per, spark = predicate_counts(triples), triples.sparkSession
    numbers = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triples"), F.count("*").alias("properties"))
    items = [iri(me, V.RDF_TYPE, f"{vo}Dataset"), literal(me, f"{dct}title", title), literal(me, f"{vo}uriSpace", namespace), *(literal(me, vo + n, F.col(n).cast("string")) for n in ("triples", "properties"))]
    counted = {"distinctSubjects": nodes(triples, 0), "distinctObjects": nodes(triples, 1), "classes": [x.pick(1) for x in stated(triples, V.RDF_TYPE)]}
    counts = [triples_of(count_distinct(spark, found), [literal(me, vo + n, F.coalesce("n", F.lit(0)).cast("string"))]) for n, found in counted.items()]
    per = per.select(F.col("p").alias("of"), F.col("n").cast("string").alias("n"))
    part = F.concat(F.lit(me + "#"), F.md5("of"))
    parts = [iri(me, f"{vo}propertyPartition", part), iri(part, f"{vo}property", F.col("of")), literal(part, f"{vo}triples", F.col("n"))]
    return together(triples_of(numbers, items), *counts, triples_of(per, parts))


def describe(triples: DataFrame, node: str, limit: int = 400) -> DataFrame:
    """p, p_label, values: what the graph says of a node, by predicate; blank values are left out."""
    rows = about(triples, node).filter((F.col("o_kind") != "bnode") & ~F.col("o").isin(f"{V.OWL}NamedIndividual", f"{V.OWL}Class"))
    rows = rows.orderBy("p", "o").limit(limit)
    names = labels(triples)
    named = rows.join(names.select(F.col("node").alias("o"), F.col("label").alias("o_label")), "o", "left").join(names.select(F.col("node").alias("p"), F.col("label").alias("p_label")), "p", "left")
    return named.groupBy("p").agg(F.min("p_label").alias("p_label"), F.array_sort(F.collect_list(F.coalesce("o_label", "o"))).alias("values"))


def resolve_entity(triples: DataFrame, name: str, namespace: str = V.DATASET_NS) -> DataFrame:
    """iri, known: a full IRI (its scheme repaired), or an id below the namespace."""
    iri = C.scheme_repair(F.lit(name)) if ":" in name else F.lit(namespace + name)
    hits = triples.filter((F.col("s") == iri) | (F.col("o") == iri)).limit(1).agg(F.count("*").alias("n"))
    return hits.select(iri.alias("iri"), (F.col("n") > 0).alias("known"))


def neighbourhood(triples: DataFrame, node: str, max_edges: int = 60, max_in: int = 20) -> DataFrame:
    """s, p, o, direction: edges around a node, no literals or OWL terms; outgoing first, in a fixed order."""
    plain = triples.filter("o_kind <> 'lit' and s_kind = 'iri'").filter(~F.col("o").startswith(V.OWL))
    out = plain.filter(F.col("s") == node).select("s", "p", "o", F.lit("out").alias("direction"))
    into = plain.filter(F.col("o") == node).select("s", "p", "o", F.lit("in").alias("direction")).orderBy("p", "s").limit(max_in)
    return out.orderBy("p", "o").limit(max_edges).unionByName(into).orderBy(F.desc("direction"), "p", "o", "s").limit(max_edges)


def export(triples: DataFrame, node: str, kind: str = "turtle") -> DataFrame:
    """value: lines of an entity as N-Triples (which is Turtle), or its JSON-LD node."""
    rows = triples.filter(F.col("s") == node)
    return jsonld(rows) if kind == "jsonld" else ntriples(rows)


# -- federation


def federated(local: DataFrame, remote, keys: list[str]) -> DataFrame | None:
    """Joins local bindings with what a remote source knows of them. remote: a DataFrame, or a function of the distinct keys. None without local rows."""
    values = local.select(*keys).distinct()
    if values.isEmpty():
        return None
    rows = remote(values) if callable(remote) else remote.join(values, keys, "left_semi")
    return local.join(rows, keys)


def values(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """An inline relation, small by nature."""
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))


ASSOCIATIONS = [
    ("Positively Regulates", "gene", "activator_role"), ("Negatively Regulates", "inhibitor", "inhibitor_role"), ("Cargo Role: Is Realized In", None, "cargo_role"),
    ("Peptide Role: Is Realized In", None, "peptide_role"), ("Complex: Is Participant In", "complex", "is_participant_in"), ("Cell Line: Is Participant In", "cell_line", "is_participant_in"),
    ("Delivery Localization", "complex", "is_located_in"),
]


def association_counts(triples: DataFrame) -> DataFrame:
    """name, n: distinct roles or subjects of the seven associations."""
    out = []
    for title, cls, what in ASSOCIATIONS:
        if what.endswith("_role"):
            p = [("?x", V.RDF_TYPE, V.CLASSES[what]), ("?x", R["is_realized_in"], "?y")]
            p += [("?a", R["has_attribute"], "?x"), ("?a", V.RDF_TYPE, V.CLASSES[cls])] if cls else []
        else:
            p = [("?x", V.RDF_TYPE, V.CLASSES[cls]), ("?x", R[what], "?y")]
        if cls and what.endswith("_role") or "_parts" not in triples.__dict__:
            out.append(bgp(triples, *p).agg(F.lit(title).alias("name"), F.countDistinct("x").alias("n")))
            continue
        link = next(x for x in p if x[1] != V.RDF_TYPE)
        found = [x.pick(0) for x in linked(triples, link, [x for x in p if x is not link])]
        out.append(count_distinct(triples.sparkSession, found).select(F.lit(title).alias("name"), F.coalesce("n", F.lit(0)).alias("n")))
    return reduce(DataFrame.unionByName, out)

