"""Forward chaining: subclass closure, restriction unfolding, type propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .graph_build import COLUMNS, SCHEMA, among, apart, claims, iri, known, of, parts, stored_graph, together, triples_of
from .names import Source, stated
from .runtime import Lazy, cut, real

MAX_LOCAL = 200_000  # edges of a hierarchy that is closed on the driver
MAX_CLOSED = 2_000_000  # edges of its closure
MAX_NAMES = 1000  # predicates or classes that are named in a filter


def closure(edges: DataFrame, a: str = "child", b: str = "parent", max_local: int = MAX_LOCAL) -> DataFrame:
    """The transitive closure of edges; cycles give self-loops. Null ends are ignored.

    Class hierarchies are small beside their instances: up to max_local edges are closed at once on the driver, as long as
    the closure has at most MAX_CLOSED; beyond that by rounds of joins that double the length of the paths, each cut to
    the shared folder.
    """
    edges = edges.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    if edges.limit(max_local + 1).count() <= max_local:
        closed = _local_closure(edges)
        if closed is not None:
            return edges.sparkSession.createDataFrame(closed, edges.schema)
    known = cut(edges)
    while True:
        left, right = known.select(a, F.col(b).alias("_m")), known.select(F.col(a).alias("_m"), b)
        grown = cut(known.unionByName(left.join(right, "_m").select(a, b)).distinct())
        if grown.count() == known.count():
            return grown
        known = grown


def _local_closure(edges: DataFrame) -> list[tuple] | None:
    """The rows of the closure; None where they are too many for the driver."""
    up: dict = {}
    for x, y in edges.toLocalIterator():
        up.setdefault(x, set()).add(y)
    rows = []
    for x in up:
        seen, todo = set(), list(up[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(up.get(y, ()))
            if len(rows) + len(seen) > MAX_CLOSED:
                return None
        rows += [(x, y) for y in seen]
    return rows


def closure_sql_plan(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The closure by joins alone, whatever the size (max_local = 0)."""
    return closure(edges, a, b, max_local=0)


def _as_triples(df: DataFrame, p: str, s_kind: str = "iri") -> DataFrame:
    kind = F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri")
    none = F.lit(None).cast("string")
    return df.select("s", F.lit(p).alias("p") if p else F.col("p"), "o", F.when(F.col("s").startswith("_:"), "bnode").otherwise(s_kind).alias("s_kind"), kind.alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"))


def missing(new: DataFrame, triples: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Those of new that the graph lacks. predicates: those that new can have; no others are read or built."""
    if predicates is not None:
        triples = among(triples, predicates)
    return new.distinct().join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS)


def subclass_closure(triples: DataFrame) -> DataFrame:
    """New subClassOf triples; blank superclasses take part."""
    edges = of(triples, V.SUB_CLASS_OF).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    closed = closure(edges).select(F.col("child").alias("s"), F.col("parent").alias("o"))
    return known(missing(_as_triples(closed, V.SUB_CLASS_OF), triples, [V.SUB_CLASS_OF]), V.SUB_CLASS_OF)


def restrictions(triples: DataFrame) -> DataFrame:
    """bnode, on_property, some_values: one row a blank node (the smallest value where it has several)."""
    on = of(triples, V.ON_PROPERTY).groupBy(F.col("s").alias("bnode")).agg(F.min("o").alias("on_property"))
    some = of(triples, V.SOME_VALUES_FROM).groupBy(F.col("s").alias("bnode")).agg(F.min("o").alias("some_values"))
    return on.join(some, "bnode")


def restricted(triples: DataFrame, predicate: str | None = None) -> list[tuple[str | None, DataFrame]]:
    """property, rows (s, p, o): subjects of a type (some p o). Restrictions that rows state as such are taken from them, by property; others are joined."""
    said, types = claims(triples, predicate)
    out = [(p, df.select("s", F.lit(p).alias("p"), "o")) for p, df in said.items() if predicate in (None, p)]
    for (_, rows), df in zip(out, [df for p, df in said.items() if predicate in (None, p)], strict=True):
        rows._set = getattr(df, "_set", False)
    if types is not None and not types.isEmpty():
        r = restrictions(triples)
        r = r if predicate is None else r.filter(F.col("on_property") == predicate)
        out.append((None, types.join(r, "bnode").select("s", F.col("on_property").alias("p"), F.col("some_values").alias("o"))))
    return out


def unfold_restrictions(triples: DataFrame) -> DataFrame:
    """x of type (some p C) gives x p C."""
    if (said := only_stated(triples)) is not None:  # then each property is looked at by itself, and what names tell is not built
        rows = lambda p: claims(triples, p)[0][p].select("s", F.lit(p).alias("p"), "o")
        new = [by_names(triples, p) or known(missing(_as_triples(rows(p), ""), triples, [p]), p) for p in said]
        return together(*new) if new else triples.sparkSession.createDataFrame([], SCHEMA)
    found = restricted(triples)
    joined = [rows for p, rows in found if p is None]
    names = [p for p, _ in found if p is not None]
    out = []
    for p, rows in found:
        if p is not None and not joined and (new := by_names(triples, p)) is not None:
            out.append(new)
        elif p is not None:
            rows = rows.unionByName(joined[0].filter(F.col("p") == p)) if joined else rows
            out.append(known(missing(_as_triples(rows, ""), triples, [p]), p))
        else:
            rows = rows.filter(~F.col("p").isin(names)) if names else rows
            named = [r[0] for r in of(triples, V.ON_PROPERTY).select("o").distinct().limit(MAX_NAMES + 1).collect()]
            few = len(named) <= MAX_NAMES
            new = missing(_as_triples(rows, ""), triples, named if few else None)
            out.append(known(new, *named) if few else new)
    return together(*out) if out else triples.sparkSession.createDataFrame([], SCHEMA)


def only_stated(triples: DataFrame) -> list[str] | None:
    """The properties of the restrictions, where rows of parts state all of them; None where there are others."""
    items = [x for part in parts(triples) for x in part.items or ()]
    if any(not x.claim and x.o_kind == "bnode" for x in items) or not all(blankless(part) for part in parts(triples) if part.items is None and part.may_have(V.RDF_TYPE)):
        return None
    return list(dict.fromkeys(x.claim[0] for x in items if x.claim))


def blankless(part) -> bool:
    """Whether triples of a part without items type nothing by a blank node; the part is looked through."""
    return part.rows.filter((F.col("p") == V.RDF_TYPE) & (F.col("o_kind") == "bnode")).isEmpty()


def by_names(triples: DataFrame, p: str) -> DataFrame | None:
    """What restrictions of a property add, as a part that knows its names; None where the graph may say some of it, or says it twice."""
    claimed = [(part, x) for part in parts(triples) if part.items for x in part.items if x.claim and x.claim[0] == p]
    had, out = stated(triples, p), []
    for part, x in claimed:
        new = Source(part.rows, (x.s, x.claim[1]), (x.s_name, x.claim_name), part.key)
        others = [Source(z.rows, (y.s, y.claim[1]), (y.s_name, y.claim_name), z.key) for z, y in claimed if y is not x]
        if not new.named() or any(not any(apart(a, b) for a, b in zip(new.names, other.names, strict=True)) for other in [*had, *others]):
            return None
        cols = list(dict.fromkeys(new.numbers()))
        rows, key, loose = part.rows, part.key, part.loose
        if not new.is_set():
            rows, key = Lazy(triples.sparkSession, lambda rows=rows, cols=cols: rows.select(*cols).distinct()), tuple(cols)
            loose = loose and loose._replace(columns=key)
        out.append(triples_of(rows, [iri(x.s_name, p, x.claim_name)], key, loose))
    return together(*out) if out else None


def having(triples: DataFrame, classes: list[str]) -> DataFrame:
    """The types of these classes; parts whose rows have other ones are not built."""
    plain, blank = [c for c in classes if not c.startswith("_:")], any(c.startswith("_:") for c in classes)
    if "_parts" not in triples.__dict__:
        return of(triples, V.RDF_TYPE).filter(F.col("o").isin(classes))
    out = Lazy(triples.sparkSession, lambda: real(triples).select("*"))
    out._parts = []
    for part in parts(triples):
        items = part.items and [x for x in part.items if not isinstance(x.p, str) or x.p == V.RDF_TYPE]
        items = items and [x for x in items if (x.same is None or x.same in plain) and (blank or not x.claim)]
        if part.items is None or items:
            out._parts.append(part if part.items is None else part._replace(items=items, predicates=None))
    return of(out, V.RDF_TYPE).filter(F.col("o").isin(classes)) if out._parts else triples.sparkSession.createDataFrame([], SCHEMA)


def propagate_types(triples: DataFrame) -> DataFrame:
    """x of type C, C below D gives x of type D; one pass, as the hierarchy is closed already."""
    up = of(triples, V.SUB_CLASS_OF).select(F.col("s").alias("c"), "o").distinct()
    below = [r[0] for r in up.select("c").distinct().limit(MAX_NAMES + 1).collect()]
    above = [r[0] for r in up.select("o").distinct().limit(MAX_NAMES + 1).collect()] if len(below) <= MAX_NAMES else below
    types = having(triples, below) if len(below) <= MAX_NAMES else of(triples, V.RDF_TYPE)  # of others nothing follows
    types = types.filter("s_kind = 'iri'").select("s", F.col("o").alias("c"))
    had = (having(triples, above) if len(above) <= MAX_NAMES else of(triples, V.RDF_TYPE)).select("s", "p", "o")
    if up.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL:  # instances then stay where they are
        up = F.broadcast(up)
        had = had.join(F.broadcast(up.select("o").distinct()), "o", "left_semi").select("s", "p", "o")  # new types are such
    return known(missing(_as_triples(types.join(up, "c").select("s", "o"), V.RDF_TYPE), had), V.RDF_TYPE)


def materialize(triples: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph with what the rules add, in their order; and counts: rule, n. stored: the graph is so already.

    A graph that knows its parts stays as it is, and what unfolding adds is a part of it, so queries build what they name.
    Any other is stored by predicate, and so is what the rules add to either.
    """
    graph, added = forward(triples, stored)
    counts = [new.agg(F.lit(name).alias("rule"), F.count("*").alias("n")) for name, new in added]
    return graph, reduce(DataFrame.unionByName, counts)


def materialized(triples: DataFrame) -> DataFrame:
    """The graph with what the rules add; parts that no rule needs to look through are not built."""
    return forward(triples)[0]


def forward(triples: DataFrame, stored: bool = False) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    in_parts = "_parts" in triples.__dict__
    graph, added = triples if stored or in_parts else stored_graph(triples), []
    for name, rule in (("subclass_closure", subclass_closure), ("unfold_restrictions", unfold_restrictions), ("propagate_types", propagate_types)):
        new = rule(graph)
        if not in_parts:
            new = stored_graph(new, distinct=False)
        elif rule is not unfold_restrictions:
            new = known(stored_graph(new, distinct=False), V.SUB_CLASS_OF if rule is subclass_closure else V.RDF_TYPE)
        empty = rule is not unfold_restrictions and in_parts and new.isEmpty()
        added.append((name, new))
        if not empty:
            graph = together(graph, new) if in_parts else graph.unionByName(new)
    return graph, added


def expected_speedup(n_restrictions: int) -> float:
    """An estimate, not a timing."""
    return 1 + min(n_restrictions / 1000 * 0.2, 2.0)
