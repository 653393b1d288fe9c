"""Nodes by their names: what a graph of parts says is counted, typed and joined by the numbers in its IRIs.

A source is rows of which each states a node, or a tuple of nodes. Sources with names that never meet are counted each by
itself; of one whose numbers hold the key of its rows, rows are counted as they are. Where names are not known, it goes by the IRIs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .graph_build import WHOLE, Item, Loose, Name, Num, Part, apart, parts
from .runtime import Lazy


class Source(NamedTuple):
    """rows, the nodes that each states, their names (None: not known), the columns that no two rows share, and what must not be null for a row to say anything.

    loose: rows that hold them (see Part), for where a node may be stated twice. steps: filters that rows, of either kind, pass.
    """

    rows: DataFrame | Lazy
    columns: tuple[Column, ...]
    names: tuple
    key: tuple[str, ...] | None = None
    needs: frozenset[str] = frozenset()
    loose: Loose | None = None
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def named(self) -> bool:
        return all(isinstance(x, Name) and x.whole() for x in self.names)

    def numbers(self) -> list[str]:
        return [str(x) for n in self.names for x in n.pieces if isinstance(x, Num)]

    def is_set(self) -> bool:
        """No two rows state the same."""
        return self.key is not None and self.named() and set(self.key) <= set(self.numbers())

    def decides(self) -> bool:
        """The numbers of the nodes decide what a row says, and so which filters it passes."""
        if self.key is None or not self.named():
            return False
        given, fixed = set(self.numbers()), None
        for c in self.key:
            if c not in given:
                fixed = fixed if fixed is not None else self.loose.fixed() if self.loose else {}
                if c not in fixed or not fixed[c] <= given:
                    return False
        return True

    def held(self) -> DataFrame:
        """The rows that say something."""
        return self.passed(self.rows)

    def loosely(self) -> Source:
        """The same nodes, each perhaps stated more often."""
        return self._replace(rows=self.loose.rows, key=None) if self.loose else self

    def passed(self, rows: DataFrame) -> DataFrame:
        rows = rows.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in sorted(self.needs)])) if self.needs else rows
        return reduce(lambda df, step: step(df), self.steps, rows)

    def where(self, step: Callable[[DataFrame], DataFrame]) -> Source:
        """Those rows that pass a filter."""
        return self._replace(steps=(*self.steps, step))

    def strings(self) -> DataFrame:
        """n0, n1, ...: the nodes."""
        return self.held().select(*[c.alias(f"n{i}") for i, c in enumerate(self.columns)]).dropna()

    def narrow(self) -> DataFrame:
        """n0, n1, ...: the numbers of the nodes."""
        return self.held().select(*[F.col(c).alias(f"n{i}") for i, c in enumerate(self.numbers())]).dropna()

    def pick(self, *at: int) -> Source:
        """Some of the nodes of each row."""
        if not self.named():
            whole = reduce(Column.__and__, [c.isNotNull() for c in self.columns])
            out = self.where(lambda df: df.filter(whole)) if len(at) < len(self.names) else self
            return out._replace(columns=tuple(self.columns[i] for i in at), names=tuple(self.names[i] for i in at))
        return self._replace(columns=tuple(self.columns[i] for i in at), names=tuple(self.names[i] for i in at), needs=self.needs | frozenset(self.numbers()))


def item_source(part: Part, x: Item) -> Source:
    """Subject and object of what each row of a part says by an item."""
    out = Source(part.rows, (x.s, x.o), (x.s_name, x.o_name), part.key, loose=part.loose)
    if out.named() and x.o_kind != "lit":
        return out._replace(needs=frozenset(out.numbers()))
    whole = x.s.isNotNull() & x.o.isNotNull()
    whole = whole & (F.trim(x.o) != "") if x.o_kind == "lit" else whole
    return out.where(lambda df: df.filter(whole))


def stated(triples: DataFrame, predicate: str, o: str | None = None) -> list[Source]:
    """Sources of subject and object of the triples with a predicate, and this object (an IRI) if one is given."""
    out = []
    for part in parts(triples):
        if not part.may_have(predicate):
            continue
        if part.items is None:
            rows = part.rows.filter((F.col("p") == predicate) & F.col("s").isNotNull() & F.col("o").isNotNull())
            names = (part.hints or {}).get(predicate, (None, None))
            out.append(Source(rows if o is None else rows.filter(F.col("o") == o), (F.col("s"), F.col("o")), names))
            continue
        for x in part.items:
            if not isinstance(x.p, str):
                rows = part.rows.select(*x.columns()).filter(WHOLE).filter(F.col("p") == predicate)
                out.append(Source(rows if o is None else rows.filter(F.col("o") == o), (F.col("s"), F.col("o")), (None, None)))
            elif x.p == predicate and (o is None or (x.same in (None, o) and not (x.claim and not o.startswith("_:")) and not apart(x.o_name, Name((o,))))):
                found = item_source(part, x)
                out.append(found if o is None or x.same == o else Source(found.held().filter(x.o == o), found.columns, (x.s_name, None)))
    return out


def predicate_counts(triples: DataFrame) -> DataFrame:
    """p, n: the triples of each predicate, repeated ones too. Of items, rows are counted, in one pass over each part."""
    found = []
    for part in parts(triples):
        if part.items is None or any(not isinstance(x.p, str) for x in part.items):
            rows = part.rows if part.items is None else reduce(DataFrame.unionByName, [part.rows.select(*x.columns()) for x in part.items]).filter(WHOLE)
            found.append(rows.groupBy("p").agg(F.count("*").alias("n")))
            continue
        says = []
        for x in part.items:
            source = Source(part.rows, (x.s, x.o), (x.s_name, x.o_name))
            whole = [F.col(c).isNotNull() for c in source.numbers()] if source.named() and x.o_kind != "lit" else [x.s.isNotNull(), x.o.isNotNull()]
            whole += [F.trim(x.o) != ""] if x.o_kind == "lit" else []
            says.append(F.count(F.when(reduce(Column.__and__, whole, F.lit(True)), 1)))
        once = part.rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(says)])
        found.append(once.select(F.inline(F.array(*[F.struct(F.lit(x.p).alias("p"), F.col(f"c{i}").alias("n")) for i, x in enumerate(part.items)]))))
    return reduce(DataFrame.unionByName, found).groupBy("p").agg(F.sum("n").alias("n")).filter("n > 0")


def nodes(triples: DataFrame, at: int) -> list[Source]:
    """Sources of all subjects (0) or all objects (1)."""
    out = []
    for part in parts(triples):
        if part.items is None:
            out.append(Source(part.rows, (F.col("so"[at]),), (None,)))
        else:
            out += [item_source(part, x).pick(at) for x in part.items]
    return out


def meet(a: Source, b: Source) -> bool:
    return not any(apart(x, y) for x, y in zip(a.names, b.names, strict=True))


def groups(sources: list[Source]) -> list[list[Source]]:
    """Sources that may state the same, together; each once."""
    out: list[list[Source]] = []
    for x in sources:
        same = [(g, y) for g in out for y in g if x.rows is y.rows and x.steps == y.steps and x.named() and x.names == y.names and (x.needs <= y.needs or y.needs <= x.needs)]
        if same:  # the one that more rows say
            g, y = same[0]
            g[[z is y for z in g].index(True)] = x if x.needs <= y.needs else y
            continue
        near = [g for g in out if any(meet(x, y) for y in g)]
        out = [g for g in out if not any(g is n for n in near)] + [[x, *(y for g in near for y in g)]]
    return out


WHOLE_TYPES = {"tinyint", "smallint", "int", "bigint"}
LOW_BITS = 24  # of a packed pair, for its second number


def distinct_numbers(rows: DataFrame) -> DataFrame:
    """The distinct rows, none of them null. Of one whole number, tasks send what they have as words of 64 bits, one for 64 numbers that lie together."""
    (name, kind), *more = rows.dtypes
    if more or kind not in WHOLE_TYPES:
        return rows.distinct()
    x = F.col(name).cast("long")
    words = rows.select(F.shiftright(x, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(1) == 1)
    return words.select("w", F.explode(held).alias("i")).select(F.shiftleft("w", 6).bitwiseOR(F.col("i")).cast(kind).alias(name))


def distinct_pairs(rows: DataFrame) -> DataFrame:
    """The distinct rows of two columns of whole numbers, shuffled as one number each. What doesn't fit, or is null, goes by itself as it is, so rows are read twice; files without such rows are passed over by their statistics."""
    (a, kind_a), (b, kind_b) = rows.dtypes
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    high, low = 1 << (63 - LOW_BITS), 1 << LOW_BITS
    packed = rows.filter((x >= 0) & (x < high) & (y >= 0) & (y < low)).select(F.shiftleft(x, LOW_BITS).bitwiseOR(y).alias("k")).distinct()
    fit = packed.select(F.shiftright("k", LOW_BITS).cast(kind_a).alias(a), F.col("k").bitwiseAND(low - 1).cast(kind_b).alias(b))
    return fit.unionByName(rows.filter((x < 0) | (x >= high) | (y < 0) | (y >= low) | x.isNull() | y.isNull()).distinct())


def distinct_rows(group: list[Source]) -> DataFrame:
    """A row for each distinct tuple of nodes that the sources of a group state."""
    if all(x.named() for x in group) and len({tuple(n.shape() for n in x.names) for x in group}) == 1:
        if not group[0].numbers():
            return reduce(DataFrame.unionByName, [x.held().select(F.lit(1).alias("n0")).limit(1) for x in group]).limit(1)
        rows = reduce(DataFrame.unionByName, [x.narrow() for x in group])
        return rows if len(group) == 1 and group[0].is_set() else distinct_numbers(rows)
    return reduce(DataFrame.unionByName, [x.strings() for x in group]).distinct()


def count_distinct(spark, sources: list[Source]) -> DataFrame:
    """n: the distinct tuples of nodes that the sources state."""
    counts = [distinct_rows(g).agg(F.count("*").alias("n")) for g in groups(sources)]
    if not counts:
        return spark.range(1).select(F.lit(0).cast("long").alias("n"))
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))


def semi(x: Source, at: int, others: list[Source], few: Callable[[DataFrame], bool] = lambda known: False) -> Source | None:
    """The rows whose node is one that the others state; None where there can be none.

    Filters of the others pass over to the rows, where the node says which they are; else rows are joined. few: whether the
    others' nodes may be broadcast.
    """
    met = [y for y in others if not apart(x.names[at], y.names[0])]
    if not met:
        return None
    name = x.names[at]
    if any(y.rows is x.rows and y.named() and y.names[0] == name and y.needs <= x.needs and set(y.steps) <= set(x.steps) for y in met):
        return x  # each row says so itself
    if len(met) == 1 and (found := by_same_rows(x, at, met[0])) is not None:
        return found
    if (found := by_origin(x, at, met)) is not None:
        return found
    hinted = lambda known: F.broadcast(known) if few(known) else known
    alike = isinstance(name, Name) and name.whole() and name.numbers() and all(y.named() and y.names[0].shape() == name.shape() for y in met)
    if alike:
        cols = [str(c) for c in name.pieces if isinstance(c, Num)]
        if len(set(cols)) == len(cols):
            known = hinted(reduce(DataFrame.unionByName, [y.loosely().narrow() for y in met]).toDF(*cols))
            return x.where(lambda df: df.join(known, cols, "left_semi"))
    known = hinted(reduce(DataFrame.unionByName, [y.loosely().strings() for y in met]).select(F.col("n0").alias("_node")))
    node = x.columns[at]
    return x.where(lambda df: df.withColumn("_node", node).join(known, "_node", "left_semi").drop("_node"))


def by_same_rows(x: Source, at: int, y: Source) -> Source | None:
    """The rows of x whose node is one that y states, by y's filters alone: both are of the same rows, and rows with equal nodes are alike to y. None where that is not known."""
    rows = x.rows if y.rows is x.rows else x.loose.rows if x.loose and y.loose and x.loose.rows is y.loose.rows else None
    if rows is None or not y.named() or y.names[0] != x.names[at] or not y.decides():
        return None
    out = x if rows is x.rows else x._replace(rows=rows, key=None)
    return out._replace(needs=x.needs | y.needs, steps=x.steps + y.steps)


def by_origin(x: Source, at: int, met: list[Source]) -> Source | None:
    """The rows of x whose node is one that the others state, made of the others' tuples: both come from one table, and x has all of its rows for these."""
    mine = x.loose and x.loose.origin
    if not mine or not mine.all:
        return None
    same = lambda z, n: z.loose and z.loose.origin and z.loose.origin[:2] == mine[:2] and isinstance(n, Name) and n.whole() and n.numbers() == list(mine.columns)
    if not same(x, x.names[at]) or not all(same(y, y.names[0]) and y.names[0].shape() == x.names[at].shape() for y in met):
        return None
    tuples = reduce(DataFrame.unionByName, [y.loosely().held().select(*mine.columns).dropna() for y in met])
    return x._replace(rows=mine.all(tuples), key=None, loose=None)


def once(x: Source) -> Source:
    """The same nodes, each stated once; their rows then have their numbers alone."""
    if not x.named() or not x.numbers() or x.is_set():
        return x
    cols = list(dict.fromkeys(x.numbers()))
    return Source(distinct_numbers(x.loosely().held().select(*cols).dropna()), x.columns, x.names, tuple(cols))


def typed(triples: DataFrame, sources: list[Source], at: int, cls: str) -> list[Source]:
    """Those rows of the sources whose node is of the class."""
    members = [y.pick(0) for y in stated(triples, V.RDF_TYPE, cls)]
    return [y for y in (semi(x, at, members) for x in sources) if y is not None]


def all_strings(sources: list[Source], names: list[str], spark) -> DataFrame:
    """The nodes as IRIs, repeated ones too."""
    if not sources:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    return reduce(DataFrame.unionByName, [x.strings() for x in sources]).toDF(*names)


def distinct_strings(sources: list[Source], names: list[str], spark) -> DataFrame:
    """The distinct nodes as IRIs; made one by their numbers, where they have some. Rows that are to be made one need not be so before."""
    sources = [x if x.is_set() else x.loosely() for x in sources]
    out = []
    for g in groups(sources):
        x = g[0]
        if len(g) == 1 and x.named() and x.numbers():
            cols = list(dict.fromkeys(x.numbers()))
            rows = x.held().select(*cols).dropna()
            rows = rows if x.is_set() else distinct_numbers(rows)
            out.append(rows.select(*[c.alias(k) for c, k in zip(x.columns, names, strict=True)]))
        else:
            out.append(reduce(DataFrame.unionByName, [y.strings() for y in g]).toDF(*names).distinct())
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
