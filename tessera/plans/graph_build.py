"""Graph construction: relational rows become triples (s, p, o, s_kind, o_kind, o_lang, o_dt).

A triple set is a DataFrame; inverse relations are written as triples of their
own. Blank nodes of restrictions are named by a hash of what they say, so two
equal restrictions of a subject are one, on every run.

A graph that triples_of() and together() make also knows its parts: the rows and what each of them says. of() and
among() then build the asked predicates alone, from those rows, and nothing of the others.

IRIs may be given as names: fixed texts around whole numbers of the rows. Equal names have equal numbers, and names of
other texts never meet, so what is counted or joined by IRI goes by the numbers, or needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V
from .runtime import Lazy, real

COLUMNS = ["s", "p", "o", "s_kind", "o_kind", "o_lang", "o_dt"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
R = V.RELATIONS


class Num(str):
    """A column of whole numbers."""


#: the rest of a name, whatever it is
ANY = type("Any", (), {"__repr__": lambda self: "ANY"})()


class Name(NamedTuple):
    """An IRI of texts around numbers (Num): a text after a number starts with no digit, so the numbers can be read from the IRI."""

    pieces: tuple

    def column(self) -> Column:
        return F.concat(*[F.col(x).cast("string") if isinstance(x, Num) else F.lit(x) for x in self.pieces])

    def numbers(self) -> list[str]:
        return list(dict.fromkeys(str(x) for x in self.pieces if isinstance(x, Num)))

    def whole(self) -> bool:
        return ANY not in self.pieces

    def shape(self) -> tuple:
        return tuple(None if isinstance(x, Num) else x for x in self.pieces)


class Known(NamedTuple):
    """A column, and what is known of the IRIs in it: one of these names."""

    column: Column
    name: Name | tuple[Name, ...]


def name(*pieces) -> Name:
    out: list = []
    for x in pieces:
        if x is ANY:
            out.append(x)
            break
        if out and not isinstance(x, Num) and not isinstance(out[-1], Num):
            out[-1] += x
        elif out and isinstance(out[-1], Num) and (isinstance(x, Num) or x[:1].isdigit()):
            raise ValueError(f"a number runs into what follows it: {pieces}")
        elif x:
            out.append(x)
    return Name(tuple(out))


def apart(a, b) -> bool:
    """Whether no IRI has both names. A tuple of names is one of them."""
    if a is None or b is None:
        return False
    for one, other in ((a, b), (b, a)):
        if not isinstance(one, Name):
            return all(apart(x, other) for x in one)
    x, y = list(a.pieces), list(b.pieces)
    while x and y:
        p, q = x.pop(0), y.pop(0)
        if p is ANY or q is ANY:
            return False
        if isinstance(p, Num) and isinstance(q, Num):
            continue
        if isinstance(p, Num) or isinstance(q, Num):
            text = q if isinstance(p, Num) else p
            return not (text[0].isdigit() or text[0] == "-")
        n = min(len(p), len(q))
        if p[:n] != q[:n]:
            return True
        x[:0], y[:0] = [p[n:]] if p[n:] else [], [q[n:]] if q[n:] else []
    return any(z and z[0] is not ANY for z in (x, y))


def name_of(x) -> Name | tuple[Name, ...] | None:
    if isinstance(x, Known):
        return x.name
    return x if isinstance(x, Name) else name(x) if isinstance(x, str) and x and not x.startswith("_:") else None


def either(names: list) -> tuple[Name, ...] | None:
    """One of these; None where one is unknown. Without their numbers, which are columns of other rows."""
    if None in names:
        return None
    flat = [y for x in names for y in ((x,) if isinstance(x, Name) else x)]
    return tuple(dict.fromkeys(name(*x.pieces[:1], ANY) if isinstance(x.pieces[0], str) else name(ANY) for x in flat))


def lit_col(x) -> Column:
    if isinstance(x, Known):
        return x.column
    return x.column() if isinstance(x, Name) else F.lit(x) if isinstance(x, str) else x


class Item(NamedTuple):
    """A triple that each row says. claim: the property and value of the restriction that o names; inner: about such a blank node; same: the object of all rows, where it is one; names of s, o and the claim's value, where they have some."""

    s: Column
    p: str | Column
    o: Column
    s_kind: str = "iri"
    o_kind: str = "iri"
    claim: tuple[str, Column] | None = None
    inner: bool = False
    same: str | None = None
    s_name: Name | None = None
    o_name: Name | None = None
    claim_name: Name | None = None

    def columns(self) -> list[Column]:
        return [self.s.alias("s"), lit_col(self.p).alias("p"), self.o.alias("o"), F.lit(self.s_kind).alias("s_kind"), F.lit(self.o_kind).alias("o_kind"), *_none()]


class Origin(NamedTuple):
    """Where columns of rows come from: token names a table, columns those that hold its tuples. all: rows for some of the tuples, of a part that has all of its rows for all of them (None: rows for any of the tuples)."""

    token: tuple
    columns: tuple[str, ...]
    all: Callable[[DataFrame], DataFrame] | None = None


class Loose(NamedTuple):
    """Rows that need no shuffle to be had, or are stored already: a part's rows are the distinct ones of these columns. fixed: gives column -> columns that decide it."""

    rows: DataFrame | Lazy
    columns: tuple[str, ...]
    fixed: Callable[[], dict[str, frozenset[str]]] = dict
    origin: Origin | None = None


class Part(NamedTuple):
    """Rows and what each says; without items, rows are triples themselves, of these predicates (None: of any). key: columns that no two rows share.

    Rows may be lazy; loose: rows that hold them, for what needs not all of them or not each once.
    """

    rows: DataFrame | Lazy
    items: list[Item] | None = None
    predicates: frozenset[str] | None = None
    key: tuple[str, ...] | None = None
    hints: dict[str, tuple] | None = None  # without items: predicate -> names of subjects and of objects, where they are known
    loose: Loose | None = None

    def may_have(self, predicate: str) -> bool:
        return self.predicates is None or predicate in self.predicates


def iri(s, p, o) -> Item:
    """A triple between resources."""
    return Item(lit_col(s), p, lit_col(o), same=o if isinstance(o, str) else None, s_name=name_of(s), o_name=name_of(o))


def literal(s, p, o) -> Item:
    return Item(lit_col(s), p, C.sanitize_xml(lit_col(o)), o_kind="lit", s_name=name_of(s))


def _none():
    return F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dt")


def both_ways(s, relation: str, o) -> list[Item]:
    """A relation and, where it has one, its inverse."""
    out = [iri(s, R[relation], o)]
    if relation in V.INVERSES:
        out.append(iri(o, R[V.INVERSES[relation]], s))
    return out


def bnode(s, p, o) -> Column:
    return F.concat(F.lit("_:r"), F.sha2(F.concat_ws("\x1f", lit_col(s), lit_col(p), lit_col(o)), 256))


def some_values(s, relation: str, o) -> list[Item]:
    """s is of type: some relation to o. Four triples around a blank node."""
    return _some(s, R[relation], o)


def _some(s, property_: str, o) -> list[Item]:
    b, sn, on = bnode(s, property_, o), name_of(s), name_of(o)
    bn = name("_:r", *sn.pieces, f"\x1f{property_}\x1f", *on.pieces) if isinstance(sn, Name) and isinstance(on, Name) and sn.whole() and on.whole() else None  # stands for the hash of just this
    return [
        Item(lit_col(s), V.RDF_TYPE, b, "iri", "bnode", claim=(property_, lit_col(o)), s_name=sn, o_name=bn, claim_name=on),
        Item(b, V.RDF_TYPE, F.lit(f"{V.OWL}Restriction"), "bnode", inner=True, same=f"{V.OWL}Restriction", s_name=bn, o_name=name(f"{V.OWL}Restriction")),
        Item(b, V.ON_PROPERTY, F.lit(property_), "bnode", inner=True, s_name=bn, o_name=name(property_)),
        Item(b, V.SOME_VALUES_FROM, lit_col(o), "bnode", inner=True, s_name=bn, o_name=on),
    ]


def individual(s, cls: str, label: Column | None = None, identifier: Column | None = None, see: Column | None = None) -> list[Item]:
    out = [iri(s, V.RDF_TYPE, f"{V.OWL}NamedIndividual"), iri(s, V.RDF_TYPE, cls)]
    if label is not None:
        out.append(literal(s, V.RDFS_LABEL, label))
    if identifier is not None:
        out.append(literal(s, "http://purl.org/dc/terms/identifier", identifier))
    if see is not None:
        out.append(iri(s, "http://www.w3.org/2000/01/rdf-schema#seeAlso", see))
    return out


WHOLE = "s is not null and p is not null and o is not null and (o_kind <> 'lit' or trim(o) <> '')"


def triples_of(df: DataFrame | Lazy, items: list[Item], key: tuple[str, ...] | None = None, loose: Loose | None = None) -> DataFrame | Lazy:
    """The triples of each row; those with a missing part are dropped. Not yet distinct. Items may be structs of the triple's columns, too. key: columns that no two rows share; loose: see Part."""
    structs = [F.struct(*x.columns()) if isinstance(x, Item) else x for x in items]
    make = lambda: df.select(F.explode(F.array(*structs)).alias("t")).select("t.*").filter(WHOLE)
    out = Lazy(df.sparkSession, make) if isinstance(df, Lazy) else make()
    if all(isinstance(x, Item) for x in items):
        names = None if any(not isinstance(x.p, str) for x in items) else frozenset(x.p for x in items)
        out._parts = [Part(df, items, names, key, loose=loose)]
    return out


def parts(triples: DataFrame) -> list[Part]:
    return triples.__dict__.get("_parts") or [Part(triples)]


def known(triples: DataFrame, *predicates: str) -> DataFrame:
    """The same triples, of which it is known that they have no other predicates."""
    out = triples.select("*")
    out._parts = [Part(out, None, frozenset(predicates))]
    return out


def together(*graphs: DataFrame) -> DataFrame:
    """All triples of the graphs, as they are, and the parts."""
    make = lambda: reduce(DataFrame.unionByName, map(real, graphs)).select("*")
    out = Lazy(graphs[0].sparkSession, make) if any(isinstance(g, Lazy) for g in graphs) else make()
    out._parts = [x for g in graphs for x in parts(g)]
    return out


def among(triples: DataFrame, predicates: list[str], o: str | None = None) -> DataFrame:
    """The triples with these predicates, and this object if one is given; of a graph that knows its parts only they are built, an item at a time, so filters reach the rows."""
    wanted = F.col("p").isin(predicates) if len(predicates) != 1 else F.col("p") == predicates[0]
    if o is not None:
        wanted = wanted & (F.col("o") == o)
    if "_parts" not in triples.__dict__:
        return triples.filter(wanted)
    found = []
    for part in parts(triples):
        if not any(part.may_have(p) for p in predicates):
            continue
        if part.items is None:
            found.append(part.rows.filter(wanted).select(*COLUMNS))
            continue
        for x in part.items:
            elsewhere = o is not None and (x.same not in (None, o) or (x.claim and not o.startswith("_:")))  # its objects are other ones
            if (not isinstance(x.p, str) or x.p in predicates) and not elsewhere:
                found.append(part.rows.select(*x.columns()).filter(WHOLE).filter(wanted))
    return reduce(DataFrame.unionByName, found) if found else triples.sparkSession.createDataFrame([], SCHEMA)


def of(triples: DataFrame, predicate: str, o: str | None = None) -> DataFrame:
    return among(triples, [predicate], o)


def about(triples: DataFrame, node: str) -> DataFrame:
    """The triples with this subject; of a graph that knows its parts, those that can have others are not built."""
    if "_parts" not in triples.__dict__:
        return triples.filter(F.col("s") == node)
    found, me = [], name_of(node)
    for part in parts(triples):
        if part.items is None:
            found.append(part.rows.filter(F.col("s") == node).select(*COLUMNS))
            continue
        said = [x for x in part.items if not apart(x.s_name, me)]
        if said:
            mine = reduce(Column.__or__, [x.s == node for x in said])
            rows = part.loose.rows.filter(mine).select(*part.loose.columns).distinct() if part.loose else part.rows.filter(mine)
            found.append(triples_of(rows, said).filter(F.col("s") == node).select(*COLUMNS))
    return reduce(DataFrame.unionByName, found) if found else triples.sparkSession.createDataFrame([], SCHEMA)


def claims(triples: DataFrame, only: str | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Restrictions (of this property only, if one is given) that rows of the parts state as such: property -> s, o; and the types by blank nodes of all other parts (s, bnode), None if there can be none.

    A blank node of some_values() is named by what it says, so nothing else can be said of it.
    """
    stated: dict[str, list[DataFrame]] = {}
    others = []
    for part in parts(triples):
        if part.items is None:
            if part.may_have(V.RDF_TYPE):
                others.append(part.rows.filter((F.col("p") == V.RDF_TYPE) & (F.col("o_kind") == "bnode")).select("s", F.col("o").alias("bnode")))
            continue
        for x in part.items:
            if x.claim:
                p, o = x.claim
                if only not in (None, p):
                    continue
                rows = part.rows.select(x.s.alias("s"), o.alias("o")).filter("s is not null and o is not null")
                both = [y for y in (x.s_name, x.claim_name) if isinstance(y, Name) and y.whole()]
                rows._set = part.key is not None and len(both) == 2 and set(part.key) <= {c for y in both for c in y.numbers()}
                stated.setdefault(p, []).append(rows)
            elif x.o_kind == "bnode" and (not isinstance(x.p, str) or x.p == V.RDF_TYPE):
                others.append(part.rows.select(*x.columns()).filter(WHOLE).filter(F.col("p") == V.RDF_TYPE).select("s", F.col("o").alias("bnode")))
    return {p: reduce(DataFrame.unionByName, x) for p, x in stated.items()}, reduce(DataFrame.unionByName, others) if others else None


def unique(graph: DataFrame) -> DataFrame:
    """The graph of items without repeated triples; what its rows state as restrictions stays stated as such."""
    items = [(part.rows, x) for part in parts(graph) for x in part.items if not x.claim and not x.inner]
    plain = reduce(DataFrame.unionByName, [rows.select(*x.columns()).filter(WHOLE) for rows, x in items]).distinct()
    claimed = [x for part in parts(graph) for x in part.items if x.claim]
    seen = lambda p, c, end: Known(F.col(c), either([getattr(x, end) for x in claimed if x.claim[0] == p]))
    stated = [triples_of(rows.distinct(), _some(seen(p, "s", "s_name"), p, seen(p, "o", "claim_name"))) for p, rows in claims(graph)[0].items()]
    out, hints = known(plain, *{x.p for _, x in items}), {}
    for p in {x.p for _, x in items}:
        hints[p] = tuple(either([getattr(x, end) for _, x in items if x.p == p]) for end in ("s_name", "o_name"))
    out._parts = [out._parts[0]._replace(hints=hints)]
    return together(out, *stated)


def union(graphs: list[DataFrame]) -> DataFrame:
    """A set of triples: one distinct over all parts, after they are put together."""
    return reduce(DataFrame.unionByName, graphs).distinct()


def stored_graph(triples: DataFrame, distinct: bool = True) -> DataFrame:
    """The distinct triples as a Parquet table by predicate in the shared folder: queries read only the predicates they name. distinct: they are not so yet.

    Rebalancing gives every predicate as many files as its size needs, so a predicate with most of the triples is split.
    """
    from .runtime import fresh_path

    path = fresh_path(triples.sparkSession, "graph")
    rows = triples.select(*COLUMNS)
    (rows.distinct() if distinct else rows).hint("rebalance", "p").write.partitionBy("p").parquet(path)
    schema = "s string, o string, s_kind string, o_kind string, o_lang string, o_dt string, p string"
    return triples.sparkSession.read.schema(schema).parquet(path).select(*COLUMNS)


def classes(terms: DataFrame, parent: str, browser: str = "https://amigo.geneontology.org/amigo/term/", names: Name | None = None) -> DataFrame:
    """Declares terms (iri, label) as subclasses of parent. names: what is known of their IRIs."""
    s = Known(F.col("iri"), either([names])) if names else F.col("iri")
    return triples_of(
        terms,
        [iri(s, V.RDF_TYPE, f"{V.OWL}Class"), iri(s, V.SUB_CLASS_OF, parent), literal(s, V.RDFS_LABEL, F.col("label")), iri(s, "http://www.w3.org/2000/01/rdf-schema#seeAlso", F.concat(F.lit(browser), F.replace(C.local_name(F.col("iri")), F.lit("_"), F.lit(":"))))],
    )


def regulation(pairs: DataFrame, positive: bool = True, names: dict[str, Name] | None = None) -> DataFrame:
    """Triples of agents (genes or inhibitors) that regulate mechanisms through a role and a process.

    pairs: ord, agent, mechanism, label, identifier, pubmed, known (false: the pair is numbered, but gives no triples).
    names: what is known of the IRIs in agent and mechanism.
    """
    kind = "activator" if positive else "inhibitor"
    cls, role_cls, process_cls = ("gene", "activator_role", "up_regulation") if positive else ("inhibitor", "inhibitor_role", "down_regulation")
    numbered = dense_number(pairs, ["ord", "agent", "mechanism"], "_n").filter("known")
    process = C.padded_id(f"{V.DATASET_NS}{'up' if positive else 'down'}reg_process_", F.col("_n"))
    role = F.concat(F.lit(V.DATASET_NS), C.local_name(F.col("agent")), F.lit("_"), C.local_name(F.col("mechanism")), F.lit(f"_{kind}_role"))
    given = lambda c: Known(F.col(c), either([names[c]])) if names else F.col(c)
    a, p, mechanism = given("agent"), Known(F.col("_process"), (name(f"{V.DATASET_NS}{'up' if positive else 'down'}reg_process_", ANY),)), given("mechanism")
    r = Known(F.col("_role"), a.name) if names and names["agent"].pieces[0].startswith(V.DATASET_NS) and "/" not in names["agent"].pieces[0][len(V.DATASET_NS) :] else F.col("_role")  # starts like the agent
    of_doc = Known(F.col("_doc"), (name("http://identifiers.org/pubmed:", ANY),))
    doc = C.publication_iri(F.col("pubmed"), F.lit(None).cast("string"))
    rows = numbered.withColumn("_role", role).withColumn("_process", process).withColumn("_doc", doc)
    return triples_of(
        rows,
        [
            *individual(a, V.CLASSES[cls], F.col("label"), F.col("identifier")),
            *individual(r, V.CLASSES[role_cls]),
            *individual(p, V.CLASSES[process_cls]),
            *both_ways(a, "has_attribute", r),
            *both_ways(r, "is_realized_in", p),
            *some_values(p, "positively_regulates" if positive else "negatively_regulates", mechanism),
            iri(a, R["has_evidence"], of_doc),
            iri(of_doc, V.RDF_TYPE, V.CLASSES["document"]),
        ],
    )


def feature_literals(df: DataFrame, subject: Column, columns: list[str]) -> DataFrame:
    """A literal for each column that is set."""
    items = [literal(subject, f"{V.SCHEMA_NS}{V.FEATURES.get(c, c)}", C.normalize_na(F.col(c).cast("string"))) for c in columns]
    return triples_of(df, items)


def numbered_pairs(rows: DataFrame, a: str, b: str, order: list[str], prefix: str = f"{V.DATASET_NS}complex_") -> DataFrame:
    """a, b, complex and first (order of the first row) for each distinct pair, numbered by first appearance.

    The global numbering is over (first place, pair) alone; with many pairs it is dealt out by place ranges: counts of
    ranges first, then numbers inside of each range.
    """
    pairs = rows.groupBy(a, b).agg(F.min(F.struct(*order)).alias("first"))
    return dense_number(pairs, ["first", a, b], "_n").select(a, b, "first", C.padded_id(prefix, F.col("_n")).alias("complex"))


def dense_number(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """1, 2, ... by a total order, without one task that sees all rows: range partitions, their counts, then local numbers."""
    from .runtime import cut

    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each partition
    before = before.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_before")


def complexes(rows: DataFrame, names: dict[str, Name] | None = None, key: tuple[str, ...] | None = None, loose: Loose | None = None) -> DataFrame:
    """Triples of peptide-cargo complexes. rows: peptide, cargo, complex, mechanism (array; of the pair's first row).

    names: of complex, peptide, cargo and mechanism, where each complex has one mechanism; the columns then are not needed. key: columns that no two rows share; loose: see Part.
    """
    x, p, c = (names[k] if names else F.col(k) for k in ("complex", "peptide", "cargo"))
    pr, cr = (name(*x.pieces, f"_{k}_role") if names else F.concat(x, F.lit(f"_{k}_role")) for k in ("peptide", "cargo"))
    base = [
        *individual(x, V.CLASSES["complex"]), *both_ways(x, "has_part", p), *both_ways(x, "has_part", c),
        *individual(pr, V.CLASSES["peptide_role"]), *individual(cr, V.CLASSES["cargo_role"]), *both_ways(p, "has_attribute", pr), *both_ways(c, "has_attribute", cr),
    ]
    m = names["mechanism"] if names else F.col("m")
    realized = [*some_values(pr, "is_realized_in", m), *some_values(cr, "is_realized_in", m)]
    if names:
        return triples_of(rows, [*base, *realized], key, loose)
    return together(triples_of(rows, base), triples_of(rows.withColumn("m", F.explode("mechanism")), realized))


def experiments(rows: DataFrame | Lazy, names: dict[str, Name] | None = None, fixed: Callable[[], dict[str, frozenset[str]]] = dict, origin: Origin | None = None) -> DataFrame:
    """Triples of experiments. rows: id, complex, cell_line, mechanism (array), location (array), pubmed, patent; rows of one id merge.

    names: of experiment, complex, mechanism and location, where each row has one of them; id and those columns then are not needed.
    fixed, origin: what is known of the rows (Loose), by names; of the document's column, _doc.
    A set: what several rows say alike is made one before it becomes triples, where rows are narrow.
    """
    given = rows
    with_doc = lambda: given.withColumn("_doc", C.publication_iri(F.col("pubmed"), F.col("patent")))
    rows = Lazy(given.sparkSession, with_doc) if names else with_doc()
    doc, line = F.col("_doc"), F.col("cell_line")
    if names:
        e, x, m, l = (names[k] for k in ("experiment", "complex", "mechanism", "location"))  # noqa: E741
    else:
        rows = rows.withColumn("_e", F.concat(F.lit(f"{V.DATASET_NS}experiment_"), F.col("id").cast("string")))
        e, x, m, l = (F.col(c) for c in ("_e", "complex", "m", "l"))  # noqa: E741
    said = [
        ([e], individual(e, V.CLASSES["experiment"])),
        ([e, x], both_ways(e, "has_participant", x)),
        ([e, line], both_ways(e, "has_participant", Known(line, names["cell_line"]) if names and "cell_line" in names else line)),
        ([e, doc], both_ways(e, "is_described_by", doc)),
        ([doc], [iri(doc, V.RDF_TYPE, V.CLASSES["document"])]),
        ([e, m], some_values(e, "is_about", m)),
        ([x, l], some_values(x, "is_located_in", l)),
    ]
    out = []
    for of, items in said:
        if names:
            cols = list(dict.fromkeys(c for y in of for c in (y.numbers() if isinstance(y, Name) else ["_doc" if y is doc else "cell_line"])))
            once = Lazy(rows.sparkSession, lambda cols=cols: rows.select(*cols).distinct())
            out.append(triples_of(once, items, tuple(cols), Loose(rows, tuple(cols), fixed, origin)))
        else:
            exploded = [F.explode({"m": "mechanism", "l": "location"}[k]).alias(k) if (k := next((n for n, c in (("m", m), ("l", l)) if c is y), None)) else y for y in of]
            out.append(triples_of(rows.select(*exploded).distinct(), items))
    return together(*out)


def ontology_header(spark, title: str, version: str = "1.0", base: str = V.DATASET_NS, literals: dict[str, list[str]] | None = None, vocabularies: list[str] | None = None, license: str = "https://creativecommons.org/licenses/by/4.0/", service: str | None = None) -> DataFrame:
    """What describes the graph itself: identity and version, Dublin Core and schema.org literals, license, access, vocabularies, and its query service.

    literals: further Dublin Core terms (description, creator, created, ...) with their values; vocabularies: namespaces that
    the graph uses; service: address of the query service.
    """
    s = base.rstrip("/#")
    dct, sdo, dcat, vo = "http://purl.org/dc/terms/", "https://schema.org/", "http://www.w3.org/ns/dcat#", "http://rdfs.org/ns/void#"
    items = [iri(s, V.RDF_TYPE, t) for t in (f"{V.OWL}Ontology", f"{vo}Dataset", f"{dcat}Dataset")]
    items += [literal(s, f"{dct}title", title), literal(s, f"{V.OWL}versionInfo", version), iri(s, f"{V.OWL}versionIRI", f"{s}/{version}"), literal(s, f"{vo}uriSpace", base)]
    items += [literal(s, f"{x}identifier", s) for x in (dct, sdo)] + [iri(s, f"{x}license", license) for x in (dct, sdo)]
    items += [iri(s, f"{dcat}accessURL", s), iri(s, f"{dcat}downloadURL", f"{s}/api/download/ttl")]
    items += [literal(s, dct + term, value) for term, values in (literals or {}).items() for value in values]
    items += [iri(s, f"{vo}vocabulary", x) for x in vocabularies or []]
    if service:
        me = f"{s}/service"
        items += [iri(me, V.RDF_TYPE, f"{dcat}DataService"), iri(me, f"{dcat}endpointURL", service), iri(me, f"{dcat}servesDataset", s), literal(me, V.RDFS_LABEL, f"{title}: query service")]
    return triples_of(spark.range(1), items)


def graph_stats(triples: DataFrame) -> DataFrame:
    """namespace, n: triples by the namespace of their predicate."""
    p = F.col("p")
    ns = F.when(p.startswith(V.SIO), "sio").when(p.contains("rdf-syntax"), "rdf").when(p.contains("rdf-schema"), "rdfs").when(p.startswith(V.OWL), "owl").when(p.startswith(V.SCHEMA_NS), "schema").otherwise("other")
    if "_parts" in triples.__dict__:
        from .names import predicate_counts

        return predicate_counts(triples).groupBy(ns.alias("namespace")).agg(F.sum("n").alias("n"))
    return triples.groupBy(ns.alias("namespace")).agg(F.count("*").alias("n"))


def node_kinds(triples: DataFrame) -> DataFrame:
    """kind, n: distinct nodes by kind."""
    from .names import count_distinct, item_source

    if any(part.items is None for part in parts(triples)):
        nodes = triples.select(F.col("s").alias("node"), F.col("s_kind").alias("kind")).union(triples.select("o", "o_kind")).distinct()
        return nodes.groupBy("kind").agg(F.count("*").alias("n"))
    by: dict[str, list] = {}
    for part in parts(triples):
        for x in part.items:
            both = item_source(part, x)
            by.setdefault(x.s_kind, []).append(both.pick(0))
            by.setdefault(x.o_kind, []).append(both.pick(1))
    counts = [count_distinct(triples.sparkSession, found).select(F.lit(kind).alias("kind"), "n") for kind, found in by.items()]
    return reduce(DataFrame.unionByName, counts).filter("n > 0")


def relation_summary(triples: DataFrame, relations: list[tuple[str, str, str]]) -> DataFrame:
    """association, n: distinct subject-object pairs. relations: (name, class of the subject, relation)."""
    from .names import count_distinct, stated, typed

    spark = triples.sparkSession
    counts = [count_distinct(spark, typed(triples, stated(triples, R[rel]), 0, V.CLASSES[cls])).select(F.lit(title).alias("association"), "n") for title, cls, rel in relations]
    return reduce(DataFrame.unionByName, counts).filter("n > 0")


#: entities of the build summary; those that are classes are counted below their parent
ENTITIES = ["gene", "inhibitor", "peptide", "cargo", "complex", "cell_line", "subcellular", "mechanism", "experiment", "document"]
#: name, class of the subject, relation, what is counted: distinct subjects, objects, or pairs
ASSOCIATIONS = [
    ("activator role is attribute of gene", "activator_role", "is_attribute_of", "pair"),
    ("inhibitor role is attribute of inhibitor", "inhibitor_role", "is_attribute_of", "pair"),
    ("peptide role is realized in mechanism", "peptide_role", "is_realized_in", "s"),
    ("cargo role is realized in mechanism", "cargo_role", "is_realized_in", "s"),
    ("cargo is part of complex", "cargo", "is_part_of", "o"),
    ("peptide is part of complex", "peptide", "is_part_of", "o"),
    ("complex is participant in experiment", "complex", "is_participant_in", "s"),
    ("cell line is participant in experiment", "cell_line", "is_participant_in", "s"),
    ("complex is located in place", "complex", "is_located_in", "s"),
    ("experiment is about mechanism", "experiment", "is_about", "s"),
    ("experiment is described by document", "experiment", "is_described_by", "s"),
]
#: name, class of the agent, relation of the process: distinct pairs of agent and mechanism
REGULATIONS = [("gene positively regulates mechanism", "gene", "positively_regulates"), ("inhibitor negatively regulates mechanism", "inhibitor", "negatively_regulates")]


def build_summary(triples: DataFrame) -> DataFrame:
    """kind (entity, association), name, n of a materialized graph: ten entities and thirteen associations, 0 where there are none.

    Counts are distinct.
    """
    from .names import all_strings, count_distinct, stated, typed

    spark = triples.sparkSession
    counts = []
    for c in ENTITIES:
        members = [x.pick(0) for x in stated(triples, V.RDF_TYPE, V.CLASSES[c])]
        if c in ("subcellular", "mechanism"):
            members += [x.pick(0) for x in stated(triples, V.SUB_CLASS_OF, V.CLASSES[c])]
        counts.append(count_distinct(spark, members).select(F.lit("entity").alias("kind"), F.lit(c).alias("name"), "n"))
    for title, cls, relation in REGULATIONS:
        agents = typed(triples, stated(triples, R["has_attribute"]), 0, V.CLASSES[cls])
        roles = all_strings(agents, ["agent", "role"], spark)
        near = [x for x in stated(triples, R["is_realized_in"]) if any(not apart(x.names[0], y.names[1]) for y in agents)]
        processes, ends = all_strings(near, ["role", "process"], spark), all_strings(stated(triples, R[relation]), ["process", "mechanism"], spark)
        pairs = roles.join(processes, "role").join(ends, "process")
        counts.append(pairs.agg(F.countDistinct("agent", "mechanism").alias("n")).select(F.lit("association").alias("kind"), F.lit(title).alias("name"), "n"))
    for title, cls, relation, what in ASSOCIATIONS:
        found = typed(triples, stated(triples, R[relation]), 0, V.CLASSES[cls])
        found = [x.pick(*{"s": (0,), "o": (1,), "pair": (0, 1)}[what]) for x in found]
        counts.append(count_distinct(spark, found).select(F.lit("association").alias("kind"), F.lit(title).alias("name"), "n"))
    return reduce(DataFrame.unionByName, counts).select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
