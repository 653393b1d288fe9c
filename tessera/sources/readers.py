"""Sources: delimited files, nested JSON, ontologies, tagged records, triples, remote bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V

#: what pandas-written CSV files mean by missing (NIL is a value)
MISSING = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A"]
TRIPLE = "s string, p string, o string, s_kind string, o_kind string, o_lang string, o_dt string"


def read_csv(spark: SparkSession, path: str, columns: list[str] | str, prune: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with header and an explicit schema; words for missing values become null. prune: only these columns are parsed."""
    schema = columns if isinstance(columns, str) else ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True, escape='"', enforceSchema=True)
    df = df.select(*prune) if prune else df
    return df.withColumns({c: F.when(F.col(c).isin(MISSING), None).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"})


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A headerless two-column TSV file, without rows that lack a side."""
    return spark.read.csv(path, schema="subject string, object string", sep="\t").na.drop("any")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in whatever file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


ALIASES = {
    "mechanism": ["GO_identifier", "GO"],
    "gene": ["ensembl_id", "ensembl"],
    "inhibitor": ["CHEBI", "chebi", "CheBI"],
    "pubmed": ["PUBMED_ID", "Pubmed", "pubmed"],
}


def json_field(doc: Column, aliases: list[str]) -> Column:
    """The first alias that is set; the item itself where it is plain text."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{a}") for a in aliases])


def read_mechanisms(spark: SparkSession, path: str) -> DataFrame:
    """mechanism, name, kind (gene | inhibitor), item, item_name, pubmed; nested pathways count for their parent."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("doc"))
    top = text.select("doc", json_field(F.col("doc"), ALIASES["mechanism"]).alias("mechanism"), F.get_json_object("doc", "$.mechanism_name").alias("name"))
    nested = top.select("mechanism", "name", F.explode(F.from_json(F.get_json_object("doc", "$.pathways"), "array<string>")).alias("doc"))
    both = top.select("mechanism", "name", "doc").unionByName(nested)
    out = None
    for kind, field in (("gene", "associated_genes"), ("inhibitor", "inhibitors")):
        items = both.select("mechanism", "name", F.explode(F.from_json(F.get_json_object("doc", f"$.{field}"), "array<string>")).alias("it"))
        found = items.select(
            "mechanism", "name", F.lit(kind).alias("kind"), F.coalesce(json_field(F.col("it"), ALIASES[kind]), F.when(~F.col("it").startswith("{"), F.col("it"))).alias("item"),
            F.get_json_object("it", "$.name").alias("item_name"), json_field(F.col("it"), ALIASES["pubmed"]).alias("pubmed"),
        ).filter("item is not null and mechanism is not null")
        out = found if out is None else out.unionByName(found)
    return out


# -- ontologies


def read_obo(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """curie, label, synonyms, parents: a [Term] stanza a row, split by the reader itself; what follows the header of another kind of stanza is not the term's."""
    parts = spark.read.text(path, lineSep="\n[Term]\n").select(F.regexp_replace("value", r"^\[Term\]\r?\n", "").alias("value"))
    own = F.get(F.split("value", r"(?:^|\n)\[[^\]\n]*\]\r?(?:\n|$)"), F.lit(0))
    stanza = parts.select(F.split(own, "\r?\n").alias("lines")).select(F.filter("lines", lambda x: x.rlike("^[a-z_]+: ")).alias("lines"))
    value = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.substr(x, F.lit(len(tag) + 3)))
    out = stanza.select(
        F.get(value("id"), F.lit(0)).alias("curie"),
        F.get(value("name"), F.lit(0)).alias("label"),
        F.transform(value("synonym"), lambda x: F.regexp_extract(x, '^"(.*)"', 1)).alias("synonyms"),
        F.transform(value("is_a"), lambda x: F.split(x, " ")[0]).alias("parents"),
    ).filter("curie is not null")
    return out.filter(F.col("curie").startswith(prefix + ":")) if prefix else out


def read_records(spark: SparkSession, path: str, database: str = "CLO") -> DataFrame:
    """name, id: of tagged flat records (ID, SY, DR lines; // ends one) that have an id of the database."""
    lines = spark.read.text(path, lineSep="\n//\n").select(F.split("value", "\n").alias("lines"))
    tag = lambda t: F.transform(F.filter("lines", lambda x: x.startswith(f"{t}   ")), lambda x: F.trim(F.substr(x, F.lit(6))))
    names = F.flatten(F.array(tag("ID"), F.flatten(F.transform(tag("SY"), lambda x: F.transform(F.split(x, ";"), lambda v: F.trim(v))))))
    ids = F.filter(F.transform(tag("DR"), lambda x: C.canon_search(F.regexp_extract(x, rf"^{database};\s*(\S+)", 1), database)), lambda x: x.isNotNull())
    return lines.select(F.explode(F.filter(names, lambda x: x != "")).alias("name"), ids.alias("ids")).select("name", F.explode("ids").alias("id")).distinct()


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """iri, label, parents of the owl:Class elements of an RDF/XML file, by Spark's own XML source."""
    schema = "`_rdf:about` string, `rdfs:label` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>"
    df = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    parents = F.filter(F.transform(F.coalesce(F.col("`rdfs:subClassOf`"), F.array()), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull())
    return df.select(F.col("`_rdf:about`").alias("iri"), F.get(F.col("`rdfs:label`"), F.lit(0)).alias("label"), parents.alias("parents")).filter("iri is not null")


def read_rdf_xml_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of the classes and individuals of an RDF/XML file: types, labels, synonyms, superclasses, and restrictions
    (some values from) of classes and individuals as blank nodes, named by a hash of what they say.
    """
    from ..plans import graph_build as B

    ref = "struct<`_rdf:resource`: string>"
    nested = f"array<struct<`_rdf:resource`: string, `owl:Restriction`: struct<`owl:onProperty`: {ref}, `owl:someValuesFrom`: {ref}>>>"
    text = "array<struct<_VALUE: string, `_xml:lang`: string>>"
    out = []
    for tag, link, kind in (("owl:Class", "rdfs:subClassOf", f"{V.OWL}Class"), ("owl:NamedIndividual", "rdf:type", f"{V.OWL}NamedIndividual")):
        schema = f"`_rdf:about` string, `rdfs:label` {text}, `oboInOwl:hasExactSynonym` {text}, `{link}` {nested}"
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter(F.col("`_rdf:about`").isNotNull())
        rows = rows.select(F.col("`_rdf:about`").alias("s"), F.col("`rdfs:label`").alias("labels"), F.col("`oboInOwl:hasExactSynonym`").alias("synonyms"), F.col(f"`{link}`").alias("links"))
        s, p = F.col("s"), V.SUB_CLASS_OF if link == "rdfs:subClassOf" else V.RDF_TYPE
        out.append(B.triples_of(rows, [B.iri(s, V.RDF_TYPE, kind)]))
        for words, name in (("labels", V.RDFS_LABEL), ("synonyms", V.EXACT_SYNONYM)):
            out.append(_texts(rows.select("s", F.explode(words).alias("x")), name))
        each = rows.select("s", F.explode("links").alias("x"))
        out.append(B.triples_of(each, [B.iri(s, p, F.col("x.`_rdf:resource`"))]))
        some = each.select("s", F.col("x.`owl:Restriction`.`owl:onProperty`.`_rdf:resource`").alias("on"), F.col("x.`owl:Restriction`.`owl:someValuesFrom`.`_rdf:resource`").alias("v")).na.drop("any")
        b = B.bnode(s, F.col("on"), F.col("v"))
        part = lambda a, q, o, a_kind, o_kind: F.struct(a.alias("s"), F.lit(q).alias("p"), o.alias("o"), F.lit(a_kind).alias("s_kind"), F.lit(o_kind).alias("o_kind"), *B._none())
        out.append(B.triples_of(some, [part(s, p, b, "iri", "bnode"), part(b, V.RDF_TYPE, F.lit(f"{V.OWL}Restriction"), "bnode", "iri"), part(b, V.ON_PROPERTY, F.col("on"), "bnode", "iri"), part(b, V.SOME_VALUES_FROM, F.col("v"), "bnode", "iri")]))
    return B.union(out)


def _texts(found: DataFrame, p: str) -> DataFrame:
    """Literals of s and x (text and language)."""
    none = F.lit(None).cast("string")
    rows = found.select("s", F.lit(p).alias("p"), F.col("x._VALUE").alias("o"), F.lit("iri").alias("s_kind"), F.lit("lit").alias("o_kind"), F.col("x.`_xml:lang`").alias("o_lang"), none.alias("o_dt"))
    return rows.filter("o is not null and trim(o) <> ''")


# -- triples

NT = r'^(<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'


def unescape_literal(c: Column) -> Column:
    marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for code, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        marked = F.replace(marked, F.lit(code), F.lit(char))
    return F.replace(marked, F.lit("\x00"), F.lit("\\"))


def escape_literal(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """Triples of N-Triples lines (column value); other lines are dropped."""
    part = lambda i: F.nullif(F.regexp_extract("value", NT, i), F.lit(""))
    text = F.regexp_extract("value", NT, 7)
    rows = lines.filter(F.col("value").rlike(NT)).select(
        F.coalesce(part(2), F.concat(F.lit("_:"), part(3))).alias("s"),
        part(4).alias("p"),
        F.coalesce(part(5), F.concat(F.lit("_:"), part(6)), unescape_literal(text)).alias("o"),
        F.when(part(3).isNotNull(), "bnode").otherwise("iri").alias("s_kind"),
        F.when(part(5).isNotNull(), "iri").when(part(6).isNotNull(), "bnode").otherwise("lit").alias("o_kind"),
        part(8).alias("o_lang"),
        part(9).alias("o_dt"),
    )
    return rows.distinct()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def turtle_to_triples(spark: SparkSession, text: str) -> DataFrame:
    """Triples of a Turtle document: prefixes, a, lists of predicates and objects, blank node property lists, literals.

    Turtle cannot be cut at lines, so one document is read on the driver; large graphs come as N-Triples.
    """
    return spark.createDataFrame(list(_turtle(text)), TRIPLE).distinct()


def _turtle(text: str) -> Iterator[tuple]:
    import re

    token = re.compile(r'\s+|#[^\n]*|("""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")(?:@([A-Za-z-]+)|\^\^(<[^>]*>|[\w-]*:[\w.-]*))?|(<[^>]*>)|(@prefix|@base|PREFIX|BASE)|([\[\];,.])(?=[\s\[\];,.<_"]|$)|(_:[\w-]+|[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|a(?=\s)|true|false|[-+]?\d+(?:\.\d+)?)')
    tokens, at = [], 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise ValueError(f"Turtle at {at}: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastindex:
            tokens.append(m)
    prefixes, blank, pos = {}, [0], [0]

    def iri(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        head, _, tail = t.partition(":")
        return prefixes[head] + tail

    def node(m) -> tuple[str, str, str | None, str | None]:
        if m[1]:
            body = m[1][3:-3] if m[1].startswith('"""') else m[1][1:-1]
            body = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), body)
            return body, "lit", m[2], iri(m[3]) if m[3] else None
        if m[4]:
            return m[4][1:-1], "iri", None, None
        t = m[7]
        if t == "a":
            return V.RDF_TYPE, "iri", None, None
        if t.startswith("_:"):
            return t, "bnode", None, None
        if ":" not in t:
            kind = "boolean" if t in ("true", "false") else "decimal" if "." in t else "integer"
            return t, "lit", None, f"http://www.w3.org/2001/XMLSchema#{kind}"
        return iri(t), "iri", None, None

    def read_node(out):
        m = tokens[pos[0]]
        pos[0] += 1
        if m[6] == "[":
            blank[0] += 1
            me = (f"_:b{blank[0]}", "bnode", None, None)
            if tokens[pos[0]][6] != "]":
                read_predicates(me, out)
            pos[0] += 1
            return me
        return node(m)

    def read_predicates(s, out):
        while True:
            p = read_node(out)
            while True:
                o = read_node(out)
                out.append((s[0], p[0], o[0], s[1], o[1], o[2], o[3]))
                if tokens[pos[0]][6] != ",":
                    break
                pos[0] += 1
            while tokens[pos[0]][6] == ";":
                pos[0] += 1
            if tokens[pos[0]][6] in (".", "]"):
                return

    while pos[0] < len(tokens):
        m = tokens[pos[0]]
        if m[5]:
            pos[0] += 1
            if m[5].lower().endswith("prefix"):
                prefixes[tokens[pos[0]][7][:-1]] = tokens[pos[0] + 1][4][1:-1]
                pos[0] += 2
            else:
                pos[0] += 1
            if pos[0] < len(tokens) and tokens[pos[0]][6] == ".":
                pos[0] += 1
            continue
        out: list[tuple] = []
        s = read_node(out)
        if tokens[pos[0]][6] != ".":
            read_predicates(s, out)
        pos[0] += 1
        yield from out


def local_names(lines: DataFrame, pattern: str) -> DataFrame:
    """Distinct matches of a pattern in raw graph text."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("name")).distinct()


def load_graph(spark: SparkSession, paths: list[str], remote: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The first graph file that exists (N-Triples, or Turtle or RDF/XML by its suffix), else the remote one."""
    found = first_existing(spark, paths)
    if found is None:
        if remote is None:
            raise FileNotFoundError(", ".join(paths))
        return remote()
    if found.endswith(".ttl"):
        return turtle_to_triples(spark, "\n".join(r[0] for r in spark.read.text(found, wholetext=True).toLocalIterator()))
    if found.endswith((".owl", ".rdf", ".xml")):
        return read_rdf_xml_triples(spark, found)
    return read_ntriples(spark, found)


# -- services


def lookup(terms: DataFrame, client: Callable[[str], list], cache: DataFrame | None = None, tries: int = 3, wait: float = 1.5) -> DataFrame:
    """term, ids: asks a service for each distinct term that the cache lacks, with retries and linear back-off."""

    def ask(batches):
        import time

        import pandas as pd

        for pdf in batches:
            out = []
            for term in pdf.term:
                for k in range(tries):
                    try:
                        out.append(client(term))
                        break
                    except Exception:
                        if k == tries - 1:
                            out.append(None)
                        else:
                            time.sleep(wait * (k + 1))
            yield pd.DataFrame({"term": pdf.term, "ids": out})

    todo = terms.select("term").filter("term is not null").distinct()
    if cache is None:
        return todo.mapInPandas(ask, "term string, ids array<string>")
    return todo.join(cache, "term", "left_anti").mapInPandas(ask, "term string, ids array<string>").unionByName(cache.select("term", "ids"))


def sparql_bindings(spark: SparkSession, reply: str) -> DataFrame:
    """A row for each binding of a SPARQL JSON reply; unbound variables are null."""
    import json

    doc = json.loads(reply)
    names = doc["head"]["vars"]
    rows = [tuple(b.get(v, {}).get("value") for v in names) for b in doc["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{v}` string" for v in names))


def cached_by_key(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table of a key (say, of model and input version), made once."""
    import hashlib

    path = f"{root}/{hashlib.md5(key.encode()).hexdigest()[:8]}"
    if first_existing(spark, [f"{path}/_SUCCESS"]) is None:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
