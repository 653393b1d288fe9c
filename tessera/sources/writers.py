"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import escape_literal


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_edges(df: DataFrame, path: str) -> None:
    """Distinct pairs, sorted, tab-separated, no header."""
    df.select("subject", "object").na.drop("any").distinct().orderBy("subject", "object").write.mode("overwrite").csv(path, sep="\t")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def term(value: Column, kind: Column, lang: Column, dt: Column) -> Column:
    literal = F.concat(F.lit('"'), escape_literal(value), F.lit('"'), F.coalesce(F.concat(F.lit("@"), lang), F.concat(F.lit("^^<"), dt, F.lit(">")), F.lit("")))
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", value).otherwise(literal)


def ntriples(triples: DataFrame) -> DataFrame:
    """value: an N-Triples line (also valid Turtle) for each triple."""
    none = F.lit(None).cast("string")
    s = term(F.col("s"), F.col("s_kind"), none, none)
    o = term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dt"))
    return triples.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_graph(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


RDF_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'


def rdf_xml(triples: DataFrame) -> DataFrame:
    """value: an RDF/XML description for each triple; predicates that end in no XML name are left out, as the format has none for them."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    name = F.regexp_extract("p", r"([A-Za-z_][A-Za-z0-9_.-]*)$", 1)
    space = F.substr(F.col("p"), F.lit(1), F.length("p") - F.length(name))
    node = lambda kind, value, iri: F.when(F.col(kind) == "bnode", F.concat(F.lit(' rdf:nodeID="b'), F.replace(F.substr(F.col(value), F.lit(3)), F.lit(":"), F.lit("_")), F.lit('"'))).otherwise(F.concat(F.lit(f' rdf:{iri}="'), escape(F.col(value)), F.lit('"')))
    tag = F.concat(F.lit("<n:"), name, F.lit(' xmlns:n="'), escape(space), F.lit('"'))
    said = F.concat(F.coalesce(F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"')), F.concat(F.lit(' rdf:datatype="'), escape(F.col("o_dt")), F.lit('"')), F.lit("")), F.lit(">"), escape(F.col("o")), F.lit("</n:"), name, F.lit(">"))
    body = F.when(F.col("o_kind") == "lit", F.concat(tag, said)).otherwise(F.concat(tag, node("o_kind", "o", "resource"), F.lit("/>")))
    return triples.filter(name != "").select(F.concat(F.lit("<rdf:Description"), node("s_kind", "s", "about"), F.lit(">"), body, F.lit("</rdf:Description>")).alias("value"))


def write_rdf_xml(triples: DataFrame, path: str) -> None:
    """A folder of RDF/XML documents, one for each partition."""

    def document(batches):
        import pyarrow as pa

        one = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield one(RDF_HEAD)
        yield from batches
        yield one("</rdf:RDF>")

    rdf_xml(triples).mapInArrow(document, "value string").write.mode("overwrite").text(path)


def write_materialized(asserted: DataFrame, materialized: DataFrame, path: str) -> int:
    """Saves the larger graph; raises if nothing was inferred. Returns the number of inferred triples."""
    inferred = materialized.count() - asserted.count()
    if inferred <= 0:
        raise ValueError("nothing was inferred; the graph is not saved")
    write_graph(materialized, path)
    return inferred


def jsonld(triples: DataFrame, subject: str | None = None) -> DataFrame:
    """value: one JSON-LD node for each subject."""
    rows = triples if subject is None else triples.filter(F.col("s") == subject)
    obj = F.when(F.col("o_kind") == "lit", F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.col("o_lang").alias("@language"), F.col("o_dt").alias("@type"))).otherwise(
        F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"), F.lit(None).cast("string").alias("@type"))
    )
    per = rows.groupBy("s", "p").agg(F.array_sort(F.collect_list(obj)).alias("os"))
    node = per.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os")))).alias("props"))
    return node.select(F.to_json(F.struct(F.col("s").alias("@id"), F.col("props").alias("@properties"))).alias("value"))


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrites a Parquet table in place, keeping the first version in <path>.bak.

    The new rows are written before the swap of two renames; a version between the first and the last is deleted after it.
    What a lost driver leaves half done is <path>.new and <path>.bak or <path>.old, both whole.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.new")
    old = f"{path}.old" if fs.exists(at(f"{path}.bak")) else f"{path}.bak"
    fs.delete(at(f"{path}.old"), True)
    for a, b in ((path, old), (f"{path}.new", path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"could not rename {a} to {b}")
    if old.endswith(".old"):
        fs.delete(at(old), True)
