"""Shape validation: cardinality and value constraints of focus nodes, as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..plans.graph_build import among, of

R, K = V.RELATIONS, V.CLASSES
INDIVIDUAL = f"{V.OWL}NamedIndividual"
IDENT = "http://purl.org/dc/terms/identifier"
MANY = 1 << 30
KINDS = ("iri", "lit", "bnode")


def shape(*items: tuple) -> list[tuple]:
    """(predicate, kind or constant, least, most)."""
    return list(items)


def typed(cls: str) -> tuple:
    return (V.RDF_TYPE, cls, 1, 1)


def some(p: str) -> tuple:
    return (p, "iri", 1, MANY)


def any_(p: str) -> tuple:
    return (p, "iri", 0, MANY)


def optional(p: str) -> tuple:
    return (p, "lit", 0, 1)


BASE = [typed(INDIVIDUAL), (V.RDFS_LABEL, "lit", 0, MANY), optional(IDENT)]
PEPTIDE_TEXTS = ["sequence", "smiles", "dssp", "chirality", "linearity", "ionicState", "peptideName", "sourceOfPeptide", "nTerminalModification", "cTerminalModification", "chemicalModification"]
#: name -> (class of the focus nodes, constraints). Predicates that a shape does not name are free; all values of one it names must fit.
SHAPES = {
    "Peptide": (K["peptide"], [*BASE, typed(K["peptide"]), some(R["is_part_of"]), some(R["has_attribute"]), *[optional(V.SCHEMA_NS + x) for x in PEPTIDE_TEXTS]]),
    "Complex": (K["complex"], [*BASE, typed(K["complex"]), (R["has_part"], "iri", 2, MANY), any_(R["is_participant_in"]), (V.RDF_TYPE, "bnode", 0, MANY)]),
    "Cargo": (K["cargo"], [*BASE, typed(K["cargo"]), some(R["is_part_of"]), some(R["has_attribute"])]),
    "Gene": (K["gene"], [*BASE, typed(K["gene"]), some(R["has_attribute"]), some(R["has_evidence"])]),
    "Inhibitor": (K["inhibitor"], [*BASE, typed(K["inhibitor"]), (V.RDF_TYPE, K["cargo"], 0, 1), some(R["has_attribute"]), some(R["has_evidence"])]),
    "Activator Role": (K["activator_role"], [*BASE, typed(K["activator_role"]), some(R["is_attribute_of"]), some(R["is_realized_in"])]),
    "Inhibitor Role": (K["inhibitor_role"], [*BASE, typed(K["inhibitor_role"]), some(R["is_attribute_of"]), some(R["is_realized_in"])]),
    "Peptide Role": (K["peptide_role"], [*BASE, typed(K["peptide_role"]), some(R["is_attribute_of"]), (V.RDF_TYPE, "bnode", 0, MANY)]),
    "Cargo Role": (K["cargo_role"], [*BASE, typed(K["cargo_role"]), some(R["is_attribute_of"]), (V.RDF_TYPE, "bnode", 0, MANY)]),
    "Cell Line": (K["cell_line"], [*BASE, typed(K["cell_line"]), some(R["is_participant_in"])]),
    "Subcellular Entity": (K["subcellular"], [*BASE, typed(K["subcellular"])]),
    "Uptake Mechanism": (K["mechanism"], [*BASE, typed(K["mechanism"])]),
    "Experiment": (K["experiment"], [*BASE, typed(K["experiment"]), (R["has_participant"], "iri", 1, MANY), any_(R["is_described_by"]), (V.RDF_TYPE, "bnode", 0, MANY)]),
    "Document": (K["document"], [typed(K["document"]), any_(R["describes"])]),
}


def constraints(spark, shapes: dict = SHAPES) -> DataFrame:
    rows = [(name, cls, p, what if what in KINDS else None, None if what in KINDS else what, lo, hi) for name, (cls, items) in shapes.items() for p, what, lo, hi in items]
    return F.broadcast(spark.createDataFrame(rows, "shape string, class string, p string, kind string, value string, least int, most int"))


def validate(triples: DataFrame, shapes: dict = SHAPES) -> DataFrame:
    """shape, focus, reason: what fails. Validate the asserted graph: inference adds types.

    One join of focus nodes with their triples; counts by constraint; a triple of a named predicate that fits none of the
    shape's constraints fails too.
    """
    spark = triples.sparkSession
    wanted = constraints(spark, shapes)
    classes = wanted.select("shape", "class").distinct()
    focus = of(triples, V.RDF_TYPE).join(F.broadcast(classes), F.col("o") == F.col("class")).filter(F.col("s") != F.col("class")).select("shape", F.col("s").alias("focus")).distinct()
    facts = focus.join(among(triples, sorted({x[0] for _, items in shapes.values() for x in items})).select(F.col("s").alias("focus"), "p", "o", "o_kind"), "focus")
    fit = (F.col("c.value").isNotNull() & (F.col("o") == F.col("c.value"))) | (F.col("c.value").isNull() & (F.col("o_kind") == F.col("c.kind")))
    per_fact = facts.join(wanted.alias("c").withColumnRenamed("shape", "cs").withColumnRenamed("p", "cp").alias("c"), (F.col("shape") == F.col("c.cs")) & (F.col("p") == F.col("c.cp")))
    hits = per_fact.filter(fit).groupBy("shape", "focus", F.col("c.cp").alias("p"), F.coalesce("c.value", "c.kind").alias("what")).agg(F.count("*").alias("n"))
    due = focus.join(wanted.select("shape", "p", F.coalesce("value", "kind").alias("what"), "least", "most"), "shape")
    counted = due.join(hits, ["shape", "focus", "p", "what"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = counted.filter("n < least or n > most").select("shape", "focus", F.format_string("%s: %d of %s", "p", "n", "what").alias("reason"))
    odd = per_fact.groupBy("shape", "focus", "p", "o").agg(F.max(fit.cast("int")).alias("ok")).filter("ok = 0").select("shape", "focus", F.format_string("%s: unexpected %s", "p", "o").alias("reason"))
    return bad.unionByName(odd).distinct()


def focus_counts(triples: DataFrame, shapes: dict = SHAPES) -> DataFrame:
    """shape, n: focus nodes of each shape, 0 where there are none."""
    names = F.broadcast(triples.sparkSession.createDataFrame([(k, c) for k, (c, _) in shapes.items()], "shape string, class string"))
    focus = of(triples, V.RDF_TYPE).join(names, F.col("o") == F.col("class")).filter(F.col("s") != F.col("class")).groupBy("shape").agg(F.countDistinct("s").alias("n"))
    return names.join(focus, "shape", "left").select("shape", F.coalesce("n", F.lit(0)).alias("n"))


def summary(triples: DataFrame, shapes: dict = SHAPES) -> DataFrame:
    """shape, focus nodes, failed, passed; shapes without focus nodes are skipped, which is no failure."""
    failed = validate(triples, shapes).groupBy("shape").agg(F.countDistinct("focus").alias("failed"))
    out = focus_counts(triples, shapes).join(failed, "shape", "left").select("shape", "n", F.coalesce("failed", F.lit(0)).alias("failed"))
    return out.withColumn("passed", F.col("n") - F.col("failed")).withColumn("status", F.when(F.col("n") == 0, "skipped").when(F.col("failed") == 0, "passed").otherwise("failed"))
