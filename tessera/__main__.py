"""Command line: python -m tessera <command> ..."""

from __future__ import annotations

import argparse
import importlib
import os


def named(path: str):
    """The object that module:name names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description="Annotation tables to knowledge graphs on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("preprocess", help="clean, split, classify and deduplicate an annotation table")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--columns", required=True, help="comma-separated header of the CSV file")
    c.add_argument("--sequence", default="Sequence")
    c.add_argument("--split", default="", help="columns to split; a trailing ! means at conjunctions only")
    c = sub.add_parser("link", help="link a column to an ontology")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--columns", required=True)
    c.add_argument("--column", required=True)
    c.add_argument("--ontology", required=True, help="CURIE prefix")
    c.add_argument("--obo", required=True)
    c.add_argument("--methods", default="exact", help="comma-separated: exact, biosyn, rag")
    c.add_argument("--fuzzy-threshold", type=float, default=0.92)
    c.add_argument("--encoder", help="module:function that returns a pandas UDF of text vectors; by default hashed character runs")
    c.add_argument("--rag-client", help="module:function(list of (mention, context)) -> list of ids")
    c.add_argument("--rag-url", help="address of a chat completions service, in place of a client")
    c.add_argument("--rag-model", default="")
    c = sub.add_parser("materialize", help="apply the rules to a graph")
    c.add_argument("input")
    c.add_argument("output")
    c = sub.add_parser("validate", help="check a graph against the shapes")
    c.add_argument("input")
    c = sub.add_parser("query", help="run a SPARQL SELECT query")
    c.add_argument("input")
    c.add_argument("query")
    c = sub.add_parser("serve", help="serve a graph")
    c.add_argument("input")
    c.add_argument("--port", type=int, default=8080)
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import annotations, linking, shapes
    from .plans import reasoner
    from .plans.sparql import sparql
    from .sources import readers, writers

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "preprocess":
        df = readers.read_csv(spark, args.input, args.columns.split(","))
        steps = annotations.Preprocessor(df, args.sequence).clean_sequences().filter_valid().normalize().filter_required()
        steps = steps.split({c.rstrip("!"): c.endswith("!") for c in args.split.split(",") if c}).classify()
        writers.write_csv(steps.df, args.output)
        print(steps.stats(df))
    elif args.command == "link":
        terms = readers.read_obo(spark, args.obo, args.ontology).withColumn("ord", F.monotonically_increasing_id())
        synonyms = terms.select("ord", "curie", "label", F.explode("synonyms").alias("synonym"))
        edges = terms.select(F.col("curie").alias("child"), F.explode("parents").alias("parent"))
        client = named(args.rag_client) if args.rag_client else linking.http_client(args.rag_url, args.rag_model, os.environ.get("RAG_API_KEY")) if args.rag_url else None
        df = readers.read_csv(spark, args.input, args.columns.split(","))
        asked = df.select(F.coalesce(args.column, F.lit("")).alias("mention"))
        try:
            found = linking.link_all(asked, terms, synonyms, edges, args.methods.split(","), args.fuzzy_threshold, named(args.encoder)() if args.encoder else None, client)
        except ValueError as e:
            raise SystemExit(str(e)) from e
        found = found.withColumnRenamed("mention", "_m")
        writers.write_csv(df.join(found, F.coalesce(args.column, F.lit("")) == F.col("_m"), "left").drop("_m"), args.output)
    elif args.command == "materialize":
        asserted = readers.load_graph(spark, [args.input])
        full, counts = reasoner.materialize(asserted)
        counts.show(truncate=False)
        print(writers.write_materialized(asserted, full, args.output), "inferred")
    elif args.command == "validate":
        found = shapes.summary(readers.load_graph(spark, [args.input]))
        found.show(truncate=False)
        if found.filter("failed > 0").count():
            raise SystemExit(1)
    elif args.command == "query":
        sparql(readers.load_graph(spark, [args.input]), args.query).show(100, truncate=False)
    else:
        from .service import Service, serve

        serve(Service(readers.load_graph(spark, [args.input]).cache()), args.port).serve_forever()


if __name__ == "__main__":
    main()
