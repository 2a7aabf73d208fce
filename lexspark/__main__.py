"""Command line: build and load a table of page texts, fetch files, search, ask, serve, or show its health."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexspark.functions.settings import Settings
from lexspark.operators import loading
from lexspark.operators.chunking import TOKEN_BUDGET
from lexspark.operators.loading import HashingEncoder
from lexspark.plans import service
from lexspark.plans.server import server
from lexspark.sources import files, schemas


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexspark")
    p.add_argument("verb", choices=["build", "fetch", "search", "ask", "serve", "health"])
    p.add_argument("path", help="folder of the loaded table; of fetch: of the files")
    p.add_argument("question", nargs="*")
    p.add_argument("--leg", choices=["hybrid", "lexical", "dense"], default="hybrid")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--fusion", choices=["weighted", "rrf"], default="weighted")
    p.add_argument("--ranking", choices=["bm25", "tf"], default="bm25")
    p.add_argument("--include-repealed", action="store_true")
    p.add_argument("--cells", type=int, help="build: cells of a vector index")
    p.add_argument("--probes", type=int, default=0, help="search: cells to look at; 0 is the exact search")
    p.add_argument("--dim", type=int, default=64, help="width of the stand-in encoder")
    p.add_argument("--pages", help="build: Parquet of page texts (act, number, text)")
    p.add_argument("--load", metavar="VERSION", help="build: encode and write this version; without it only the report is made")
    p.add_argument("--previous", help="build: the version that this one changes")
    p.add_argument("--manifest", help="fetch: the manifest's file")
    p.add_argument("--repin", action="store_true", help="fetch: take what comes as the new pin")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexspark").getOrCreate()
    if a.verb == "health":
        print(service.health(spark, a.path))
        return
    if a.verb == "fetch":
        service.fetch_all(files.read_manifest(spark, a.manifest), a.path, a.repin).show(truncate=False)
        return
    if a.verb == "build":
        report, chunks, future = service.build(spark.read.schema(schemas.PAGE_TEXT).parquet(a.pages))
        report.show(truncate=False)
        chunks.groupBy("act").agg(F.count("*").alias("chunks"), F.count_if(F.col("part_index") > 0).alias("of_split_articles")).show(truncate=False)
        print(f"articles of future law left out: {future.count()}; budget {TOKEN_BUDGET} tokens")
        if a.load:
            loading.load(spark, a.path, chunks, HashingEncoder(a.dim), a.load, a.previous, cells=a.cells).show()
        else:
            print("dry run: --load VERSION encodes and writes")
        return
    if a.verb == "serve":
        server(spark, a.path, HashingEncoder(a.dim), port=a.port).serve_forever()
        return
    asked = spark.createDataFrame(list(enumerate([" ".join(a.question)])), "qid long, question string")
    if a.verb == "ask":
        service.ask(spark, a.path, asked, HashingEncoder(a.dim)).show(truncate=False, vertical=True)
        return
    settings = Settings(fusion=a.fusion, lexical_ranking=a.ranking, vector_probes=a.probes)
    found = service.find(spark, a.path, asked, HashingEncoder(a.dim), settings, a.leg, a.k, include_repealed=a.include_repealed).orderBy("rank")
    shown = [c for c in ("lexical_rank", "dense_rank") if c in found.columns]
    found.select("rank", "score", *shown, "act", "article", "paragraph", F.substring("content", 1, 100).alias("content")).show(a.k, truncate=False)


if __name__ == "__main__":
    main()
