"""Command line: python -m inkstrata COMMAND ...

queries                          list the registered queries
run NAME --data DIR [--out DIR]  run a query over a folder of tables; show it or write it as Parquet
prep --documents DIR --out DIR   snippets of about 300 words
score --rows DIR [--reference C] accuracy tables of score rows on the console
report --rows DIR --out FILE     the same as a page
items --data DIR --out DIR       items of the tables examples, aliases and chapters in DIR, and the counters (--mode, --two, --min-mentions, --seed)
reps --data DIR --out DIR        representations of the tables items, texts, records, aliases (and rated) in DIR, by condition (--conditions, --sheets)
parse CONDITION                  what a condition's name means
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="inkstrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    prep = sub.add_parser("prep")
    prep.add_argument("--documents", required=True)
    prep.add_argument("--out", required=True)
    prep.add_argument("--words", type=int, default=300)
    for name in ("items", "reps"):
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
        if name == "items":
            p.add_argument("--mode", default="section", choices=["section", "window", "short"])
            p.add_argument("--two", action="store_true")
            p.add_argument("--min-mentions", type=int, default=1)
            p.add_argument("--seed", type=int, default=0)
        else:
            p.add_argument("--conditions", nargs="*", help="all of the catalogue if left out")
            p.add_argument("--sheets", nargs="*", default=[])
            p.add_argument("--generators", nargs="*", default=[])
    for name in ("score", "report"):
        p = sub.add_parser(name)
        p.add_argument("--rows", required=True)
        p.add_argument("--reference", default="noinfo")
        p.add_argument("--min-items", type=int, default=10)
        p.add_argument("--labels", type=int, default=3)
        if name == "report":
            p.add_argument("--out", required=True)
    sub.add_parser("parse").add_argument("condition")
    args = ap.parse_args(argv)

    if args.command == "parse":
        from .plans.conditions import parse

        print(parse(args.condition))
        return 0

    from . import catalog

    if args.command == "queries":
        for name, f in sorted(catalog.QUERIES.items()):
            print(f"{name:24} {(f.__doc__ or '').strip()}")
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .session import ship

    spark = ship(SparkSession.builder.appName("inkstrata").getOrCreate())
    if args.command == "run":
        got = catalog.QUERIES[args.name](spark, args.data)
        got.write.mode("overwrite").parquet(args.out) if args.out else got.show(50, False)
    elif args.command == "prep":
        from .functions.text import snippets, word_count

        docs = spark.read.parquet(args.documents).select("doc_id", F.posexplode(snippets(F.col("text"), args.words)).alias("idx", "text"))
        docs.withColumn("words", word_count(F.col("text"))).write.mode("overwrite").parquet(args.out)
    elif args.command == "items":
        from .operators import itemplan

        rows = itemplan.plan(*(spark.read.parquet(f"{args.data}/{t}") for t in ("examples", "aliases", "chapters")), mode=args.mode, two=args.two, min_mentions=args.min_mentions, seed=args.seed)
        rows.write.mode("overwrite").parquet(args.out)
        itemplan.counters(spark.read.parquet(args.out)).orderBy("book").show(1000, False)
    elif args.command == "reps":
        from .plans import catalogue

        read = lambda t: spark.read.parquet(f"{args.data}/{t}")
        keys = read("items").where("reason is null").select("book", F.col("chapter_index").alias("boundary"), F.explode("labels").alias("label"))
        sheets = any(c.endswith("_fd_flat") for c in args.conditions or ["_fd_flat"])
        sources = catalogue.Sources(read("texts"), read("records"), read("aliases"), read("rated") if sheets else None)
        catalogue.write(catalogue.build(keys, sources, args.conditions or catalogue.standard(sheets=args.sheets, generators=args.generators)), args.out)
    else:
        from .plans import report

        rows = spark.read.parquet(args.rows)
        if args.command == "report":
            report.write(rows, args.reference, args.out, n=args.labels, least=args.min_items)
        else:
            for name, df in report.tables(rows, args.reference, n=args.labels, least=args.min_items).items():
                print(name)
                df.orderBy(*df.columns[:2]).show(60, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
