"""Command line: ``audit PATH``, ``benchmark PATHS...``, ``harness BASE NAMES...``, ``summary PATHS...``, ``version``."""

from __future__ import annotations

import argparse
import json

import strata


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strata")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    a = sub.add_parser("audit")
    a.add_argument("path")
    a.add_argument("--markdown-report", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("paths", nargs="+")
    b.add_argument("--json", action="store_true")
    h = sub.add_parser("harness")
    h.add_argument("base")
    h.add_argument("names", nargs="*", help="folders below BASE, or clone URLs of which the last part counts")
    h.add_argument("--url-file", help="a file of clone URLs, one a line; # begins a comment")
    h.add_argument("--results", default="results.csv")
    h.add_argument("--append", action="store_true")
    h.add_argument("--summary")
    r = sub.add_parser("summary", help="the text summary of stored documents")
    r.add_argument("paths", nargs="+")
    o = p.parse_args(argv)
    if o.command == "version":
        print(strata.__version__)
        return
    from pyspark.sql import SparkSession

    from strata.operators import report
    from strata.plans import scan
    from strata.sources import pytree

    spark = SparkSession.builder.appName("strata").getOrCreate()
    if o.command == "audit":
        texts = scan.audit(spark, o.path, o.markdown_report)
        print(texts["table"], texts["summary"], sep="\n\n")
    elif o.command == "benchmark":
        rows = scan.benchmark(spark, o.paths)
        if o.json:
            print(json.dumps([r.asDict() for r in rows.collect()], indent=2))
        else:
            report.benchmark_table(rows).show(1000, truncate=False)
    elif o.command == "summary":
        print("\n\n".join(r.summary for r in report.summaries(scan.stored_scan(spark, o.paths).overview()).collect()))
    else:
        urls = pytree.read_urls(o.url_file) if o.url_file else []
        wanted = {pytree.url_name(n): n if "://" in n else "" for n in [*o.names, *urls]}
        roots = pytree.local_corpus(o.base, list(wanted))
        links = spark.createDataFrame([(root, wanted[root.rpartition("/")[2]]) for root in pytree.absolute(roots)], "repo string, url string")
        rows = scan.harness(spark, roots, store=True)
        n = report.write_results(rows, o.results, o.append, links)
        if o.summary and n:
            report.write_summary(rows, o.summary)
        print(f"{n} repositories" if n else f"No results. The folders must exist below {o.base}.")


if __name__ == "__main__":
    main()
