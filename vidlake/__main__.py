"""Command line: list and run registered queries, or run a job on tables.

    python -m vidlake list
    python -m vidlake run a1_retrieval_metrics --sf-dir /data/sf0.1 [--out PATH]
    python -m vidlake evaluate --refs PATH --queries PATH [--topk 10 --stride 1 --max-frames N]
    python -m vidlake shortlist --top PATH --evidence PATH --truth PATH [--ks 1 5 10 20 50 --min-matches 10]
    python -m vidlake align --candidates PATH --out PATH [--radius 5 --n-ref N]
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vidlake", description="Frame analytics on Spark")
    jobs = top.add_subparsers(dest="job", required=True)
    jobs.add_parser("list")
    run = jobs.add_parser("run")
    run.add_argument("name")
    run.add_argument("--sf-dir", required=True)
    run.add_argument("--out")
    evaluate = jobs.add_parser("evaluate")
    for name in ("--refs", "--queries"):
        evaluate.add_argument(name, required=True)
    evaluate.add_argument("--topk", type=int, default=10)
    evaluate.add_argument("--stride", type=int, default=1)
    evaluate.add_argument("--max-frames", type=int)
    evaluate.add_argument("--out")
    shortlist = jobs.add_parser("shortlist")
    for name in ("--top", "--evidence", "--truth"):
        shortlist.add_argument(name, required=True)
    shortlist.add_argument("--ks", type=int, nargs="+", default=[1, 5, 10, 20, 50])
    shortlist.add_argument("--min-matches", type=int, default=10)
    shortlist.add_argument("--out")
    align = jobs.add_parser("align")
    align.add_argument("--candidates", required=True)
    align.add_argument("--out", required=True)
    align.add_argument("--radius", type=int, default=5)
    align.add_argument("--n-ref", type=int)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .plans import jobs
    from .plans.catalog import QUERIES

    if args.job == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.job == "run" and args.name not in QUERIES:
        print(f"unknown query {args.name!r}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("vidlake").getOrCreate()
    read = spark.read.parquet
    if args.job == "align":
        print(jobs.align_to_json(read(args.candidates), args.out, args.radius, args.n_ref))
        return 0
    if args.job == "run":
        found = QUERIES[args.name](spark, args.sf_dir)
    elif args.job == "evaluate":
        found = jobs.evaluate(read(args.refs), read(args.queries), args.topk, args.stride, args.max_frames)
    else:
        found = jobs.evaluate_shortlist(read(args.top), read(args.evidence), read(args.truth), args.ks, args.min_matches)
    if args.out:
        found.write.mode("errorifexists").json(args.out)
    else:
        found.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
