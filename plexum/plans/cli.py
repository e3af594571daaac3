"""Command line: run, merge, evaluate, figures."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from plexum.plans import experiment as E
from plexum.plans.evaluation import evaluate_results
from plexum.plans.figures import generate
from plexum.sources import results as R


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plexum")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="compute a results table")
    run.add_argument("config", choices=sorted([*E.EXPERIMENTS, *E.MOLECULE_RUNS]))
    run.add_argument("--molecules", help="folder of the molecule cache")
    run.add_argument("--output", required=True)
    run.add_argument("--workflows", nargs="+")
    run.add_argument("--seeds", type=int)
    run.add_argument("--seed-range", help="A:B")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--rerun-failed", action="store_true")
    run.add_argument("--evaluate", action="store_true")
    merge = sub.add_parser("merge", help="one table of several shards")
    merge.add_argument("shards", nargs="+")
    merge.add_argument("--output", required=True)
    for name, text in (("evaluate", "summary, matrix and failure map"), ("figures", "SVG charts")):
        q = sub.add_parser(name, help=text)
        q.add_argument("results")
        q.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plexum").config(map=E.THREAD_CAPS).getOrCreate()
    if args.command == "run":
        config = E.molecule_run(args.config, args.molecules or "data") if args.config in E.MOLECULE_RUNS else E.EXPERIMENTS[args.config]()
        if args.workflows:
            config = replace(config, workflows=tuple(args.workflows))
        if args.seeds:
            config = replace(config, seeds=E.seeds_from_count(args.seeds))
        rows = E.run_experiment(spark, config, args.output, args.resume, args.rerun_failed, args.seed_range)
        print(f"{rows.count()} of {E.expected_rows(E.with_seed_range(config, args.seed_range))} rows")
        if args.evaluate:
            evaluate_results(spark, f"{args.output}/results", f"{args.output}/evaluation")
    elif args.command == "merge":
        R.write_table(E.merge_runs([R.read_results(spark, x) for x in args.shards]), f"{args.output}/results", format="parquet")
    elif args.command == "evaluate":
        evaluate_results(spark, args.results, args.output)
    else:
        print(*generate(R.read_results(spark, args.results), args.output), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
