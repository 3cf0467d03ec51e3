"""Command line: generate a corpus, audit a source, or replay stored records."""

from __future__ import annotations

import argparse
import functools
import os

from pyspark.sql import DataFrame, SparkSession

from leakscan import dims as D
from leakscan.operators import answers, corpus, evalset, probes
from leakscan.sources import backends, records, reports


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leakscan")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("--n-entries", type=int, default=140, help="persons")
    a = sub.add_parser("audit")
    a.add_argument("--n-entries", type=int, default=980, help="(person, category) entries")
    a.add_argument("--models", nargs="+", default=["qwen2.5-1.5b", "qwen2.5-3b"])
    a.add_argument("--conditions", nargs="+", default=["zh2zh", "en2zh"])
    a.add_argument("--backend", default="demo", help="demo, openai_compat or hf_api")
    a.add_argument("--data", help="a corpus document to reuse or to make")
    r = sub.add_parser("replay", help="judge stored records*.csv below a folder")
    r.add_argument("--records", required=True)
    r.add_argument("--limit-files", type=int)
    for s in (g, a, r):
        s.add_argument("--seed", type=int, default=D.SEED)
        s.add_argument("--out", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("leakscan").getOrCreate()
    if args.command == "replay":
        return replay(spark, args)
    n = args.n_entries if args.command == "generate" else max(1, round(args.n_entries / len(D.CATEGORIES)))
    if args.command == "audit" and args.data:
        people = records.cached_corpus(spark, args.data, n, args.seed)
    else:
        people = corpus.persons(spark.range(n).withColumnRenamed("id", "key"), "key", seed=args.seed)
    if args.command == "generate":
        records.write_corpus(people, args.out, args.seed)
        return 0
    asked = probes.matrix(people, conditions=args.conditions)
    if args.backend == "demo":
        x = answers.simulate(asked, args.models, args.seed)
    else:
        each = [answers.remote(asked, m, backends.backend(args.backend, m)) for m in args.models]
        x = functools.reduce(DataFrame.unionByName, each)
    x = answers.detect(x).persist()
    found = reports.bundle(x)
    reports.write_csvs(found, args.out)
    reports.write_json(found, f"{args.out}/results.json")
    with open(f"{args.out}/report.html", "w", encoding="utf-8") as f:
        f.write(reports.page(found))
    with open(f"{args.out}/dashboard.html", "w", encoding="utf-8") as f:
        f.write(reports.dashboard(found))
    return 0


def replay(spark: SparkSession, args: argparse.Namespace) -> int:
    """What stored records come to, beside the self-test on a corpus of 140 persons."""
    stored = records.read_csv(spark, args.records, recursive=True, files=args.limit_files)
    people = corpus.first_persons(corpus.persons(spark.range(150).withColumnRenamed("id", "key"), "key", seed=args.seed), 140)
    cases = evalset.judged(evalset.labelset(people, 6)).persist()
    rows = lambda x: [r.asDict(recursive=True) for r in x.collect()]
    os.makedirs(args.out, exist_ok=True)
    with open(f"{args.out}/demo.html", "w", encoding="utf-8") as f:
        f.write(reports.demo_page(rows(evalset.confusion(cases)), rows(evalset.by_kind(cases)), rows(answers.replayed(stored)), rows(evalset.disagreement(answers.detect(stored)))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
