"""python -m cairnflow analyse FILE OUT | generate N OUT | benchmark N OUT | scale N: spark-submit entry points."""

from __future__ import annotations

import argparse
import json
import time

from cairnflow.config import ForensicsConfig
from cairnflow.plans import benchmark, forensics, report
from cairnflow.session import session
from cairnflow.sources import raw, synth


def scale(spark, n: int, f: ForensicsConfig) -> dict:
    """Seconds of each stage of an analysis of about ``n`` synthetic transactions; making them doesn't count."""
    rows = forensics.stash(synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=n)), "economy")
    known = synth.truth(rows)
    at, took = time.time(), {}
    d = forensics.load(raw.as_strings(rows.drop("kind", "scenario", "campaign")), unit=1.0)
    took["load"], at = time.time() - at, time.time()
    p = forensics.prepare(d, f=f)
    took["prepare"], at = time.time() - at, time.time()
    y = forensics.entity_truth(p, known).selectExpr("entity", "cast(is_illicit as double) as label", "campaign")
    leads = forensics.score(p, None, y, f=f).leads
    took["score"] = time.time() - at
    return {"n_tx": d.tx.count(), "n_leads": leads.where("rank > 0").count()} | {k: round(v, 2) for k, v in took.items()} | {"total": round(sum(took.values()), 2)}


def main() -> None:
    p = argparse.ArgumentParser(prog="cairnflow", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyse", help="ranked leads of a raw transaction file")
    a.add_argument("file")
    a.add_argument("out")
    for name, text in (("generate", "synthetic transactions as Parquet, with their ground truth"), ("benchmark", "experiments on synthetic transactions, as a Markdown report")):
        g = sub.add_parser(name, help=text)
        g.add_argument("n", type=int)
        g.add_argument("out")
    sub.add_parser("scale", help="seconds of an analysis of N synthetic transactions").add_argument("n", type=int)
    args = p.parse_args()
    if args.what != "analyse" and not 500 <= args.n <= 400_000_000:
        p.error("n must be 500 or more")
    spark = session()
    if args.what == "generate":
        rows = synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=args.n))
        rows.write.mode("overwrite").parquet(f"{args.out}/transactions")
        raw.write_truth(synth.truth(spark.read.parquet(f"{args.out}/transactions")), f"{args.out}/truth")
    elif args.what == "benchmark":
        rows = forensics.stash(synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=args.n)), "economy")
        d = forensics.load(raw.as_strings(rows.drop("kind", "scenario", "campaign")), unit=1.0)
        found = benchmark.run(forensics.prepare(d), synth.truth(rows))
        text = report.markdown("Benchmark", {k: [r.asDict() for r in v.collect()] for k, v in found.items()})  # tables of a few rows
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(args.out)
    elif args.what == "scale":
        print(json.dumps(scale(spark, args.n, ForensicsConfig(trees=100, folds=2))))
    else:
        result = forensics.analyse(forensics.load(raw.read_raw(spark, args.file)))
        result.leads.write.mode("overwrite").parquet(f"{args.out}/leads")
        result.features.write.mode("overwrite").parquet(f"{args.out}/features")


if __name__ == "__main__":
    main()
