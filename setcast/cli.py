"""Command line: benchmark, saps and compare over a data folder; results as CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from setcast.operators import conformal
from setcast.plans import catalog, harness
from setcast.sources import tables


def _floats(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="setcast", description=__doc__)
    # Names and defaults of the public command line.
    parser.add_argument("command", choices=("benchmark", "saps", "compare"))
    parser.add_argument("--data", help="folder of the input tables; else SETCAST_DATA_DIR")
    parser.add_argument("--out", default="results")
    parser.add_argument("--models", default="dummy,linear,rf,xgboost,lightgbm,catboost,tabpfn,tabicl")
    parser.add_argument("--model", default="centroid", help="base model of saps and compare")
    parser.add_argument("--alpha", default="0.05,0.1,0.2")
    parser.add_argument("--lam", default="0.05,0.2,0.5")
    parser.add_argument("--saps-lam", type=float, default=0.2)
    parser.add_argument("--raps-lam", type=float, default=0.01)
    parser.add_argument("--raps-kreg", type=int, default=1)
    parser.add_argument("--deterministic", action="store_true", help="all uniforms are 1")
    parser.add_argument("--refit", action="store_true", help="ignore cached probabilities")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--n-estimators", type=int, default=500)
    parser.add_argument("--max-train-rows", type=int)
    parser.add_argument("--max-val-rows", type=int)
    parser.add_argument("--n-jobs", type=int, help="accepted; Spark's cores decide")
    parser.add_argument("--tracking-mode", default="online", choices=("online", "offline", "disabled"), help="both of the first append to the run log under --out; there is no network")
    parser.add_argument("--device", default="auto", choices=("auto", "cpu", "cuda"), help="accepted; Spark's resources decide")
    a = parser.parse_args(argv)
    spark, folder = SparkSession.builder.getOrCreate(), tables.data_dir(a.data)
    if a.command == "benchmark":
        names = [x.strip() for x in a.models.split(",") if x.strip()]
        found = harness.benchmark(spark, folder, names, f"{a.out}/run-log", a.n_estimators, a.seed, a.max_train_rows, a.max_val_rows, a.tracking_mode, f"{a.out}/benchmark")
    else:
        config = {"data": folder, "rows": tables.data_print(tables.samples(spark, folder)), "model": a.model, "n_estimators": a.n_estimators, "seed": a.seed}
        probs = tables.cached(spark, f"{a.out}/cache", config, lambda: catalog.probs(spark, folder, a.model, n_estimators=a.n_estimators, seed=a.seed), a.refit)
        rows = conformal.ranked(probs.selectExpr("sample_id", "split", "y", "1D AS u" if a.deterministic else "u", "p"))
        if a.command == "saps":
            found = conformal.saps_sweep(rows, _floats(a.alpha), _floats(a.lam))
        else:
            cells = (("APS", 0.0, 1), ("RAPS", a.raps_lam, a.raps_kreg), ("SAPS", a.saps_lam, None))
            found = conformal.timed_comparison(rows, _floats(a.alpha), cells)
    if a.command != "benchmark":  # which writes after every model
        tables.write_csv(found, f"{a.out}/{a.command}")
    print(f"Saved to {a.out}/{a.command}")
    found.show(100, truncate=False)


if __name__ == "__main__":
    main()
