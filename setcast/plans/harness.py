"""Benchmark harness: fit, time and score models by name; a failure is an error row, and every row is logged at once."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setcast.operators import metrics, models, prep
from setcast.sources import tables

#: In-context models take at most so many training and validation rows.
SUPPORT_MODELS, SUPPORT_ROWS = ("tabpfn", "tabicl", "knn"), 5_000


def driver_mb() -> float | None:
    """Resident memory of the driver's Python process, where it can be told."""
    try:
        import psutil
    except ImportError:
        return None
    return psutil.Process().memory_info().rss / 1024**2


def memory_line() -> str:
    """Memory of the driver's machine, where it can be told."""
    try:
        import psutil
    except ImportError:
        return "memory unknown"
    found = psutil.virtual_memory()
    return f"available: {found.available / 1024**3:.1f} GB ({found.percent}% used)"


def executor_memory(spark: SparkSession) -> dict[str, float]:
    """From Spark's status store: how many executors there are or were, the largest peak of their heaps, of what they held for execution and storage, and of
    their process trees (0 where Spark is not told to look: spark.executor.processTreeMetrics.enabled). Peaks come with the executors' heartbeats,
    so that short work may be missing from them; where Spark runs in one process the heap is looked at now as well."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, out = spark.sparkContext._jsc.sc().statusStore().executorList(False), {"executors": 0, "heap_mb": 0.0, "unified_mb": 0.0, "rss_mb": 0.0}
    for k in range(found.size()):
        out["executors"] += 1
        peaks = found.apply(k).peakMemoryMetrics()
        if not peaks.isDefined():
            continue
        of = lambda *names: sum(peaks.get().getMetricValue(n) for n in names) / 1024**2  # noqa: B023,E731  called at once
        now = {"heap_mb": of("JVMHeapMemory"), "unified_mb": of("OnHeapUnifiedMemory", "OffHeapUnifiedMemory"), "rss_mb": of("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory", "ProcessTreeOtherRSSMemory")}
        out |= {c: max(out[c], v) for c, v in now.items()}
    if spark.sparkContext.master.startswith("local"):
        heap = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage().getUsed() / 1024**2
        out["heap_mb"] = max(out["heap_mb"], heap)
    return {c: round(v, 1) for c, v in out.items()}


def run_model(name: str, train: DataFrame, val: DataFrame, n_classes: int, n_estimators: int, seed: int) -> dict:
    if name in SUPPORT_MODELS:
        train, val = prep.subsample(train, SUPPORT_ROWS, seed=seed), prep.subsample(val, SUPPORT_ROWS, seed=seed)
    row, pred = {"model": name, "n_train_used": train.count(), "n_val_used": val.count()}, None
    print(f"  [mem] {memory_line()}  train: {row['n_train_used']}  val: {row['n_val_used']}")
    try:
        before, began = driver_mb(), time.perf_counter()
        scored = models.with_probabilities(name, train, val, n_classes, n_estimators, seed)
        row["train_time_s"] = round(time.perf_counter() - began, 3)
        row |= {f"fit_executor_{c}": v for c, v in executor_memory(train.sparkSession).items() if c.endswith("_mb")}
        after, began = driver_mb(), time.perf_counter()
        pred = scored.select(F.col("class_idx").alias("y"), models.predicted(F.col("p")).alias("pred")).persist()
        pred.count()
        row["val_time_s"] = round(time.perf_counter() - began, 3)
        row["f1_macro"] = round(metrics.macro_f1(pred).first()[0], 4)
        row["balanced_accuracy"] = round(metrics.balanced_accuracy(pred).first()[0], 4)
        row |= {f"val_executor_{c}": v for c, v in executor_memory(train.sparkSession).items() if c.endswith("_mb")}
        if before is not None:
            row |= {"peak_mem_mb": round(driver_mb(), 1), "fit_mem_delta_mb": round(after - before, 1)}
    except Exception as e:  # one model's failure must not end the benchmark
        row["error"] = f"{type(e).__name__}: {e}"[:300]
    finally:
        if pred is not None:
            pred.unpersist()
    return row


def benchmark(spark: SparkSession, folder: str, names: list[str], log: str, n_estimators: int = 500, seed: int = 0, max_train: int | None = None, max_val: int | None = None, tracking: str = "online", csv: str | None = None) -> DataFrame:
    """One row per model, in order. Row caps come before labels are encoded, by the classes of the rows left.

    Unless tracking is disabled, the configuration and each row are appended to the run log under this run's identifier, at once; csv, if given,
    has the rows so far after every model.
    """
    rows = tables.samples(spark, folder, seed=seed)
    train, val = rows.where("split = 'train'"), rows.where("split = 'cal'")
    train = prep.subsample(train, max_train, seed=seed) if max_train else train
    val = prep.subsample(val, max_val, seed=seed) if max_val else val
    classes, n_classes = prep.known_classes(train, val)
    train, val, run = prep.with_classes(train, classes), prep.with_classes(val, classes), uuid.uuid4().hex
    print("  class distribution (train):", {r["class_idx"]: r["n"] for r in prep.class_distribution(train, "class_idx").collect()})
    if tracking != "disabled":
        config = {"folder": folder, "models": names, "n_estimators": n_estimators, "seed": seed, "max_train": max_train, "max_val": max_val, "n_classes": n_classes}
        tables.log_config(spark, run, config, f"{log}-config")
    done: list[dict] = []
    for name in names:
        print(f"=== {name} ===")
        done.append(run_model(name, train, val, n_classes, n_estimators, seed) | {"run": run})
        if tracking != "disabled":
            tables.log_rows(spark, done[-1:], log)
        if csv:
            tables.write_csv(tables.result_rows(spark, done), csv)
    return tables.result_rows(spark, done)
