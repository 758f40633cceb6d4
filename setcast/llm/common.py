"""Helpers shared by the training-text operators: tables, cut lineage, connected components."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import threading
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch for Python workers.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Signs of a plan's description.
DESCRIBED = 100_000
_OWN_DIRS: dict[str, str] = {}
_LEFT: dict[str, str] = {}
_CONSTANTS: WeakKeyDictionary[SparkSession, dict[tuple[str, str], str]] = WeakKeyDictionary()
_DECLARING = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where none is set and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN_DIRS:
        _OWN_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="setcast-")
    return _OWN_DIRS[spark.sparkContext.applicationId]


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get few rows at a time: the usual 10,000 whole texts would take hundreds of MB in each worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def short_plans(spark: SparkSession) -> None:
    """From now on the driver keeps no more than so much of the description of a plan of this session: a plan with large literals is described in MB, for each run."""
    most = spark.conf.get("spark.sql.maxPlanStringLength")
    if not most.isdigit() or int(most) > DESCRIBED:  # by default it has a unit
        spark.conf.set("spark.sql.maxPlanStringLength", DESCRIBED)


def constant(spark: SparkSession, text: str, kind: str) -> Column:
    """A large value, given as JSON, for plans of this session: a session variable, made once, which the optimizer puts in as a literal. A literal that is made from
    the text itself is spelled out, whole, in each description and in each node of the graphs that the driver keeps of the plans it ran."""
    with _DECLARING:
        made, key = _CONSTANTS.setdefault(spark, {}), (hashlib.sha256(text.encode()).hexdigest(), kind)
        if key not in made:
            name = f"setcast_{uuid.uuid4().hex}"
            spark.sql(f"DECLARE VARIABLE {name} {kind}")
            spark.sql(f"SET VARIABLE {name} = (SELECT from_json(text, '{kind}') FROM {{given}})", given=spark.createDataFrame(pa.table({"text": pa.array([text])})))
            made[key] = name
        return F.expr(made[key])


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut, and it outlives lost executors. Packed with zstd: texts take
    two thirds of what they take by default.

    What a result still reads cannot be deleted here; left() and release() let a caller do so when the result is no longer needed.
    """
    name = f"{tag}-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT[name] = path
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(_LEFT.pop(name))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def names(df: DataFrame) -> set[str]:
    """The written tables that df reads."""
    return {f.split("/")[-2] for f in df.inputFiles()} & _LEFT.keys()


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    for name in names(df):
        _delete(df.sparkSession, name)


def collected(spark: SparkSession) -> None:
    """Have the driver collect garbage now: what finished plans held is let go, and Spark's cleaner deletes their shuffles and broadcasts. Left to itself a driver
    with memory to spare collects seldom, while its heap and the executors' disks fill."""
    gc.collect()  # Python's data frames and columns hold those of the JVM
    spark._jvm.System.gc()


def left() -> set[str]:
    """Names of all tables that written() made in this process and that are not deleted yet."""
    return set(_LEFT)


def release(spark: SparkSession, tables: set[str], reading: DataFrame | None = None) -> None:
    """Delete these tables, but for those that a table still in use reads."""
    for name in (tables - (names(reading) if reading is not None else set())) & _LEFT.keys():
        _delete(spark, name)


def hash01(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), any orderable type: (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds. A round takes each node's smallest neighbour by a
    pre-aggregated minimum and joins it back, so a hub's edges are never gathered in one task. Rounds follow the
    logarithm of a component's width; each is written to the shared folder. Nodes without an edge are not
    returned; loops and repeated edges do no harm; nulls are dropped.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen = print_of(now)
    while seen["n"]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        then = written(small.distinct(), "edges")
        found = print_of(then)
        dropped(now)
        now = then
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
