"""Sources and sinks: feature tables, the keyed probability cache, result tables and the run log."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setcast.sources import dbf

TARGET = "code"
DROPPED = ("split", "geometry")
#: Portable pseudo-uniform of an id: exact integer arithmetic in any engine.
_MULTIPLIER, _MODULUS = 2654435761, 4294967296


def data_dir(given: str | None = None, candidates: tuple[str, ...] = ()) -> str:
    """The data folder: as given, else SETCAST_DATA_DIR, else the first candidate there is. Resolved when called, never on import."""
    found = given or os.environ.get("SETCAST_DATA_DIR") or next((c for c in candidates if os.path.exists(c)), None)
    if not found:
        raise FileNotFoundError(f"No data folder: give one, set SETCAST_DATA_DIR, or provide one of {list(candidates)}")
    return found


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_clean(df: DataFrame, target: str = TARGET, dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    """Rows without a null or NaN in any column, the target as an int, bookkeeping columns gone, doubles narrowed to floats.

    Rows go before columns do, so that a null in a dropped column removes its row, except for geometry, which is never read.
    """
    df = df.drop("geometry").na.drop("any")
    kinds = {c: t for c, t in df.dtypes if c not in (target, *dropped)}
    narrow = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in kinds.items()]
    return df.select(*narrow, F.col(target).cast("int").alias(target))


#: Fixed value: the target's name in files of a split.
FILE_TARGET = "fallbck"


def load_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A split's rows, clean, with the target as code: from <name>_values.dbf, a shapefile's attributes, or <name>_values.parquet. Geometry is never read."""
    path = f"{folder}/{name}_values"
    local = path.removeprefix("file://").removeprefix("file:")
    df = dbf.read(spark, f"{local}.dbf") if os.path.exists(f"{local}.dbf") else spark.read.parquet(f"{path}.parquet")
    return load_clean(df, FILE_TARGET).withColumnRenamed(FILE_TARGET, TARGET)


def split_samples(spark: SparkSession, folder: str, deterministic: bool = False, seed: int = 0) -> DataFrame:
    """samples() from the files of three splits: every column but the target is a feature, in the order of the training file. Row numbers follow the files'
    order of reading."""
    found = None
    for k, (split, name) in enumerate((("train", "train"), ("cal", "val"), ("test", "test"))):
        df = load_split(spark, folder, name)
        features = features if found is not None else [c for c in df.columns if c != TARGET]  # noqa: F821  those of the first
        part = df.select((F.monotonically_increasing_id() * 3 + k).alias("sample_id"), F.lit(split).alias("split"), F.array(*(F.col(f"`{c}`").cast("float") for c in features)).alias("features"), TARGET)
        found = part if found is None else found.union(part)
    u = F.lit(1.0) if deterministic else uniform(F.col("sample_id"), seed)
    return found.withColumn("u", u)


def uniform(sample_id, seed: int = 0) -> Column:
    """In [0, 1), decided by the id and the seed."""
    small = F.pmod(sample_id + F.lit(seed * 104_729), F.lit(1 << 31))  # so that no product leaves 64 bits
    return F.pmod(small * F.lit(_MULTIPLIER), F.lit(_MODULUS)) / F.lit(float(_MODULUS))


def samples(spark: SparkSession, folder: str, deterministic: bool = False, seed: int = 0) -> DataFrame:
    """(sample_id, split, features, code, u) from the embeddings table; six tenths train, two each cal and test. A folder with files of splits has those instead."""
    if os.path.exists(f"{folder}/train_values.dbf") or os.path.exists(f"{folder}/train_values.parquet"):
        return split_samples(spark, folder, deterministic, seed)
    rows = table(spark, folder, "embeddings").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    part = F.pmod(F.col("vec_id"), F.lit(10))
    split = F.when(part < 6, "train").when(part < 8, "cal").otherwise("test")
    u = F.lit(1.0) if deterministic else uniform(F.col("vec_id"), seed)
    return rows.select(F.col("vec_id").alias("sample_id"), split.alias("split"), F.col("embedding").alias("features"), F.col("label").cast("int").alias("code"), u.alias("u"))


def cached(spark: SparkSession, folder: str, config: dict, make, refit: bool = False) -> DataFrame:
    """make()'s rows from a Parquet cache whose key is the whole configuration; made and written where absent or refit."""
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder}/probs-{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refit or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="setcast-core-")
    return _OWN_FOLDERS[spark.sparkContext.applicationId]


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and it outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by settled(); nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_RESULT = "run string, model string, n_train_used long, n_val_used long, train_time_s double, val_time_s double, f1_macro double, balanced_accuracy double, peak_mem_mb double, fit_mem_delta_mb double, fit_executor_heap_mb double, fit_executor_unified_mb double, fit_executor_rss_mb double, val_executor_heap_mb double, val_executor_unified_mb double, val_executor_rss_mb double, error string"


def result_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Benchmark results as a table; keys that a row lacks are null."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _RESULT)


def log_rows(spark: SparkSession, rows: list[dict], path: str) -> DataFrame:
    """Append result rows to the run log, whose column run tells runs apart. Called after each model, so that a crash keeps what is done."""
    df = result_rows(spark, rows)
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def log_config(spark: SparkSession, run: str, config: dict, path: str) -> None:
    """Append a run's configuration, as JSON."""
    spark.createDataFrame([(run, json.dumps(config, sort_keys=True))], "run string, config string").coalesce(1).write.mode("append").parquet(path)


def data_print(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: part of a cache's key, so that changed data make another cache."""
    columns = [F.col(c) for c in df.columns]
    found = df.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return "-".join(map(str, found))
