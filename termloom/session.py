"""Reading tables, cutting lineage and streaming whole groups out of sorted partitions."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Where that is unset a local session gets a temporary folder,
    which goes when the program ends; a cluster, whose machines share no such folder, gets an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="termloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back: survives lost executors, and its statistics are
    those of the files, where a checkpoint's would grow with every join of a loop. The layout is not kept."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> DataFrame:
    """``cut``, and the shuffles that led to it, which nothing reads again, leave the disk: else they stay until the driver
    happens to collect its garbage."""
    out = cut(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def pinned(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, with the rows of each partition and their order kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for a Python stage: an input of fewer bytes than make a split per core is shuffled once; a
    larger one, and one whose size is unknown, stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if bytes_of(df) < cores * split else df


def bytes_of(df: DataFrame) -> int:
    """Bytes of ``df`` by the statistics of its plan: no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``rows`` rows and ``size`` bytes (as JSON); reads no more than that many rows."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; the unhinted frame (shuffled join) beyond them."""
    return F.broadcast(df) if small_enough(df, rows) else df


ROWS_PER_SALT = 2_000_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Left join on ``keys`` in which a key with more than ``per_salt`` rows of ``left`` is met in that many parts: its left
    rows are salted by hash and its right rows repeated per part. ``right`` has few rows per key. Rows with a null key
    meet nothing. The hot keys are at most rows / ``per_salt``."""
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_salt).select(*keys, F.ceil(F.col("_n") / per_salt).cast("int").alias("_parts"))
    if hot.isEmpty():
        return left.join(right, keys, "left")
    hot = cut(hot)
    parts = F.coalesce("_parts", F.lit(1))
    rest = [F.col(c) for c in left.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*rest), parts.cast("bigint")).cast("int") if rest else F.lit(0)
    a = left.join(maybe_broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    b = right.join(maybe_broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"], "left").drop("_salt")


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut a stream sorted by ``keys`` so that no group spans two frames."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[keys].iloc[-1]
        same = pd.Series(True, index=batch.index)
        for k in keys:
            same &= (batch[k] == last[k]) | (batch[k].isna() & pd.isna(last[k]))
        head, tail = batch[~same], batch[same]
        if len(head):
            yield pd.concat([*held, head], ignore_index=True) if held else head.reset_index(drop=True)
            held = []
        elif held and any(held[-1][k].iloc[-1] != last[k] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(tail)
    if held:
        yield pd.concat(held, ignore_index=True)
