"""Session helpers: checkpoint folder, lineage cuts, size-checked broadcasts, salted joins."""

from __future__ import annotations

import tempfile
import uuid
from decimal import Decimal
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a build side that may be broadcast; beyond either joins shuffle with salted keys.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
SALTS = 16


def session(app: str = "lexiloom", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later jobs and lost executors don't recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the checkpoint folder for a table that executors read by themselves."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """df written to a new folder of the checkpoint folder and read again, and that folder; the folder ``before`` of an
    earlier call goes once df is written. For loops: Spark takes the size of a checkpoint from the plan that made it,
    and as joins multiply sizes there, the digits of that number would double with each turn until the driver has no
    memory left. The size of files is measured.
    """
    folder = shared_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    if before:
        system, path = open_folder(before)
        system.delete_dir(path)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for reading it in a worker without the session."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ranges(position: Column, low: int, high: int, buckets: int) -> Column:
    """The bucket, of up to ``buckets`` equal ones, of a whole number between two bounds. Positions may be as far apart
    as longs can be (hashes, say), so that their distance fits no long."""
    step = max(1, -(-(int(high) - int(low) + 1) // buckets))
    wide = "decimal(38,0)"
    return F.call_function("div", position.cast(wide) - F.lit(Decimal(int(low))).cast(wide), F.lit(Decimal(step)).cast(wide)).cast("int") if int(high) - int(low) >= 1 << 62 else F.floor((position - F.lit(int(low))) / F.lit(step)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join a table with hot keys to one with unique keys.

    ``small`` is materialised when the plan is built, counted and measured. Up to ``rows`` rows and BROADCAST_BYTES
    bytes it is broadcast; beyond that both sides are
    shuffled on the keys and a salt, so that a key that holds a third of ``big`` is spread over ``salts`` tasks.
    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing. Columns of both sides other than
    ``on`` must differ.
    """
    small = cut(small)
    whole = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in small.columns]).cast("string"))
    n, size = small.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(whole), F.lit(0))).first()
    if n <= rows and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), list(on), how)
    salt = "__salt"
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a hash of all columns and not rand(): a task that is run again puts each row where it was
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    return salted.join(spread, [*on, salt], how).drop(salt)
