"""Access to the input tables and to the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else, on one machine only (tests), an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gritmill-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of a frame as a table in the shared folder, which outlives lost executors; ``drop_written`` deletes it."""
    spark = df.sparkSession
    path = f"{ensure_shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append((spark.sparkContext._jvm, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(jvm: object, path: str) -> bool:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True))
    except Exception:  # noqa: BLE001 - the session that wrote it is gone
        return False


def drop_written() -> int:
    """Deletes the intermediate tables written so far, at the latest when the driver program ends; frames over them can't be read afterwards."""
    dropped = 0
    while _WRITTEN:
        dropped += _delete(*_WRITTEN.pop())
    return dropped


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Intermediate tables of one operator: dense files, whose shuffles are deleted as soon as each is written, and which leave on request."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{ensure_shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_FREE, None)
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_FREE) if before is None else self.spark.conf.set(_FREE, before)
        if not _WRITTEN:
            atexit.register(drop_written)
        _WRITTEN.append((self.spark.sparkContext._jvm, path))
        frame = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((frame, path))
        return frame

    def drop(self, *frames: DataFrame) -> None:
        for entry in [e for e in self.paths if any(e[0] is f for f in frames)]:
            self.paths.remove(entry)
            if found := next((w for w in _WRITTEN if w[1] == entry[1]), None):
                _WRITTEN.remove(found)
                _delete(*found)

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[f for f, _ in self.paths if not any(f is k for k in kept)])


#: Rows from which an operator takes its input in shares, one after the other, so that only a share's shuffle is on disk at once.
MANY_ROWS, SHARES = 4_000_000, 3


def shares(*keys: Column, rows: int) -> list[Column]:
    """Conditions that split rows by the hash of a key into shares; null keys fall into one of them."""
    n = SHARES if rows > MANY_ROWS else 1
    return [F.pmod(F.xxhash64(*keys), F.lit(n)) == i for i in range(n)]
