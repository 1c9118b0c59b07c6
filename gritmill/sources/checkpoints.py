"""Stage outputs by run and step in a folder: save, load, prune, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StageStore:
    """Parquet tables under ``root/run=…/step=…``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, run_id: str, step: str) -> str:
        return f"{self.root}/run={run_id}/step={step}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, run_id: str, step: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(run_id, step))

    def load(self, run_id: str, step: str) -> DataFrame | None:
        path = self.path(run_id, step)
        return self.spark.read.parquet(path) if self._exists(path + "/_SUCCESS") else None

    def resume(self, run_id: str, steps: list[str]) -> dict[str, DataFrame]:
        """The outputs of the leading steps that are there: a later one counts only if all before it do."""
        out = {}
        for s in steps:
            df = self.load(run_id, s)
            if df is None:
                break
            out[s] = df
        return out


def stale_runs(runs: DataFrame, now, max_days: int, keep: int) -> DataFrame:
    """Runs older than the limit or not among the latest ``keep``."""
    latest = runs.orderBy(F.desc("started_at"), "run_id").limit(keep).select("run_id", F.lit(True).alias("_latest"))
    old = F.col("started_at") < F.lit(now) - F.make_dt_interval(F.lit(max_days))
    return runs.join(latest, "run_id", "left").where(F.col("_latest").isNull() | old).drop("_latest")


def tenant_rows(df: DataFrame, tenant_conf: str = "gritmill.tenant", tenant: str | None = None) -> DataFrame:
    """Only the rows of a tenant, by default the session's; an error when none is set."""
    tenant = tenant or df.sparkSession.conf.get(tenant_conf, None)
    if not tenant:
        raise ValueError(f"{tenant_conf} is not set")
    return df.where(F.col("tenant_id") == tenant)


def checked_write_rows(df: DataFrame, tenant: str) -> DataFrame:
    """The rows to write, failing on any of another tenant."""
    bad = F.raise_error(F.lit("row of another tenant"))
    return df.withColumn("tenant_id", F.when(F.col("tenant_id") == tenant, F.col("tenant_id")).otherwise(bad.cast("string")))
