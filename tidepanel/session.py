"""Session factory and expressions that are safe under ANSI mode."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides, with dots written as double underscores."""
    builder = SparkSession.builder.appName("tidepanel")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it runs from its folder and isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own if that is unset and the master is local."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{context.applicationId}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df, made: list[str] | None = None):
    """df written in the shared folder and read back: its lineage ends here, after one computation. The folder's name is added
    to `made`, for a caller who knows when it may go."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def number(c: Column | str) -> Column:
    """A double, null where it can't be read or isn't a number."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null on zero."""
    return F.try_divide(a, b)


def pearson(x: str, y: str) -> Column:
    """Correlation over rows where both are set; null where either side doesn't vary (sigma of at most 1e-12)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-12) & (sb > 1e-12), F.try_divide(F.covar_pop(a, b), sa * sb))
