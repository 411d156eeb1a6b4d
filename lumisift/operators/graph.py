"""Link graphs: written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lumisift-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumisift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def tidy() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001, S110
            pass

    atexit.register(tidy)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumisift_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a written table that no later plan reads."""
    _delete(df.sparkSession, df._lumisift_path)


def _stars(e: DataFrame) -> bool:
    """Whether every node of the links (u, v), v < u, is the end of one link or the centre of some, not both."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v"))
    centres = e.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v"))
    each = ends.union(centres).groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return not each.where("as_u > 1 or as_u = 1 and as_v = 1").limit(1).count()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of links (u, v), component the smallest node reachable; smallest nodes themselves have no row.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until every component is a star. Each half
    step is a partially aggregated minimum and an equi-join that adaptive execution can split where a hub is hot; its
    outcome is written.
    """
    e = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-links")
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), f"{name}-links")
        discard(large)
        discard(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
