"""Session settings and the shared folder that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data, in the order in which they are described.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "runs models samples raw_customers raw_orders eval_items mix_targets"
).split()


def get_session(app: str = "millrace", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    sc._millrace_shipped = True
    root = Path(__file__).resolve().parent
    # the driver's copy; Spark's file server takes it from there
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root).as_posix()}")
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views for the given tables (all by default)."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_dir(spark: SparkSession, purpose: str = "work") -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one is set only where that is unset, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="millrace-")
            sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/millrace/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
