"""Session factory and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cpus: int | str = 8, app: str = "larkspur", **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on; on a cluster, pass your own session instead.

    Such a session must name a folder that all executors share in spark.checkpoint.dir; this one gets a temporary folder where conf names none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.runSQLOnFiles", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark__checkpoint__dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Register the tables of a data folder as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
