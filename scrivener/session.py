"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "scrivener", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this library from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables; Spark's reader alone opens the path."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of less than a full split per core, dealt over all cores: its file may have fewer row groups than they
    are. Larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (64 << 20) else df


class Scratch:
    """Intermediate tables, written as Parquet below the cluster's checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; only a local session without one gets a temporary folder, since
    the machines of a cluster share none.
    A written table cuts the lineage, survives lost executors and gives the optimizer exact sizes.
    """

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            folder = spark.conf.get("spark.checkpoint.dir", None)
            if not folder and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        self.spark, self.path, self.made = spark, f"{context.getCheckpointDir()}/scrivener-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and return a reader of what was written."""
        self.made += 1
        to = f"{self.path}/{self.made}"
        df.write.option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *frames: DataFrame) -> None:
        """Delete scratch tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
