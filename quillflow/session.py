"""Session defaults and the shared folder that cuts lineage.

Iterative operators write each round as a Parquet table under the folder the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not the whole lineage. Only where
that setting is absent (tests, a laptop) does a local temporary folder take its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_OWNED: list[tuple[SparkSession, str]] = []


def session(app: str = "quillflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE with skew handling, and Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="quillflow-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


class Workspace:
    """Tables of one run of an iterative operator under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillflow/{name}-{uuid.uuid4().hex}"
        if not _OWNED:
            atexit.register(_clean)
        _OWNED.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table and read it back: lineage ends here."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.load(df, name)

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The same, with the number of rows, which the write itself counts."""
        seen = Observation()
        got = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return got, seen.get["n"]

    def load(self, like: DataFrame, *names: str) -> DataFrame:
        """Read saved tables that share one schema as one."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.root}/{n}" for n in names))

    def drop(self, name: str) -> None:
        """Delete a table no later step reads."""
        _delete(self.spark, f"{self.root}/{name}")


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path): any store that Spark itself can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _clean() -> None:
    for spark, root in _OWNED:
        try:
            _delete(spark, root)
        except Exception:  # the JVM may be gone already
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
