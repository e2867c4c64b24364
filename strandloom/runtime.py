"""Session helpers and the scratch tables that cut lineage.

Iterative operators write their intermediate tables as Parquet into the folder
that the cluster names in ``spark.checkpoint.dir``.  Unlike a local checkpoint
such a table survives the loss of any executor, and unlike ``cache`` it keeps
neither heap nor a growing lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python functions that run there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = pathlib.Path(__file__).parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"strandloom/{f.relative_to(here)}")
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store that Spark writes to will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256, size: str = "8m"):
    """Arrow batches of few rows for jobs started inside: whole texts go to Python, so rows, not only counts, are large.

    Batches have no influence on results; the session's own settings come back afterwards.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    had = {}
    for k, v in wanted.items():
        had[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run below the shared folder; ``drop`` them as soon as nothing reads them any more.

    What an operator returns may still read its last tables, so these stay until the
    Python process ends (then the whole run folder goes).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back with the schema that was written (no inference job)."""
        path = self.path(name)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                remove(self.spark, path)

    def clear(self) -> None:
        """Delete all tables and files of this run."""
        remove(self.spark, self.root)

    def release(self) -> None:
        """Let Spark delete shuffle files that no live DataFrame needs, now instead of at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                remove(self.spark, self.root)
        except Exception:  # the JVM has already gone
            pass


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
