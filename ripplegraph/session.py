"""Session helpers: table loading and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplegraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, unless they inherit a path to it."""
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root.parent in inherited or getattr(context, "_ripplegraph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="ripplegraph-code-")  # the driver serves the archive from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._ripplegraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a folder of our own is made and
    set on the session, so that ``DataFrame.checkpoint`` uses the same place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a folder they share")
        else:
            root = tempfile.mkdtemp(prefix="ripplegraph-")
            spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """A private sub-folder of the shared folder that holds an operator's written tables."""

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._tables: dict[str, str] = {}

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here and survives lost executors."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.load(name, df)

    def save_bucketed(self, df: DataFrame, name: str, key: str | list[str], buckets: int) -> DataFrame:
        """Write ``df`` in ``buckets`` by hash of its ``key``, sorted by it: joins on the key read it as it lies,
        without a shuffle. It is known to the catalog, under a name of its own, until it is dropped."""
        label = self.path.rsplit("/", 1)[-1].replace("-", "_") + "_" + name.replace("-", "_")
        df.write.format("parquet").mode("overwrite").option("path", self.at(name)).bucketBy(buckets, key).sortBy(key).saveAsTable(label)
        self._tables[name] = label
        return self.spark.table(label)

    def forget(self, *names: str) -> None:
        """Take bucketed tables, all if none is named, out of the catalog; their files stay."""
        for name in names or list(self._tables):
            if label := self._tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {label}")

    def plain(self, name: str, like: DataFrame) -> DataFrame:
        """The files of a bucketed table, whatever the catalog knows of it."""
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def _place(self, name: str):
        """The file system of a place below the folder, and its path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self.forget(name)
        files, path = self._place(name)
        files.delete(path, True)

    def names(self, name: str) -> list[str]:
        """What lies directly below a place; nothing if it is not there."""
        files, path = self._place(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def write_text(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all: written beside its place and moved."""
        files, path = self._place(name)
        draft = path.suffix(".draft")
        out = files.create(draft, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        files.delete(path, False)
        files.rename(draft, path)

    def read_text(self, name: str) -> str:
        files, path = self._place(name)
        source = files.open(path)
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()


def save_observed(work: Workspace, df: DataFrame, name: str, flag: str, bucketed: tuple[str | list[str], int] | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` (in buckets, if a key and their number are given) and count the rows with ``flag``
    set, in the same job where that is possible.

    The plan of an empty input may have no place left to count in; then the written table is asked.
    """
    seen = Observation()
    counted = df.observe(seen, F.count_if(flag).alias("n"))
    saved = work.save_bucketed(counted, name, *bucketed) if bucketed else work.save(counted, name)
    try:
        return saved, int(seen.get["n"])
    except (Py4JError, KeyError):
        return saved, saved.where(flag).count()


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: their names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(at))) if files.exists(at) else ()


class SharedTables:
    """Tables derived from others, written once per session and used by all queries that need them.

    A table is made anew when the files it came from have changed, or its own are gone.
    """

    _made: dict[tuple, tuple] = {}

    def __init__(self, spark: SparkSession, sources: list[str]):
        self.spark = spark
        self.key = (spark.sparkContext.applicationId, *((p, fingerprint(spark, p)) for p in sources))

    def get(self, name: str, make) -> DataFrame:
        key = (*self.key, name)
        if key in self._made:
            work, schema = self._made[key]
            if "_SUCCESS" in work.names(name):
                return self.spark.read.schema(schema).parquet(work.at(name))
        work = Workspace(self.spark, "shared")
        saved = work.save(make(), name)
        self._made[key] = (work, saved.schema)
        return saved


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def data_home(sf: str) -> str:
    return os.environ.get("RIPPLEGRAPH_DATA", "/root/testdata") + f"/{sf}"
