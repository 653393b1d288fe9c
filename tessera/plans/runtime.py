"""Session, table and shared-folder helpers used by every plan."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4_000_000  # that a Python worker gets at once
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
INITIAL_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPREAD_BYTES = 4_000_000  # of a table's files; a partition gets a million lines at most
MAX_SPREAD = 4000
ADVISORY_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SORT_BYTES = 8_000_000  # of a shuffle that a task sorts
PACKAGE_ROOT = Path(__file__).resolve().parents[1]


def session(app: str = "tessera", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results depend on (UTC, AQE)."""
    return (
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; columns are pruned and filters pushed by Catalyst."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread(spark, df)
    return df


def spread(spark: SparkSession, df: DataFrame) -> None:
    """Shuffles of the session start with a partition for each SPREAD_BYTES of the largest table, so a task's share does not grow with the input.

    Adaptive execution joins small partitions again.
    """
    n = -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SPREAD_BYTES)
    now = spark.conf.get(INITIAL_CONF, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if n > int(now):
        spark.conf.set(INITIAL_CONF, str(min(n, MAX_SPREAD)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has none to fall back on."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark.sparkContext, "_tessera_shared", None)
        if where is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
            where = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
            spark.sparkContext.setCheckpointDir(where)
            spark.sparkContext._tessera_shared = where
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str = "part", order: tuple[str, ...] = ()) -> DataFrame:
    """Cuts lineage with a compressed table in the shared folder; later reads take only the columns they need. order: of the rows of each file, so that near values lie together."""
    path = fresh_path(df.sparkSession, kind)
    with small_partitions(df.sparkSession) if order else nullcontext():
        (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_partitions(spark: SparkSession):
    """What runs meanwhile gets at most SORT_BYTES of a shuffle in a task, as far as adaptive execution joins its partitions, so sorts stay in memory."""
    before = spark.conf.get(ADVISORY_CONF)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= SORT_BYTES:
        yield
        return
    spark.conf.set(ADVISORY_CONF, str(SORT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ADVISORY_CONF, before)


def remembered(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, made once a session for these sources as they are (paths, times, sizes); make it a stored one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    key = [name]
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(conf)
        key += [source, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()]
    known = spark.sparkContext.__dict__.setdefault("_tessera_tables", {})
    if tuple(key) not in known:
        known[tuple(key)] = make()
    return known[tuple(key)]


class Lazy:
    """A DataFrame that is made when something of it is first asked for; its session is known before."""

    def __init__(self, spark: SparkSession, make: Callable[[], DataFrame]):
        self.sparkSession, self._make, self._made = spark, make, None

    def real(self) -> DataFrame:
        if self._made is None:
            self._made = self._make()
        return self._made

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "_parts":
            raise AttributeError(name)
        return getattr(self.real(), name)


def real(df: DataFrame | Lazy) -> DataFrame:
    return df.real() if isinstance(df, Lazy) else df


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for the operators that run Python there, and bounds their batches.

    The bound is the session's spark.sql.execution.arrow.maxBytesPerBatch: it is lowered to BATCH_BYTES, so batches of
    very long texts are small ones; plans run when they are used, so it stays lowered.
    """
    sc = spark.sparkContext
    now = spark.conf.get(BYTES_CONF).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))
    if getattr(sc, "_tessera_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), f"{PACKAGE_ROOT.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE_ROOT.parent)))
    sc.addPyFile(out)
    sc._tessera_shipped = True
