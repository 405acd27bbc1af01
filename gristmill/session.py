"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gristmill")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one set on the context or named in spark.checkpoint.dir.

    Where both are unset a local folder is made in local mode only: on a cluster every
    executor would write to its own disk and the driver would read nothing.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back; tables given as used are deleted afterwards.

    Unlike a checkpoint the table is compressed, later reads take only the columns
    they need, and the planner knows its size. The shuffle files of the write are
    removed with its end: nothing reads them again. Tables that a result still reads
    are deleted by clear_tables, at the latest when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    release(*used)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_table = path
    _TABLES.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by cut_lineage that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_gristmill_table", None):
            _delete(df.sparkSession, path)


def clear_tables(spark: SparkSession) -> None:
    """Delete every table this program made by cut_lineage; results that read them can't be computed again."""
    for path in list(_TABLES):
        _delete(spark, path)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _TABLES else None
    if spark is not None:
        try:
            clear_tables(spark)
        except Exception:  # the JVM may be gone already
            pass


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast when its counted rows are at most max_rows, else unchanged.

    Only for narrow rows (keys and short labels): at the default bound that is
    some tens of megabytes. Beyond it Spark shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
