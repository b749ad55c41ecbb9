"""Session-level helpers: the shared scratch folder, lineage cuts, size checks."""

import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster the executors would
    not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if not hasattr(context, "paperlake_scratch"):
        context.paperlake_scratch = tempfile.mkdtemp(prefix="paperlake-")
    return context.paperlake_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that ends inside go with it. Otherwise they stay until the driver
    happens to collect its garbage, beside those of the queries that follow."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Materialise `df` as a table in the shared folder and read it back.

    The written table survives the loss of executors, and later jobs over it do not repeat the
    work (or the nondeterminism) before the cut. The shuffle files of the work go at once.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_cut(df: DataFrame, label: str = "cut", count=None) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows (or another aggregate), taken while the table is written."""
    seen = Observation()
    counted = F.count(F.lit(1)) if count is None else count
    return cut(df.observe(seen, counted.alias("count")), label), seen.get["count"]


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none when it does not exist."""
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in files.listStatus(hadoop_path)]


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small new file."""
    files, hadoop_path = _file_system(spark, path)
    stream = files.create(hadoop_path, False)
    stream.write(content)
    stream.close()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors; once per context.

    Not needed where it is installed on the executors or given to spark-submit as a Python file.
    """
    context = spark.sparkContext
    if getattr(context, "paperlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    path = f"{scratch_path(spark, 'package')}/paperlake.zip"
    write_file(spark, path, packed.getvalue())
    context.addPyFile(path)
    context.paperlake_shipped = True
