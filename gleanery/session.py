"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts, one row at least.
BATCH_BYTES = 2 << 20


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gleanery")
    settings = dict(DEFAULTS)
    settings["spark.driver.memory"] = "16g"
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once per application."""
    context = spark.sparkContext
    if getattr(context, "_gleanery_shipped", False):
        return
    package = Path(__file__).resolve().parent
    # read by the driver's own file server only
    archive = Path(tempfile.mkdtemp(prefix="gleanery-")).resolve() / "gleanery.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gleanery_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """End Arrow batches at ``BATCH_BYTES`` in this session, unless it has a smaller bound.

    Batches of texts are otherwise bounded by a number of rows; each is held by the executor and by its Python worker, going and coming.
    """
    if _bytes(spark.conf.get(_BATCH, "64m")) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def _bytes(size: str) -> int:
    number = size.lower().rstrip("b")
    unit = number.lstrip("0123456789")
    return int(number.removesuffix(unit)) << 10 * " kmgt".index(unit or " ")


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the rows once to the shared folder and reading them back.

    Unlike an in-memory persist this survives the loss of executors, and unlike
    ``checkpoint()`` it runs the plan once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work a partition per core when the input arrives in fewer; else no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
