"""Session settings for local runs; on a cluster pass the session you have."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "clauselake", memory: str = "12g", shuffle: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# The JVM never compiles a method of more bytes than this; it interprets it, several times slower.
COMPILED_BYTES = "8000"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compile_wide_plans(spark: SparkSession) -> None:
    """Let Spark split the code of long rule expressions into methods that the JVM compiles.

    A stage fused into one method beyond the JVM's limit would be interpreted.
    A limit of the session's own stays.
    """
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, COMPILED_BYTES)


# Bytes of a batch that goes to a Python worker; several workers a task hold one at a time.
_BATCH_LIMIT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304b"
_GIVEN_BYTES = ("67108864b", "64MB")


def bound_batches(spark: SparkSession) -> None:
    """Let batches of texts hold a few megabytes, so that workers stay small beside the JVM.  A limit of the session's own stays."""
    if spark.conf.get(_BATCH_LIMIT) in _GIVEN_BYTES:
        spark.conf.set(_BATCH_LIMIT, _BATCH_BYTES)


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names; where all tasks are local and none is set, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="clauselake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
