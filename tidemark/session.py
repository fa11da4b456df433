"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

MB = 1024 * 1024

# The JVM does not compile methods above this size; Spark then runs the operators of a wide
# stage one by one instead of interpreting one huge method.
COMPILED_METHOD = "8000"


# Beyond this many partitions a shuffle's map-output table becomes a burden on the driver.
MOST_PARTITIONS = 50_000


def recommended_conf(input_bytes: int, cores: int, partition_mb: int = 128) -> dict[str, str]:
    """Settings for an input of this size: shuffle partitions that fit an executor's
    memory, runtime coalescing of the small ones and splitting of the skewed ones. Of a
    very large input the partitions grow instead of their number."""
    partition_mb = max(partition_mb, -(-input_bytes // (MOST_PARTITIONS * MB)))
    partitions = max(cores, -(-input_bytes // (partition_mb * MB)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_mb * MB),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_mb * MB),
        "spark.sql.codegen.hugeMethodLimit": COMPILED_METHOD,
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: int | str = 8, name: str = "tidemark", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.maxMetadataStringLength", "1000")  # plans tell whole paths
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD)
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session may fall back to a temporary folder of its own machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
