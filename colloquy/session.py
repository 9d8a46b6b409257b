"""Session settings and lineage control."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from colloquy.errors import ContractViolation

# Settings that hold at any scale.  Partition counts are left to adaptive
# execution, which splits skewed join partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch may hold long token lists, so it is limited by bytes as well as by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Checkpoints of dropped frames are removed, so long loops do not fill the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("colloquy")
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        # Small tables are read by several tasks; a cluster keeps the default.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when driver and executors are the
    same process, so it is chosen only for a local master.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(configured)
        return configured
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ContractViolation("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so a lost executor costs one read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
