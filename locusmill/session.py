"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings the operators rely on. All are ordinary SQL settings, so they
#: can be put on a session somebody else made.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where that costs one more exchange later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sequences are long strings: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "locusmill") -> SparkSession:
    """A session for tests and benches; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        folder = tempfile.mkdtemp(prefix="locusmill-checkpoint-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def step(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for loops: the estimated size is forgotten too. Spark keeps it with a
    checkpoint and multiplies sizes at joins, so that in a loop of joins it is squared each
    round, and soon planning takes longer than the work."""
    spark, kept = df.sparkSession, cut_lineage(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files that a job hands on."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def slots(spark: SparkSession) -> int:
    """Partitions to aim for when work per row, not bytes, sets the pace."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows over all slots before heavy work on each of them.

    The partition count is given, so adaptive execution does not fold the partitions
    back together because they are small in bytes.
    """
    # a hash of the keys, so that an exchange below on the same keys is not taken for this one
    return df.repartition(slots(df.sparkSession), F.xxhash64(*keys))
