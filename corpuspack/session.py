"""Session helpers: a tuned builder for tests and local runs, and the shared scratch folder.

On a cluster the session is built by the platform; the only thing we read from it is
``spark.checkpoint.dir`` (a shared folder every executor can reach). Tests and local runs
leave it unset, and ``scratch_dir`` then picks a fresh temporary folder once per session; on any
other master an unset folder is an error, as no machine-local one reaches the executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpuspack") -> SparkSession:
    """Session for tests and single-machine runs (AQE on, Arrow on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.driver.memory", os.environ.get("CORPUSPACK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.executorEnv.TOKENIZERS_PARALLELISM", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for materialized tables and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared folder there).
    Only when it is unset on a ``local`` master (tests, single-machine runs) a fresh temporary
    folder is made, once per application; it is registered with
    ``SparkContext.setCheckpointDir`` (the config itself cannot be changed on a running session).
    """
    sc = spark.sparkContext
    current = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not current:
        current = _LOCAL_SCRATCH.get(sc.applicationId)
        if current is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="corpuspack-ckpt-")
            _LOCAL_SCRATCH[sc.applicationId] = current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path in it (any scheme that Spark reads)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str, rebalance: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and read it back.

    Cuts lineage (a lost executor recomputes from the written table, not from the
    source scan), and unlike ``DataFrame.checkpoint`` keeps column pruning and
    predicate pushdown on the stored result. ``rebalance`` lets AQE size the output
    files (advisory partition size) when ``df`` keeps the partitioning of a huge scan
    but is much narrower than it, which would otherwise leave one tiny file per input
    split.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.hint("rebalance") if rebalance else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-reading job
