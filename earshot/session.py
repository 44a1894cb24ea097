"""Session settings this library relies on, and where it may write shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "earshot", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution, including skew-join splitting."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in tests, it is a
    folder in the warehouse, which all executors share too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read to the shared folder.

    The branches then read one copy instead of each computing it, and a lost executor
    costs a read, not the whole lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a step after `spread` holds in a task on average.
TASK_ROWS = 250_000
#: Bytes of an Arrow batch: rows of packed vectors or whole texts are wide.
BATCH_BYTES = 16 << 20


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Partition by ``keys`` ahead of a step that makes many rows, or much work, of each.

    Adaptive execution would merge partitions by their size before that step; an explicit
    number, the session's shuffle partitions, keeps them apart. ``rows`` says how many rows the step
    has in all: of many, each task gets about ``TASK_ROWS``, so that its memory doesn't grow with them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // TASK_ROWS)), *keys)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes from now on, unless the session asks for fewer.

    Spark counts rows: 10,000 of them, each a block of vectors or a long text, are gigabytes.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None) or ""
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))
