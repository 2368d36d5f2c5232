"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or plan quality; all are runtime SQL settings, so
# they can also be applied to a session somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode. The cleaning
    # projection exceeds that as one generated method; below this limit Spark splits it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Arrow batches are bounded by rows only unless told otherwise; long texts need a bound in bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gatewise")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    The session's ``spark.checkpoint.dir``, else the directory given to ``setCheckpointDir``. A
    session in one local process has nobody to share with and gets a temporary folder, which is
    then set as its ``spark.checkpoint.dir``; any other session without a folder is refused, since
    files in a machine's own folder are missing everywhere else.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            root = tempfile.mkdtemp(prefix="gatewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder; whoever runs the job removes it afterwards."""
    import uuid

    return f"{shared_root(spark)}/gatewise-{label}-{uuid.uuid4().hex}"


def written(df, label: str, partition_by: str | None = None):
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Cuts the lineage of tables of any size: a lost executor rereads files, not the history.
    """
    path = scratch_dir(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def cut_lineage(df):
    """Checkpoint ``df``, a small bounded table that several branches of a job join.

    They are computed once, and a lost executor rereads the files instead of the history.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()
