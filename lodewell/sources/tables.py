"""Parquet table access and shared working folders."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    `spark.checkpoint.dir` names it on a cluster. Only on a local master, where that is unset as in tests,
    a temporary folder is created and set on the session's context.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodewell-")
        context.setCheckpointDir(root)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation.

    Rows lie in a folder for each value of `by`, so that who asks for one value reads no other's files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    _written[out] = path
    return out


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 18) -> DataFrame:
    """The same rows, dealt by `keys` in as many parts as hold about `rows` each, so that what a task sorts or sums of a
    part doesn't grow with the table. They are counted for that; keys are to be of many values."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def small_batches(df: DataFrame, *, records: int = 1000, size: str = "8m") -> DataFrame:
    """The same rows, in a session whose Arrow batches hold at most so many records and about so many bytes.

    What Python makes of the result is bounded so wherever it runs, and the settings of `df`'s own session stay as they
    are. The other settings are that session's of now.
    """
    return _in_session(df, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": size})


def by_partition(df: DataFrame, *, size: str = "8m", rows: int | None = None) -> DataFrame:
    """The same rows, in a session that sends no table through the driver and reads exchanges in parts of about `size`.

    What is joined and summed of the result is dealt by its keys, so that no task's share grows with the tables;
    parts are of an even size whatever their number, and a hot key is still split. With the number of `rows`, exchanges have
    a part for each 2^18 of them at least. The settings of `df`'s own session stay as they are.
    """
    spark = df.sparkSession
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": size}
    if rows is not None:
        settings["spark.sql.shuffle.partitions"] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (1 << 18))))
    return _in_session(df, settings)


def _in_session(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same rows in a new session: that of `df`, with these settings."""
    spark = df.sparkSession
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in settings.items():
        session.conf.set(key, value)
    return handed(df, session)


def handed(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same rows in another session of the application."""
    # Sessions of one application share global views, and nothing else.
    view = f"rows_{uuid.uuid4().hex}"
    df.toDF(*(f"c{i}" for i in range(len(df.columns)))).createGlobalTempView(view)
    try:
        return session.table(f"global_temp.{view}").toDF(*df.columns)
    finally:
        df.sparkSession.catalog.dropGlobalTempView(view)


def discard(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = _written.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
