"""Session construction and scratch tables shared by all executors."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_folders: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("folders", default=())


def get_session(app: str = "veilwright", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested under; a running one is reused.

    On a cluster the caller's own session is used instead and nothing here is applied.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus or '*'}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.retainedJobs", "50")
        .config("spark.ui.retainedStages", "100")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir``, which executors share.

    Where it is unset, a local master gets a temporary folder; any other master is an error,
    because a machine-local folder would not be seen by other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="veilwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Inputs of at most so many bytes are dealt out anew for functions that run in Python.
SPREAD_BYTES = 256 << 20
_EXCHANGING = ("Join", "Aggregate", "Window", "Exchange", "Sort", "Limit", "Repartition")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small and read straight from files.

    A small file is few row groups, so few tasks, and a function in Python then has few cores.
    Larger inputs have tasks enough and are returned as they are, without an exchange.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > SPREAD_BYTES or any(word in plan.toString() for word in _EXCHANGING):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``staged`` wrote within it, but for tables staged as ``lasting``, which the scope around it has.

    Results are lazy and read staged tables: write them before the scope ends.
    """
    path = f"{scratch_root(spark)}/veilwright/scope-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), path))
    try:
        yield
    finally:
        _folders.reset(token)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, label: str, lasting: bool = False, release: bool = False) -> DataFrame:
    """``df`` written to the scratch folder and read back.

    Cuts the lineage, survives the loss of executors, gives the planner true sizes and lets
    AQE split skewed joins on it. Files stay until the scope or the folder is cleaned.
    ``release`` also asks the driver's JVM to collect garbage: the shuffle files of the written
    plan, which nothing reads any more, go at once rather than at the next collection.
    """
    spark = df.sparkSession
    folders = (f"{scratch_root(spark)}/veilwright", *_folders.get())
    folder = folders[-2] if lasting and len(folders) > 1 else folders[-1]
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
