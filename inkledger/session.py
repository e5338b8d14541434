"""Session settings and small helpers shared by every module."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both a laptop and a cluster; sizes adapt at run time through AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("inkledger")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops an execution's shuffle files when it has ended; a query may set it while it runs.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that the phases now running have written, the innermost last.
_RUNNING = threading.local()


def _phases() -> list[list[str]]:
    if not hasattr(_RUNNING, "open"):
        _RUNNING.open = []
    return _RUNNING.open


def phase(function: Callable) -> Callable:
    """A step whose intermediate results are deleted once its own result is written.

    Within it ``cut_lineage`` writes compressed files, and shuffle files are dropped with the execution
    they served instead of with the driver's garbage, so the disk holds what is still needed.  The
    result, a DataFrame or a tuple of them, is cut; that of the outermost phase is a checkpoint.
    """

    @functools.wraps(function)
    def run(*args, **options):
        phases = _phases()
        spark = next(x.sparkSession for x in (*args, *options.values()) if isinstance(x, DataFrame))
        before = spark.conf.get(_DROP_SHUFFLES, "false")
        spark.conf.set(_DROP_SHUFFLES, "true")
        phases.append([])
        try:
            out = function(*args, **options)
            cut = (lambda df: _written(df, phases[-2])) if len(phases) > 1 else _checkpoint
            return tuple(cut(df) for df in out) if isinstance(out, tuple) else cut(out)
        finally:
            for path in phases.pop():
                _delete(spark, path)
            spark.conf.set(_DROP_SHUFFLES, before)

    return run


def cut_lineage(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder the cluster names; within a ``phase``, files there
    that are deleted at its end.  ``over`` is a cut frame that nothing needs once this one is written.

    Only where ``spark.checkpoint.dir`` is unset on a local master (tests, laptops) is a
    temporary folder of this machine used; on a cluster that is an error, for executors
    could not see it.  ``localCheckpoint`` is never used: its blocks die with their
    executor.
    """
    phases = _phases()
    if not phases:
        return _checkpoint(df)
    out = _written(df, phases[-1])
    path = getattr(over, "_written_at", None)
    if path in phases[-1]:
        phases[-1].remove(path)
        _delete(df.sparkSession, path)
    return out


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or _own_folder())
    return context._jsc.sc().getCheckpointDir().get()


def _checkpoint(df: DataFrame) -> DataFrame:
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame, into: list[str]) -> DataFrame:
    """``df`` read from files of its own, whose folder is noted in ``into``."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/phase-{uuid.uuid4().hex}"
    into.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@functools.cache
def _own_folder() -> str:
    return str(Path(tempfile.mkdtemp(prefix="inkledger-checkpoint-")))


def small_rows(df: DataFrame, bound: int) -> list:
    """Rows of a reference table proven to have at most ``bound`` rows; else an error.

    The only way in this library to bring rows to the driver: one more row than the bound
    is asked for, so a table that has outgrown it fails instead of being cut.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the reference table has over {bound} rows")
    return rows
