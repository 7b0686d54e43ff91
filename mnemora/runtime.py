"""Session helpers shared by every operator: table loading, lineage cuts, size-guarded broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's own estimate of its size stays below this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names, or in local mode, where one machine runs everything, a private one of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="mnemora-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def checkpointed(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so its lineage ends there and survives lost executors.

    The cluster names the folder in ``spark.checkpoint.dir``; only a local session may leave it unset.
    With ``free`` the shuffle files that this one plan wrote are removed as soon as the checkpoint is there; else they
    stay on the executors' disks until the driver happens to collect its garbage.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_checkpoint_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if free and not _removed_shuffles(df):
        # The plan that was run holds its shuffles as long as its frame is known here; Python's bridge lets go of
        # frames within a second.
        del df
        gc.collect()
        time.sleep(1.5)
        sc._jvm.System.gc()
    return out


def _removed_shuffles(df: DataFrame) -> bool:
    """Removes the shuffle files of the plan that ``df`` ran, on all executors, and waits for it; false if it isn't known which."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    try:
        ids = list(df._jdf.queryExecution().executedPlan().context().shuffleIds().keySet().toArray())
    except Py4JError:  # the plan isn't an adaptive one
        return False
    if not cleaner.isDefined():
        return False
    for shuffle in ids:
        cleaner.get().doCleanupShuffle(shuffle, True)
    return True


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """A broadcast hint behind a size check; beyond the limit the join falls back to a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def canonical_name(name: Column | str) -> Column:
    """Lower-case ASCII canonical form: runs outside ``[a-z0-9]`` become one underscore, outer underscores go."""
    c = F.col(name) if isinstance(name, str) else name
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def instant(text: Column | str) -> Column:
    """ISO date-time text as a UTC instant, or null if it isn't a complete one; without an offset it means UTC."""
    c = F.btrim(F.col(text) if isinstance(text, str) else text)
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?$"
    iso = F.replace(F.regexp_replace(c, r"\s*([+-]\d{2})(\d{2})$", "$1:$2"), F.lit(","), F.lit("."))
    return F.when(c.rlike(shape), F.try_to_timestamp(F.upper(iso)))
