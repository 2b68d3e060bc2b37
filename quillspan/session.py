"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "quillspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (AQE on, UTC, Arrow on).

    A cluster's own settings win: only ``conf`` and the defaults below are set, and
    none of them names a machine-local path.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # files of cut lineages go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared folder named in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, local mode) is a temporary folder used.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named and not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix=f"quillspan-{uuid.uuid4().hex[:8]}-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, settle: float = 0.0) -> None:
    """Have the shuffles and checkpoints removed that nothing refers to any more.

    Spark removes them when the driver's collector finds them dead, which on a large heap may be never.
    The last job's are still held for a second or two: ``settle`` is the time to wait for them.
    """
    time.sleep(settle)
    gc.collect()  # frames are in cycles of the gateway's objects
    spark.sparkContext._jvm.System.gc()
