"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Input timestamps carry no zone; results must not depend on the machine's.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is cut into several tasks even when the operator above
    # wants the join's own partitioning (that operator then shuffles again).
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Bytes (compressed) that a task reads of a shuffle and of files; a session's own smaller values stay. One stage
#: sorts and hashes its rows several times over: at Spark's 64 and 128 MB joins with aggregates take over 1 GB a task.
TASK_INPUT = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 32 << 20}
UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: 64m, 64MB, 67108864b."""
    n, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(n) << UNITS[unit]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on. Only runtime SQL settings are
    changed, so it is safe on a session somebody else has made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, most in TASK_INPUT.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new path under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Without it only a
    local master may go on, because a machine-local folder is lost with its
    executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            base = checkpoint.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="cohorta-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, in the folder the cluster names."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        sc.setCheckpointDir(base)
    else:
        scratch_dir(spark)
