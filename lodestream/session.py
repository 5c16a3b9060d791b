"""Session settings the engine relies on, applied without overriding a cluster's own choices."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that change results rather than speed; everything else is left to the cluster.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: str = "*", app: str = "lodestream", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**RESULT_CONF, "spark.checkpoint.dir": _private_folder(), **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _private_folder() -> str:
    """A folder for local sessions, gone when the process ends."""
    path = tempfile.mkdtemp(prefix="lodestream-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a private one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(_private_folder())
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """checkpoint() into the shared folder: survives the loss of executors, and keeps plans short."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
