"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CKPT: str | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "vellum") -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time, UI off, Arrow on."""
    master = master or os.environ.get("VELLUM_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("VELLUM_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Settings the library's semantics depend on; safe to call on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make `vellum` importable in the Python workers (the runtime form of `--py-files`).

    The Arrow UDFs and `mapInPandas` functions live in this package; workers
    do not see the driver's `sys.path`, so the package is zipped once per
    SparkContext and handed to `addPyFile`, which ships it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="vellum-pyfiles-"), "vellum.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and snapshots.

    It is what ``spark.checkpoint.dir`` names, else the folder the context was
    given.  Only a local session without either gets a private one; on a
    cluster that would be a folder no other machine sees, and is an error.
    """
    global _LOCAL_CKPT
    sc = spark.sparkContext
    ckpt = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not ckpt:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="vellum-ckpt-")
        ckpt = _LOCAL_CKPT
        spark.conf.set("spark.checkpoint.dir", ckpt)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(ckpt)
    return ckpt


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df, floor: int | None = None):
    """Give a CPU-heavy step at least `floor` tasks (default: the cluster's parallelism).

    Only when the input has fewer partitions than that (a few large files) is
    it redistributed round-robin; a large input already split into thousands
    of scan partitions passes through untouched, so no shuffle is added where
    the scan already spreads the work.
    """
    want = floor or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def parts_for(df, text_col: str, task_bytes: int) -> int:
    """Shuffle partitions for `df`, so that none gets much more than `task_bytes` of `text_col`; never less than usual."""
    from pyspark.sql import functions as F

    total = df.agg(F.sum(F.octet_length(text_col).cast("long")).alias("b")).first()["b"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
