"""Session helpers: the settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # Day boundaries are UTC days everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "buywave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session with the settings the operators assume.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` so that a
    partition of the largest shuffle stays around 200 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # Checkpoints go when nothing refers to them any more.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in {**RUNTIME_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    A warehouse on the driver's own disk is no such folder on a cluster, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder: ``spark.checkpoint.dir``, else one in the warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = shared_folder(spark)
        sc.setCheckpointDir(folder if spark.conf.get("spark.checkpoint.dir", None) else f"{folder}/_checkpoints")
    return sc.getCheckpointDir()
