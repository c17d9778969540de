"""Session settings and the shared scratch folder."""

import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # event time, windows and dates are UTC throughout
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # bounded heap for large windowed state
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app="carbonhaul", master=None, **conf):
    """A session with the runtime settings the library relies on.

    Shuffle partitions are left to the cluster's setting: AQE coalesces them downwards, so a
    cluster should start high (2-3 per core) and only local runs lower it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {
        **RUNTIME_CONF,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark):
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark):
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name one: only then do checkpoints and staged tables outlive an executor.
    A local session without the setting uses the folder ``scratch`` beside its warehouse.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    current = context.getCheckpointDir()
    if root is None and current is not None:
        # <folder>/<uuid> of an earlier setCheckpointDir
        root = current.rsplit("/", 1)[0]
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        root = f"{warehouse.rsplit('/', 1)[0]}/scratch"
    if current is None:
        context.setCheckpointDir(root)
    return root


def materialized(df):
    """The frame written to the shared folder: computed once, lineage cut, and still there when
    an executor is lost. For aggregates that several branches of a plan use."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark, name):
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
