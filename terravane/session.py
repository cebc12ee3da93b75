"""Session helpers shared by operators, queries, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is written for; operators that need one of them say so.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans of many expressions are built several times as fast without a Python stack trace for each of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", app: str = "terravane", **conf: str) -> SparkSession:
    """A local session with the engine's settings, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a session on one machine (master ``local...``, as in
    tests and notebooks) gets a temporary one where none is set; on a cluster, whose machines would each see another
    disk, that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terravane-"))
    return df.checkpoint(eager=True)


def fresh(columns: list[str], wanted: str) -> str:
    """``wanted``, or the first of ``wanted_``, ``wanted__``... that is not among ``columns``."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def spread(df: DataFrame) -> DataFrame:
    """``df``, shuffled over all cores if it comes in far fewer partitions; larger inputs stay as they are.

    For stages that compute much per row: a small table is often one file and would occupy one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
