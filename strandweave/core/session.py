"""Session helpers: test sessions, shared checkpoints, and code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
PACKAGE = Path(__file__).resolve().parents[1]
_shipped: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "strandweave") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


BATCH_ROWS = 2048  #: rows of an Arrow batch, where the session has Spark's own default: rows here are whole texts and sets


def ship(spark: SparkSession) -> None:
    """Give this package to every executor's Python workers, once for each application, and keep Arrow batches small."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if _shipped.get(sc.applicationId):
        return
    path = Path(tempfile.mkdtemp(prefix="strandweave-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    _shipped[sc.applicationId] = str(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is set."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"strandweave-checkpoints-{sc.applicationId}")  # one machine: nothing to share
    sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` in the shared checkpoint folder, dealt by ``keys``: later joins on them don't shuffle it again.

    A checkpoint keeps the partitioning of its plan only if that plan is not
    adaptive, so adaptive planning is off for this one job.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpoint(df.repartition(parts, *keys))
    finally:
        conf.set(name, before)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (one count decides); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def extended(df: DataFrame, **types: str) -> T.StructType:
    """The frame's schema with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, _TYPES[v]) for k, v in types.items())])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of the frame is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt anew if they come from fewer files than the session has cores; larger inputs have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
