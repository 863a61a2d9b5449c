"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Where the copies of ``materialize`` lie, and those made inside each open ``copies_of`` of a thread.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open = threading.local()


def build_session(app: str = "lexiframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` (a test) gets a
    temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="lexiframe-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused."""
    return f"{shared_dir(spark)}/lexiframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, is column-pruned by later readers and has a
    known file size, so Catalyst can decide by size whether to broadcast it. It stays until
    ``discard`` or the end of an enclosing ``copies_of``.
    """
    path = new_path(df.sparkSession, name)
    for made in getattr(_open, "scopes", ()):
        made.append(path)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def _delete(spark: SparkSession, paths: list[str], shuffles: bool = True) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)
    if shuffles:
        # Shuffle files go with the plans that made them.
        gc.collect()
        jvm.System.gc()


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete copies made by ``materialize``; nothing may read them any more. Other tables are left alone.

    With ``shuffles`` the shuffle files of plans that are out of use go too.
    """
    paths = [path for path in (_paths.pop(t, None) for t in tables) if path]
    if paths:
        _delete(tables[0].sparkSession, paths, shuffles)


@contextlib.contextmanager
def recorded_copies() -> Iterator[list[str]]:
    """The paths of all copies this thread makes inside the block."""
    scopes = _open.__dict__.setdefault("scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.pop()


def delete_copies(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded copies; those gone already do no harm."""
    if paths:
        _delete(spark, paths)


@contextlib.contextmanager
def copies_of(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete all copies made inside when the block ends, but for the tables put into the list it gives."""
    kept: list[DataFrame] = []
    with recorded_copies() as made:
        try:
            yield kept
        finally:
            stay = {_paths.get(t) for t in kept}
            delete_copies(spark, [path for path in made if path not in stay])


def partition_by(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` into ``times`` as many partitions as the session shuffles into.

    The number is given, as later steps multiply the rows: sizing partitions by the
    bytes of the short input would leave a handful of tasks with all the work.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n * times, *keys)


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it.

    On a cluster the package is installed or sent along with ``--py-files``; then this
    changes nothing that matters.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
