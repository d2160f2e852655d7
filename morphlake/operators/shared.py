"""The folder that all executors share, for written tables and checkpoints."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where it is unset (tests on one machine) a fresh local one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        local = tempfile.mkdtemp(prefix="morphlake-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        at = f"file://{local}"
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as a Parquet table in the shared folder and read from there.

    Cuts the lineage: a lost executor costs no recomputation of what stands before the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A freshly read df in as many partitions as there are cores, if it has fewer; else as it is.

    For row-local work that costs more than moving the rows: a small file is one split and would keep one core
    busy. A table with splits for every core, as any large one has, is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


_given: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> None:
    """Delete all that this session's queries have put into the shared folder. Call it when their results have been
    written or read: a DataFrame not yet evaluated may still need its tables."""
    for path in _given.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A state store on disk: memory doesn't grow with the keys.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def folder_of(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = folder_of(spark, path)
    return fs.exists(at)


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]):
    """Session settings for a while; those before come back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StateFiles:
    """The state of something stored in a folder, as numbered JSON files of which the last one holds.

    Each is written whole beside them and then gets its name, so a run that dies leaves the state before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self):
        self._of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = self._of(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at, fs = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("state-"))

    def load(self) -> dict | None:
        """The last state; None before the first."""
        names = self._names()
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]) if names else None

    def save(self, state: dict) -> None:
        names, (at, fs) = self._names(), self._folder()
        number = int(names[-1].split("-")[1]) + 1 if names else 0
        draft = self._of(at, f"_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not fs.rename(draft, self._of(at, f"state-{number:09d}")):
            raise RuntimeError(f"{self.path}: another run has stored state {number}")
        for n in names[:-1]:  # the last two are kept
            fs.delete(self._of(at, n), False)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it on their path."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(root) in known:
        return
    target = Path(tempfile.mkdtemp(prefix="morphlake-zip-")) / "morphlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "morphlake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
