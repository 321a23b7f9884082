"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that set none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session (one machine, as in tests) gets a temporary folder; on a cluster it is an error, since its machines share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='murmuration-')}"
    return _LOCAL[context.applicationId]


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, files = _file(spark, path)
    return files.exists(at)


def keep(df: DataFrame, tag: str, **options) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and lost executors lose nothing. It goes when it is dropped, or else with the session. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    at, files = _file(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._murmuration_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a kept table. Nothing may read it afterwards."""
    at, files = _file(df.sparkSession, df._murmuration_path)
    files.delete(at, True)


def trim(spark: SparkSession) -> None:
    """The driver's JVM gives back to the system what its C allocator has free, by the diagnostic command System.trim_native_heap where it has that. What compiling plans and code has used stays with the process otherwise."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    with contextlib.suppress(Py4JError):
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the public interface: the server's own class is hidden in its module.
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are gone: it does so for those that the driver's collectors find. Then the driver gives free memory back. A second's work, for where much has been shuffled or planned."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


class Scratch:
    """Tables that go as soon as no result needs them: `with Scratch() as s: ... s.keep(df, tag)`, and s.drop(df) for one that goes before the rest."""

    def __init__(self):
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, tag: str, **options) -> DataFrame:
        out = keep(df, tag, **options)
        self.kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.kept = [x for x in self.kept if x is not df]
            drop(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        tables = self.kept
        self.drop(*tables)
        if tables:
            sweep(tables[0].sparkSession)
