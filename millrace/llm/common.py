"""What the corpus operators share: the shared folder, lineage cuts, word rules and small SQL helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone a temporary one stands in where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has made, oldest first.
made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    made.append(f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}")
    return made[-1]


def result_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for files that are a result: not among ``made``, so never dropped."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def drop_folders(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the folders made after the first ``since``, but for the last ``keep``: for callers whose results no longer hang on them."""
    gone = made[since : len(made) - keep]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del made[since : len(made) - keep]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, and outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if len(made) % 4 == 0:
        trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, fact: Column) -> tuple[DataFrame, int]:
    """``written``, and an aggregate of its rows that is taken while they are written instead of by a query of its own."""
    seen = Observation()
    out = written(df.observe(seen, fact.alias("fact")), name)
    return out, seen.get["fact"]


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers are kept for later stages, and with them what they once held."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """``trim`` for the driver's JVM, whose hundreds of threads leave what they have freed in arenas of their own. A JVM without such a command is left as it is."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    kinds, args = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = kind(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JJavaError):  # by reflection: the server's own class is not open to callers
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
