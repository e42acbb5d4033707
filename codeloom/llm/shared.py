"""Shared-folder tables and small expression helpers.

Intermediate results that are read more than once, or that must cut a long
lineage, are written as Parquet under the folder the session names in
``spark.checkpoint.dir``: every executor sees it, and losing an executor
costs nothing but the tasks that ran on it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.tables import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Session settings while a table is written: batches to Python workers have fewer rows, as whole texts are large
#: ones, and shuffle files go as soon as the table is there, as nothing reads the plan again.
WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: For tables of a run: a file system on disk starts a process for each change of a file's mode, four for a file and its
#: checksums, and until that runs its program it counts as a second copy of the executor or driver. Parquet's pages have
#: checksums of their own, which are verified here, nothing asks for the file that marks the end, and ``file_system``
#: sets the mode of the file itself without a process.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

FILE_SYSTEM = "codeloom.files.PlainFileSystem"
FILE_SYSTEM_SOURCE = """
package codeloom.files;

public class PlainFileSystem extends org.apache.hadoop.fs.RawLocalFileSystem {
    public void setPermission(org.apache.hadoop.fs.Path path, org.apache.hadoop.fs.permission.FsPermission mode) throws java.io.IOException {
        String bits = mode.getUserAction().SYMBOL + mode.getGroupAction().SYMBOL + mode.getOtherAction().SYMBOL;
        java.nio.file.Files.setPosixFilePermissions(pathToFile(path).toPath(), java.nio.file.attribute.PosixFilePermissions.fromString(bits));
    }
}
"""


def file_system(spark: SparkSession) -> str:
    """The class that writes run tables on disk: once for each application it is compiled by Spark's own compiler and
    handed out as a jar; where the driver's class loader takes no jar, Hadoop's own class stays."""
    sc = spark.sparkContext
    if not hasattr(sc, "_codeloom_file_system"):
        sc._codeloom_file_system = PLAIN_FILES["fs.file.impl"]
        loader = sc._jsc.hadoopConfiguration().getClassLoader()
        if sc._jvm.java.lang.Class.forName("org.apache.spark.util.MutableURLClassLoader").isInstance(loader):
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(loader)
            compiler.cook(FILE_SYSTEM_SOURCE)
            path = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom-files.jar")
            with zipfile.ZipFile(path, "w") as jar:
                for name, code in compiler.getBytecodes().items():
                    jar.writestr(name.replace(".", "/") + ".class", bytes(code))
            loader.addURL(sc._jvm.java.io.File(path).toURI().toURL())
            sc._jsc.addJar(path)
            sc._codeloom_file_system = FILE_SYSTEM
    return sc._codeloom_file_system


@contextmanager
def writing(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with writing(spark):
        df.write.options(**PLAIN_FILES | {"fs.file.impl": file_system(spark)}).parquet(path)
    return spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; no later plan may read it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/codeloom-" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
