"""Session helpers: shared working tables and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary one is set; on a cluster that is an error, since
    a machine-local folder can't be read by other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperweir-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def working_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/paperweir/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without recomputing Python stages, and a result
    used by several branches is computed once.
    """
    spark = df.sparkSession
    path = working_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_groups(df: DataFrame, enough: int) -> int:
    """Row groups of the Parquet files that df scans, counted up to enough; only footers are read, of few files.

    Files of another format, which are split otherwise, count as enough.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    files = df._jdf.inputFiles()
    if len(files) >= enough or any(not f.endswith(".parquet") for f in files):
        return max(len(files), enough)
    n = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            n += reader.getRowGroups().size()
        finally:
            reader.close()
    return n


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files cannot occupy them.

    A row group is read by one task, however many splits a file has. A scan of Parquet files with fewer row groups
    than the session has cores is therefore spread before rows are parsed in Python; any other scan is left as it is,
    whatever its size, so a table written in row groups of usual size is never shuffled for that.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 0 < row_groups(df, n) < n else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path (once a session)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="paperweir-zip-"), "paperweir.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_working_tables(spark: SparkSession) -> None:
    """Remove what materialise() wrote to the shared folder, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/paperweir")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
