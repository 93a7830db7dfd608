"""Session helpers: tables by name, shared scratch tables."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per application.

    The archive lies in the shared folder and Spark hands it out, so executors need no
    copy of the repository; one that joins later gets it too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sitelens_archive", None):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{f.relative_to(root).as_posix()}"), f.read_bytes())
    content = data.getvalue()
    path = f"{scratch_dir(spark)}/{root.name}-{hashlib.sha256(content).hexdigest()[:16]}.zip"
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
    out.write(content)
    out.close()
    sc.addPyFile(path)
    sc._sitelens_archive = path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables this application has written to the shared folder.
_written: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; results that still read them become invalid."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent (unit tests on one machine) a private temporary
    folder is chosen once per session; a cluster must always name the folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("sitelens.scratch.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="sitelens-")
            spark.conf.set("sitelens.scratch.dir", shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``clear_scratch`` deletes with the rest."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps columns prunable for later readers, and survives the
    loss of executors because every task's output is in shared storage.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

