"""Writes that happen once: files are staged in a folder of their own, and a manifest written last makes them count.

A job is named by its caller. A retry of a job whose manifest exists writes nothing; files of a try that failed before its
manifest are never read, and `vacuum` deletes them. Of two tries at once the first manifest stands and the other try's
files go. Readers see the folders that manifests name, so never half a write. The folder may lie in any store that Hadoop's
file systems reach; creating a file only where there is none must be atomic there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "data"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listed(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _named(job: str) -> str:
    if not job or not all(c.isalnum() or c in "-_." for c in job) or job[0] in "._":
        raise ValueError(f"a job is named by letters, digits, '-', '_' and '.': {job!r}")
    return job


def _folder_of(spark: SparkSession, path: str, job: str) -> str:
    fs, at = _store(spark, path)
    stream = fs.open(at(MANIFESTS, job))
    try:
        return stream.readUTF()
    finally:
        stream.close()


def commit(df: DataFrame, path: str, job: str, by: list[str] | None = None, kind: str = "parquet") -> bool:
    """Adds the rows of df once for all tries of the job; whether this try did. by: columns that files are parted by."""
    spark, job = df.sparkSession, _named(job)
    fs, at = _store(spark, path)
    if fs.exists(at(MANIFESTS, job)):
        return False
    folder = f"{job}-{uuid.uuid4().hex}"
    writer = df.write.format(kind)
    (writer.partitionBy(*by) if by else writer).save(at(DATA, folder).toString())
    fs.mkdirs(at(MANIFESTS))
    try:
        stream = fs.create(at(MANIFESTS, job), False)
    except Exception:
        if not fs.exists(at(MANIFESTS, job)):
            raise
        fs.delete(at(DATA, folder), True)  # another try was first
        return False
    stream.writeUTF(folder)
    stream.close()
    return True


def committed(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """All rows that were committed; the schema says what an empty folder has. Files parted by columns give those too."""
    fs, at = _store(spark, path)
    out = None
    for job in _listed(fs, at(MANIFESTS)):
        part = spark.read.format(kind).schema(schema).load(at(DATA, _folder_of(spark, path, job)).toString())
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes and names the folders of tries that never finished. Not to be run beside a running write."""
    fs, at = _store(spark, path)
    kept = {_folder_of(spark, path, job) for job in _listed(fs, at(MANIFESTS))}
    gone = [f for f in _listed(fs, at(DATA)) if f not in kept]
    for f in gone:
        fs.delete(at(DATA, f), True)
    return gone
