"""State tables in buckets: an upsert reads and rewrites only the buckets that its batch touches.

A table is a folder of versions, each with folders of buckets, and of numbered manifests. A manifest says which folder
holds each bucket now. An upsert writes the touched buckets to a new version and then one new manifest, which appears
as a whole under its final name: readers see the table before or after, never between. A manifest's number can be taken
once, so of two upserts at a time one fails and can be tried again. Buckets whose rows come out as they were keep their
files; a batch that changes nothing leaves no new manifest.

Rows are in buckets by a hash of their keys, so a key's rows are in one. The manifest has one entry for each bucket,
whatever the table's size; choose as many buckets as make files of some 100 MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Null keys hash alike: give them another key, if they are many."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def files(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    """(the file system of a path, a function that makes its paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest."""
    fs, at = files(spark, path)
    folder = at(f"{path}/manifests")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not names:
        return None
    (text,) = (r["value"] for r in spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).collect())
    return json.loads(text)


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, at = files(spark, path)
    final = at(f"{path}/manifests/{manifest['version']:012}.json")
    draft = at(f"{path}/manifests/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(json.dumps(manifest).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest['version']} of {path} was written by another upsert")


def create(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> None:
    """An empty table; schema as a DDL text without the column _bucket."""
    publish(spark, path, {"version": 0, "schema": schema, "keys": keys, "buckets": buckets, "folders": {}})


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table as it is now, or some of its buckets."""
    now = latest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    found = [f"{path}/{folder}" for b, folder in sorted(now["folders"].items()) if only is None or int(b) in only]
    return spark.read.schema(now["schema"]).parquet(*found) if found else spark.createDataFrame([], now["schema"])


def digests(rows: DataFrame) -> dict[int, tuple[int, str]]:
    """bucket -> (rows, a sum of hashes that doesn't depend on their order); one row for each bucket."""
    every = [c for c in rows.columns if c != BUCKET]
    # sums of two hashes of 64 bits: rows that differ agree in both by a chance of 2^-128
    one, other = F.xxhash64(*every), F.xxhash64(F.lit("again"), *every)
    found = rows.groupBy(BUCKET).agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(20,0)")).cast("string").alias(a) for a, h in (("x", one), ("y", other))))
    return {r[BUCKET]: (r["n"], f"{r['x']} {r['y']}") for r in found.collect()}


def upsert(spark: SparkSession, path: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Puts merge(old rows of the touched buckets, batch) in their place; returns the buckets that changed.

    merge is one of the snapshot functions of `store`, whose result has the table's columns and whose rows stay in
    their buckets, as they do if they keep their keys.
    """
    now = latest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    where = bucket_of(now["keys"], now["buckets"])
    touched = sorted(r[BUCKET] for r in batch.select(where.alias(BUCKET)).distinct().collect())
    if not touched:
        return []
    old = read(spark, path, touched)
    version = f"versions/{now['version'] + 1:012}-{uuid.uuid4().hex}"
    new = merge(old, batch).select(*old.columns).withColumn(BUCKET, where)
    new.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{version}")
    before = digests(old.withColumn(BUCKET, where))
    after = digests(spark.read.schema(f"{now['schema']}, {BUCKET} int").parquet(f"{path}/{version}"))
    strange = sorted(set(after) - set(touched))
    if strange:
        raise ValueError(f"merge moved rows to the buckets {strange[:5]}")
    changed = [b for b in touched if before.get(b) != after.get(b)]
    if changed:
        folders = {b: f for b, f in now["folders"].items() if int(b) not in changed}
        folders |= {str(b): f"{version}/{BUCKET}={b}" for b in changed if b in after}
        publish(spark, path, {**now, "version": now["version"] + 1, "folders": folders})
    return changed


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes bucket folders that the newest manifest doesn't name, and older manifests; returns how many folders went.

    Nobody may be reading an older state, or be in the middle of an upsert.
    """
    now = latest(spark, path)
    fs, at = files(spark, path)
    gone = 0
    kept = set(now["folders"].values()) if now else set()
    if now and fs.exists(at(f"{path}/versions")):
        for version in fs.listStatus(at(f"{path}/versions")):
            name = version.getPath().getName()
            for bucket in fs.listStatus(version.getPath()):
                folder = f"versions/{name}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and folder not in kept:
                    gone += bool(fs.delete(bucket.getPath(), True))
            if not any(f.startswith(f"versions/{name}/") for f in kept):
                fs.delete(version.getPath(), True)
        for m in fs.listStatus(at(f"{path}/manifests")):
            if m.getPath().getName() < f"{now['version']:012}.json":
                fs.delete(m.getPath(), False)
    return gone
