"""Streams: feedback counts, replace-by-source upserts, windows over event time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import replace_sources

BUCKETS, BUCKET = 64, "__bucket"


def feedback_counts(log: DataFrame) -> DataFrame:
    """(relation, exposures, positives) as records (useful, relations) come in; the state is a row a relation."""
    each = log.filter("useful IS NOT NULL").select("useful", F.explode(F.array_distinct("relations")).alias("relation"))
    return each.groupBy("relation").agg(F.count("*").alias("exposures"), F.sum(F.col("useful").cast("long")).alias("positives"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) in tumbling or sliding windows of event time; rows over `late` behind are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no gap that long."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def upsert_stream(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at `target` as the last state of each source file: every micro-batch replaces the files it has.

    Files are dealt into BUCKETS by a hash; a batch rewrites the buckets that it touches, in a folder of its number. Last it
    writes an index that names the folder of each bucket, so a batch that was cut short is not seen, and one that runs again
    writes the same. Folders that neither of the last two indexes names are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(BUCKET, F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())  # BUCKETS at most
            if not touched:
                return
            index = _index(spark, target, number)
            held = [index[b] for b in touched if b in index]
            new = batch
            if held:
                old = spark.read.schema(batch.drop(BUCKET).schema).parquet(*held).withColumn(BUCKET, F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int"))
                new = replace_sources(old, batch.select(*old.columns))
            new.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/v={number:08d}")
            index |= {b: f"{target}/v={number:08d}/{BUCKET}={b}" for b in touched}
            _write(spark, f"{target}/_index/{number:08d}", json.dumps(index))
            _clean(spark, target)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _at(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark, path: str) -> list[str]:
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _read(spark, path: str) -> dict[int, str]:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
    finally:
        stream.close()


def _write(spark, path: str, text: str) -> None:
    fs, at = _at(spark, path)
    _, fresh = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):  # the batch ran before
        fs.delete(at, False)
    fs.rename(fresh, at)


def _index(spark, target: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket in the latest index, or the latest one before a batch."""
    found = [n for n in _names(spark, f"{target}/_index") if n.isdigit() and (before is None or int(n) < before)]
    return _read(spark, f"{target}/_index/{found[-1]}") if found else {}


def _clean(spark, target: str) -> None:
    found = [n for n in _names(spark, f"{target}/_index") if n.isdigit()]
    kept = {p for n in found[-2:] for p in _read(spark, f"{target}/_index/{n}").values()}
    for v in _names(spark, target):
        for b in _names(spark, f"{target}/{v}") if v.startswith("v=") else []:
            if b.startswith(BUCKET) and f"{target}/{v}/{b}" not in kept:
                fs, at = _at(spark, f"{target}/{v}/{b}")
                fs.delete(at, True)
    for n in found[:-2]:
        fs, at = _at(spark, f"{target}/_index/{n}")
        fs.delete(at, False)


def current(spark, target: str) -> DataFrame | None:
    """The table as the last whole batch left it; none if there is none."""
    index = _index(spark, target)
    return spark.read.parquet(*sorted(set(index.values()))) if index else None
