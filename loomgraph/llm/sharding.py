"""Sharding by vector bin packing.

Groups of equal texts are items with three sizes (bytes, tokens of the tokenizer in a file, rows). Items go, largest first, to the shard with the
highest dot product between the item and the shard's residual capacity, among the shards with room for its bytes.

What is packed is bounded whatever the input, as packing goes item by item: a group of at least 1/(256 * shards) of all
bytes is an item of its own, of which there can be 256 * shards; smaller groups are dealt by hash into BUNDLES bundles, each
an item; a group over half a shard is split by a hash of its rows' numbers into pieces of about a quarter of a shard. Only
these items reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches
from .idcoder import Pieces, slices_of
from .tokens import default_path

BUNDLES = 16384
HEAVY_PER_SHARD = 256
ROWS_PER_RUN = 1_000_000


def pack_vectors(items: np.ndarray, bins: int, weights=(4.0, 1.0, 1.0)) -> np.ndarray:
    """The bin of each item (a row of sizes, the first one leading), by the greatest dot product with what is left."""
    items = np.asarray(items, float)
    total = items.sum(axis=0)
    part = items / np.where(total > 0, total / bins, 1.0)
    left = np.ones((bins, items.shape[1]))
    pull = part * np.asarray(weights)
    out = np.empty(len(items), np.int32)
    for i in np.lexsort((-part[:, 1], -part[:, 0])):
        room = left[:, 0] >= part[i, 0]
        b = int(np.argmax(np.where(room, left @ pull[i], -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        left[b] -= part[i]
        out[i] = b
    return out


def shard_documents(docs: DataFrame, shards: int = 40, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens for every row of docs (doc_id, text).

    Law `bytes`: the sizes of shards are near equal. Equal texts share a shard unless they alone exceed half of one.
    A null text has the size 16 and no tokens, as an empty one. Null and repeated ids and rows each get a slot; ties go to the
    shard of the lower number. Long texts count whole; other columns are not looked at. An empty table gives an empty result.
    path: the file of the tokenizer whose tokens are balanced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()

    @F.arrow_udf("bigint")
    def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            pieces = Pieces(path)
            for b in batches:
                yield pa.array([n for texts in slices_of(b) for n in pieces.counts(texts)], pa.int64())

        return lean(run)(batches)

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            tokens_of(text).alias("n_tokens"),
            F.md5(text.cast("binary")).alias("key"),
            F.monotonically_increasing_id().alias("n"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = slim.groupBy("key").agg(*sums)
    size, rows = slim.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
    heavy_at, split_at = max(1, size / (shards * HEAVY_PER_SHARD)), size / (2 * shards)
    heavy = groups.filter(F.col("size") >= heavy_at).collect()  # at most shards * HEAVY_PER_SHARD
    pieces = {r["key"]: math.ceil(r["size"] / (split_at / 2)) if r["size"] > split_at else 1 for r in heavy}
    bundle = F.pmod(F.xxhash64("key"), F.lit(BUNDLES))
    items = [("g" + r["key"], r["size"], r["tokens"], r["rows"]) for r in heavy if pieces[r["key"]] == 1]
    items += [("b" + str(r[0]), *r[1:]) for r in groups.filter(F.col("size") < heavy_at).groupBy(bundle.alias("b")).agg(F.sum("size"), F.sum("tokens"), F.sum("rows")).collect()]
    known = spark.createDataFrame([*pieces.items()] or [("", 1)], "key string, pieces int")
    piece = F.concat(F.lit("p"), "key", F.lit("#"), F.pmod(F.xxhash64("n", F.lit(7)), F.col("pieces")).cast("string"))
    if any(n > 1 for n in pieces.values()):  # at most 2 * shards groups are
        split = slim.join(F.broadcast(known.filter("pieces > 1")), "key")
        items += [tuple(r) for r in split.groupBy(piece.alias("item")).agg(*sums).collect()]
    items.sort()
    where = pack_vectors(np.array([x[1:] for x in items], float), shards)
    homes = spark.createDataFrame([(x[0], int(b)) for x, b in zip(items, where)], "item string, shard int")
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle.cast("string"))).when(F.col("pieces") == 1, F.concat(F.lit("g"), "key")).otherwise(piece)
    runs = max(4, math.ceil(rows / (shards * ROWS_PER_RUN)))  # slots are counted in runs within a shard, then shifted
    placed = (
        slim.join(F.broadcast(known), "key", "left")
        .withColumn("item", item)
        .join(F.broadcast(homes), "item")
        .select("doc_id", "size", "text_crc32", "n_tokens", "n", "shard", F.pmod(F.xxhash64("n"), F.lit(runs)).cast("int").alias("run"))
    )
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size", "n"))
    return (
        placed.withColumn("at", within)
        .join(F.broadcast(starts), ["shard", "run"])  # shards * runs rows: one for each million documents or so
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
    )
