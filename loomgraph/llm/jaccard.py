"""N-gram Jaccard join with Bayesian candidate pruning.

Rows with equal texts share one text. Two texts with a Jaccard similarity of at least `threshold` on their five-word
shingles are linked. A text is known by its place, the number of a row that has it; ids may be null or repeated.

1. Each text gets 128 MinHash values and 32 band keys of four values; a pair at 0.8 shares no band once in 10^7 pairs.
2. Bands shared by two texts or more are buckets; of buckets with the same members one stays.
3. In a bucket of over HOT texts the least one is a pivot. Texts within half the allowed distance of a pivot (of several,
   the least) are its core: by the triangle inequality they are all linked, so they are counted, not compared.
4. Other pairs of a bucket meet in Python tasks, in square blocks if there are many. They compare their MinHash
   values 16 at a time and are dropped when the posterior probability of reaching the threshold, from a uniform prior,
   falls below TOLERANCE; the rest are verified exactly on their shingle sets. A pair that meets in several buckets
   counts in the first of them.
5. A block returns a row for each linked text: its links and the least text of its group there. No pairs are
   written. Groups are the connected components of these rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, lean, materialise, parts_for, small_batches, text_of

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS, ROWS = 128, 32, 4
STEP = 16
TOLERANCE = 1e-5
#: Texts and bytes of text that one side of a block may hold; larger buckets are cut into several.
SIDE, SIDE_BYTES = 1024, 8 << 20
#: Texts of a bucket beyond which it gets a pivot.
HOT = 256
_RANDOM = np.random.default_rng(20240229)
MULTIPLY = (_RANDOM.integers(0, 2**32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _RANDOM.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word runs; all words as one run if there are fewer; none without words."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    known = {w: xxh64_intdigest(w) for w in set(words)}
    w = np.array([known[x] for x in words], np.uint64)
    k = min(k, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ w[j : len(w) - k + 1 + j]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """128 MinHash values of a shingle set that isn't empty."""
    h = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(out, (h[a : a + 512, None] * MULTIPLY + ADD).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, in which the band itself counts."""
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for j in range(ROWS):
        out = (out ^ x[:, j]) * MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


@lru_cache(maxsize=64)
def least_matches(threshold: float, n: int, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal MinHash values with P(similarity >= threshold | matches) >= tolerance, the prior uniform.

    With m of n equal the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    for m in range(n + 1):
        if sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) >= tolerance:
            return m
    return n + 1


def linked(left: list[np.ndarray], right: list[np.ndarray], sl: np.ndarray, sr: np.ndarray, band: int, masks_l: np.ndarray, masks_r: np.ndarray, cores_l: np.ndarray, cores_r: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Index pairs of this bucket (its band given) that are linked, of no common core, and don't meet in a bucket of an earlier band.

    left, right: shingle sets; sl, sr: signatures; masks: bit b is set if the text's bucket in band b stayed; cores: -1 is none.
    """
    n, m = len(left), len(right)
    alive = (cores_l[:, None] != cores_r[None, :]) | (cores_l[:, None] < 0)
    if same:
        alive = np.triu(alive, 1)
    matches = np.zeros((n, m), np.uint8)
    for a in range(0, HASHES, STEP):
        i, j = np.nonzero(alive)
        if not len(i):
            return np.empty((0, 2), np.int64)
        if len(i) * 4 < n * m:
            matches[i, j] += (sl[i, a : a + STEP] == sr[j, a : a + STEP]).sum(axis=1).astype(np.uint8)
        else:
            for c in range(a, a + STEP):
                matches += sl[:, c, None] == sr[None, :, c]
        alive &= matches >= least_matches(threshold, a + STEP)
    i, j = np.nonzero(alive)
    if band and len(i):  # the first common bucket has the pair
        earlier = np.zeros(len(i), bool)
        for b in range(band):
            kept = ((masks_l[i] >> b) & (masks_r[j] >> b) & 1).astype(bool)
            if kept.any():
                at = slice(b * ROWS, (b + 1) * ROWS)
                kept[kept] = (sl[i[kept], at] == sr[j[kept], at]).all(axis=1)
                earlier |= kept
        i, j = i[~earlier], j[~earlier]
    if not len(i):
        return np.empty((0, 2), np.int64)
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    if len(i) <= 4 * (n + m):
        common = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j)])
    else:  # many pairs: products of incidence matrices over slices of the common vocabulary
        common = np.zeros(len(i), np.int64)
        known, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        row = np.repeat(np.arange(n + m), np.concatenate([sizes_l, sizes_r]))
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        total = np.zeros((n, m), np.float32)
        for a in range(0, len(known), 4096):
            lo, hi = np.searchsorted(at, [a, a + 4096])
            x = np.zeros((n + m, min(4096, len(known) - a)), np.float32)
            x[row[lo:hi], at[lo:hi] - a] = 1
            total += x[:n] @ x[n:].T
        common = total[i, j].astype(np.int64)
    ok = common >= threshold * (sizes_l[i] + sizes_r[j] - common) - 1e-9
    return np.stack([i[ok], j[ok]], axis=1)


def groups_of(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The least member of the group of each id."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def compare(rows: list[tuple], band: int, i: int, j: int, threshold: float, k: int) -> list[tuple[int, int, int]]:
    """(id, links, least id of its group here) for the rows (id, side, mask, core, text) of one block."""
    made = {}
    for r in rows:
        s = shingles(r[4], k)
        made[r[0]] = (s, signature(s))
    left = sorted(r for r in rows if r[1] == i)
    right = left if i == j else sorted(r for r in rows if r[1] == j)
    if not left or not right:
        return []
    sl, sr = (np.stack([made[r[0]][1] for r in x]) for x in (left, right))
    ml, mr = (np.array([r[2] for r in x], np.int64) for x in (left, right))
    cl, cr = (np.array([r[3] for r in x], np.int64) for x in (left, right))
    found = linked([made[r[0]][0] for r in left], [made[r[0]][0] for r in right], sl, sr, band, ml, mr, cl, cr, i == j, threshold)
    if not len(found):
        return []
    pairs = [(left[a][0], right[b][0]) for a, b in found.tolist()]
    links: dict[int, int] = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    least = groups_of(pairs)
    return [(x, n, least[x]) for x, n in links.items()]


def within(pivot: np.ndarray, s: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard distance is at most half of 1 - threshold."""
    common = len(np.intersect1d(pivot, s, assume_unique=True))
    union = len(pivot) + len(s) - common
    return 2 * (union - common) <= (1 - threshold) * union + 1e-9


def components(edges: DataFrame) -> DataFrame:
    """(id, least id of its component) for edges (id, other), other <= id. Rounds of taking the least neighbour's label and
    then that label's label go on until none changes; each round is written to the shared folder, and the one before goes."""
    edges = materialise(edges.filter("id <> other").distinct(), "links")
    both = edges.union(edges.select("other", "id"))
    step = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("new")), "labels")
    while True:
        label = step.select("id", F.col("new").alias("label"))
        near = both.join(label.select(F.col("id").alias("other"), F.col("label").alias("seen")), "other").groupBy("id").agg(F.min("seen").alias("seen"))
        new = label.join(near, "id").select("id", "label", F.least("label", "seen").alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("label").alias("jumped"))
        new = materialise(new.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("jumped", "new")).alias("new")), "labels")
        discard(step)
        step = new
        if not step.filter("label <> new").limit(1).count():
            discard(edges)
            return step.select("id", "label")


def groups_in(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys, across batches."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in keys + values)):
            key = row[: len(keys)]
            if now != key:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row[len(keys) :])
    if held:
        yield now, held


def cores_of(members: DataFrame, kept: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id, core): core is the least pivot, of the buckets over HOT that hold the text, that it is near enough to."""
    spark = members.sparkSession
    hot = kept.filter(F.col("n") > HOT).select("key", F.col("low").alias("pivot"))
    wish = materialise(members.select("id", "key").join(hot, "key").select("id", "pivot").distinct(), "pivots")
    salts = wish.groupBy("pivot").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("salts"))
    one = wish.join(salts, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("is_member"))
    head = salts.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("is_member"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _), rows in groups_in(batches, ("pivot", "salt"), ("is_member", "id", "text")):
            s = shingles(rows[0][2], k)
            ids = [i for _, i, text in rows[1:] if within(s, shingles(text, k), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([pivot] * len(ids), pa.int64())], names=["id", "pivot"])

    rows = one.union(head).join(texts.select("id", "text"), "id")
    rows = rows.repartition(parts_for(spark, wish.count() << 12), "pivot", "salt").sortWithinPartitions("pivot", "salt", "is_member", "id").select("pivot", "salt", "is_member", "id", "text")
    return rows.mapInArrow(lean(near), "id bigint, pivot bigint").groupBy("id").agg(F.min("pivot").alias("core"))


def classes_of(docs: DataFrame, threshold: float, k: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (place, doc_id, digest, and text or, if whole, `row` with all their columns), and a row for each text:
    digest, id, rep_id, least (of its rows: doc_id null, doc_id, place), n_copies, n_links, label (the least id that links
    lead to)."""
    spark = docs.sparkSession
    small_batches(spark)

    @F.arrow_udf("array<bigint>")
    def bands_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            for b in batches:
                out = [band_keys(signature(s)) if len(s := shingles(t.as_py(), k)) else np.empty(0, np.int64) for t in b]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out, np.empty(0, np.int64)])))

        return lean(run)(batches)

    text = F.coalesce(F.col("text"), F.lit(""))
    what = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole else text.alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.octet_length(text).alias("size"), bands_of(text).alias("bands"), what)
    rows = materialise(rows, "bands")
    texts = rows.select(F.col("place").alias("id"), F.coalesce("row.text", F.lit("")).alias("text") if whole else "text")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    every = rows.groupBy("digest").agg(F.min("place").alias("id"), F.min("doc_id").alias("rep_id"), least.alias("least"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    every = materialise(every, "classes")
    bands = every.select("id", "size", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("low"), F.max("id").alias("high")).filter("n > 1")
    one = buckets.groupBy("n", "x", "low", "high").agg(F.min(F.struct("band", "key")).alias("b"))
    kept = materialise(one.select("b.key", "b.band", "n", "low"), "buckets")
    members = materialise(bands.select("id", "size", "key").join(kept.select("key", "band"), "key"), "members")
    if kept.filter(F.col("n") > HOT).limit(1).count():
        core = materialise(cores_of(members, kept, texts, threshold, k), "cores")
    else:
        core = spark.createDataFrame([], "id bigint, core bigint")
    used = (every, kept, members)
    members = members.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
    # in each bucket the largest core stands on one side: its texts only meet the others
    parts = members.groupBy("key", "core").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / SIDE), F.ceil(size / SIDE_BYTES)).cast("int")
    sized = parts.groupBy("key").agg(F.max_by(F.struct("core", "n", "bytes"), F.struct(F.when(F.col("core") >= 0, F.col("n")).otherwise(0), "core")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    none = F.col("top.core") < 0
    top_n, top_bytes = F.when(none, 0).otherwise(F.col("top.n")), F.when(none, 0).otherwise(F.col("top.bytes"))
    sized = materialise(sized.select("key", F.when(~none, F.col("top.core")).alias("top"), blocks_of(F.col("n") - top_n, F.col("bytes") - top_bytes).alias("others"), blocks_of(top_n, top_bytes).alias("tops"), "bytes"), "sizes")
    in_top = F.coalesce(F.col("core") == F.col("top"), F.lit(False))
    bucket = F.struct("key", "band", "others", "tops", in_top.alias("in_top"))
    of_text = members.join(sized.drop("bytes"), "key").groupBy("id").agg(F.max("core").alias("core"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"), F.collect_list(bucket).alias("buckets"))  # at most one for each band
    spread = texts.join(of_text.hint("merge"), "id").select("id", "core", "mask", "text", F.explode("buckets").alias("b")).select("id", "core", "mask", "text", "b.*").filter("others > 0")
    side = F.when(F.col("in_top"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    facing = F.sequence(F.lit(0), F.when(F.col("in_top"), F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1))
    spread = spread.select("*", side.alias("side"), F.explode(facing).alias("with"))
    blocks = spread.select("key", "band", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "id", "side", "mask", "core", "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, n, low = (np.array(c, np.int64) for c in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(low)], names=["id", "n", "other"])

        for (_, band, i, j), held in groups_in(batches, ("key", "band", "i", "j"), ("id", "side", "mask", "core", "text")):
            found += compare(held, band, i, j, threshold, k)
            if len(found) > 10_000:
                yield batch()
                found = []
        if found:
            yield batch()

    bytes_in_blocks = sized.agg(F.sum(F.col("bytes") * (F.col("others") + F.col("tops")))).first()[0] or 0
    blocks = blocks.repartition(parts_for(spark, bytes_in_blocks), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = materialise(blocks.mapInArrow(lean(meet), "id bigint, n bigint, other bigint"), "met")
    in_core = core.join(core.groupBy("core").agg((F.count("*") - 1).alias("n")), "core").select("id", "n", F.least("core", "id").alias("other"))
    of_core = core.select(F.greatest("core", "id").alias("id"), F.least("core", "id").alias("other"))
    links = met.select("id", "n").union(in_core.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_links"))
    label = components(met.select("id", "other").union(of_core))
    found = every.select("digest", "id", "rep_id", "least", "n_copies").join(links, "id", "left").join(label, "id", "left")
    found = found.withColumns({"label": F.coalesce("label", "id"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})
    found = materialise(found, "found")
    for done in (*used, sized, met):
        discard(done)
    return rows, found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, rep_id, class_id, n_links, n_copies, class_key for every row of docs (doc_id, text).

    rep_id: the least doc_id with the same text; n_copies: rows with that text; n_links: other texts at least `threshold`
    similar; class_id: the least doc_id of all texts that links lead to; class_key: a number of the class, which tells
    classes apart whose ids clash or are null. Words are as in common.WORD, case kept.
    Null texts are empty ones; texts without words are no one's neighbours but each other's copies if equal. A text of fewer
    than k words is one shingle. A null doc_id counts after all others, a repeated one like any; repeated rows
    are copies. Long texts count whole. Other columns of docs are not looked at. An empty table gives an empty result.
    """
    rows, found = classes_of(docs, threshold, k)
    ids = found.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    found = found.join(ids, "label").select("digest", "rep_id", "class_id", "n_links", "n_copies", F.col("label").alias("class_key"))
    return rows.select("doc_id", "digest").join(found, "digest").select("doc_id", "rep_id", "class_id", "n_links", "n_copies", "class_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs, with all its columns, of each class: that of the least doc_id, nulls last; of several rows with that
    id any one. Nulls, empty and long texts and empty tables are as in `near_duplicates`."""
    rows, found = classes_of(docs, threshold, SHINGLE, whole=True)
    keep = found.groupBy("label").agg(F.min("least").alias("least")).select("least.place")
    return rows.select("place", "row").join(keep.hint("merge"), "place", "left_semi").select("row.*")
