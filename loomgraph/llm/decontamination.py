"""Benchmark decontamination by greedy string tiling.

Benchmark items become word-id sequences with an index of their k-word seeds. Each document is turned into the same ids
and joined with the seeds; for each item of whose words enough stand in shared seeds, running Karp-Rabin greedy string
tiling marks the longest non-overlapping matches again and again, so a passage is found in whatever order its parts stand.
An item is leaked if its tiles cover at least `threshold` of its words. An item of fewer words than a seed has is leaked
by a document that has these words and no others.

Documents are only read: no shuffle. The benchmark is dealt into blocks of about BLOCK_WORDS words. One block at a time goes
to the tasks, and what it finds is written before the next one goes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

WORDS = re.compile(r"\w+")
MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:bigint,item_words:int,matched:int,tiles:int,longest:int,coverage:double>>"


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes of the windows of a sequence, of any length. A window's hash is the sum of its words times rising
    powers of BASE: from one window to the next a word is added and one taken away, so sums up to each place give all."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, n), dtype=np.uint64)])
        self.back = powers(INVERSE, n + 1)

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all k-word windows."""
    return Running(ids).at(np.arange(max(0, len(ids) - k + 1)), k)


def tile(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length): the longest unmarked common run first, down to k words.

    starts: where in doc a k-word window of the item begins; every longer match begins at one of them too. Runs of s unmarked
    words in common exist if runs of s + 1 do, so the longest is found by halving; no run is longer, so all runs of that
    length are marked, each place of the item with the first free place of the document. Hashes say where, words decide.
    """
    h_doc, h_item = Running(doc), Running(item)
    used_d, used_p = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    places = np.arange(len(item))
    tiles: list[tuple[int, int, int]] = []

    def free(at: np.ndarray, used: np.ndarray, s: int) -> np.ndarray:
        """Those of the places `at` from which s words are there and unmarked."""
        at = at[: np.searchsorted(at, len(used) - s, "right")]
        upto = np.concatenate([[0], np.cumsum(used)])
        return at[upto[at + s] == upto[at]]

    def common(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = free(starts, used_d, s), free(places, used_p, s)
        hi, hj = h_doc.at(i, s), h_item.at(j, s)
        both = np.isin(hj, hi)
        return i, j[both], hi, hj[both]

    most = min(len(item), len(doc))
    while most >= k:
        low, high = k - 1, most  # runs of `low` words exist (or aren't asked for), of more than `high` don't
        while low < high:
            s = (low + high + 1) // 2
            low, high = (s, high) if len(common(s)[1]) else (low, s - 1)
        if low < k:
            break
        s = low
        i, j, hi, hj = common(s)
        order = np.argsort(hi, kind="stable")
        i, hi = i[order], hi[order]
        begin, end = np.searchsorted(hi, hj, "left"), np.searchsorted(hi, hj, "right")
        after: dict[int, int] = {}  # of each hash: the first place in doc that may still be free
        for p, a, b in zip(j.tolist(), begin.tolist(), end.tolist()):
            if used_p[p : p + s].any():
                continue
            at = after.get(a, a)
            while at < b and (used_d[i[at]] or used_d[i[at] + s - 1]):  # marks are never shorter than s
                at += 1
            after[a] = at
            if at < b and np.array_equal(doc[i[at] : i[at] + s], item[p : p + s]):
                used_p[p : p + s] = used_d[i[at] : i[at] + s] = True
                tiles.append((p, int(i[at]), s))
        most = s - 1
    return sorted(tiles)


class Index:
    """The items of one block: vocabulary, id sequences, and seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.vocabulary, self.items, self.short = k, {}, [], defaultdict(list)
        hashes, owners = [], []
        for item_id, text in items:
            words = WORDS.findall(text.lower())
            if 0 < len(words) < k:
                self.short[tuple(words)].append(item_id)
            if len(words) < k:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            h = rolling(ids, k)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            self.items.append((item_id, ids, h))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        o = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, bool)
        self.hashes, self.owners = h[new], o[new]  # each seed once for each item

    def hits(self, text: str | None, threshold: float) -> list[dict]:
        k, get = self.k, self.vocabulary.get
        words = WORDS.findall((text or "").lower())
        if len(words) < k:
            return [{"item_id": i, "item_words": len(words), "matched": len(words), "tiles": 1, "longest": len(words), "coverage": 1.0} for i in self.short.get(tuple(words), ())]
        if not len(self.hashes):
            return []
        ids = np.array([get(w, -1) for w in words], np.int64)
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(bad[k:] == bad[:-k])
        if not len(at):
            return []
        h = np.zeros(len(at), np.uint64)
        power = powers(BASE, k)
        for j in range(k):
            x = (ids[at + j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            h += (x ^ (x >> np.uint64(32))) * power[j]
        known = np.unique(h)
        lo, hi = np.searchsorted(self.hashes, known, "left"), np.searchsorted(self.hashes, known, "right")
        n = hi - lo
        if not n.any():
            return []
        owner = self.owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        seeds = np.bincount(owner, minlength=len(self.items))
        out = []
        for o in np.flatnonzero(seeds).tolist():
            item_id, item, item_h = self.items[o]
            need = threshold * len(item)
            if seeds[o] * k < need and len(np.unique(item_h)) == len(item_h):
                continue
            shared = np.isin(item_h, known)
            edge = np.zeros(len(item) + 1, np.int64)
            edge[: len(shared)] += shared
            edge[k : k + len(shared)] -= shared
            if (np.cumsum(edge[:-1]) > 0).sum() < need:  # tiles lie within the words of shared seeds
                continue
            tiles = tile(ids, item, at[np.isin(h, item_h)], k)
            matched = sum(n for *_, n in tiles)
            if matched and matched >= need:
                out.append({"item_id": item_id, "item_words": len(item), "matched": matched, "tiles": len(tiles), "longest": max(n for *_, n in tiles), "coverage": matched / len(item)})
        return out


def finders(benchmark: DataFrame, k: int, threshold: float) -> Iterator:
    """For each block of benchmark items a function text column -> HITS column; its index goes when the next one is asked for."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // (5 * BLOCK_WORDS)))
    for b in range(blocks):
        some = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index(sorted(map(tuple, some.collect()), key=str), k))
        yield blocks > 1, _finder(index, threshold)
        if blocks > 1:
            index.unpersist()


def _finder(index, threshold: float):
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([index.value.hits(t, threshold) for t in texts], dtype=object)

    return F.pandas_udf(find, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_words, matched, tiles, longest, coverage for each leaked item in each row of docs.

    Words are runs of letters, digits and _ in lower case. Null, empty and wordless texts and items match nothing; an item of
    fewer than k words is found in documents of just these words. Null ids stay null, repeated rows and items are reported
    once each; long and repetitive texts are tiled whole; an empty table on either side gives an empty result. Other columns
    are not looked at.
    """
    out = None
    for several, find in finders(benchmark, k, threshold):
        hits = docs.select("doc_id", F.explode(find("text")).alias("h")).select("doc_id", "h.*")
        hits = materialise(hits, "leaks") if several else hits
        out = hits if out is None else out.union(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is leaked; odd rows are treated as in `contaminated`."""
    for several, find in finders(benchmark, k, threshold):
        docs = docs.filter(F.size(find("text")) == 0)
        docs = materialise(docs, "clean") if several else docs
    return docs
