"""Quality rules with suffix-array repetition.

The words of many texts stand in one array, each text ended by a number of its own. Prefix doubling sorts the suffixes;
the longest common prefixes of neighbours in that order are the repeats. A repeat of at least MIN_WORDS words is maximal
where it can't be extended to the left with all of its occurrences; the spans of maximal repeats are united, and a text
fails if they cover too much of it or the longest is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches, text_of

WINDOW = 8
MIN_WORDS = 8
MIN_TEXT = 20
BASE_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Limits on the part of the words that maximal repeats cover, and on the words of the longest one.
COVERED, LONGEST = 0.2, 64
#: Words whose suffixes are sorted together.
TOGETHER = 200_000


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of x (each text's end is a value that occurs once), and their ranks, by prefix doubling.
    Only suffixes that still tie are sorted again."""
    n = len(x)
    _, rank = np.unique(x, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))  # rank: where its group of ties starts
    sorted_rank = rank[order]
    tied = np.flatnonzero(np.concatenate([sorted_rank[1:] == sorted_rank[:-1], [False]]) | np.concatenate([[False], sorted_rank[1:] == sorted_rank[:-1]]))
    k = 1
    while len(tied):
        who = order[tied]
        second = np.where(who + k < n, rank[np.minimum(who + k, n - 1)], -1)
        group = rank[who]
        by = np.lexsort((second, group))
        who, group, second = who[by], group[by], second[by]
        order[tied] = who
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        at = np.flatnonzero(new)
        ranks = np.repeat(tied[at], np.diff(np.concatenate([at, [len(tied)]])))
        rank[who] = ranks
        same = ranks[1:] == ranks[:-1]
        tied = tied[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        k *= 2
    return order, rank


def common_prefixes(x: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """lcp[k]: words in common of the suffixes order[k-1] and order[k] if there are at least `least`, else 0.

    Candidates are compared by doubling steps of hashes, all at once.
    """
    n = len(x)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1], order[1:]
    live = np.flatnonzero((a + least <= n) & (b + least <= n))
    for j in range(least):
        live = live[x[a[live] + j] == x[b[live] + j]]
    if not len(live):
        return lcp
    power = np.uint64(0x9E3779B97F4A7C15)
    hashes, width = [x.astype(np.uint64) * power + np.uint64(77)], 1
    while width * 2 <= n:
        h, p = hashes[-1], np.uint64(pow(int(power) | 1, width, 1 << 64))
        out = np.zeros(n, np.uint64)
        out[: n - width] = h[: n - width] * (p | np.uint64(1)) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        hashes.append(out)
        width *= 2
        reach = np.maximum(a[live], b[live]) + width
        if not ((reach <= n) & (out[np.minimum(a[live], n - 1)] == out[np.minimum(b[live], n - 1)])).any():
            break
    i, j, length = a[live].copy(), b[live].copy(), np.zeros(len(live), np.int64)
    for level in range(len(hashes) - 1, -1, -1):
        w = 1 << level
        fits = np.maximum(i, j) + w <= n
        ok = fits & (hashes[level][np.minimum(i, n - 1)] == hashes[level][np.minimum(j, n - 1)])
        i, j, length = i + w * ok, j + w * ok, length + w * ok
    lcp[live + 1] = length
    return lcp


def repeats(texts: list[list[bytes]], window: int = WINDOW, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """For each text (words in windows that occur twice, words that maximal repeats cover, words of the longest repeat)."""
    known: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    flat = np.empty(sum(sizes) + len(texts), np.int64)
    starts, at = [], 0
    for k, t in enumerate(texts):
        starts.append(at)
        flat[at : at + len(t)] = [known.setdefault(w, len(known)) for w in t]
        at += len(t)
        flat[at] = -1 - k
        at += 1
    # words of one text only count as equal within it
    owner = np.repeat(np.arange(len(texts)), np.array(sizes) + 1)
    flat = np.where(flat < 0, flat, flat + owner * (len(known) + 1))
    n = len(flat)
    order, _ = suffix_array(flat)
    lcp = common_prefixes(flat, order, min(window, least))
    best = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if n else lcp  # by place in the order
    reach = np.zeros(n, np.int64)
    reach[order] = best

    def cover(mark: np.ndarray) -> np.ndarray:
        """Words covered in each text by spans (start, start + mark[start])."""
        edge = np.zeros(n + 1, np.int64)
        s = np.flatnonzero(mark)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + mark[s], -1)
        inside = np.cumsum(edge[:-1]) > 0
        return np.bincount(owner[inside], minlength=len(texts))

    in_windows = cover(np.where(reach >= window, window, 0))
    # a repeat at p is a part of one at p - 1 if that reaches as far: only the others are maximal
    before = np.concatenate([[0], reach[:-1]]) if n else reach
    maximal = np.where((reach >= least) & (before != reach + 1), reach, 0)
    covered = cover(maximal)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, maximal)
    return list(zip(in_windows.tolist(), covered.tolist(), longest.tolist()))


def measure(text: str) -> tuple[list[bytes], int, int, int]:
    """(words, their code points, symbols, lines with a word that equal an earlier one)."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def judge(docs: DataFrame, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered, longest for every
    row of docs (doc_id, text).

    covered: part of the words in maximal repeats; longest: words of the longest; a text at a limit is kept. Repeats are
    compared by 64-bit hashes of doubling length. A null or empty text has no words and fails the base. Null ids stay null,
    repeated rows are each judged, long texts are sorted whole, an empty table gives an empty result, other columns are not
    looked at. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [measure(t.as_py()) for t in b.column("text")]
            found: list[tuple[int, int, int]] = []
            some, size = [], 0
            for m in seen:
                some.append(m[0])
                size += len(m[0]) + 1
                if size >= TOGETHER:
                    found += repeats(some)
                    some, size = [], 0
            found += repeats(some) if some else []
            n = np.array([len(m[0]) for m in seen], np.int64)
            chars, symbols, lines = (np.array([m[c] for m in seen], np.int64) for c in (1, 2, 3))
            windows, cover, most = np.array(found, np.int64).reshape(-1, 3).T
            failed = (n < MIN_TEXT) | (100 * windows > BASE_PERCENT * n)
            part = cover / np.maximum(n, 1)
            kept = ~failed & (part <= covered) & (most <= longest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n, chars, symbols, lines, windows, failed, kept, part, most))], names=names)

    rows = text_of(docs, "doc_id")
    kinds = [rows.schema["doc_id"].dataType.simpleString(), *["bigint"] * 5, "boolean", "boolean", "double", "bigint"]
    return rows.mapInArrow(lean(run), ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))
