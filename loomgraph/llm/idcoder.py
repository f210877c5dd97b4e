"""Token-id output: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A block's ids are cut into lanes of equal length that are coded in step, so each operation is one on an array. The lanes
share one model, which learns after each step. Orders 2 and 1 each predict the id that last followed their context, order 0
has an adaptive distribution over all ids. The three are mixed: an id's probability is the sum of what each order gives it
times the order's weight, which is learned for each state of confidence of orders 2 and 1. That one distribution drives
the arithmetic coding. Each lane has its own range coder with carries.

Block:  u32 tokens, u32 lanes, u32 crc32 of the ids as little-endian u32, u32 bytes of body; body: u32 words of each
        lane, then the lanes' 32-bit words. A block is decoded by itself; a wrong checksum raises ValueError.
Record: b"LGTK0003", u32 documents, u32 blocks, u32 bytes of table; the table, deflated: i64 doc_id of each document,
        u32 ids of each, u8 whether the doc_id is null; then the blocks.
File:   a Parquet table of records (part, record, n_docs, n_tokens, payload), ascending doc_id over part and record.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, parts_for, plan_bytes, small_batches, text_of
from .tokens import default_path, load, rules_known, whole_of

MAGIC = b"LGTK0003"
VOCABULARY = 49_408
END = 2
BLOCK = 1 << 20
LANES, LANE = 4096, 256
#: Ids that a record holds before it is closed at the end of a document.
RECORD = 1 << 21
HASH_BITS = 18
REFRESH = 64
GAIN = 32
#: The weights of the three orders add up to 2 ** WEIGHTS, the lengths of all ids in order 0 to 2 ** ALL at most. A range of
#: 2 ** 32 or more keeps 2 ** (32 - WEIGHTS - ALL) after a step at least, so that one 32-bit word, put out where it is under
#: 2 ** 32, restores it.
WEIGHTS, ALL = 10, 20
SCALE, UALL = np.uint64(WEIGHTS + ALL), np.uint64(ALL)
MOST = (1 << WEIGHTS + ALL) - 1
BOT, LOW32 = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
U0, U32 = np.uint64(0), np.uint64(32)
#: By hits of order 1 and twice those of order 2: which order was right.
CASE = np.array([2, 1, 0, 0], np.int64) << 7
PIECES_KEPT = 500_000
#: Characters of texts that are cut into pieces together, and new pieces that the library gets as one text.
AT_ONCE, NEW_AT_ONCE = 4 << 20, 500
#: Characters, in lower case or not, and pieces for which the tokenizer file's rules are these.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
NONE = re.compile("(?!)")
NOT_PLAIN = "[^\t\n\r\x20-\x7e\xa1-\xff]"
NOT_LETTERS = "'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾ \t\n\r]+"


class Model:
    """What both sides know of a block so far. Tables of intervals hold start << 32 | length."""

    def __init__(self, vocabulary: int, lanes: int, ranks: bool = False):
        if not 0 < vocabulary < 1 << (ALL - 1):
            raise ValueError("the vocabulary is too large for this coder")
        self.v, self.ranks = vocabulary, ranks
        self.count = np.ones(vocabulary, np.int64)
        # context -> id << 3 | how often in a row it followed, 7 at most; 0: none yet
        self.one, self.two = np.zeros(vocabulary + 1, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.mix = np.full((128, 4), 8, np.int64)  # by state of confidence: how often order 2, only order 1, neither was right
        self.a = np.full(lanes, vocabulary, np.int64)  # last id of each lane, and the one before
        self.b = np.full(lanes, vocabulary, np.int64)
        self.waiting: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.steps = 0
        self.scale()

    def scale(self) -> None:
        """The intervals of all ids, at least 1 long each, and of the three cases in each state, likewise."""
        upto = np.cumsum(self.count)
        cum = np.zeros(self.v + 1, np.uint64)
        cum[1:] = (upto * (((1 << ALL) - self.v) / upto[-1])).astype(np.uint64)
        cum[1:] += np.arange(1, self.v + 1, dtype=np.uint64)
        self.ids = cum[:-1] << U32 | np.diff(cum)
        if self.ranks:  # one bit where an interval starts: the id at v is the number of such bits up to v
            starts = np.zeros(1 << ALL, np.uint8)
            starts[cum[:-1].astype(np.int64)] = 1
            self.bits = np.packbits(starts, bitorder="little").view("<u8")
            n = np.bitwise_count(self.bits).astype(np.int64)
            self.before = np.cumsum(n) - n - 1
        m = self.mix[:, :3]
        w = (m * ((1 << WEIGHTS) - 3) // m.sum(axis=1, keepdims=True) + 1).astype(np.uint64)
        self.w2, self.w1 = w[:, 0] << UALL, w[:, 1] << UALL  # what is given to the one id that the order predicts
        self.w0 = np.uint64(1 << WEIGHTS) - w[:, 0] - w[:, 1]

    def id_at(self, v: np.ndarray) -> np.ndarray:
        w = v >> 6
        upto = (np.uint64(2) << (v.view(np.uint64) & np.uint64(63))) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.bits[w] & upto)

    def predict(self, n: int) -> None:
        """For the first n lanes: what orders 2 and 1 say, and the state of confidence."""
        a = self.a[:n]
        self.slot = (a * 0x2F0B4C47 + self.b[:n] * 0x1B873593) >> 7 & ((1 << HASH_BITS) - 1)
        self.e2, self.e1 = self.two[self.slot], self.one[a]
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.same = self.p1 == self.p2
        self.state = ((self.e2 & 7) << 3 | self.e1 & 7 | self.same.view(np.int8) << np.int32(6)).astype(np.int64)

    def interval(self, x: np.ndarray, w2: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of x (i32) in the mixture, of 2 ** SCALE; which orders foresaw it is noted."""
        part = self.ids[x]
        self.hit1, self.hit2 = self.p1 == x, self.p2 == x
        return w0 * (part >> U32) + w2 * (self.p2 < x) + w1 * (self.p1 < x), w0 * (part & LOW32) + w2 * self.hit2 + w1 * self.hit1

    def found(self, t: np.ndarray, w2: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id (i64) whose interval in the mixture holds t, and that interval; which orders foresaw it is noted."""
        one, two = self.ids[self.p1], self.ids[self.p2]
        less = self.p2 < self.p1
        from1, from2 = w0 * (one >> U32) + w2 * less, w0 * (two >> U32) + w1 * ~(less | self.same)
        size1, size2 = w0 * (one & LOW32) + w1 + w2 * self.same, w0 * (two & LOW32) + w2 + w1 * self.same
        over1, over2 = t >= from1 + size1, t >= from2 + size2
        start = w1 * over1 + w2 * over2
        v = ((t - start).astype(np.float64) / w0.astype(np.float64)).astype(np.int64)  # both are exact, under 2 ** 30
        y = self.id_at(np.minimum(v, (1 << ALL) - 1))
        part = self.ids[y]
        start += w0 * (part >> U32)
        size = w0 * (part & LOW32)
        self.hit1, self.hit2 = (t >= from1) & ~over1, (t >= from2) & ~over2
        for hit, p, begin, length in ((self.hit1, self.p1, from1, size1), (self.hit2, self.p2, from2, size2)):
            w = np.flatnonzero(hit)
            y[w], start[w], size[w] = p[w], begin[w], length[w]
        return y, start, size

    def learn(self, ids: np.ndarray, x: np.ndarray) -> None:
        """ids: what came (i64), x: the same (i32)."""
        n = len(ids)
        first, a = x << 3 | 1, self.a[:n]
        self.one[a] = np.where(self.hit1, self.e1 + ((self.e1 & 7) < 7), first)
        self.two[self.slot] = np.where(self.hit2, self.e2 + ((self.e2 & 7) < 7), first)
        self.keys.append(self.state | CASE[self.hit1.view(np.int8) + 2 * self.hit2.view(np.int8)])
        self.waiting.append(ids)
        self.b[:n] = a
        self.a[:n] = ids
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps < REFRESH and self.steps & (self.steps - 1) == 0:
            self.mix += np.bincount(np.concatenate(self.keys), minlength=512).reshape(4, 128).T * 4
            self.keys = []
            if (big := self.mix.sum(axis=1) > 1 << 16).any():
                self.mix[big] = (self.mix[big] >> 1) + 1
            self.count += GAIN * np.bincount(np.concatenate(self.waiting), minlength=self.v)
            self.scale()
            self.waiting = []


def grid(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes, the first ones, have an id at the last step; the others are one shorter."""
    lanes = max(1, min(LANES, n // LANE))
    return lanes, -(-n // lanes), n % lanes or lanes


def encode_block(ids: np.ndarray, vocabulary: int = VOCABULARY) -> bytes:
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary:
        raise ValueError("an id is outside the vocabulary")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return struct.pack("<4I", 0, 0, crc, 0)
    lanes, steps, full = grid(n)
    rows = np.zeros((lanes, steps), np.int64)
    rows[:full] = ids[: full * steps].reshape(full, steps)
    rows[full:, : steps - 1] = ids[full * steps :].reshape(lanes - full, steps - 1)
    columns = np.ascontiguousarray(rows.T)
    short = columns.astype(np.int32)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    width = steps + 2  # a step gives a word at most, the end two
    out = np.zeros(lanes * width, np.uint32)
    base = np.arange(lanes) * width
    at = base.copy()
    model = Model(vocabulary, lanes)
    for s in range(steps):
        k = lanes if s < steps - 1 else full
        x = columns[s, :k]
        model.predict(k)
        start, length = model.interval(short[s, :k], model.w2[model.state], model.w1[model.state], model.w0[model.state])
        r = rng[:k] >> SCALE
        up = r * start
        r *= length
        lo = low[:k]
        lo += up
        c = at[np.flatnonzero(lo < up)]
        while len(c):  # a carry goes to the words before
            c = c - 1
            out[c] += np.uint32(1)
            c = c[out[c] == 0]
        w = np.flatnonzero(r < BOT)
        if len(w):
            top = lo[w]
            out[at[w]] = (top >> U32).astype(np.uint32)
            at[w] += 1
            lo[w] = top << U32
            r[w] <<= U32
        rng[:k] = r
        model.learn(x, short[s, :k])
    out[at], out[at + 1] = (low >> U32).astype(np.uint32), (low & LOW32).astype(np.uint32)
    filled = at + 2 - base
    body = filled.astype("<u4").tobytes() + out.reshape(lanes, width)[np.arange(width)[None, :] < filled[:, None]].astype("<u4").tobytes()
    return struct.pack("<4I", n, lanes, crc, len(body)) + body


def decode_block(data: bytes, at: int = 0, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, int]:
    """The ids (u32) of the block at this byte, and where the next one begins."""
    n, lanes, crc, size = struct.unpack_from("<4I", data, at)
    at += 16
    ids = np.zeros(n, np.int64)
    if n:
        if lanes != grid(n)[0] or at + size > len(data) or size < 4 * lanes:
            raise ValueError("damaged block")
        lanes, steps, full = grid(n)
        filled = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        words = np.frombuffer(data, "<u4", size // 4 - lanes, at + 4 * lanes).astype(np.uint64)
        if int(filled.sum()) != len(words) or int(filled.min()) < 2:
            raise ValueError("damaged block")
        words = np.append(words, U0)
        last = len(words) - 1
        ptr = np.cumsum(filled) - filled
        above = words[ptr] << U32 | words[ptr + 1]  # how far the code lies above the low end of each lane's range
        ptr += 2
        rng = np.full(lanes, 2**64 - 1, np.uint64)
        columns = np.zeros((steps, lanes), np.int64)
        model = Model(vocabulary, lanes, ranks=True)
        for s in range(steps):
            k = lanes if s < steps - 1 else full
            model.predict(k)
            r, d = rng[:k] >> SCALE, above[:k]
            w2, w1, w0 = model.w2[model.state], model.w1[model.state], model.w0[model.state]
            t = np.minimum(d.astype(np.float64) / r.astype(np.float64), MOST).astype(np.uint64)
            if len(w := np.flatnonzero(d - r * t >= r)):  # the floating-point quotient was off by one, or the end was met
                t[w] = np.minimum(d[w] // r[w], np.uint64(MOST))
            x, start, length = model.found(t, w2, w1, w0)
            rest = d - r * start
            length *= r
            if len(w := np.flatnonzero(length < BOT)):
                p = ptr[w]
                rest[w] = rest[w] << U32 | words[np.minimum(p, last)]
                ptr[w] = p + 1
                length[w] <<= U32
            above[:k], rng[:k] = rest, length
            columns[s, :k] = x
            model.learn(x, x.astype(np.int32))
        rows = columns.T
        ids[: full * steps] = rows[:full].ravel()
        ids[full * steps :] = rows[full:, : steps - 1].ravel()
    out = ids.astype("<u4")
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError("a block's checksum doesn't match")
    return out, at + size


def pack(doc_ids: list, ids: list[np.ndarray], vocabulary: int = VOCABULARY, block: int = BLOCK) -> bytes:
    """One record of whole documents."""
    n = np.array([len(x) for x in ids], "<u4")
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + n.tobytes() + bytes(d is None for d in doc_ids))
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    blocks = [encode_block(flat[k : k + block], vocabulary) for k in range(0, len(flat), block)]
    return MAGIC + struct.pack("<3I", len(ids), len(blocks), len(table)) + table + b"".join(blocks)


def unpack(data: bytes, vocabulary: int = VOCABULARY) -> tuple[list, list[np.ndarray]]:
    if data[:8] != MAGIC:
        raise ValueError("not a record of this format")
    n, blocks, size = struct.unpack_from("<3I", data, 8)
    table = zlib.decompress(data[20 : 20 + size])
    doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(table, "<i8", n), table[12 * n :])]
    lengths = np.frombuffer(table, "<u4", n, 8 * n).astype(np.int64)
    at, parts = 20 + size, []
    for _ in range(blocks):
        ids, at = decode_block(data, at, vocabulary)
        parts.append(ids)
    flat = np.concatenate(parts) if parts else np.empty(0, "<u4")
    if len(flat) != int(lengths.sum()):
        raise ValueError("the table and the blocks don't match")
    return doc_ids, np.split(flat, np.cumsum(lengths)[:-1]) if n else []


class Pieces:
    """Ids of whole texts, through ids that the library gave for their pieces.

    For texts of PLAIN characters the file's normaliser (NFC, white space, lower case) does no more than lower case, and
    its splitter cuts at white space and before and after NOT_LETTERS. Pieces met before are looked up; the library's model
    encodes the new ones together, as words of one text, and each ends at the id that ends a word. Any other text, one that
    could hold an added token, and every text of a tokenizer with rules other than tokens.EXPECTED, goes to the library whole.
    """

    def __init__(self, path: str, whole_texts: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.tok = path, load(path)
        config = json.loads(self.tok.to_str())
        suffix = config["model"].get("end_of_word_suffix")
        self.plain = PLAIN if not whole_texts and bool(suffix) and config["model"]["type"] == "BPE" and rules_known(path) and all(t["content"].startswith("<|") for t in config["added_tokens"]) else NONE
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.large_string())  # pieces by number; what white space at either end of a text leaves has no ids
        self.starts, self.sizes, self.store = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.int32)

    def add(self, new: list[str]) -> None:
        some = [" ".join(new[k : k + NEW_AT_ONCE]) for k in range(0, len(new), NEW_AT_ONCE)]
        ids = np.array([i for e in self.words.encode_batch_fast(some, add_special_tokens=False) for i in e.ids], np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("pieces and ends of words don't match")
        starts = np.concatenate([[0], ends[:-1]])
        self.sizes = np.append(self.sizes, ends - starts)
        self.starts = np.append(self.starts, starts + len(self.store))
        self.store = np.append(self.store, ids)

    def cut(self, texts: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts go to the library whole; of the others the numbers of their pieces, and where each text's begin and end."""
        if len(self.known) > PIECES_KEPT:
            self.clear()
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, NOT_PLAIN)) if self.plain is PLAIN else pa.array([True] * len(texts), pa.bool_())
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        lower = pc.utf8_lower(pc.if_else(odd, pa.scalar("", texts.type), texts) if whole else texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, NOT_LETTERS, r" \0 "))
        pieces = parts.flatten().dictionary_encode()
        met = pieces.dictionary.cast(pa.large_string())
        number = pc.fill_null(pc.index_in(met, value_set=self.known), -1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(number < 0)):
            number[new] = len(self.known) + np.arange(len(new))
            fresh = met.take(pa.array(new))
            self.add(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
        return whole, number[pieces.indices.to_numpy()], np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])

    def encoded(self, texts: pa.Array, whole: list[int], of: Callable) -> list:
        return whole_of(self.path).each(texts.take(pa.array(whole, pa.int64())).to_pylist(), of) if whole else []

    def counts(self, texts: pa.Array) -> list[int]:
        """Ids of each text."""
        whole, number, ends = self.cut(texts)
        upto = np.concatenate([[0], np.cumsum(self.sizes[number])])[ends]
        out = np.diff(upto).tolist()
        for k, n in zip(whole, self.encoded(texts, whole, len)):
            out[k] = n
        return out

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        if self.plain is NONE:
            return whole_of(self.path).each(texts.to_pylist(), with_end)
        whole, number, ends = self.cut(texts)
        size = self.sizes[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.store[np.repeat(self.starts[number] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[ends]
        out = [np.append(flat[a:b], np.int32(END)) for a, b in zip(cuts[:-1], cuts[1:])]
        for k, x in zip(whole, self.encoded(texts, whole, with_end)):
            out[k] = x
        return out


def with_end(encoding) -> np.ndarray:
    return np.array([*encoding.ids, END], np.int32)


@lru_cache(maxsize=1)
def pieces_of(path: str, whole_texts: bool = False) -> Pieces:
    """Pieces that the tasks of a process share; at most PIECES_KEPT stay known after a slice of texts."""
    return Pieces(path, whole_texts)


def by_bytes(sizes: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Slices of texts of about as many bytes at most; a longer text is one by itself."""
    first = size = 0
    for k, n in enumerate(sizes):
        if k > first and size + n > most:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def slices_of(texts: pa.Array) -> Iterator[pa.Array]:
    for a, b in by_bytes(pc.binary_length(texts).to_pylist()):
        yield texts.slice(a, b - a)


def write_ids(docs: DataFrame, path: str | None = None, at: str | None = None, whole_texts: bool = False) -> DataFrame:
    """Write the ids of docs (doc_id, text) in the format above, to `at` or the shared folder, and read the file back.

    A null or empty text has the end id only. Rows are ordered by doc_id, null ids first, then by a hash of the text. Repeated
    ids and rows are each written, an empty table gives no records, other columns of docs are not looked at. Long texts are
    written whole, over as many blocks as they need. whole_texts: give the library each text as it is, not its pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, part, record = pieces_of(path, whole_texts), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([record], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(doc_ids, ids)], pa.binary())], names=["part", "record", "n_docs", "n_tokens", "payload"])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), (x for texts in slices_of(b.column("text")) for x in ids_of.batch(texts))):
                doc_ids.append(d)
                ids.append(x)
                size += len(x)
                if size >= RECORD:
                    yield close()
                    doc_ids, ids, size, record = [], [], 0, record + 1
        if ids:
            yield close()

    rows = text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    keys = ["doc_id", "h", "n"]  # rows with the same id and text are alike: a number parts them
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts_for(spark, plan_bytes(docs)), *keys).sortWithinPartitions(*keys).drop("h", "n")
    records = rows.mapInArrow(lean(run), "part int, record int, n_docs bigint, n_tokens bigint, payload binary")
    if at:
        records.write.parquet(at)
        return spark.read.schema(records.schema).parquet(at)
    return materialise(records, "token-ids")


def read_ids(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in files that `write_ids` wrote; no rows if they hold none.

    start counts the ids of all documents before it: sums of parts (as many as tasks wrote) go to all tasks; within a
    part a window adds up its records.
    """
    spark = records.sparkSession
    small_batches(spark)
    parts = records.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in parts:
        starts.append((r["part"], total))
        total += r["n"]
    first = spark.createDataFrame(starts or [(0, 0)], "part int, first bigint")
    before = Window.partitionBy("part").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    at = records.select("part", "record", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inner")).join(F.broadcast(first), "part").select("part", "record", (F.col("first") + F.col("inner")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of.cache_clear()  # the process encodes no more
        for b in batches:
            for first, payload in zip(b.column("first").to_pylist(), b.column("payload")):
                doc_ids, ids = unpack(payload.as_py())
                n = np.array([len(x) for x in ids], np.int64)
                start = first + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row of `at` for each record, of some millions of ids: small beside the payloads, which stay where they were read
    joined = records.select("part", "record", "payload").join(at.hint("broadcast") if len(parts) <= 10_000 else at, ["part", "record"])
    return joined.select("first", "payload").mapInArrow(lean(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
