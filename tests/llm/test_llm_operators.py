"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and extra columns."""

import datetime
import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, htmlcut, idcoder, jaccard, mixing, quality, queries, repetition, sharding, tokens, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, words string, key int"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def rows():
    base = prose(120, 1).split(" ")
    near = [*base]
    near[60] = "changed"
    far = base[:60] + prose(60, 2).split(" ")
    texts = [None, "", "   ", "one", "one two", "one two", " ".join(base), " ".join(base), " ".join(near), " ".join(far), prose(3000, 3), "über  naïve\n\nCafé ﬁ́ x", "same line\nsame line\n\n same line", "a b c d e f g h " * 30, "x" * 5000]
    texts += [prose(random.Random(k).randint(1, 90), 50 + k) for k in range(40)]
    return [(k, t, ["en", "de", None][k % 3], ["s0", "s1", None, "s0"][k % 4], 0, 1, "s", "w", 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows()
    return spark.createDataFrame([*data, data[7]], DOCS).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == docs.count()
    text = {r[0]: r[1] or "" for r in rows()}
    for r in out:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["grown_shard"] is None
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in out if text[r["doc_id"]] == text[6]}) == 1
    assert sharding.shard_documents(empty, 4).count() == 0


def test_sharding_splits_a_group_over_half_a_shard(spark):
    d = spark.createDataFrame([(7, "hot " * 50) if k % 3 else (k, prose(30, k)) for k in range(600)], "doc_id bigint, text string")
    loads = Counter()
    for r in sharding.shard_documents(d, 8).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) < 1.1 * sum(loads.values()) / 8


def test_sharding_against_plain_packing(spark):
    tok = tokens.load(tokens.default_path())
    data = [(k, prose(random.Random(k % 90).randint(20, 60), k % 90)) for k in range(200)] + [(None, None), (3, "")] * 2
    size = {t or "": len((t or "").encode()) + 16 for _, t in data}
    groups = [(n * size[t], n * len(tok.encode(t, add_special_tokens=False).ids), n, t) for t, n in Counter(t or "" for _, t in data).items()]
    total = [sum(g[c] for g in groups) for c in range(3)]
    left, where = [[1.0] * 3 for _ in range(4)], {}
    for g in sorted(groups, key=lambda g: (-g[0], -g[1], hashlib.md5(g[3].encode()).hexdigest())):
        part = [g[c] / (total[c] / 4) for c in range(3)]
        scores = [(left[b][0] >= part[0], sum(w * p * x for w, p, x in zip((4, 1, 1), part, left[b])), -b) for b in range(4)]
        best = -max(scores)[2] if any(x[0] for x in scores) else max(range(4), key=lambda b: (left[b][0], -b))
        where[g[3]] = best
        left[best] = [x - p for x, p in zip(left[best], part)]
    d = spark.createDataFrame([(*x, 7) for x in data], "doc_id bigint, text string, n int")
    out = sharding.shard_documents(d, 4).collect()
    assert Counter(r["shard"] for r in out) == Counter(where[t or ""] for _, t in data)
    assert {(r["doc_id"], r["shard"]) for r in out} == {(k, where[t or ""]) for k, t in data}


def test_pack_vectors_balances_all_sizes():
    r = np.random.default_rng(1)
    items = np.stack([r.lognormal(5, 1, 3000), r.lognormal(3, 1, 3000), np.ones(3000)], axis=1)
    where = sharding.pack_vectors(items, 10)
    for c, most in ((0, 1.001), (1, 1.1), (2, 1.2)):
        load = np.bincount(where, items[:, c])
        assert load.max() < most * load.mean()


def longest_common(a, b, used_a, used_b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
    return best[0], -best[1], -best[2]


def test_tiles_cover_as_much_as_plain_greedy_tiling():
    r = random.Random(3)
    for _ in range(150):
        item = [r.randint(0, 30) for _ in range(r.randint(5, 40))]
        cut = r.randint(0, len(item))
        doc = [r.randint(0, 30) for _ in range(10)] + item[cut:] + [99] + item[:cut] + [r.randint(0, 30) for _ in range(10)]
        used_i, used_d, plain = [False] * len(item), [False] * len(doc), 0
        while (m := longest_common(item, doc, used_i, used_d))[0] >= 5:
            plain += m[0]
            used_i[m[1] : m[1] + m[0]] = used_d[m[2] : m[2] + m[0]] = [True] * m[0]
        windows = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        starts = np.array([k for k in range(len(doc) - 4) if tuple(doc[k : k + 5]) in windows], np.int64)
        tiles = decontamination.tile(np.array(doc), np.array(item), starts, 5)
        assert sum(n for *_, n in tiles) == plain
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards juggle tiny boxes of glass"
    w = item.split()
    leaks = [(100, f"before {item.upper()}! after"), (101, " ".join(w[9:]) + ". Other words here. " + " ".join(w[:9])), (102, " ".join(w[:6]) + " only"), (103, None), (104, "Too, SHORT"), (105, "this is too short")]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, ""), (11, prose(30, 900))], "item_id bigint, text string")
    d = docs.select("doc_id", "text").union(spark.createDataFrame(leaks, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["matched"]) for r in decontamination.contaminated(d, bench).collect()) == [(100, 7, len(w)), (101, 7, len(w)), (104, 8, 2)]
    assert {r[0] for r in d.select("doc_id").collect()} - {r["doc_id"] for r in decontamination.drop_contaminated(d, bench).collect()} == {100, 101, 104}
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns


def plain_tiling(item, doc, k=5):
    used_i, used_d, total = [False] * len(item), [False] * len(doc), 0
    while (m := longest_common(item, doc, used_i, used_d))[0] >= k:
        total += m[0]
        used_i[m[1] : m[1] + m[0]] = used_d[m[2] : m[2] + m[0]] = [True] * m[0]
    return total


def test_decontamination_against_plain_tiling(spark, monkeypatch):
    r = random.Random(12)
    words = VOCABULARY[:40]
    items = [[r.choice(words) for _ in range(r.randint(1, 30))] for _ in range(12)] + [["x"] * 20]
    docs = []
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            i = r.choice(items)
            a = r.randrange(len(i))
            parts += i[a : a + r.randint(1, 20)] + [r.choice(words) for _ in range(r.randint(0, 3))]
        docs.append(parts)
    docs += [["x"] * 50, *items[:4]]
    want = {(d, i, plain_tiling(item, doc) if len(item) >= 5 else len(item)) for d, doc in enumerate(docs) for i, item in enumerate(items) if (2 * plain_tiling(item, doc) >= len(item) if len(item) >= 5 else item == doc)}
    assert len(want) > 20
    d = spark.createDataFrame([(k, ", ".join(t), 1) for k, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(k, " ".join(t).upper()) for k, t in enumerate(items)], "item_id bigint, text string")
    for size in (500_000, 40):  # the second makes several blocks
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", size)
        assert {(x["doc_id"], x["item_id"], x["matched"]) for x in decontamination.contaminated(d, b).collect()} == want
        assert {x["doc_id"] for x in decontamination.drop_contaminated(d, b).collect()} == set(range(len(docs))) - {x[0] for x in want}


def test_repetitive_texts_are_tiled_soon():
    began = time.thread_time()
    r = random.Random(13)
    for doc, item in (("x " * 200_000, "x " * 500), (" ".join(r.choices("ab", k=20_000)), " ".join(r.choices("ab", k=400)))):
        assert decontamination.Index([(1, item)], 5).hits(doc, 0.5)[0]["coverage"] > 0.9
    assert time.thread_time() - began < 5


def test_mixing(docs, empty):
    out = mixing.mixed(docs).collect()
    assert len(out) == docs.count() and all(0 < r["p"] <= 1 for r in out) and any(r["source"] == "(none)" for r in out)
    assert mixing.mixed(empty).count() == 0
    assert {r[0] for r in mixing.mix(docs).collect()} == {r["doc_id"] for r in out if r["kept"]} and mixing.mix(docs).columns == docs.columns


def test_raking_meets_the_targets(spark):
    r = random.Random(1)
    cells = [(s, g, t, float(r.randint(1, 1000))) for s in "abc" for g in ("en", "de") for t in "xyz"]
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.2}}
    d = spark.createDataFrame(cells, "source string, lang string, topic string, words double")
    out = mixing.rake(d.coalesce(1), targets, sweeps=25).collect()
    total = sum(x["weight"] for x in out)
    for dim, goal in targets.items():
        for value, share in goal.items():
            assert abs(sum(x["weight"] for x in out if x[dim] == value) / total - share) < 1e-4
    assert max(x["p"] for x in out) == 1
    raked = mixing.rake(d, targets, sweeps=25)
    assert mixing.misses(raked, targets) == []
    assert {x[:2] for x in mixing.misses(mixing.rake(d, targets, sweeps=0), targets)} >= {("source", "a"), ("lang", "en")}
    assert [x[:3] for x in mixing.misses(raked, {"lang": {"fr": 0.5}})] == [("lang", "fr", 0.5)]
    for bad in ({"source": {"a": 0.7, "b": 0.5}}, {"colour": {"red": 0.1}}):
        with pytest.raises(ValueError):
            mixing.rake(d, bad)


def test_mixing_with_clashing_columns(spark, docs):
    odd = docs.withColumns({"__p": F.lit(1.5), "__source": F.lit("x"), "row": F.lit(3), "words": F.lit(None).cast("string")})
    kept = mixing.mix(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in mixing.mix(docs).collect())


def test_token_counts(docs, empty):
    tok = tokens.load(tokens.default_path())
    text = {r[0]: r[1] or "" for r in rows()}
    out = tokens.count_tokens(docs, chunk=300, overlap=16, limit=50).collect()
    assert len(out) == docs.count()
    for r in out:
        n = len(tok.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text[r["doc_id"]].encode()), n > 50)
    assert tokens.count_tokens(empty).count() == 0


def test_whole_texts_in_fewer_steps():
    tok, whole, r = tokens.load(tokens.default_path()), tokens.whole_of(tokens.default_path()), random.Random(6)
    steps = [json.loads(t.to_str())["normalizer"] for t in (whole.any, whole.composed)]
    assert steps == [{"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}, {"type": "Lowercase"}]
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["\u200b", "\u180e"]
    low = [chr(c) for c in range(0x300)]
    high = [chr(c) for c in (*range(0x300, 0x370), *range(0x1E00, 0x2000), 0x3A3, 0x1100, 0x1161, 0x11A8, 0x212B, 0x2126)]
    texts = ["".join(r.choices(some, k=r.randint(0, 50))) for some in (blanks + low, low, blanks + high, low + high) for _ in range(500)]
    texts += [f"a{c}'S{c}{c}'ll <|endoftext|>{c}B" for c in blanks] + ["e\u0301 \u00e9 É", "ẞß İ Σ", ""]
    ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert whole.each(texts, lambda e: e.ids) == ids
    assert tokens.counts(tok, texts, whole=whole) == tokens.counts(tok, texts) == list(map(len, ids))
    other = tokens.Whole(tok)  # of a tokenizer with other rules nothing is left out
    assert other.any is other.composed is tok and other.each(texts[:20], len) == list(map(len, ids[:20]))


def test_whole_texts_are_lowered_before_and_visible_ones_not_mapped():
    tok, whole, r = tokens.load(tokens.default_path()), tokens.whole_of(tokens.default_path()), random.Random(7)
    low, steps = [chr(c) for c in range(0x300)], json.loads(tok.to_str())["normalizer"]["normalizers"]
    assert [c.lower() for c in low] == [whole.composed.normalizer.normalize_str(c) for c in low] and steps[2] == {"type": "Lowercase"}
    assert json.loads(whole.visible.to_str())["pre_tokenizer"] == tokens.EXPECTED[1]["pretokenizers"][0]
    assert [json.loads(t.to_str())["normalizer"] for t in (whole.lowered, whole.visible)] == [None, None]
    ways = {"It'S\ta\x0bTEXT!": "visible", "": "visible", "a\x1cB": "lowered", "\x7f": "lowered", "É": "lowered", "<|STARTOFTEXT|>": "composed", "É<|endoftext|>": "composed", "e\u0301": "any", "<|endoftext|>Σ": "any"}
    assert {t: whole.way(t) for t in ways} == ways
    ascii_ = [chr(c) for c in (*range(9, 14), *range(32, 127))]
    texts = [*ways, *low, *(f"{a}{b}" for a in map(chr, range(128)) for b in map(chr, range(128)))]
    texts += ["".join(r.choices(some, k=r.randint(0, 80))) for some in (ascii_, "'SsTRrEe VvMLlDd19?", low, [*"<|>aE ", "<|endoftext|>", "<|StartOfText|>"]) for _ in range(1000)]
    assert whole.each(texts, lambda e: e.ids) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_ids_gives_the_library_whole_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(2, "It's a text"), (1, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, write = [], idcoder.write_ids
    monkeypatch.setattr(idcoder, "write_ids", lambda *a, **k: asked.append(k) or write(*a, **k))
    out = queries.op5_token_ids(spark, str(tmp_path)).collect()
    ids = [*tokens.load(tokens.default_path()).encode("It's a text", add_special_tokens=False).ids, 2]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in out) == [(1, 0, 1), (2, 1, len(ids))]
    assert asked == [{"whole_texts": True}] and idcoder.Pieces(tokens.default_path(), True).plain is idcoder.NONE


def test_token_ids_come_from_the_tokenizer_with_the_fewest_steps(monkeypatch):
    path = tokens.default_path()
    tok, whole, texts = tokens.load(path), tokens.Whole(tokens.load(path), True), ["It's A\tTEXT 12!", "É a", "e\u0301", "<|EndOfText|>", ""]
    monkeypatch.setattr(idcoder, "whole_of", lambda _: whole)
    want = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in idcoder.Pieces(path, True).batch(pa.array(texts))] == want
    got, inner = [], whole.visible
    whole.visible = type("Spy", (), {"encode_batch_fast": lambda _, some, **k: got.extend(some) or inner.encode_batch_fast(some, **k)})()
    assert [x.tolist() for x in idcoder.Pieces(path, True).batch(pa.array(texts))] == want and got == ["it's a\ttext 12!", ""]


def test_spliced_ids_are_those_of_the_whole():
    tok = tokens.load(tokens.default_path())
    r = random.Random(2)
    alphabet = ["a", "Be", " ", "\n", "  ", "1", "é", "é", "'s", "<|endoftext|>", "!", "ß", "　", "漢字", "́"]
    for k in range(150):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 900)))
        whole = tok.encode(t, add_special_tokens=False).ids
        assert tokens.encode_long(tok, t, 60, 12) == whole, k
        assert tokens.counts(tok, [t], 60, 12) == [len(whole)]
        assert idcoder.Pieces(tokens.default_path()).batch(pa.array([t]))[0].tolist() == [*whole, 2]


def test_chunks_go_to_the_tokenizer_with_the_fewest_steps(monkeypatch):
    tok, whole, r = tokens.load(tokens.default_path()), tokens.whole_of(tokens.default_path()), random.Random(8)
    used, encode = [], tokens.encode_long
    monkeypatch.setattr(tokens, "encode_long", lambda t, *a: used.append(t) or encode(t, *a))
    for way, some in (("visible", "aBe  \n1'sS!?"), ("lowered", "aÉß İ \x1c\xa0'S1!"), ("composed", [*"aBÉ 1!", "<|endoftext|>", "<|EndOfText|>", "<|"]), ("any", [*"aB é1!İ", "\u0301", "漢", "Σ", "<|endoftext|>"])):
        texts = ["".join(r.choices(some, k=r.randint(200, 900))) for _ in range(60)]
        used.clear()
        assert tokens.counts(tok, texts, 60, 12, True, whole) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert all(a is b for a, b in zip(used, [getattr(whole, way)] * len(texts), strict=True))
        assert [encode(*whole.fit(t), 60, 12) for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    t = "Visible text, " * 5000
    used.clear()
    assert tokens.counts(tok, [t], whole=whole) == [len(tok.encode(t, add_special_tokens=False).ids)] and len(used) == 1 and used[0] is whole.visible


def test_long_texts_of_the_default_sizes():
    tok, r = tokens.load(tokens.default_path()), random.Random(4)
    kana = "".join(chr(0x3041 + k) for k in range(80))
    for characters in (kana, kana + "。、", "ab c", "a", " ", "!?", "12", "'s ", "e\u0301 <|endoftext|>"):
        t = "".join(r.choices(characters, k=3 * tokens.CHUNK))
        assert tokens.encode_long(tok, t) == tok.encode(t, add_special_tokens=False).ids
    t = "".join(r.choices(kana, k=1 << 20))  # nowhere to cut
    began = time.thread_time()
    n = len(tok.encode_batch_fast([t], add_special_tokens=False)[0])
    library = time.thread_time() - began
    assert tokens.counts(tok, [t]) == [n] and time.thread_time() - began - library < 3 * library


def test_pieces_are_those_of_the_library(monkeypatch):
    tok, pieces, r = tokens.load(tokens.default_path()), idcoder.Pieces(tokens.default_path()), random.Random(3)
    assert pieces.plain is idcoder.PLAIN  # the file's rules are those that the quick way mirrors
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x100))]
    texts = ["".join(r.choices(plain, k=r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choices("'strevmld <|>Á", k=30)) for _ in range(1000)]
    texts += ["it's they'RE ''s 'll'd x'sab", "İstanbul", "a\u00a0b", "a\x1cb", "x<|endoftext|>y", "½ ²x ªº µΜ", "ÀÉß ẞ", ""]
    whole = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in pieces.batch(pa.array(texts))] == whole
    monkeypatch.setattr(idcoder, "PIECES_KEPT", 10)  # pieces are forgotten and met again
    assert [x.tolist() for k in range(0, len(texts), 100) for x in pieces.batch(pa.array(texts[k : k + 100]))] == whole


def test_coder_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 255, 257, 1000, 5000, 70_000):
        for ids in (r.integers(0, 49_408, n), r.zipf(1.3, n) % 49_408, np.zeros(n, np.int64), np.arange(n) % 7):
            data = idcoder.encode_block(ids)
            back, at = idcoder.decode_block(data)
            assert at == len(data) and (back == ids).all()
    data = bytearray(idcoder.encode_block(np.arange(1000) % 50))
    data[-30] ^= 255
    with pytest.raises(ValueError):
        idcoder.decode_block(bytes(data))
    with pytest.raises(ValueError):
        idcoder.encode_block(np.array([50_000]))
    # what orders 2 and 1 foresee takes next to nothing, random ids no more than their share
    assert len(idcoder.encode_block(np.arange(200_000) % 7)) < 200_000 / 15
    assert len(idcoder.encode_block(r.integers(0, 49_408, 200_000))) < 200_000 * 17 / 8
    # a block decodes without those before it
    ids = [r.integers(0, 100, 700), np.array([], np.int64), r.integers(0, 100, 300)]
    assert [x.tolist() for x in idcoder.unpack(idcoder.pack([5, None, 6], ids, block=256))[1]] == [x.tolist() for x in ids]


def test_token_ids(docs, empty, tmp_path):
    tok = tokens.load(tokens.default_path())
    text = {r[0]: r[1] or "" for r in rows()}
    whole = idcoder.read_ids(idcoder.write_ids(docs, whole_texts=True)).collect()
    out = sorted(idcoder.read_ids(idcoder.write_ids(docs, at=f"file://{tmp_path}/ids")).collect(), key=lambda r: r["start"])
    assert sorted(whole) == sorted(out)
    assert [r["doc_id"] for r in out] == sorted(r[0] for r in docs.select("doc_id").collect())
    start = 0
    for r in out:
        ids = [*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert idcoder.read_ids(idcoder.write_ids(empty)).count() == 0


def test_url_filter(spark, monkeypatch):
    day = datetime.date
    caps = [(1, "http://A.b.com/x/y", day(2023, 1, 5)), (2, "http://a.b.com:80/x", day(2023, 2, 5)), (3, "https://u@a.b.com/q", day(2023, 3, 5)), (4, "http://b.com", day(2023, 1, 5)), (5, None, day(2023, 1, 1)), (6, "nonsense", day(2023, 1, 1)), (7, "http://a.b.com/x", None), (8, "http://notb.com/", day(2023, 1, 5)), (1, "http://A.b.com/x/y", day(2023, 1, 5))]
    log = [("domain", "b.com", "block", day(2023, 1, 1)), ("host", "a.b.com", "allow", day(2023, 1, 5)), ("host", "a.b.com", "drop", day(2023, 2, 20)), ("prefix", "a.b.com/x", "block", day(2023, 2, 1)), ("domain", "b.com", "drop", day(2023, 3, 5)), ("domain", "b.com", "allow", day(2023, 3, 5)), (None, "b.com", "block", day(2023, 1, 1))]
    c = spark.createDataFrame([(*x, "h", 5, None) for x in caps], "page_id bigint, url string, fetched date, host string, n int, verdict string")
    e = spark.createDataFrame(log, "scope string, value string, action string, since date")
    for sent in (100_000, 0):  # the second joins by key
        monkeypatch.setattr(urlfilter, "SENT", sent)
        got = Counter((r["page_id"], r["verdict"], r["scope"]) for r in urlfilter.verdicts(c, e).collect())
        assert got == Counter([(1, "allow", "host"), (1, "allow", "host"), (2, "block", "prefix"), (3, "allow", "domain"), (4, "block", "domain"), (5, "none", None), (6, "none", None), (7, "none", None), (8, "none", None)])
    assert urlfilter.verdicts(c, e.limit(0)).filter("verdict <> 'none'").count() == 0 and urlfilter.verdicts(c.limit(0), e).count() == 0


def test_min_cut_is_least():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 9)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(x):
            return sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, x)) + sum(w for u, v, w in edges if x[u] != x[v])

        assert abs(cost(htmlcut.min_cut(gain, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site name</a> Slogan of the site, in some words.</header>
<div class="cookie-notice">We use cookies. Please accept them all, as they taste good.</div><nav><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></nav>
<div class="wrap"><article class="post"><h1>Head &amp; title</h1><p>First <b>para</b>graph&nbsp;with   many words, and more words.<p>Second one &mdash; it is<br>longer and goes on for a while.</p>
<aside>Related: something else that has a full sentence.</aside><script>var x = "<p>no</p>";</script><ul><li>an item of the list</li><li>another one of them</li></ul></article>
<div class="sidebar"><p>About the author of this site. A long line of text, with commas.</p></div><section id="comments"><p>Great post, thank you so much for it!</p></section></div>
<form><p>Subscribe to our letter now.</p><input name=q></form><footer>&copy; 2024 Site. All rights are reserved.</footer></body></html>"""


def plain_page(seed):
    """A page of div, p, ul and a alone, without names, and its main text: paragraphs, short lines and lists between them."""
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{k}>{line(2)}</a></li>" for k in range(n)) + "</ul>"
    body, text = [], []
    for _ in range(r.randint(3, 7)):
        if r.random() < 0.7:
            text.append(line(r.randint(1, 2)))
            body.append(f"<div>{text[-1]}</div>")
        text.append(line(r.randint(20, 60)) + ".")
        body.append(f"<p>{text[-1]}</p>")
    return f"<body><div>{links(5)}</div><div><div>{''.join(body)}</div></div><div>{links(8)}</div><div>&copy; {line(4)}.</div></body>", text


def test_the_cut_decides_where_names_tell_nothing():
    blocks = turned = 0
    for seed in range(40):
        page, want = plain_page(seed)
        bs = htmlcut.blocks(page)
        gain, edges = htmlcut.graph(bs)
        keep = htmlcut.label(gain, edges)
        assert [b.text for b, k in zip(bs, keep) if k] == want
        blocks += len(bs)
        turned += sum((g >= 0) != k for g, k in zip(gain, keep))
    assert turned > 0.05 * blocks


def test_settled_blocks_are_those_of_a_least_cut():
    r = random.Random(18)
    for _ in range(300):
        n = r.randint(1, 9)
        gain = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(j, i, r.choice((0.05, 0.3, 1.0))) for i in range(n) for j in range(i) if r.random() < 0.4]

        def cost(x):
            return sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, x)) + sum(w for u, v, w in edges if x[u] != x[v])

        assert abs(cost(htmlcut.label(gain, edges)) - cost(htmlcut.min_cut(gain, edges))) < 1e-6


def test_hostile_pages_take_time_in_proportion():
    n = 100_000
    for page in ("<a " * 3 * n, "<div>" * n + "x" + "</div>" * n, "<b>" * n + "<div>" * n + "</b>" * n, "<p title=\"a>Text " * n, "<" * 10 * n, "<!-- " * 2 * n, "<div " * 2 * n, "<script>" * n, "&" * 10 * n, "<li><a href=x>b</a>" * (n // 2)):
        began = time.thread_time()
        htmlcut.main_text(page)
        assert time.thread_time() - began < 5, page[:20]  # of a second or less; the machine may be busy


def test_tags_that_are_not_right():
    for page, want in (
        ('<p title="a>Text of a page, all of it.', "Text of a page, all of it."),
        ('<p title="a > b" class=x>Text of a page.<p id=\'y>Another line of it.', "Text of a page. Another line of it."),
        ("<article><p>Energy <math><mi>E</mi><mo>=</mo>mc</math> is <object>old</object> <svg><text>drawn</text></svg>.</p></article>", "Energy E=mc is old drawn."),
        ("<html><head><title>T</title><body><p>No end of the head, but text.</p>", "No end of the head, but text."),
        ("<p>If a < b and c > d, then so be it.</p>", "If a < b and c > d, then so be it."),
    ):
        assert htmlcut.main_text(page) == want


def test_html_text(spark):
    want = "Head & title First paragraph with many words, and more words. Second one — it is longer and goes on for a while. an item of the list another one of them"
    assert htmlcut.main_text(PAGE) == want
    for odd in (None, "", "  ", "<", "<p", "</p></p>", "<script>", "<!-- never ends", "<b><i></b></i>", "&", "<div" * 50, "<div>" * 3000):
        htmlcut.main_text(odd)
    assert htmlcut.main_text("<body><p>One sentence, of some words, without any article around it.</p></body>").startswith("One")
    long = PAGE.replace("<p>First", "<p>First " + "sentence after sentence. " * 20_000)
    d = spark.createDataFrame([(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, None, 1), (3, "u", "", "", 1), (4, "u", long, "", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmlcut.extract(d).collect() if r["page_id"] < 4)
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert htmlcut.extract(d.filter("page_id = 4")).first()["n_chars"] == len(want) + len("sentence after sentence. ") * 20_000
    assert htmlcut.extract(d.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in out if r["quality"] == 1]
    bad = [r["score"] for r in out if r["quality"] == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.98
    assert sum((r["score"] >= 0.3) == r["quality"] for r in out) > 0.95 * len(out)
    assert sum(s < 0.3 for s in good) < 0.01 * len(good)


def test_quality_against_plain_nearest_neighbours(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    voters = quality.fit(d, labels)
    known = [r for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    assert len(voters.label) == len({r["doc_id"] for r in known}) and voters.label.sum() == sum(r["quality"] for r in known)
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in quality.classify(d, labels).collect():
        x = quality.counts(texts[r["doc_id"]])
        if not x.any():
            assert r["score"] == pytest.approx(voters.prior)
            continue
        v = quality.unit(quality.damp(x[None].copy(), voters.idf) @ voters.basis)[0]
        near = sorted(((sum(a * b for a, b in zip(v.tolist(), w.tolist())), y) for w, y in zip(voters.vectors, voters.label.tolist())), reverse=True)
        near = [(s, y) for s, y in near if s <= quality.SAME][: quality.NEIGHBOURS]
        total = sum(max(s, 0) ** quality.POWER for s, _ in near)
        assert r["score"] == pytest.approx(sum(max(s, 0) ** quality.POWER * y for s, y in near) / total, abs=2e-3)


def test_quality_with_repeated_ids_and_long_texts(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    more = spark.createDataFrame([(6, prose(300, 61), None, None, 0, 1, "s", "w", 2), (None, prose(30, 62), None, None, 0, 1, "s", "w", 2), (900, prose(200_000, 63), None, None, 0, 1, "s", "w", 2)], DOCS)
    both = [sorted((str(r["doc_id"]), r["score"]) for r in quality.classify(x, labels).collect()) for x in (docs.union(more), more.union(docs).repartition(5))]
    assert [x[0] for x in both[0]] == [x[0] for x in both[1]] and all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(*both))
    assert sum(x[0] == "6" for x in both[0]) == 2


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def brute_links(data, threshold=0.8):
    """For each row: (least id of its text, least id of its class, links, place of the class)."""
    big = 10**12
    sets = {}
    for k, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = min(5, len(w))
        k = big if k is None else k
        if (t or "") not in sets:
            sets[t or ""] = [k, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()]
        sets[t or ""][0] = min(k, sets[t or ""][0])
    links, texts = Counter(), list(sets)
    up = {t: t for t in texts}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    least = {}
    for t in texts:
        least[find(t)] = min(sets[t][0], least.get(find(t), big))
    null = lambda k: None if k == big else k
    return [(k, null(sets[t or ""][0]), null(least[find(t or "")]), links[t or ""], find(t or "")) for k, t, *_ in data]


def variants(n, words, seed):
    r, base, out = random.Random(seed), prose(words, seed).split(" "), []
    for _ in range(n):
        w = [*base]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


def test_jaccard_join(spark, docs, empty, monkeypatch):
    texts = variants(60, 240, 11) + variants(20, 30, 12) + variants(5, 8, 13) + [prose(20, 14) + " " + prose(40, 100 + k) for k in range(30)]
    extra = [(1000 + k, t, "en", "s", 0, 1, "s", "w", 2) for k, t in enumerate(texts)]
    d = docs.union(spark.createDataFrame(extra, DOCS))
    data = [*rows(), rows()[7], *extra]
    want = brute_links(data)
    for side, hot in ((1024, 256), (16, 256), (16, 8)):  # the second cuts buckets into blocks, the third gives them pivots
        monkeypatch.setattr(jaccard, "SIDE", side)
        monkeypatch.setattr(jaccard, "HOT", hot)
        out = jaccard.near_duplicates(d).collect()
        assert Counter((r["doc_id"], r["rep_id"], r["class_id"], r["n_links"]) for r in out) == Counter(x[:4] for x in want)
    assert max(x[3] for x in want) > 20
    one = jaccard.keep_one(d)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({x[2] for x in want}) and one.columns == d.columns
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_jaccard_join_with_clashing_and_null_ids(spark):
    a, b = ([prose(200, seed) + end for end in ("", " once", " twice")] for seed in (21, 22))
    data = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (None, a[2]), (None, prose(50, 23)), (None, prose(50, 23)), (5, prose(60, 24)), (5, prose(60, 24)), (None, None)]
    d = spark.createDataFrame([(*x, "i", 0.5) for x in data], "doc_id bigint, text string, __id string, place double")
    out = jaccard.near_duplicates(d).collect()
    want = brute_links(data)
    assert Counter((r["doc_id"], r["rep_id"], r["class_id"], r["n_links"]) for r in out) == Counter(x[:4] for x in want)
    assert len({r["class_key"] for r in out}) == len({x[4] for x in want})
    one = jaccard.keep_one(d)
    assert one.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(kept, key=str) == sorted([data[0], data[1], data[5], data[7], data[9]], key=str)


def test_a_core_is_counted_not_compared(spark, monkeypatch):
    base, r = prose(300, 31).split(" "), random.Random(31)
    near = [" ".join([*base[:i], "x", *base[i + 1 : j], "y", *base[j + 1 :]]) for i, j in (sorted(r.sample(range(300), 2)) for _ in range(400))]
    data = list(enumerate([" ".join(base), *near, prose(200, 32)]))
    want = brute_links(data)
    compared = spark.sparkContext.accumulator(0)
    plain = jaccard.compare

    def counted(rows, *rest):
        compared.add(len(rows))
        return plain(rows, *rest)

    monkeypatch.setattr(jaccard, "compare", counted)
    monkeypatch.setattr(jaccard, "SIDE", 64)
    out = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["rep_id"], r["class_id"], r["n_links"]) for r in out) == Counter(x[:4] for x in want)
    assert compared.value < 400  # 32 buckets of about 350 texts, each in 7 blocks with the others


def test_posterior_bound():
    m = jaccard.least_matches(0.8, 128)
    s = np.linspace(0, 1, 200_001)
    for k, below in ((m, False), (m - 1, True)):
        p = s**k * (1 - s) ** (128 - k)
        assert (p[s >= 0.8].sum() / p.sum() < jaccard.TOLERANCE) == below


def brute_repeats(w, k=8):
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    inside = {j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    most = 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            most = max(most, n)
    return len(inside), most if most >= k else 0


def test_repetition(docs, empty):
    text = {r[0]: r[1] or "" for r in rows()}
    out = repetition.judge(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        t = text[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        inside, most = brute_repeats(w) if len(w) < 400 else (r["n_repeat_words"], r["longest"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)))
        assert (r["n_repeat_words"], r["longest"]) == (inside, most)
        assert r["base_failed"] == (len(w) < 20 or 100 * inside > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert repetition.judge(empty).count() == 0


def test_kept_on_both_sides_of_its_limits(spark):
    free = (f"w{k}" for k in itertools.count())
    take = lambda n: [next(free) for _ in range(n)]

    def repeated(part, rest):
        p = take(part)
        return " ".join(take(rest // 2) + p + take(rest - rest // 2) + p)

    texts = {1: repeated(10, 80), 2: repeated(11, 78), 3: repeated(64, 1000), 4: repeated(65, 1000), 5: " ".join(take(20)), 6: " ".join(take(19)), 7: " ".join(take(60_000))}
    d = spark.createDataFrame([(k, t, 0.0, "x") for k, t in texts.items()], "doc_id bigint, text string, covered double, kept string")
    got = {r["doc_id"]: r for r in repetition.judge(d).collect()}
    assert {k: r["kept"] for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True}
    assert (got[1]["covered"], got[3]["longest"], got[4]["longest"], got[2]["base_failed"], got[6]["base_failed"]) == (0.2, 64, 65, False, True)


def test_repeats_against_brute_force():
    r = random.Random(9)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 90))] for _ in range(120)] + [[b"x"] * 40, [], [b"y"]]
    for t, (inside, covered, most) in zip(texts, repetition.repeats(texts)):
        assert (inside, most) == brute_repeats(t) and covered == inside


def test_slices_of_texts_are_whole(monkeypatch):
    texts = ["ab", "", "c" * 20, "d", "e", "", "f" * 9, "g"]
    slices = list(idcoder.by_bytes(list(map(len, texts)), 10))
    assert slices == [(0, 2), (2, 3), (3, 6), (6, 8)]
    assert list(idcoder.by_bytes([])) == []
    assert [t for s in idcoder.slices_of(pa.array(texts)) for t in s.to_pylist()] == texts
