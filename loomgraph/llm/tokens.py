"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of over CHUNK characters is encoded in chunks that overlap. Two neighbours are spliced at a boundary in their
overlap that is proven stable: both encodings have the same tokens on either side of it at the same offsets, and the
splitter of the tokenizer can't but cut there, whatever stands further off (`boundaries`). A chunk goes on to such a place.
Where the encodings don't agree the overlap is doubled, at last the chunk: the time stays in proportion to the text.

All else goes to the library whole, with its own splitter and model; `Whole` only has it leave out steps that can't change an id.

The rules of `boundaries` and `Whole` hold for a tokenizer whose file has the normaliser and the splitter in EXPECTED; the texts of any
other go to the library whole, as those up to CHUNK do.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_of

CHUNK = 32_768
OVERLAP = 512
#: Tokens on each side of a splice that must agree.
AGREE = 4
#: Characters given to the library at once, and those looked at on each side of a boundary for normalisation.
AT_ONCE, AROUND = 1 << 20, 16
LIMIT = 2048
#: Words of which the library keeps the tokens; it keeps 10,000 by default.
WORDS_KEPT = 500_000
#: A character that NFC may change, or that may be composed with one before it. NFC leaves texts without any as they are.
NFC_MATTERS = re.compile("[\u0300-\U0010ffff]")
SPACE = frozenset(" \t\n\r\x0b\x0c")
#: Visible ASCII, which stands for itself among the symbols of bytes, and white space, which the splitter drops.
AS_THEY_ARE = bytes([*range(9, 14), *range(32, 127)])
#: The tokenizers of `Whole`, and those that take texts in lower case.
WAYS, LOW = ("any", "composed", "lowered", "visible"), ("lowered", "visible")
#: The rules of the tokenizer file for which `boundaries` is proven.
EXPECTED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer in a file, one a process, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def rules_known(path: str) -> bool:
    config = json.loads(load(path).to_str())
    return [config["normalizer"], config["pre_tokenizer"]] == EXPECTED


class Whole:
    """What the library gives for whole texts, in fewer steps where the tokenizer's rules are EXPECTED.

    White space is in no match of the splitter, so it isn't first made a blank; texts without NFC_MATTERS aren't composed. Those
    without "<|", which begins each added token, are lowered before, letter by letter as the library does. If they hold only
    bytes of AS_THEY_ARE, these aren't mapped to symbols either. The library splits and encodes as the file says. It keeps the
    tokens of more words; all tokenizers share them.
    """

    def __init__(self, tok, known: bool = False):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.any = self.composed = self.lowered = self.visible = tok
        added = tok.get_added_tokens_decoder().values()
        self.known = known and not any(t.normalized for t in added)
        self.marked = self.known and all(t.content.startswith("<|") for t in added)
        if self.known:
            self.any, self.composed = Tokenizer.from_str(tok.to_str()), Tokenizer.from_str(tok.to_str())
            self.any.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.composed.normalizer = normalizers.Lowercase()
            model = self.any.model
            if hasattr(model, "_resize_cache"):
                model._resize_cache(WORDS_KEPT)
            self.any.model = self.composed.model = model
            self.lowered, self.visible = Tokenizer(model), Tokenizer(model)
            self.lowered.pre_tokenizer = self.any.pre_tokenizer
            self.visible.pre_tokenizer = pre_tokenizers.Split(Regex(EXPECTED[1]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)

    def way(self, text: str) -> str:
        """Which tokenizer takes the text; lowered and visible take it in lower case."""
        if not self.known or not text.isascii() and NFC_MATTERS.search(text):
            return "any"
        if not self.marked or "<|" in text:
            return "composed"
        return "visible" if text.isascii() and not text.encode().translate(None, AS_THEY_ARE) else "lowered"

    def fit(self, text: str) -> tuple:
        """The tokenizer that takes the text, and the text as it takes it."""
        way = self.way(text)
        return getattr(self, way), text.lower() if way in LOW else text

    def each(self, texts: list[str], of: Callable) -> list:
        """of(encoding) of each text; the library gets AT_ONCE characters or one text at once."""
        out: list = [None] * len(texts)
        batches: dict[str, list[int]] = {way: [] for way in WAYS}
        sizes = dict.fromkeys(WAYS, 0)

        def flush(way: str) -> None:
            batch = batches[way]
            some = [texts[k].lower() if way in LOW else texts[k] for k in batch]
            for k, e in zip(batch, getattr(self, way).encode_batch_fast(some, add_special_tokens=False)):
                out[k] = of(e)
            batches[way], sizes[way] = [], 0

        for k, t in enumerate(texts):
            way = self.way(t)
            batches[way].append(k)
            sizes[way] += len(t)
            if sizes[way] > AT_ONCE:
                flush(way)
        for way in WAYS:
            flush(way)
        return out


@lru_cache(maxsize=4)
def whole_of(path: str) -> Whole:
    """One a process."""
    return Whole(load(path), rules_known(path))


def kind(c: str) -> str:
    """L, N or O as the splitter sees the character, S if it is ASCII white space, ? where normalisation could change that."""
    if c in SPACE:
        return "S"
    if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or len(c.lower()) > 1:
        return "?"
    category, low = unicodedata.category(c)[0], unicodedata.category(c.lower())[0]
    return "?" if category in "MZ" or category == "C" or category != low else category if category in "LN" else "O"


def boundaries(text: str) -> np.ndarray:
    """The places before which the splitter can't but cut, whatever stands further off.

    White space is in no match. A match that holds a digit holds nothing else. One with a letter holds only letters,
    but for an apostrophe before it. So a cut stands beside white space and digits, after letters, and before letters
    if not after an apostrophe. Places beside characters that normalisation may change are left out.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    seen, at = np.unique(codes, return_inverse=True)
    kinds = np.array([ord(kind(chr(c))) for c in seen.tolist()], np.uint8)[at]
    left, right = kinds[:-1], kinds[1:]
    space, digit, letter, other, unsure = map(ord, "SNLO?")
    cut = (left == space) | (left == digit) | (right == digit) | (left == letter) & (right == other)
    cut |= (left == other) & (right == letter) & ~np.isin(codes[:-1], [ord(c) for c in "'<|"])
    return np.flatnonzero(cut & (right != space) & (left != unsure) & (right != unsure)) + 1


def apart(text: str, at: int) -> bool:
    """Whether the text around is normalised as its two halves are: nothing is composed across text[at]."""
    a, b = text[max(0, at - AROUND) : at], text[at : at + AROUND]
    return unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)


class Piece:
    """An encoding of text[start:end], of which tokens are asked for by number; offsets are those in the whole text."""

    def __init__(self, tok, text: str, start: int, end: int):
        self.start, self.end, self.encoding = start, end, tok.encode(text[start:end], add_special_tokens=False)
        self.first, self.size = 0, len(self.encoding)

    def token(self, k: int) -> tuple[int, int] | None:
        span = self.encoding.token_to_chars(k) if 0 <= k < self.size else None
        return span and (span[0] + self.start, span[1] + self.start)

    def at(self, place: int) -> int | None:
        """The token that begins at this character."""
        k = self.encoding.char_to_token(place - self.start)
        while k and (span := self.token(k - 1)) and span[0] == place:  # several tokens of one character
            k -= 1
        return k if k is not None and self.token(k)[0] == place else None


def splice(text: str, left: Piece, right: Piece, places: np.ndarray) -> tuple[int, int] | None:
    """(tokens of left to keep, tokens of right to skip) at a stable boundary in the overlap, the first from its middle on."""
    inside = places[np.searchsorted(places, right.start, "right") : np.searchsorted(places, left.end)]
    if not len(inside):
        return None
    ids_l, ids_r = left.encoding.ids, right.encoding.ids
    for place in inside[np.argsort(np.abs(inside - (right.start + left.end) // 2), kind="stable")].tolist():
        k, j = left.at(place), right.at(place)
        if k is None or j is None or k - AGREE < left.first or j < AGREE or k + AGREE > left.size or j + AGREE > right.size:
            continue
        if all(left.token(k + d) == right.token(j + d) and ids_l[k + d] == ids_r[j + d] for d in range(-AGREE, AGREE)) and left.token(k - 1)[1] <= place and apart(text, place):
            return k, j
    return None


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, encoded in chunks. The tokenizer's rules must be EXPECTED."""
    places = boundaries(text)

    def upto(end: int) -> int:
        """Where a chunk ends: at `end`, or so far behind the next boundary that this stands well within the overlap."""
        k = int(np.searchsorted(places, end - overlap * 3 // 4))
        return min(len(text), max(end, int(places[k]) + overlap // 2)) if k < len(places) else len(text)

    done: list[int] = []
    left, size = Piece(tok, text, 0, upto(chunk)), chunk
    while left.end < len(text):
        width, cut, floor = overlap, None, left.token(left.first)[0] if left.first else left.start
        while True:
            lo = max(floor, left.end - width)
            right = Piece(tok, text, lo, upto(left.end + size))
            if (cut := splice(text, left, right, places)) or lo == floor:
                break
            width *= 2
        if cut:
            done += left.encoding.ids[left.first : cut[0]]
            left, left.first, size = right, cut[1], chunk
        else:  # nothing in all that is left of the chunk agrees: it grows
            size = 2 * max(size, left.end - floor)
            left = Piece(tok, text, floor, upto(floor + size))
    return done + left.encoding.ids[left.first :]


def counts(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, known: bool = True, whole: Whole | None = None) -> list[int]:
    """Tokens of each text. known: the tokenizer's rules are EXPECTED. whole: takes the texts and chunks, tok if not given."""
    out, whole = [0] * len(texts), whole or Whole(tok)
    short = []
    for k, t in enumerate(texts):
        if len(t) > chunk and known:
            out[k] = len(encode_long(*whole.fit(t), chunk, overlap))
        else:
            short.append(k)
    for k, n in zip(short, whole.each([texts[k] for k in short], len)):
        out[k] = n
    return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text), as the library counts the whole text.

    A null text counts as an empty one: no bytes, no tokens. A null doc_id stays null. Repeated rows are each counted, an
    empty table gives an empty result, and other columns of docs are not looked at. Very long texts are counted whole, in
    chunks: what the library holds at once is bounded, but for a run of characters without any stable boundary.
    Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, whole = load(path), rules_known(path), whole_of(path)
        for b in batches:
            n = counts(tok, b.column("text").to_pylist(), chunk, overlap, known, whole)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = text_of(docs, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
