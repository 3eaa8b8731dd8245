"""Evaluation passages inside corpus documents.

Texts are brought to plain words. Every window of 20 words, of items and of documents,
has a fingerprint of three blocks, each the SimHash of a third of the window. Two windows
of which at most two words differ agree in at least one block: the fingerprint is indexed
by block, and every window within that radius is found (multi-index Hamming search; the
radius is two of three blocks). What is found is verified exactly along the alignment
that the block states.

The search loses no passage of any length: of n words with at most n / 8 altered, the
untouched ones fall into at most n / 8 + 1 runs, so one run has at least six words, which
is a block; blocks are indexed at every word.

Items are a stated query set. They are gone through in blocks of bounded size, each
against all documents in one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Where the window's three parts begin and end.
PARTS = ((0, 7), (7, 14), (14, 20))
BITS = 32
#: One word in so many may be altered.
ALTERED = 8
#: Items that share their first sentence, from which on it counts as an instruction.
COMMON = 5
#: Words of items that one pass over the documents takes along.
BLOCK_WORDS = 200_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    """A text's words without what doesn't matter: markup, entities, hidden characters,
    character forms, marks on letters, case, punctuation, spacing. Null has none."""
    if not text:
        return []
    s = _HIDDEN.sub("", _TAG.sub(" ", html.unescape(text) if "&" in text else text))
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return _WORD.findall(s.casefold())


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def simhash_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The SimHash of each run of `length` words, at its first word: per bit, the
    majority of the words. Shorter than `length` at the end: left out."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint32)
    if n <= 0:
        return out
    for bit in range(BITS):
        ones = np.zeros(len(hashes) + 1, np.int32)
        np.cumsum((hashes >> np.uint64(bit)).astype(np.uint8) & 1, out=ones[1:])
        out |= (2 * (ones[length:] - ones[:-length]) > length).astype(np.uint32) << np.uint32(bit)
    return out


def passage(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(first word, words, words that differ) of the longest common passage of two
    aligned word sequences: at least WINDOW words, at most one in ALTERED differing,
    beginning and ending with a word that agrees. None if there is none."""
    differ = a != b
    n = len(a)
    if n < WINDOW:
        return None
    m = np.zeros(n + 1, np.int64)
    np.cumsum(differ, out=m[1:])
    g = ALTERED * m - np.arange(n + 1)
    starts, ends = np.flatnonzero(~differ), np.flatnonzero(~differ) + 1
    if not len(starts) or ends[-1] - starts[0] < WINDOW:
        return None
    # for each end the earliest start with g[start] >= g[end]: running maxima of g over starts
    top = np.maximum.accumulate(g[starts])
    first = starts[np.minimum(np.searchsorted(top, g[ends]), len(starts) - 1)]
    length = np.where(top[-1] >= g[ends], ends - first, 0)
    best = int(length.argmax())
    if length[best] < WINDOW:
        return None
    i, j = int(first[best]), int(ends[best])
    return i, j - i, int(m[j] - m[i])


class ItemIndex:
    """The blocks of all windows of some items, sorted by hash."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [np.array([word_hash(w) for w in ws], np.uint64) for _, ws in items]
        self.runs = {}
        for length in {b - a for a, b in PARTS}:
            rows = []
            for k, h in enumerate(self.words):
                if len(h) >= WINDOW:
                    runs = simhash_runs(h, length)
                    rows.append(np.rec.fromarrays([runs, np.full(len(runs), k, np.int32), np.arange(len(runs), dtype=np.int32)], names="h,k,at"))
            flat = np.concatenate(rows) if rows else np.rec.fromarrays([np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)], names="h,k,at")
            order = np.argsort(flat["h"], kind="stable")
            h = flat["h"][order]
            keys, first = np.unique(h, return_index=True)
            self.runs[length] = (keys, np.append(first, len(h)), flat["k"][order], flat["at"][order])

    def search(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (words, words that differ) of the best passage, among the
        words h of the documents doc, one after another."""
        seen = set()
        out: dict[tuple[int, int], tuple[int, int]] = {}
        bounds = np.flatnonzero(np.diff(doc)) + 1
        begin = {int(doc[i]): int(i) for i in np.append(0, bounds)} if len(doc) else {}
        end = {int(doc[i - 1]): int(i) for i in np.append(bounds, len(doc))} if len(doc) else {}
        for length, (keys, first, item, at) in self.runs.items():
            runs = simhash_runs(h, length)
            if not len(runs) or not len(keys):
                continue
            pos = np.searchsorted(keys, runs)
            pos[pos == len(keys)] = 0
            hit = np.flatnonzero((keys[pos] == runs) & (doc[: len(runs)] == doc[length - 1 :]))
            for t in hit.tolist():
                p = int(pos[t])
                d = int(doc[t])
                for x in range(first[p], first[p + 1]):
                    k, shift = int(item[x]), t - int(at[x])
                    if (d, k, shift) in seen:
                        continue
                    seen.add((d, k, shift))
                    w = self.words[k]
                    lo, hi = max(begin[d], shift), min(end[d], shift + len(w))
                    if hi - lo < WINDOW:
                        continue
                    found = passage(h[lo:hi], w[lo - shift : hi - shift])
                    if found and found[1:] > out.get((d, k), (0, 0)):
                        out[d, k] = found[1:]
        return out


def _items(items: DataFrame, item_id: str, text: str) -> list[tuple[int, list[str]]]:
    """The items' words without instructions: first sentences that several items share."""
    first = F.regexp_extract(text, r"^\s*([^.!?]*[.!?])", 1)
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text"), first.alias("first")).distinct()
    common = rows.where("first <> ''").groupBy("first").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= COMMON).select("first", F.lit(True).alias("common"))
    rows = rows.join(common, "first", "left").select("id", F.when(F.col("common"), F.expr("substring(ltrim(text), length(ltrim(first)) + 1)")).otherwise(F.col("text")).alias("text"))
    return [(r["id"], plain_words(r["text"])) for r in rows.toLocalIterator()]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, n_altered): every document that contains a passage of
    an item of at least 20 words of which at most one in eight is altered or replaced;
    the longest such passage. Items shorter than 20 words without their instruction, and
    null or empty texts, give no rows; repeated rows count once."""
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, n_words int, n_altered int"
    docs = documents.select(doc_id, text).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    blocks: list[list] = [[]]
    size = 0
    for item in _items(items, item_id, text):
        if size + len(item[1]) > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(item)
        size += len(item[1])
    if doc_id == item_id:
        raise ValueError("the columns of document and item ids must differ in name")
    kinds = [documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    id_types = [{"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string()) for k in kinds]

    def searching(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block)
            known: dict[str, int] = {}
            for b in batches:
                ids = b.column(0).to_pylist()
                words, counts = [], []
                for t in b.column(1).to_pylist():
                    ws = plain_words(t)
                    for w in ws:
                        if w not in known:
                            known[w] = word_hash(w)
                    words += [known[w] for w in ws]
                    counts.append(len(ws))
                if len(known) > 500_000:
                    known.clear()
                found = index.search(np.array(words, np.uint64), np.repeat(np.arange(len(ids)), counts))
                rows = [(ids[d], index.ids[k], n, x) for (d, k), (n, x) in found.items()]
                cols = list(zip(*rows)) if rows else [[]] * 4
                names = [doc_id, item_id, "n_words", "n_altered"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*id_types, pa.int32(), pa.int32()])], names=names)

        return run

    parts = [docs.mapInArrow(searching(b), schema) for b in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(doc_id, item_id).agg(F.max(F.struct("n_words", (-F.col("n_altered")).alias("x"))).alias("m")).select(doc_id, item_id, "m.n_words", (-F.col("m.x")).cast("int").alias("n_altered"))
