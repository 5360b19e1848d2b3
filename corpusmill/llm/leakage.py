"""Evaluation texts leaking into training text: hashed n-grams of the test items against all token windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K

#: n-grams of test items in one broadcast block (16 MB of hashes, about 40 MB with their places and words); more items
#: take more blocks over all rows.
BLOCK_GRAMS = 2_000_000
_FILTER_BITS = 23
_U = np.uint64


class _Block:
    """Test n-grams: sorted hashes, where each occurs, a bit filter, and the items' words for verification."""

    def __init__(self, width: int):
        self.width, self.ids, self.words, self.begins = width, [], [], []

    def add(self, item_id: str, w: list[str]) -> int:
        self.ids.append(item_id)
        self.words.append(" ".join(w))
        # where each word begins, and where another one would
        self.begins.append(np.cumsum([0, *(len(x) + 1 for x in w)], dtype=np.int32))
        return len(w) - self.width + 1

    def has(self, item: int, place: int, window: str) -> bool:
        at = self.begins[item]
        return self.words[item][at[place] : at[place + self.width] - 1] == window

    def close(self) -> "_Block":
        cache = K.WordHashes()
        flat = np.array([cache[x] for w in self.words for x in w.split(" ")], np.uint64)
        h, item, place = K.ngrams(flat, np.array([len(b) - 1 for b in self.begins]), self.width)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order].astype(np.int32), place[order].astype(np.int32)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(h >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits)
        return self


def _blocks(items: DataFrame, item_id: str, text: str, width: int):
    block, size = _Block(width), 0
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    for r in rows.toLocalIterator():
        w = K.words(r.text)
        if len(w) >= width:
            size += block.add(r.id, w)
        if size >= BLOCK_GRAMS:
            yield block.close()
            block, size = _Block(width), 0
    if size:
        yield block.close()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "item_text", width: int = 12) -> DataFrame:
    """(doc_id, item_id, first_word, words): documents that share at least `width` consecutive words with an item.

    `words` counts the document's words that stand in shared windows and `first_word` is the first of them
    (from 0). Each hit of the hashes is compared word by word. Items are taken in blocks of BLOCK_GRAMS
    windows, each broadcast once and run over all documents. NULL texts, texts and items of fewer words
    than `width` give no row; repeated rows give one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, first_word int, words int"
    out = None
    for block in _blocks(items, item_id, item_text, width):
        part = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), width), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("words").alias("words"))


def _hits(texts, cache, block: _Block, width: int):
    """Verified hits of a slice: (text number, item number, place in the text)."""
    flat, n = K.word_hashes(texts, cache)
    h, doc, place = K.ngrams(flat, n, width)
    bits = np.unpackbits(block.bits).view(bool) if not hasattr(block, "open") else block.open
    block.open = bits
    maybe = np.flatnonzero(bits[(h >> _U(64 - _FILTER_BITS)).astype(np.int64)])
    h, doc, place = h[maybe], doc[maybe], place[maybe]
    lo, hi = np.searchsorted(block.hash, h, "left"), np.searchsorted(block.hash, h, "right")
    known: tuple[int, list[str]] = (-1, [])
    for i in np.flatnonzero(hi > lo):
        if known[0] != doc[i]:
            known = (int(doc[i]), K.words(texts[doc[i]]))
        window = " ".join(known[1][place[i] : place[i] + width])
        for j in range(lo[i], hi[i]):
            if block.has(block.item[j], block.place[j], window):
                yield int(doc[i]), int(block.item[j]), int(place[i])


def _scan(shared, width: int):
    def run(batches):
        cache, block = K.WordHashes(), shared.value
        for b in batches:
            for at in range(0, b.num_rows, K.SLICE):
                s = b.slice(at, K.SLICE)
                found: dict[tuple[int, int], list[int]] = {}
                for d, i, p in _hits(s.column(1).to_pylist(), cache, block, width):
                    found.setdefault((d, i), []).append(p)
                if found:
                    keys = list(found)
                    covered = [_covered(sorted(set(found[k])), width) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [s.column(0).take(pa.array([k[0] for k in keys])), pa.array([block.ids[k[1]] for k in keys]), pa.array([min(found[k]) for k in keys], pa.int32()), pa.array(covered, pa.int32())],
                        ["doc_id", "item_id", "first_word", "words"],
                    )

    return run


def _covered(places: list[int], width: int) -> int:
    end = total = 0
    for p in places:
        total += p + width - max(p, end)
        end = p + width
    return total


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "item_text", width: int = 12) -> DataFrame:
    """(doc_id, text, removed_words): the documents without the spans they share with test items.

    Documents that share nothing come out unchanged with removed_words 0; a NULL text stays NULL. The spans of all
    blocks are found in the text as it is and cut once, so the result doesn't depend on how items fall into blocks.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.array().cast("array<int>").alias("places"))

    def find(shared):
        def run(batches):
            cache, block = K.WordHashes(), shared.value
            for b in batches:
                for at in range(0, b.num_rows, K.SLICE):
                    s = b.slice(at, K.SLICE)
                    texts, places = s.column(1).to_pylist(), s.column(2).to_pylist()
                    for d, _, p in _hits(texts, cache, block, width):
                        places[d].append(p)
                    yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([sorted(set(p)) for p in places], pa.list_(pa.int32()))], ["doc_id", "text", "places"])

        return run

    def cut(batches):
        for b in batches:
            texts, removed = b.column(1).to_pylist(), []
            for d, places in enumerate(b.column(2).to_pylist()):
                gone = {i for p in places for i in range(p, p + width)}
                removed.append(len(gone))
                if gone:
                    texts[d] = _cut(texts[d], gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed_words"])

    for block in _blocks(items, item_id, item_text, width):
        rows = rows.mapInArrow(find(docs.sparkSession.sparkContext.broadcast(block)), rows.schema)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, text string, removed_words int")


def _cut(text: str, gone: set[int]) -> str:
    """The text without the words of the given numbers; what stands between two of them goes too."""
    lower = text.lower()
    if len(lower) != len(text):  # places would shift: lower case the text with it
        text = lower
    keep, last, previous = [], 0, -2
    for i, m in enumerate(K.WORD.finditer(lower)):
        if i in gone:
            if i - 1 != previous:
                keep.append(text[last : m.start()])
            last, previous = m.end(), i
    return "".join([*keep, text[last:]])
