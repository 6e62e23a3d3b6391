"""Evaluation passages in training documents: exact pieces by the pigeonhole principle, verified by bit-parallel edit distance over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_word = re.compile(r"[^\W_]+")
#: So many words of items go to the tasks at once; more items are taken in blocks, each with a pass of its own.
BLOCK_WORDS = 2_000_000


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _word.findall(text.lower())


def closest(pattern: list, text: list) -> int:
    """Least edit distance between the pattern and any stretch of the text, whole words inserted, removed or replaced (Myers' bit vectors, one integer of len(pattern) bits)."""
    m = len(pattern)
    where: dict = {}
    for k, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


class Items:
    """Windows of the items and the exact pieces by which they are found."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors, self.piece = window, errors, window // (errors + 1)
        if self.piece < 1:
            raise ValueError("more errors than words in a window")
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.pieces: dict[tuple, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            if len(w) >= window:
                for p in range(len(w) - self.piece + 1):
                    self.pieces.setdefault(tuple(w[p : p + self.piece]), []).append((k, p))
        self.known = frozenset(x for piece in self.pieces for x in piece)
        self.run = b"\x01" * self.piece

    def found(self, text: str) -> dict[int, int]:
        """Items (their ids) of which a window of words is in the text with at most ``errors`` words edited, with the least number of edits."""
        w = words(text)
        if len(w) < self.piece:
            return {}
        known = bytes(map(self.known.__contains__, w))
        out: dict[int, int] = {}
        at = known.find(self.run)
        while at >= 0:
            for k, p in self.pieces.get(tuple(w[at : at + self.piece]), ()):
                i = self.ids[k]
                if out.get(i) != 0:
                    d = self._verified(k, p, w, at)
                    if d <= self.errors and d < out.get(i, d + 1):
                        out[i] = d
            at = known.find(self.run, at + 1)
        return out

    def _verified(self, k: int, p: int, w: list[str], at: int) -> int:
        """The least distance of a window that has the piece as one of its errors + 1 parts to the text around the hit."""
        item, size, e = self.words[k], self.window, self.errors
        best = e + 1
        for part in range(e + 1):
            start = p - part * self.piece
            if 0 <= start <= len(item) - size:
                lo = max(0, at - part * self.piece - e)
                best = min(best, closest(item[start : start + size], w[lo : max(0, at - part * self.piece + size + e)]))
                if not best:
                    break
        return best


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most block_words words; one block is held at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in items.orderBy("i", "t").toLocalIterator(prefetchPartitions=False):
        n = len(words(t))
        if block and size + n > block_words and i != block[-1][0]:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    yield block


def leaked(docs: DataFrame, items: DataFrame, window: int = 12, errors: int = 1, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, edits): documents that share a window of ``window`` consecutive words with an item, up to ``errors`` words inserted, removed or replaced; ``edits`` is the least number.

    Case and whatever stands between words don't matter. Each window is cut into errors + 1 pieces, one of which must stand in the document as it is; every such
    hit is verified. Null or empty texts and null ids share nothing; an item or text shorter than the window neither (a text shorter by up to ``errors`` words may); repeated document rows give repeated rows, and
    items of one id are searched together within a block. Whole texts are read, in one narrow stage without a shuffle. Items are the stated query set: they travel as broadcast blocks of at most
    ``block_words`` words (or one item), with a pass over the documents for each block; the driver holds one block at a time.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    kept = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    out = None
    for block in _blocks(kept, block_words):
        part = src.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), window, errors), "doc_id bigint, item_id bigint, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def _search(block, window: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value, window, errors)
        for b in batches:
            rows = [(i, k, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, e in sorted(items.found(t).items())]
            if rows:
                i, k, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(e, pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def edited(items: DataFrame, window: int, errors: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, text): for each item with a window of words, texts that hold its middle window with 0 to ``errors`` + 2 words replaced, inserted or removed in turn, evenly spread, between words of
    no item. For measuring the recall: those with up to ``errors`` edits have to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                if len(w) < window:
                    continue
                a = (len(w) - window) // 2
                for e in range(errors + 3):
                    new = w[a : a + window]
                    for k in range(e):
                        at = min(len(new) - 2, 1 + (2 * k + 1) * window // (2 * e))
                        new[at : at + (k % 3 != 1)] = [] if k % 3 == 2 else [f"edit{i}x{k}"]
                    rows.append((i * 100 + e, i, e, " ".join([f"before{i}", *new, f"after{i}"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "item_id", "edits", "text"])

    return items.select(F.col(item_id).cast("bigint"), text).dropna().mapInArrow(run, "doc_id bigint, item_id bigint, edits int, text string")


def recall(items: DataFrame, window: int, errors: int) -> DataFrame:
    """(edits, planted, found) over ``edited`` texts."""
    texts = edited(items, window, errors)
    hits = leaked(texts, items, window, errors).select("doc_id", "item_id", F.lit(1).alias("hit"))
    return texts.join(hits, ["doc_id", "item_id"], "left").groupBy("edits").agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("found"))
