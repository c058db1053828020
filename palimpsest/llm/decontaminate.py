"""Benchmark decontamination by edit distance.

A document is contaminated by a benchmark item if some passage of it is within ``EDIT_SHARE`` of the item's length in edits
(on normalised text: lower case, ASCII punctuation removed, white space as single bytes; lengths and edits in UTF-8 bytes).

1. Windows of an item's size are laid where they can succeed: an item cut into two pieces more than it may have edits keeps
   two of them untouched, so a window needs the first eight bytes of two pieces, not more than the edits out of line. Items
   under 80 bytes are found by the first four bytes of their pieces; one of fewer than 12 bytes needs a single piece.
2. Every such window is verified by its exact edit distance, best over all passages around it.

Documents are never shuffled. Items are broadcast in blocks of at most ``ITEM_BYTES`` of text, one pass a block.

Defined cases: null and empty texts are clean; items of fewer than four normalised bytes, and null ones, take no part;
repeated items give one hit each; an empty table on either side gives no hit; other
columns are kept by ``mark``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, ship_by_value, table
from palimpsest.llm.hashindex import MULTIPLIER, HashIndex

ship_by_value(__name__)

EDIT_SHARE, SEED_BYTES, SHORT_SEED = 0.1, 8, 4
ITEM_BYTES = 32 << 20
SLICE = 1 << 20
SPACES, PUNCTUATION = b"\t\n\v\f\r", string.punctuation.encode()
TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
HITS = "array<struct<item_id:bigint,distance:int>>"


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TO_SPACE, PUNCTUATION)


def most_edits(size: int, share: float = EDIT_SHARE) -> int:
    return int(share * size)


class Seeds:
    """The first bytes of the pieces of some items, and which items and offsets they are of."""

    def __init__(self, size: int, key: list[int], item: list[int], offset: list[int]):
        self.size = size
        distinct, which = np.unique(np.array(key, np.uint64), return_inverse=True) if key else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(which, kind="stable")
        self.item, self.offset = np.array(item, np.int64)[order], np.array(offset, np.int64)[order]
        self.first = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        self.index = HashIndex(distinct)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(distinct * MULTIPLIER) >> np.uint64(42)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, offset) wherever a text holds the beginning of a piece."""
        n = len(data) - self.size + 1
        places, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, n if len(self.item) else 0, SLICE):
            part = _words(data, at, min(SLICE, n - at), self.size)
            near = np.flatnonzero(self.filter[(part * MULTIPLIER) >> np.uint64(42)])
            row = self.index.find(part[near])
            places.append(near[row >= 0] + at)
            entries.append(row[row >= 0])
        place, entry = np.concatenate(places), np.concatenate(entries)
        count = self.first[entry + 1] - self.first[entry]
        pick = np.repeat(self.first[entry], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(place, count), self.item[pick], self.offset[pick]


class Items:
    """Benchmark items with their pieces."""

    def __init__(self, rows: list[tuple[int | None, str | None]], share: float = EDIT_SHARE):
        kept = [(i, normal(t)) for i, t in rows]
        kept = [(i, t) for i, t in kept if len(t) >= SHORT_SEED]
        self.ids, self.text = [i for i, _ in kept], [t for _, t in kept]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([most_edits(len(t), share) for t in self.text], np.int64)
        self.need = np.zeros(len(kept), np.int64)
        found: dict[int, tuple[list, list, list]] = {SEED_BYTES: ([], [], []), SHORT_SEED: ([], [], [])}
        for k, t in enumerate(self.text):
            most = int(self.edits[k])
            seed = SEED_BYTES if len(t) >= SEED_BYTES * (most + 2) else SHORT_SEED
            self.need[k] = 2 if len(t) >= seed * (most + 2) else 1
            count = most + int(self.need[k])
            key, item, offset = found[seed]
            for p in range(count):
                at = p * len(t) // count
                key.append(int.from_bytes(t[at : at + seed], "little"))
                item.append(k)
                offset.append(at)
        self.seeds = [Seeds(size, *lists) for size, lists in found.items() if lists[0]]

    def windows(self, data: np.ndarray, owner_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first start, last start) of the windows that hold two pieces in line. Documents lie in ``data`` one after another."""
        every = [s.places(data) for s in self.seeds]
        place, item, offset = (np.concatenate(c) for c in zip(*every, strict=True)) if every else (np.zeros(0, np.int64),) * 3
        doc = np.searchsorted(owner_starts, place, "right") - 1
        line = place - offset
        order = np.lexsort((offset, line, item, doc))
        doc, item, line, offset = doc[order], item[order], line[order], offset[order]
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (line[1:] - line[:-1] <= self.edits[item[1:]])
        group = np.append(0, np.cumsum(~same)) if len(doc) else np.zeros(0, np.int64)
        if not len(doc):
            return doc, item, line, line
        head = np.flatnonzero(np.append(True, ~same))
        tail = np.append(head[1:], len(doc)) - 1
        pieces = np.unique(np.stack([group, offset]), axis=1)[0]
        several = np.bincount(pieces, minlength=len(head))
        enough = several >= self.need[item[head]]
        head, tail = head[enough], tail[enough]
        return doc[head], item[head], line[head], line[tail]

    def hits(self, texts: list[str | None]) -> list[list[tuple[int | None, int]]]:
        """(item id, distance) of the items that each text holds."""
        out: list[dict[int, int]] = [{} for _ in texts]
        at = 0
        while at < len(texts) and self.text:
            group, size = [], 0
            while at + len(group) < len(texts) and size < SLICE:
                group.append(normal(texts[at + len(group)]))
                size += len(group[-1])
            gap = b"\0" * SEED_BYTES
            raw = gap.join(group) + gap
            starts = np.cumsum([0] + [len(g) + SEED_BYTES for g in group[:-1]])
            data = np.frombuffer(raw, np.uint8)
            for d, i, first, last in zip(*(x.tolist() for x in self.windows(data, starts)), strict=True):
                most = int(self.edits[i])  # a piece is out of line with its passage by that at most, and so is the passage's end
                low = max(first - 2 * most, int(starts[d]))
                high = min(last + int(self.size[i]) + 2 * most, int(starts[d]) + len(group[d]))
                distance = least_distance(self.text[i], raw[low:high])
                if distance <= most:
                    out[at + d][i] = min(distance, out[at + d].get(i, distance))
            at += len(group)
        return [sorted(((self.ids[i], x) for i, x in found.items()), key=lambda h: (h[0] is not None, h[0] or 0, h[1])) for found in out]


def _words(data: np.ndarray, at: int, count: int, size: int) -> np.ndarray:
    """The ``size`` bytes that start at each of ``count`` places, as one number each."""
    kind = "<u8" if size == 8 else "<u4"
    return np.lib.stride_tricks.as_strided(data[at : at + size].view(kind), (count,), (1,)).astype(np.uint64, copy=False)


def least_distance(pattern: bytes, text: bytes) -> int:
    """Least edit distance between the pattern and any passage of the text, by bit-parallel columns."""
    if pattern in text:
        return 0
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
        best = min(best, score)
    return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """The items in blocks of bounded size, each read by its own job."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // most_bytes) * (1 if total <= most_bytes else 2))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(count)) == k)
        yield Items([(r["id"], r["text"]) for r in part.collect()])


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with ``hits``, the items that contaminate each row (a column of that name gives way). No shuffle."""
    docs = docs.drop("hits")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", hits {HITS}"
    names = [*docs.columns, "hits"]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    out = docs
    for n, items in enumerate(item_blocks(benchmark, item_id_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by ITEM_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.hits(batch.column(text_col).to_pylist())
                if n:
                    found = [[(h["item_id"], h["distance"]) for h in old] + new for old, new in zip(batch.column("hits").to_pylist(), found, strict=True)]
                rows = pa.array([[{"item_id": i, "distance": x} for i, x in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-1]] + [rows], names=names)
            give_back()

        out = out.mapInArrow(run, fields)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    marked = mark(docs, benchmark)
    return marked.where(F.size("hits") == 0).select(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance")
