"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text, and the text is cut where the hash is least among the ``REACH`` places on
either side. So equal passages are cut alike wherever they stand, an insertion moves no later cut, and chunk sizes vary
less than with a bit mask, which keeps more of a short passage inside whole chunks. Without a cut for ``MAX_CHUNK`` bytes
one is made. Chunks are addressed by digest. The first holder of a digest, by
(doc_id, position), keeps it; every other occurrence is a repeat. Repeats that follow one another are joined into spans, and
spans of at least ``min_bytes`` are reported.

Defined cases: null and empty texts, and rows without a doc_id, have no chunk; rows that repeat a (doc_id, text) hold the same
occurrences, so only the other documents' copies are repeats; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, persist, ship_by_value, table

ship_by_value(__name__)

REACH, MAX_CHUNK, MIN_BYTES = 16, 192, 120
SLICE = 1 << 22
CHUNK = "doc_id long, n int, start int, size int, digest long, again boolean"


def gear_table(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-j]] << j over the last 16 bytes, in 16 bits: each step doubles the window."""
    h = gear[data]
    for width in (1, 2, 4, 8):
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width)
        h = more
    return h


def least_before(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values that end at each place."""
    have, out = 1, h
    while have < width:
        step = min(have, width - have)
        more = out.copy()
        np.minimum(more[step:], out[:-step], out=more[step:])
        have, out = have + step, more
    return out


def cuts(data: np.ndarray, gear: np.ndarray, reach: int = REACH, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of one text. Slices overlap by what the hash and the comparison reach, so they cut as the whole does."""
    marks = []
    size = len(data)
    for at in range(0, size, SLICE):
        low, high = max(0, at - 16 - reach), min(size, at + SLICE + reach)
        h = gear_hashes(data[low:high], gear)
        before = least_before(h, reach + 1)
        after = least_before(h[::-1], reach + 1)[::-1]
        best = h == np.minimum(before, after)
        best[1:] &= h[1:] < least_before(h, reach)[:-1]  # of equal ones the first
        mark = np.flatnonzero(best) + low + 1
        marks.append(mark[(mark > at) & (mark <= at + SLICE)])
    mark = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    edges = np.concatenate([[0], mark[mark < size], [size]])
    gaps = np.diff(edges)
    extra = (gaps - 1) // max_chunk
    if extra.any():
        which = np.repeat(np.arange(len(gaps)), extra)
        step = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        edges = np.sort(np.concatenate([edges, edges[which] + step * max_chunk]))
    return edges[1:]


def chunks_of(text: str, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and digests of a text's chunks, in bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = cuts(np.frombuffer(raw, np.uint8), gear)
    starts = np.append(0, ends[:-1])
    digest = xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    return starts, ends - starts, found.view(np.int64)


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk; no shuffle."""
    gear = gear_table()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("digest", pa.int64()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, count = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start, size, digest = chunks_of(text, gear)
                again = np.ones(len(start), bool)
                again[np.unique(digest, return_index=True)[1]] = False
                parts.append((np.full(len(start), doc), np.arange(len(start), dtype=np.int32), start.astype(np.int32), size.astype(np.int32), digest, again))
                count += len(start)
                if count >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)
                    parts, count = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)
        give_back()

    usable = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    return usable.mapInArrow(run, CHUNK)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Spans that repeat an earlier document or place: doc_id, start, end, n_bytes, n_chunks, first_doc_id (bytes, end exclusive).

    The chunk table is stored once. Holders are found by an aggregation that sums up before it shuffles; only digests with
    a repeat are joined back, and a digest that a third of all chunks share is split by the adaptive join.
    """
    chunks = persist(chunk_rows(docs, id_col, text_col), "cdc-chunks")
    held = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.max("again").alias("any_again"))
    shared = held.where((F.col("first_doc_id") != F.col("last")) | F.col("any_again")).select("digest", "first_doc_id")
    again = chunks.join(shared, "digest").where((F.col("doc_id") != F.col("first_doc_id")) | F.col("again"))
    again = again.groupBy("doc_id", "n").agg(F.min("start").alias("start"), F.min("size").alias("size"), F.min("first_doc_id").alias("first_doc_id"))  # one row for repeated rows
    order = Window.partitionBy("doc_id").orderBy("n")
    runs = again.withColumn("run", F.col("n") - F.row_number().over(order))
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.withColumn("n_bytes", (F.col("end") - F.col("start")).cast("long")).where(F.col("n_bytes") >= min_bytes).select("doc_id", "start", "end", "n_bytes", "n_chunks", "first_doc_id")


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts lack the given spans; all columns stay."""
    found = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    rows = docs.join(found.withColumnRenamed("doc_id", "_doc"), F.col(id_col) == F.col("_doc"), "left").drop("_doc")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for x in s:
                parts.append(raw[at : x["start"]])
                at = x["end"]
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return rows.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_spans")))).drop("_spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
