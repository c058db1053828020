"""N-gram Jaccard join with Bayesian pruning.

Texts become sets of five-word shingles; a pair is a link if the Jaccard similarity of its sets is at least 0.8.

1. Texts with equal sets form one entry, numbered by a hash of the set, held by their first row and weighted by their number.
2. Bands of MinHash values gather entries that may be linked; each entry is tied to the least entry of its bucket, and
   connected components of these ties hold every candidate pair.
3. Inside a component, all pairs are compared hash by hash: after each step, the posterior of the similarity (Beta, uniform
   prior) drops a pair once it makes reaching the threshold less likely than ``TOLERANCE``. The rest is verified exactly.

A component of more than ``BLOCK`` entries is dealt out as pairs of blocks, so no task holds more than two blocks. Pairs
never leave a task: it returns, for each entry, its number of links and the least entry it is connected to.

Words are runs of letters, digits and underscores in lower case. Defined cases: a text of one to four words is one shingle;
a null text or one without words has no link and is a class of its own; rows are told apart by (doc_id, hash of the text), so
repeated ids may hold different texts; a row without a doc_id is joined like any other, and its class has the least id there
is, or none; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, persist, ship_by_value, table
from palimpsest.llm.components import connected_components

ship_by_value(__name__)

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS, STEP = 24, 6, 16
BLOCK = 512
TOKEN = re.compile(r"\w+")
SKETCH = "doc_id long, copy long, set_id binary, bands array<long>"
RESULT = "rep long, root long, links long"


def hash_family(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32), rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    tokens = [TOKEN.findall((t or "").lower()) for t in texts]
    flat = [w for t in tokens for w in t]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(flat, object))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))[codes]
    factor = np.uint64(0x9E3779B97F4A7C15)
    out, at = [], 0
    for t in tokens:
        w = hashed[at : at + len(t)]
        at += len(t)
        if not len(w):
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(words, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = h * factor + w[k : len(w) - size + 1 + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(np.unique(h ^ (h >> np.uint64(29))))
    return out


def minhashes(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low = (items >> np.uint64(32)).astype(np.uint32)
    flip, factor = family
    out = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, ((low[None, at : at + 2048] ^ flip[:, None]) * factor[:, None]).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    family = hash_family(bands * rows)
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, keys = [], []
                for items in shingle_sets(batch.column("text").to_pylist(), words):
                    if not len(items):
                        ids.append(None)
                        keys.append(None)
                        continue
                    ids.append(xxhash.xxh3_128_digest(items.tobytes()))
                    hashes = minhashes(items, family).reshape(bands, rows)
                    keys.append(np.array([xxhash.xxh3_64_intdigest(hashes[b].tobytes(), b) for b in range(bands)], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
        give_back()

    return keyed(docs, id_col, text_col).mapInArrow(run, SKETCH)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))


def least_matches(threshold: float, tolerance: float, counts: list[int]) -> list[int]:
    """For each number of compared hashes, the fewest equal ones that keep P(similarity >= threshold) at ``tolerance`` or more."""
    out = []
    for n in counts:
        tail = 0.0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
        else:
            out.append(n)
    return out


def surviving_pairs(sigs: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j in ``left``, or i in ``left`` and j in ``right``) that the incremental comparison doesn't drop."""
    total = sigs.shape[1]
    counts = list(range(step, total + 1, step))
    least = least_matches(threshold, tolerance, counts)
    found_i, found_j = [], []
    columns = left if right is None else right
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        small = np.minimum(sizes[some][:, None], sizes[columns][None, :])
        large = np.maximum(sizes[some][:, None], sizes[columns][None, :])
        alive = small >= threshold * large
        if right is None:
            alive &= np.arange(len(columns))[None, :] > (at + np.arange(len(some)))[:, None]
        i, j = np.nonzero(alive)
        i, j = some[i], columns[j]
        same = np.zeros(len(i), np.int32)
        for k, low in zip(counts, least, strict=True):
            if not len(i):
                break
            same += (sigs[i, k - step : k] == sigs[j, k - step : k]).sum(axis=1)
            keep = same >= low
            i, j, same = i[keep], j[keep], same[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs: one by one, or, where pairs are dense, by products of indicator blocks."""
    who = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(who):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    sizes = np.array([len(sets[w]) for w in who])
    values, column, times = np.unique(np.concatenate([sets[w] for w in who]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(who)), sizes)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    both = np.zeros((len(who), len(who)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, int((times > 1).sum()) + width, width))
    for k in range(len(bounds) - 1):
        part = np.zeros((len(who), width), np.float32)
        part[row[bounds[k] : bounds[k + 1]], column[bounds[k] : bounds[k + 1]] - k * width] = 1
        both += part @ part.T
    place = np.searchsorted(who, i), np.searchsorted(who, j)
    return np.rint(both[place]).astype(np.int64)


def join_group(weights: np.ndarray, second: np.ndarray, sets: list[np.ndarray], cross: bool, family, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one group: the least entry each entry is connected to, and its number of links."""
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([minhashes(s, family) for s in sets])
    every = np.arange(len(sets))
    left, right = (every[~second], every[second]) if cross else (every, None)
    links = np.zeros(len(sets), np.int64)
    root = every.copy()
    if len(left) and (right is None or len(right)):
        i, j = surviving_pairs(sigs, sizes, left, right, threshold, tolerance)
        if len(i):
            common = intersections(sets, i, j)
            good = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
            i, j = i[good], j[good]
            np.add.at(links, i, weights[j])
            np.add.at(links, j, weights[i])
            while True:  # the least reachable number, by halving paths
                before = root.copy()
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (root == before).all():
                    break
    return root, links


def _grouped(words: int, threshold: float, tolerance: float, hashes: int):
    family = hash_family(hashes, seed=23)
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def close(rows: list[tuple]) -> pa.RecordBatch | None:
        sets, seen = {}, {}
        for row, items in zip(rows, shingle_sets([r[7] for r in rows], words), strict=True):
            if xxhash.xxh3_128_digest(items.tobytes()) == row[6]:  # an id may come with other texts, or again
                sets[row[3]], seen[row[3]] = items, row
        order = sorted(sets)  # the least number is then the least entry
        reps = np.array(order, np.int64)
        weights, second = np.array([seen[r][4] for r in order], np.int64), np.array([seen[r][5] for r in order], bool)
        root, links = join_group(weights, second, [sets[r] for r in order], rows[0][1] != rows[0][2], family, threshold, tolerance)
        hit = links > 0
        if not hit.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(reps[root[hit]]), pa.array(links[hit])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("component", "bi", "bj", "rep", "weight", "second", "set_id", "text")), strict=True):
                if waiting and waiting[0][:3] != row[:3]:
                    done = close(waiting)
                    waiting = []
                    if done is not None:
                        yield done
                waiting.append(row)
        if waiting:
            done = close(waiting)
            if done is not None:
                yield done
        give_back()

    return run


def join_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy (a hash of the text), class_id (the least doc_id it is connected to), n_links
    (rows at ``threshold`` or more), and the first place of the class, (first_id, first_copy)."""
    sketch = persist(sketches(docs, id_col, text_col, words), "ngram-sketch")
    place = F.struct("doc_id", "copy")
    groups = sketch.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(place).alias("p"), F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    entries = persist(groups.select("set_id", F.xxhash64("set_id").alias("rep"), F.col("p.doc_id").alias("doc"), F.col("p.copy").alias("c"), "least", "weight"), "ngram-entries")
    at_place = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("copy") == F.col("c"))
    held = entries.select(F.col("set_id").alias("s"), "rep", "doc", "c").hint("shuffle_hash")
    keys = sketch.join(held, at_place & (F.col("set_id") == F.col("s"))).select("rep", F.explode("bands").alias("key"))
    bucket = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi")).select("key", "lo")
    ties = keys.join(bucket, "key").where(F.col("rep") != F.col("lo")).select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    member = persist(connected_components(ties), "ngram-members")
    size = member.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = member.join(size, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(entries, F.col("node") == F.col("rep")).select("component", "blocks", "own", "rep", "set_id", "weight", "doc", "c")
    rows = keyed(docs, id_col, text_col).join(placed.hint("shuffle_hash"), at_place)
    rows = rows.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "rep", "weight", "set_id", "text")
    rows = rows.select("component", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "rep", "weight", (F.col("own") > F.col("other")).alias("second"), "set_id", "text")
    dealt = rows.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    found = persist(dealt.mapInArrow(_grouped(words, threshold, tolerance, 144), RESULT), "ngram-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_rep = entries.join(links, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_rep = persist(by_rep.select("set_id", "component", "doc", "c", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "ngram-classes")
    first = by_rep.groupBy("component").agg(F.min(F.struct("doc", "c")).alias("f"), F.min("least").alias("class_id"))
    by_set = by_rep.join(first, "component").select(F.col("set_id").alias("s"), "class_id", "n_links", F.col("f.doc").alias("first_id"), F.col("f.c").alias("first_copy"))
    out = sketch.select("doc_id", "copy", "set_id").join(by_set, F.col("set_id") == F.col("s"), "left")
    alone = F.col("s").isNull()
    own = lambda c, other: F.when(alone, F.col(other)).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "copy", own("class_id", "doc_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("first_id", "doc_id"), own("first_copy", "copy"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links."""
    return join_rows(docs, id_col, text_col, words, threshold, tolerance, block).select("doc_id", "class_id", "n_links")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
