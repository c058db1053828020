"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of byte counts. A byte costs log2((T+D)/n) in the longest context that
has seen it; a context that hasn't charges its escape, log2((T+D)/D), and passes the byte to the next shorter one; below
order 0 every byte costs 8 bits (T: bytes seen in the context, D: distinct ones, n: those equal to this byte; escape
method C, without exclusion). Statistics are frozen after training. The language of the shortest code wins; the score is
its posterior under equal priors.

Training is bounded: at most ``PER_LANGUAGE`` texts of a language, ``TRAIN_ROWS`` in all, drawn by a hash of doc_id and text;
of a longer one, ``TRAIN_CHARS`` characters from its middle are learned. Prediction reads whole texts and nothing but the text.

Defined cases: a text that is null or has no letter, or a model without languages, gives ``und`` with score 0; ties go to the
first language in alphabetical order; rows without an id are never held out; repeated rows repeat; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, ship_by_value, table
from palimpsest.llm.hashindex import HashIndex

ship_by_value(__name__)

ORDER = 4
PER_LANGUAGE, TRAIN_ROWS, TRAIN_CHARS = 256, 4096, 20_000
SLICE = 1 << 19
UNKNOWN = "und"


class Model:
    """Code lengths of every byte string seen, by order and language; escapes of every context seen."""

    def __init__(self, languages: list[str], order: int):
        self.languages, self.order = languages, order
        self.grams: list[HashIndex] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[HashIndex] = []
        self.escape: list[np.ndarray] = []


def packed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, the byte and the ``order`` bytes before it in one number; and the text it is of.

    Every text starts in the context of line feeds.
    """
    pad = b"\n" * order
    raw = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    real = np.arange(int(sizes.sum())) + (owner + 1) * order
    key = np.zeros(len(real), np.uint64)
    for k in range(order, -1, -1):
        key = (key << np.uint64(8)) | raw[real - k].astype(np.uint64)
    return key, owner


def low_bytes(keys: np.ndarray, count: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * count)) - 1)


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    model = Model(sorted(samples), order)
    full = [packed([t.encode("utf-8", "replace") for t in samples[x]], order)[0] for x in model.languages]
    for k in range(order + 1):
        counted = [np.unique(low_bytes(x, k + 1), return_counts=True) for x in full]
        every = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.uint64)
        contexts = np.unique(every >> np.uint64(8))
        cost = np.zeros((len(every), len(model.languages)), np.float32)
        escape = np.zeros((len(contexts), len(model.languages)), np.float32)
        shorter = np.full((len(every), len(model.languages)), 8.0) if k == 0 else model.cost[k - 1][model.grams[k - 1].find(low_bytes(every, k))].astype(float)
        at = np.searchsorted(contexts, every >> np.uint64(8))
        for x, (grams, n) in enumerate(counted):
            own = np.searchsorted(contexts, grams >> np.uint64(8))
            total = np.bincount(own, n, len(contexts))
            distinct = np.bincount(own, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, x] = np.where(total > 0, np.log2((total + distinct) / distinct), 0)
            cost[:, x] = shorter[:, x] + escape[at, x]
            cost[np.searchsorted(every, grams), x] = np.log2((total + distinct)[own] / n)
        model.grams.append(HashIndex(every))
        model.cost.append(cost)
        model.contexts.append(HashIndex(contexts))
        model.escape.append(escape)
    return model


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language. Memory is bounded by a slice of bytes, however long a text is."""
    out = np.zeros((len(texts), len(model.languages)))
    group: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        keys, owner = packed(group, model.order)
        bits = np.zeros((len(keys), len(model.languages)), np.float32)
        rest = np.arange(len(keys))
        for k in range(model.order, -1, -1):
            row = model.grams[k].find(low_bytes(keys[rest], k + 1))
            hit = row >= 0
            bits[rest[hit]] += model.cost[k][row[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
            row = model.contexts[k].find(low_bytes(keys[rest], k + 1) >> np.uint64(8))
            bits[rest[row >= 0]] += model.escape[k][row[row >= 0]]
        bits[rest] += 8
        for x in range(len(model.languages)):
            np.add.at(out[:, x], owners, np.bincount(owner, bits[:, x], len(group)))

    for i, text in enumerate(texts):
        for start in range(0, len(text), SLICE):  # a later slice of a long text starts in the bytes before it
            piece = text[start : start + SLICE]
            if start:
                lead = text[start - model.order : start]
                key_piece = lead + piece
                out[i] += _continued(model, key_piece)
                continue
            group.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= SLICE:
                flush()
                group, owners, size = [], [], 0
    flush()
    return out


def _continued(model: Model, piece: bytes) -> np.ndarray:
    """Bits of a slice without its first ``order`` bytes, which are only context."""
    whole, lead = code_lengths(model, [piece[: SLICE]])[0], code_lengths(model, [piece[: model.order]])[0]
    if len(piece) > SLICE:
        return whole - lead + _continued(model, piece[SLICE - model.order :])
    return whole - lead


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    known = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) if texts else np.zeros(0, bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
    bits = code_lengths(model, raw)
    best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
    least = bits[np.arange(len(texts)), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    rate = least / np.maximum([len(r) for r in raw], 1)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, rate, 8.0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """Bounded sample of labelled, not held-out texts. Counts per language set a hash threshold, so no group is sorted."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    each = max(1, min(per_language, rows // len(counts)))
    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max(1, min(1 << 20, int((1 << 20) * (1.5 * each + 16) / n))))])
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int") + 1), F.lit(chars))
    drawn = labelled.where(where < F.element_at(limit, F.col("lang"))).select("lang", where.alias("w"), "doc_id", middle.alias("text")).toPandas()
    drawn = drawn.sort_values(["w", "doc_id", "text"]).groupby("lang").head(each)
    return {lang: part["text"].tolist() for lang, part in drawn.groupby("lang")}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; only ``text`` is read for them. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rate = classify(shared.value, batch.column("text").to_pylist())
            cols = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "bits_per_byte"])
        give_back()

    return docs.select(*keep).mapInArrow(run, fields + "lang_pred string, score double, bits_per_byte double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
