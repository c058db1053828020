"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is a lattice of vocabulary pieces. Filtering sums, for every position, the weight of all segmentations up to it;
sampling then walks back from the end, choosing each piece in proportion to the weight that passes through it. Draws are a
hash of (seed, row key, word number, step), so a row gets the same segmentation in any partition, order or run.

No piece of the vocabulary goes on past the end of a word into white space (checked when the vocabulary is loaded), so the
lattice falls apart at word starts into factors, and equal words of a batch share one filtered factor.

The vocabulary holds merge ranks, not probabilities; a piece of rank r weighs (r + 1) ** -theta. A character that is not in
the vocabulary, and a literal U+2581, is spelled in byte pieces, which keeps decoding lossless.

Defined cases: a null text has null pieces; an empty text has none and decodes to itself; repeated rows with one key get one
segmentation; a null key counts as a key of its own; an empty table gives no row; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import give_back, ship_by_value, table
from palimpsest.llm.hashindex import HashIndex

ship_by_value(__name__)

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(" *[^ ]+| +")
UNIT_CHARS = 1_500_000
SEED, THETA = 17, 1.0


class Vocabulary:
    """Pieces as a trie whose transitions are one hash index."""

    def __init__(self, pieces: list[tuple[str, float, bool]], byte_ids: list[int], theta: float = THETA):
        """``pieces``: text, score and whether it may be used, by id; ``byte_ids``: the ids of the 256 byte pieces."""
        self.text = [p for p, _, _ in pieces]
        self.byte_ids = np.array(byte_ids, np.int32)
        self.raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.text]
        for value, i in enumerate(byte_ids):
            self.raw[i] = bytes((value,))
        nodes: dict[str, int] = {"": 0}
        piece, weight = [-1], [0.0]
        keys, child = [], []
        usable = [(p, s, i) for i, (p, s, ok) in enumerate(pieces) if ok]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in usable):
            raise ValueError("a piece spans a word end; the lattice does not factor by words")
        for p, score, i in usable:
            at = 0
            for n, c in enumerate(p, 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(piece)
                    keys.append(at << 21 | ord(c))
                    child.append(len(piece))
                    piece.append(-1)
                    weight.append(0.0)
                at = nodes[p[:n]]
            piece[at] = i
            weight[at] = -theta * float(np.log1p(min(-score, len(pieces)) if score < 0 else 0.0))
        self.steps, self.child = HashIndex(np.array(keys, np.uint64)), np.array(child, np.int32)
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)

    def filtered(self, words: list[str]) -> "Lattice":
        return Lattice(self, words)

    def decode(self, ids) -> str:
        """The text that was encoded."""
        return b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "surrogatepass")[1:]


def load(path: str = MODEL_FILE, theta: float = THETA) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, byte = 1, 6  # fixed values: the types of usable pieces
    spelled = {p.piece: i for i, p in enumerate(model.pieces) if p.type == byte}
    return Vocabulary([(p.piece, p.score, p.type == normal) for p in model.pieces], [spelled[f"<0x{b:02X}>"] for b in range(256)], theta)


class Lattice:
    """Filtered lattice of distinct words. Nodes are the positions after each character; edges are ordered by the node they end at."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        v = self.vocabulary = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        literal = codes == ord(SPACE)
        codes = np.where(codes == ord(" "), np.uint64(ord(SPACE)), np.where(literal, np.uint64(0x110000), codes))
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        n = len(codes)
        left = np.repeat(self.end, sizes) - np.arange(n)  # characters from here to the word's end
        starts, stops, ids, weights = [], [], [], []
        at, state, depth = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), 0
        spelled = np.zeros(n, bool)
        while len(at):
            row = v.steps.find(state.astype(np.uint64) << np.uint64(21) | codes[at + depth])
            hit = row >= 0
            if depth == 0:
                spelled = ~hit
            at, state, depth = at[hit], v.child[row[hit]], depth + 1
            piece = v.piece[state]
            real = piece >= 0
            if depth == 1:  # the beginning of a piece, but no piece by itself
                spelled[at[~real]] = True
            starts.append(at[real])
            stops.append(at[real] + depth)
            ids.append(piece[real])
            weights.append(v.weight[state[real]])
            more = left[at] > depth
            at, state = at[more], state[more]
        byte = np.flatnonzero(spelled).astype(np.int32)
        starts.append(byte)
        stops.append(byte + 1)
        ids.append(np.full(len(byte), -1, np.int32))
        weights.append(np.full(len(byte), -np.log(len(v.text))))
        # Nodes are numbered by level, the distance from the word's begin, so that a level is one range.
        begin = np.repeat(self.begin.astype(np.int32), sizes)
        level = np.arange(n, dtype=np.int32) - begin
        longest = int(sizes.max()) if len(words) else 0
        rank = np.empty(len(words), np.int32)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(words), dtype=np.int32)
        bounds = np.append(0, np.cumsum(len(words) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest])).astype(np.int64)
        node = bounds.astype(np.int32)[level] + np.repeat(rank, sizes) if n else np.zeros(0, np.int32)
        self.node_of_end = node[self.end - 1] if n else node
        ends = [node[x - 1] for x in stops]
        fill = np.zeros(n + 1, np.int64)
        for x in ends:
            fill[x + 1] += 1  # at one node ends at most one edge of each length
        np.cumsum(fill, out=fill)
        head = fill[:-1].copy()
        size = int(fill[-1]) if n else 0
        stop, self.back, weight, self.ids = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size), np.empty(size, np.int32)
        self.first = np.empty(size, bool)
        self.covers: dict[int, str] = {}
        fill = head.copy()
        for x, at, w, i in zip(ends, starts, weights, ids, strict=True):
            place = fill[x]
            fill[x] += 1
            stop[place], weight[place], self.ids[place] = x, w, i
            self.first[place] = at == begin[at]
            self.back[place] = node[at - 1]  # of no use for a word's first character
            if len(i) and i[0] < 0:
                self.covers = {int(k): joined[c] for k, c in zip(place, at, strict=True)}
        alpha = np.empty(n)
        total = np.empty(size)
        edge_at = np.append(head, size)[bounds]
        for k in range(longest):
            i, j = edge_at[k], edge_at[k + 1]
            mass = weight[i:j] + np.where(self.first[i:j], 0.0, alpha[self.back[i:j]])
            alpha[bounds[k] : bounds[k + 1]] = np.logaddexp.reduceat(mass, head[bounds[k] : bounds[k + 1]] - i)
            total[i:j] = mass
        self.cumulated = np.cumsum(np.exp(total - alpha[stop]))
        self.base = np.append(0.0, self.cumulated[:-1])
        self.head, self.tail = head.astype(np.int32), (np.append(head[1:], size) - 1).astype(np.int32)

    def spell(self, edge: int) -> list[int]:
        """Byte pieces of the character that an edge without a piece covers."""
        return self.vocabulary.byte_ids[list(self.covers[int(edge)].encode("utf-8", "surrogatepass"))].tolist()

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence (number of a word, seed): edges of its sampled path in text order, and how many."""
        count = np.zeros(len(words), np.int64)
        who, node = np.arange(len(words)), self.node_of_end[words]
        owners, edges, step = [], [], 0
        while len(who):
            draw = uniform(seeds[who], step)
            low, high = self.head[node], self.tail[node]
            goal = self.base[low] + draw * (self.cumulated[high] - self.base[low])
            edge = low.copy()
            on = np.flatnonzero((self.cumulated[low] <= goal) & (low < high))
            while len(on):  # few edges end at one node
                edge[on] += 1
                on = on[(self.cumulated[edge[on]] <= goal[on]) & (edge[on] < high[on])]
            owners.append(who)
            edges.append(edge)
            count[who] += 1
            more = ~self.first[edge]
            who, node, step = who[more], self.back[edge[more]], step + 1
        out = np.empty(int(count.sum()), np.int64)
        last = np.cumsum(count) - 1
        for k, (o, e) in enumerate(zip(owners, edges, strict=True)):
            out[last[o] - k] = e
        return out, count


def unsorted(values: np.ndarray, count: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, of ``count`` each, that were made in ``order``, put back in place."""
    sizes = np.empty_like(count)
    sizes[order] = count
    ends = np.cumsum(sizes)
    shift = np.repeat((ends - sizes)[order] - (np.cumsum(count) - count), count)
    out = np.empty_like(values)
    out[np.arange(len(values)) + shift] = values
    return out, sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    return (mixed(seeds + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 64))) >> np.uint64(11)) * (1.0 / (1 << 53))


def row_seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)


def slices(text: str, most: int) -> Iterator[str]:
    """Parts of a text with its leading space, cut only where a word begins."""
    text = " " + text
    at = 0
    while len(text) - at > most:
        cut = re.compile("(?<! ) ").search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(vocabulary: Vocabulary, texts: list[str | None], keys: list, seed: int = SEED, unit: int = UNIT_CHARS) -> list[np.ndarray | None]:
    """Sampled piece ids of each text. Works through units of bounded size, however long a text is."""
    seeds = row_seeds(keys, seed)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list[str]]] = []
    size = 0

    def flush() -> None:
        words = [w for _, _, part in waiting for w in part]
        codes, distinct = pd.factorize(np.array(words, object))
        lattice = vocabulary.filtered(distinct.tolist())
        owner = np.repeat([i for i, _, _ in waiting], [len(p) for _, _, p in waiting])
        number = np.concatenate([np.arange(n, n + len(p)) for _, n, p in waiting])
        order = np.argsort(codes, kind="stable")  # neighbours in the lattice are walked together
        edges, count = lattice.sample(codes[order], mixed(seeds[owner] + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))[order])
        edges, count = unsorted(edges, count, order)
        ids = lattice.ids[edges]
        ends = np.cumsum(count)[np.cumsum([len(p) for _, _, p in waiting]) - 1]
        start = 0
        for (i, _, _), end in zip(waiting, ends, strict=True):
            part = ids[start:end]
            odd = np.flatnonzero(part < 0)
            if len(odd):
                flat, at = [], 0
                for o in odd.tolist():
                    flat += [part[at:o], np.array(lattice.spell(edges[start + o]), np.int32)]
                    at = o + 1
                part = np.concatenate([*flat, part[at:]])
            out[i].append(part.astype(np.int32))
            start = end

    for i, text in enumerate(texts):
        if not text:
            continue
        number = 0
        for piece in slices(text, unit):
            part = WORD.findall(piece)
            waiting.append((i, number, part))
            number += len(part)
            size += len(piece)
            if size >= unit:
                flush()
                waiting, size = [], 0
    if waiting:
        flush()
    return [None if t is None else np.concatenate(o) if o else np.zeros(0, np.int32) for t, o in zip(texts, out, strict=True)]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary | None = None, key_col: str = "doc_id", text_col: str = "text", seed: int = SEED, check: bool = False, digest: bool = False) -> DataFrame:
    """(key, pieces, n_pieces), plus whether decoding gave the text back, or a digest instead of the pieces. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load())  # the vocabulary's size is fixed
    kind = docs.schema[key_col].dataType.simpleString()
    fields = f"`{key_col}` {kind}, n_pieces long, " + ("pieces_digest string" if digest else "pieces array<int>") + (", lossless boolean" if check else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            found = encode(v, texts, batch.column(key_col).to_pylist(), seed)
            cols = [batch.column(key_col), pa.array([None if x is None else len(x) for x in found], pa.int64())]
            if digest:
                cols.append(pa.array([None if x is None else xxhash.xxh3_128_hexdigest(x.astype("<i4").tobytes()) for x in found], pa.string()))
            else:
                cols.append(pa.array(found, pa.list_(pa.int32())))
            if check:
                cols.append(pa.array([None if x is None else v.decode(x) == t for x, t in zip(found, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.strip().split(" ")[0].strip("`") for f in fields.split(", ")])
        give_back()

    return docs.select(key_col, text_col).mapInArrow(run, fields)


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary | None = None, pieces_col: str = "pieces") -> DataFrame:
    """``rows`` with the decoded text in column ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary or load())

    @F.pandas_udf("string")
    def text(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: None if p is None else shared.value.decode(p))

    return rows.withColumn("text", text(F.col(pieces_col)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), check=True, digest=True)
