import itertools
import os

import numpy as np
import pytest

from palimpsest.llm import pieces as P

TOY = [("<unk>", 0.0, False), ("▁", -30.0, True), ("a", -20.0, True), ("b", -21.0, True), ("ab", -3.0, True), ("▁a", -4.0, True), ("aa", -6.0, True), ("▁ab", -9.0, True)]
TOY += [(f"<0x{b:02X}>", 0.0, False) for b in range(256)]


@pytest.fixture(scope="module")
def toy():
    return P.Vocabulary(TOY, list(range(len(TOY) - 256, len(TOY))))


def paths(word, toy):
    """Every segmentation of a word with its weight."""
    weight = {p: (1 + min(-s, len(TOY))) ** -1.0 for p, s, ok in TOY if ok}
    out = {}
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[at:k])
                at = k
        if all(p in weight for p in parts):
            out[tuple(parts)] = float(np.prod([weight[p] for p in parts]))
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_lattice(toy):
    n = 20_000
    got = P.encode(toy, ["aab"] * n, list(range(n)))
    seen = {}
    for ids in got:
        key = tuple(toy.text[i] for i in ids)
        seen[key] = seen.get(key, 0) + 1
    want = paths("▁aab", toy)
    assert set(seen) <= set(want)
    for key, p in want.items():
        assert abs(seen.get(key, 0) / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3


@pytest.mark.parametrize("text", ["", "a", " ", "   ", "ab  aab ", "x▁y", "é🙂\n\t\0", "a" * 3000, "ß"])
def test_lossless_with_a_toy_vocabulary(toy, text):
    (ids,) = P.encode(toy, [text], [1])
    assert toy.decode(ids) == text


def test_same_whatever_the_batch(toy):
    texts = ["ab aab b", "aaaa", None, "", "b  b ab " * 50]
    one = P.encode(toy, texts, [1, 2, 3, 4, 5])
    for unit in (1, 7, 100):
        for a, b in zip(one, P.encode(toy, texts, [1, 2, 3, 4, 5], unit=unit)):
            assert (a is None and b is None) or np.array_equal(a, b)
    assert np.array_equal(P.encode(toy, [texts[4]], [5])[0], one[4])
    assert not np.array_equal(P.encode(toy, [texts[4]], [6])[0], one[4])


def test_a_piece_across_words_is_refused():
    with pytest.raises(ValueError, match="word end"):
        P.Vocabulary([*TOY[:3], ("a▁b", -1.0, True), *TOY[3:]], list(range(len(TOY) - 255, len(TOY) + 1)))


@pytest.mark.skipif(not os.path.exists(P.MODEL_FILE), reason="no vocabulary file")
def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello wörld\nagain"), (2, None), (None, ""), (1, "Hello wörld\nagain")], "doc_id long, text string").selectExpr("*", "1 as pieces")
    out = P.encode_texts(df, check=True)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_pieces", "pieces", "lossless"] and len(rows) == 4
    assert [r.pieces for r in rows if r.doc_id == 2] == [None] and all(r.lossless for r in rows if r.pieces is not None)
    first, second = (r.pieces for r in rows if r.doc_id == 1)
    assert first == second
    back = {r.doc_id: r.text for r in P.decode_pieces(out).collect()}
    assert back == {1: "Hello wörld\nagain", 2: None, None: ""}
    assert P.encode_texts(df.limit(0)).count() == 0
