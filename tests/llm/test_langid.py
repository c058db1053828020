import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import langid as P

TEXTS = {"de": ["der die das und ist nicht", "ich und du"], "en": ["the and of to in is", "that was with for"], "fr": ["é le la les et est", "de un"]}


def brute_bits(texts, text, order):
    """Code length by definition, byte by byte."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        raw = b"\n" * order + t.encode()
        for at in range(order, len(raw)):
            for k in range(order + 1):
                counts[k][raw[at - k : at + 1]] += 1
    raw, bits = b"\n" * order + text, 0.0
    for at in range(order, len(raw)):
        for k in range(order, -1, -1):
            ctx = raw[at - k : at]
            here = {g: n for g, n in counts[k].items() if g[:k] == ctx}
            if not here:
                continue
            total, distinct = sum(here.values()), len(here)
            n = here.get(raw[at - k : at + 1])
            if n:
                bits += math.log2((total + distinct) / n)
                break
            bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    model = P.train(TEXTS, order=3)
    for text in (b"the und est", "é\xff".encode(), b"", b"zzz"):
        got = P.code_lengths(model, [text])[0]
        assert np.allclose(got, [brute_bits(TEXTS[x], text, 3) for x in model.languages], rtol=1e-5)


def test_long_texts_are_whole(monkeypatch):
    model = P.train(TEXTS)
    text = "the and der ist et les ".encode() * 40
    whole = P.code_lengths(model, [text])
    monkeypatch.setattr(P, "SLICE", 64)
    assert np.allclose(whole, P.code_lengths(model, [text]), rtol=1e-6)


def test_defined_cases(spark):
    model = P.train(TEXTS)
    langs, score, _ = P.classify(model, [None, "", "123 !?", "the and of the", "²½"])
    assert langs == ["und", "und", "und", "en", "und"] and score[0] == 0 and 0 < score[3] <= 1
    assert P.classify(P.train({}), ["x"])[0] == ["und"] and P.classify(model, [])[0] == []
    df = spark.createDataFrame([(1, "the", None), (None, None, "x")], "doc_id long, text string, score string")
    out = P.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "bits_per_byte"] and out.count() == 2
    assert P.training_sample(df.selectExpr("doc_id", "text", "score as lang").limit(0)) == {}


def test_sample_is_bounded_and_not_held_out(spark):
    df = spark.createDataFrame([(i, f"text {i}", "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, lang string")
    sample = P.training_sample(df, per_language=20)
    assert all(0 < len(x) <= 20 for x in sample.values())
    assert all(zlib.crc32(t.split()[1].encode()) % 4 != 2 for x in sample.values() for t in x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = P.predict(docs.where(P.held_out()), P.train(P.training_sample(docs))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, ("ab " if i % 2 else "zq ") * 20_000, "aa" if i % 2 else "zz") for i in range(12)]
    sample = P.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(sample) == {"aa", "zz"} and all(len(t) == P.TRAIN_CHARS for ts in sample.values() for t in ts)
