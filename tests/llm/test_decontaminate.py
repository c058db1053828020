import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate as D

LETTERS = "abcdefghijklmnopqrstuvwxyz "


def edited(text, count, r):
    s = list(text)
    for _ in range(count):
        at, how = r.randrange(len(s)), r.random()
        if how < 0.33:
            s[at] = r.choice(LETTERS)
        elif how < 0.66:
            s.insert(at, r.choice(LETTERS))
        else:
            del s[at]
    return "".join(s)


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(now[j - 1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = now
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(4)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, 20))).encode() for _ in range(2))
        assert D.least_distance(p, t) == slow_distance(p, t)


def test_recall_at_the_largest_distance_and_no_false_hit(prose):
    r = random.Random(8)
    items = [(k, prose(1000 + k, 36)) for k in range(30)]
    held = D.Items(items)
    texts, truth = [], []
    for n in range(300):
        k = r.randrange(30)
        size = len(D.normal(items[k][1]))
        host, passage = prose(n, 90), edited(items[k][1], r.randrange(D.most_edits(size) + 1), r)
        at = r.randrange(len(host))
        texts.append(host[:at] + " " + passage + " " + host[at:] if n % 3 else host)
        truth.append({i for i, t in items if slow_distance(D.normal(t), D.normal(texts[-1])) <= D.most_edits(len(D.normal(t)))} if n < 60 else None)
    found = [{i for i, _ in h} for h in held.hits(texts)]
    for got, want in zip(found[:60], truth[:60]):
        assert got == want
    assert sum(bool(f) for n, f in enumerate(found) if n % 3) >= 199 and not any(f for n, f in enumerate(found) if n % 3 == 0)


def test_edits_in_one_run_near_the_start(prose):
    r = random.Random(12)
    items = [(k, prose(3000 + k, 36)) for k in range(20)]
    texts = []
    for n in range(200):
        text = D.normal(items[n % 20][1]).decode()
        run, at = D.most_edits(len(text)), r.randrange(len(text) // 50, len(text) // 10)
        text = text[:at] + ("".join(r.choice(LETTERS) for _ in range(run)) if n % 40 < 20 else "") + text[at if n % 40 < 20 else at + run :]
        texts.append(prose(n, 40) + " " + text + " " + prose(n + 500, 40))
    found = D.Items(items).hits(texts)
    assert [n for n, f in enumerate(found) if n % 20 not in [i for i, _ in f]] == []


@pytest.mark.parametrize("item,text,hit", [("short", "a short one", True), ("short", "a shirt", False), ("abc", "abc", False), ("exactly ten", "say exactly ten!", True), ("exactly ten", "exactly tan", True), ("exactly ten", "exactly tam", False)])
def test_small_items(item, text, hit):
    assert bool(D.Items([(1, item)]).hits([text])[0]) is hit


def test_operator_cases(spark, docs, prose):
    bench = spark.createDataFrame([(1, prose(5, 40)), (2, None), (3, ""), (4, prose(5, 40))], "item_id long, text string")
    df = docs([(1, prose(1, 50) + " " + prose(5, 40)), (2, prose(2, 50)), (3, None), (4, ""), (1, prose(1, 50)), (5, "x" * 300_000)]).withColumn("hits", F.lit(0))
    out = {(r.doc_id, tuple(h.item_id for h in r.hits)) for r in D.mark(df, bench).collect()}
    assert out == {(1, (1, 4)), (2, ()), (3, ()), (4, ()), (1, ()), (5, ())}
    assert D.clean(df.drop("hits"), bench).count() == 5 and D.clean(df.drop("hits"), bench).columns == df.drop("hits").columns
    assert D.clean(df, bench.limit(0)).count() == 6 and D.mark(df.limit(0), bench).count() == 0


def test_items_in_blocks(spark, docs, prose, monkeypatch):
    bench = spark.createDataFrame([(k, prose(50 + k, 40)) for k in range(6)], "item_id long, text string")
    monkeypatch.setattr(D.item_blocks, "__defaults__", (500,))
    out = D.mark(docs([(1, prose(52, 40) + " " + prose(55, 40))]), bench).first()
    assert sorted(h.item_id for h in out.hits) == [2, 5]


def test_short_items_get_their_tenth(prose):
    r = random.Random(8)
    text = prose(31, 400, 1)
    missed = []
    for size in (4, 7, 9, 10, 12, 16, 20, 30, 47, 64, 79, 80, 81, 120):
        for k in range(20):
            item = "".join(r.choice("bcdfghjkmnpqrstvwxyz") for _ in range(size))
            passage = list(item)
            for at in r.sample(range(size), int(0.1 * size)):
                passage[at] = "a"
            at = r.randrange(len(text))
            items = D.Items([(k, item)])
            if items.hits([text[:at] + "".join(passage) + text[at:]]) != [[(k, int(0.1 * size))]]:
                missed.append((size, item))
    assert not missed
