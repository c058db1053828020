import random

import pytest

from palimpsest.llm import line_dedup as L
from pyspark.sql import functions as F


def brute(rows, k=L.SHINGLE, least=L.THRESHOLD):
    places = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                places.setdefault(line.strip(" "), []).append((i, n))
    names = list(places)
    sets = [{x[j : j + k] for j in range(len(x) - k + 1)} for x in names]
    parent = list(range(len(names)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for a, name in enumerate(names):
        groups.setdefault(find(a), []).extend(places[name])
    return {p for g in groups.values() for p in g if p != min(g)}


def test_against_brute_force(spark, docs, prose):
    r = random.Random(3)
    rows = []
    for i in range(40):
        text = prose(i, 60)
        if i % 4 == 1:
            lines = rows[-1][1].split("\n")
            at = r.randrange(len(lines[0]))
            lines[0] = lines[0][:at] + "#" + lines[0][at + 1 :]
            text = "\n".join(lines)
        rows.append((i, text))
    rows += [(40, "short\n\nabc\nabc"), (41, "abc\n  \nzz"), (42, ""), (43, None), (44, rows[0][1]), (45, "日本語の行はここにあります、そして長い\nx")]
    verdicts = L.line_verdicts(docs(rows)).where(~F.col("kept")).select("doc", "n").collect()
    assert {(v.doc, v.n) for v in verdicts} == brute(rows)
    kept = {x.doc_id: x.text for x in L.dedup_lines(docs(rows)).collect()}
    assert kept[42] == "" and kept[43] is None and kept[44] == "" and kept[40] == "short\n\nabc" and kept[41] == "  \nzz"
    assert len(kept) == len(rows)


@pytest.mark.parametrize("few, block", [(L.FEW, L.BLOCK), (3, 4)])  # the second: nearly every bucket is large and in several blocks
def test_links_between_entries_that_a_bucket_s_least_is_unlike(spark, docs, prose, monkeypatch, few, block):
    monkeypatch.setattr(L, "FEW", few)
    monkeypatch.setattr(L, "BLOCK", block)
    r = random.Random(5)
    rows = []
    for i in range(20):
        line = list(prose(500 + i, 18, 1))
        for k in range(25):  # a chain: each line is near its neighbours only
            line[r.randrange(len(line))] = r.choice("#$%&")
            rows.append((25 * i + k, "".join(line)))
    verdicts = L.line_verdicts(docs(rows)).where(~F.col("kept")).select("doc", "n").collect()
    assert {(v.doc, v.n) for v in verdicts} == brute(rows)


def test_empty_table_repeats_and_clashing_columns(spark, docs):
    assert L.dedup_lines(docs([])).count() == 0
    df = docs([(1, "one line of text here\nother"), (1, "one line of text here\nother"), (None, "one line of text here")]).withColumn("entry", F.lit(1)).withColumn("n", F.lit(2))
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"] and out.count() == 3


def test_main_path_runs_no_python(spark, docs):
    plan = L.line_verdicts(docs([(1, "a line of text\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def similarity(x, y, k=L.SHINGLE):
    a, b = ({t[j : j + k] for j in range(len(t) - k + 1)} for t in (x, y))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_recall_of_pairs_at_other_thresholds(spark, docs, prose, threshold):
    r = random.Random(9)
    rows = []
    for i in range(150):
        line = prose(9000 + i, 24, 1)
        other, best = list(line), line
        for at in r.sample(range(len(line)), len(line)):  # edits until the next one would end the likeness
            other[at] = "#"
            if similarity(line, "".join(other)) < threshold:
                break
            best = "".join(other)
        rows += [(2 * i, line), (2 * i + 1, best)]
    gone = {v.doc for v in L.line_verdicts(docs(rows), threshold=threshold).where(~F.col("kept")).select("doc").collect()}
    assert len(gone) >= 0.9 * 150 and all(d % 2 for d in gone)


def test_bands_follow_the_threshold():
    assert [L.rows_for(t) for t in (0.5, 0.8, 0.9)] == [1, 3, 3] and L.least_equal(0.5) < L.least_equal(0.8) < L.least_equal(0.9)


def test_one_group_of_near_copies_and_outsiders(spark, docs, prose):
    r = random.Random(4)
    line, rows = prose(77, 30, 1), []
    for i in range(600):
        other = list(line)
        for at in r.sample(range(len(line)), 2):
            other[at] = chr(0x3B1 + r.randrange(20))
        rows.append((i, "".join(other)))
    rows += [(1000 + i, prose(5000 + i, 30, 1)) for i in range(30)]
    gone = {v.doc for v in L.line_verdicts(docs(rows)).where(~F.col("kept")).select("doc").collect()}
    assert gone == set(range(1, 600))


def test_ties_to_verify_do_not_grow_with_the_square_of_a_family(spark, docs, prose, monkeypatch):
    r = random.Random(8)
    base, rows = prose(31, 24, 1).split(" "), []
    for i in range(300):  # all from one line, most pairs under the threshold and all in the same buckets
        words = list(base)
        for at in r.sample(range(len(words)), 2):
            words[at] = "".join(r.choice("αβγδεζηθικλμ") for _ in range(6))
        rows.append((i, " ".join(words)))
    seen, real = [], L.verified
    monkeypatch.setattr(L, "verified", lambda ties, *more: seen.append(ties.count()) or real(ties, *more))
    verdicts = L.line_verdicts(docs(rows)).where(~F.col("kept")).select("doc", "n").collect()
    assert {(v.doc, v.n) for v in verdicts} == brute(rows)
    assert sum(seen) < 20 * len(rows)


def test_sets_and_lines_are_made_once(spark, docs):
    lines = L.lines_of(docs([(1, "a line of text\nb")]), "doc_id", "text")
    texts = lines.select("entry", "line")
    ties = texts.select(F.col("entry").alias("a"), F.col("entry").alias("b"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(L.signatures(lines)).count("split(") == 1
    assert plan(L.marks(texts.limit(9), L.SHINGLE)).count("UTF-32") == 1
    assert plan(L.verified(ties, texts)).count("UTF-32") == 2 and plan(L.verified(ties, texts)).count("array_intersect") == 1
