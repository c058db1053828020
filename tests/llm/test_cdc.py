import random

import numpy as np

from palimpsest.llm import cdc as C

GEAR = C.gear_table()


def slow_cuts(raw, reach=C.REACH, most=C.MAX_CHUNK):
    h = []
    for i in range(len(raw)):
        h.append(sum(int(GEAR[raw[i - j]]) << j for j in range(min(i + 1, 16))) & 0xFFFF)
    marks = [i + 1 for i in range(len(raw)) if h[i] == min(h[max(0, i - reach) : i + reach + 1]) and all(h[k] > h[i] for k in range(max(0, i - reach), i)) and i + 1 < len(raw)]
    out, last = [], 0
    for m in [*marks, len(raw)]:
        while m - last > most:
            last += most
            out.append(last)
        out.append(m)
        last = m
    return out


def test_cuts_by_definition_and_in_slices(prose, monkeypatch):
    for text in (prose(1, 300), "a" * 1000, "ab" * 400, "x", prose(2, 20) + "\0" * 500):
        data = np.frombuffer(text.encode(), np.uint8)
        assert C.cuts(data, GEAR).tolist() == slow_cuts(text.encode())
        monkeypatch.setattr(C, "SLICE", 101)
        assert C.cuts(data, GEAR).tolist() == slow_cuts(text.encode())
        monkeypatch.undo()


def test_repeated_passages_are_found(spark, docs, prose):
    r = random.Random(2)
    rows, planted = [(i, prose(i, 120)) for i in range(60)], set()
    for k in range(30):
        a, b = rows[k], 30 + k
        w = a[1].replace("\n", " ").split(" ")
        s = r.randrange(len(w) - 55)
        host = prose(200 + k, 120).split(" ")
        at = r.randrange(len(host))
        rows[b] = (b, " ".join(host[:at] + w[s : s + 52] + host[at:]))
        rows[k] = (k, " ".join(w))
        planted.add((k, b))
    out = C.repeats(docs(rows)).collect()
    assert {(x.first_doc_id, x.doc_id) for x in out} == planted
    text = dict(rows)
    for x in out:
        assert text[x.doc_id].encode()[x.start : x.end] in text[x.first_doc_id].encode()


def test_copies_inner_repeats_and_defined_cases(spark, docs, prose):
    t = prose(1, 90)
    rows = [(1, t), (2, t), (1, t), (3, None), (4, ""), (None, t), (5, prose(9, 60) + t[:0] + "\n" + prose(9, 60))]
    out = {(x.doc_id, x.first_doc_id): x for x in C.repeats(docs(rows)).collect()}
    assert set(out) == {(2, 1), (5, 5)} and (out[2, 1].start, out[2, 1].end) == (0, len(t.encode()))
    cleaned = {r.doc_id: r.text for r in C.without_repeats(docs(rows), C.repeats(docs(rows))).collect() if r.doc_id}
    assert cleaned[2] == "" and cleaned[1] == t and cleaned[3] is None and len(cleaned[5]) < 0.7 * len(rows[6][1])
    assert C.repeats(docs([])).count() == 0
