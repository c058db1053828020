import random
import re

import numpy as np
import pytest

from palimpsest.llm import ngram_join as N
from palimpsest.llm.components import connected_components


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, docs, prose, block):
    r = random.Random(1)
    rows = [(i, prose(i, 80)) for i in range(12)]
    hot = prose(99, 200).split(" ")
    for i in range(12, 60):  # one large group of near copies, some of them equal
        w = list(hot)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(30)
        rows.append((i, " ".join(w)))
    rows += [(60, rows[0][1].upper()), (61, "three words only"), (62, "three words only"), (63, ""), (64, None), (65, "  ,, "), (66, "!")]
    out = {x.doc_id: (x.class_id, x.n_links) for x in N.join(docs(rows), block=block).collect()}
    assert out == brute(rows)


def test_empty_repeats_and_null_ids(spark, docs, prose):
    assert N.join(docs([])).count() == 0
    out = N.join(docs([(1, prose(1, 50)), (1, prose(1, 50)), (None, prose(1, 50)), (2, prose(1, 50))])).collect()
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in out), key=str) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3)]


def test_repeated_ids_with_different_texts(spark, docs, prose):
    one, two = prose(1, 50), prose(2, 50)
    rows = [(1, one), (2, two), (2, one), (3, one), (4, two), (None, "some words that nobody else has"), (None, None)]
    out = sorted(((x.doc_id, x.class_id, x.n_links) for x in N.join(docs(rows)).collect()), key=str)
    assert out == sorted([(1, 1, 2), (2, 2, 1), (2, 1, 2), (3, 1, 2), (4, 2, 1), (None, None, 0), (None, None, 0)], key=str)


def test_pipeline_stage_keeps_unique_texts_that_share_an_id(spark, docs, prose):
    import corpus_pipeline

    one, two = prose(1, 50), prose(2, 50)
    kept = corpus_pipeline.join_ngrams(spark, docs([(1, one), (2, two), (2, one), (3, one), (None, prose(3, 50)), (None, None)]), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, one), (2, two), (None, prose(3, 50)), (None, None)], key=str)


def test_pruning_keeps_pairs_over_the_threshold():
    family = N.hash_family(144, seed=23)
    r = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        both = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, r.integers(0, 1 << 63, 45, dtype=np.uint64)])), np.unique(np.concatenate([both, r.integers(0, 1 << 63, 45, dtype=np.uint64)]))
        sigs = np.stack([N.minhashes(a, family), N.minhashes(b, family)])
        i, _ = N.surviving_pairs(sigs, np.array([len(a), len(b)]), np.arange(2), None, 0.8, N.TOLERANCE)
        lost += not len(i)
    assert lost == 0
    far = np.stack([N.minhashes(r.integers(0, 1 << 63, 100, dtype=np.uint64), family) for _ in range(20)])
    assert not len(N.surviving_pairs(far, np.full(20, 100), np.arange(20), None, 0.8, N.TOLERANCE)[0])


def test_dense_and_single_intersections_agree():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, 120).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert (N.intersections(sets, i, j) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30) if k % 10 != 9] + [(5, 5), (100, 3), (7, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: k // 10 * 10 for k in range(30)}, 100: 0, 200: 0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
