import random

import pytest

from palimpsest.llm import components as C


def brute(edges):
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("few", [C.FEW_EDGES, 0])  # in one partition; dealt out
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_EDGES", few)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, 500), (501, 500), (500, 501)]
    r.shuffle(edges)
    found = C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in found} == brute(edges) and len(found) == len(brute(edges))
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_few_edges_has_no_shuffle(spark, monkeypatch):
    plans, real = [], C.persist

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(C, "persist", seen)
    C.connected_components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")).count()
    assert len(plans) > 1 and not any("hashpartitioning" in p for p in plans[1:])
