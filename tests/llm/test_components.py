import random

import pytest

from ledgerline.llm.components import connected_components


def plain(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    random.seed(seed)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)]
    links += [(None, 3), (4, None), (7, 7)]
    found = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["node"]: r["component"] for r in found.collect()} == plain(links)


def test_long_chain_and_hub(spark):
    order = random.Random(1).sample(range(200), 200)
    chain = list(zip(order, order[1:]))
    hub = [(1000, 1001 + i) for i in range(300)]
    found = connected_components(spark.createDataFrame(chain + hub, "a long, b long").repartition(11))
    rows = found.collect()
    assert {r["node"]: r["component"] for r in rows} == plain(chain + hub)
    assert len(rows) == 501


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
