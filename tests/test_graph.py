import random

import pytest

from bandloom.graph import connected_components


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, seen = set(), set()
    for s in sorted(near):
        if s in seen:
            continue
        todo = [s]
        seen.add(s)
        while todo:
            k = todo.pop()
            out.add((k, s))
            todo += [x for x in near[k] if x not in seen]
            seen |= near[k]
    return out


@pytest.mark.parametrize("small", [-1, 10_000])
def test_components(spark, small):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(5000, k) for k in range(5001, 5060)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(df, small=small).collect()} == brute(edges)
    assert connected_components(df.limit(0), small=small).collect() == []
