"""The embedding join, components and the trie against brute force."""

import math
import random

import numpy as np

from statloom.llm import embedding_join
from statloom.llm.components import components
from statloom.llm.trie import spanning_links


def brute(rows):
    ok = [label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v, _), g in zip(rows, ok)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                n[a] += 1
                n[b] += 1
                up[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), n[k], str(least.get(find(k)))) for k, (i, _, _) in enumerate(rows))


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "PER_PIVOT", 40)
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    r = np.random.default_rng(3)
    rows = []
    for k in range(12):
        c = r.normal(size=8)
        rows += [(len(rows) + j, (c + r.normal(size=8) * s).tolist(), k % 3) for j, s in enumerate(r.choice([0.05, 0.15, 0.3], 25))]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(60)] + [(2000, [2 * x for x in rows[5][1]], rows[5][2]), (2001, rows[5][1], None), (2002, None, 1), (2003, [0.0] * 8, 1), (2004, [float("nan")] * 8, 1), (2005, [None] + [1.0] * 7, 1), (2006, [float("inf")] * 8, 1), (None, rows[5][1], rows[5][2]), (2007, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (2008, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in embedding_join.near_vectors(df).collect())
    assert found == brute(rows)
    assert embedding_join.near_vectors(df.filter("false")).count() == 0


def test_embedding_join_of_pivots_close_together(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "PER_PIVOT", 20)
    r = np.random.default_rng(7)
    hot = r.normal(size=8)
    hot /= np.linalg.norm(hot)
    points = [hot + r.normal(size=8) * s for s in (1e-10, 1e-9, 1e-8) for _ in range(70)]
    for _ in range(390):  # about as far from the group as links reach
        side = r.normal(size=8)
        side -= (side @ hot) * hot
        points.append(hot + side / np.linalg.norm(side) * r.uniform(0.05, 0.35))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in embedding_join.near_vectors(df).collect())
    assert found == brute(rows)


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    alone = {x for x in up if not any(x in e and e[0] != e[1] for e in links)}
    found = {tuple(x) for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {(x, find(x)) for x in up if x not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trie_finds_every_group():
    r = random.Random(9)
    for trial in range(30):
        base = [r.sample(range(200), 40) for _ in range(4)]
        sets = [np.array(sorted(set(r.sample(b, 40 - r.randrange(8)) + r.sample(range(200), r.randrange(9)))), np.uint64) for b in base for _ in range(12)]
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        link = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
        for a in range(len(sets)):
            for b in range(a):
                if link(sets[a], sets[b]):
                    up[find(a)] = find(b)
        want = [find(k) for k in range(len(sets))]
        got = list(range(len(sets)))

        def root(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in spanning_links(sets):
            assert link(sets[a], sets[b])
            got[root(a)] = root(b)
        assert len({(w, root(k)) for k, w in enumerate(want)}) == len(set(want)) == len({root(k) for k in range(len(sets))})
