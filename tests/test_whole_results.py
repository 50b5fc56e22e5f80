"""Registered queries on small ledgers, by brute force: no row is left out."""

import random

from tracewright.plans import graph, registry, typology

QUERIES = registry.queries()


def transfers(n=240, seed=4):
    """Rows of a ledger with several gas amounts and kinds of address."""
    rng = random.Random(seed)
    names = [f"0x{k:040}" for k in range(6)] + ["0xmix0", "0xmix1", "0xabc"]
    return [(f"0x{i}", 1_700_000_000 + rng.randrange(900_000), rng.choice(names), rng.choice(names), rng.choice([0.1, 1.0, 1.04, 10.0, 100.0, 7.0]), 21000 + i % 7 * 1000) for i in range(n)]


def given(spark, monkeypatch, module, data, name="event_ledger"):
    df = spark.createDataFrame(data, "hash string, timestamp long, from_addr string, to_addr string, value_eth double, gas long")
    monkeypatch.setattr(module, name, lambda spark, sf_dir: df)


def test_band_join_takes_every_gas(spark, monkeypatch):
    data = transfers()
    given(spark, monkeypatch, typology, data)
    band = lambda v: next((d for d in (0.1, 1.0, 10.0, 100.0) if abs(v - d) <= d * 0.05), None)
    expected = {}
    for h, t, a, _, v, _ in data:
        far = [abs(t - t2) for h2, t2, f, d, v2, _ in data if band(v) is not None and band(v) == band(v2) and abs(t - t2) <= 259200 and a not in (f, d) and h != h2]
        if far:
            expected[h] = (len(far), max(far))
    got = {r["hash"]: (r["matches"], r["farthest"]) for r in QUERIES["j6_band_join"](spark, "").collect()}
    assert got == expected and len({int(h[2:]) % 7 for h in got}) == 7


def test_coactivity_takes_every_address(spark, monkeypatch):
    data = [(h, 1_700_000_000 + (t - 1_700_000_000) // 20, a, b, v, g) for h, t, a, b, v, g in transfers(120)]
    given(spark, monkeypatch, typology, data)
    own = {}
    for h, t, a, b, _, _ in data:
        for x in {a, b}:
            own.setdefault(x, {})[h] = t
    expected = {}
    for a, x in own.items():
        for b, y in own.items():
            share = sum(any(abs(t - u) <= 3600 for u in y.values()) for t in x.values()) / len(x)
            if a != b and min(len(x), len(y)) >= 5 and share > 0.7:
                expected[a, b] = round(share, 6)
    got = {(r["a"], r["b"]): r["coactivity"] for r in QUERIES["j14_coactivity"](spark, "").collect()}
    assert got == expected and any("mix" in a for a, _ in got)


def test_components_have_every_node(spark, monkeypatch):
    pairs = [("0xc1", "0xs1"), ("0xc2", "0xs1"), ("0xs1", "0xn1"), ("0xc3", "0xs2"), ("0xs2", "0xn2"), ("0xc4", "0xs3"), ("0xc4", "0xs2")]
    given(spark, monkeypatch, graph, [(f"0x{i}", i, a, b, 1.0, 21000) for i, (a, b) in enumerate(pairs)], "order_ledger")
    group = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        both = group[a] | group[b]
        group.update({x: both for x in both})
    got = {r["node"]: r["component"] for r in QUERIES["l3_connected_components"](spark, "").collect()}
    assert got == {x: min(g) for x, g in group.items()}


def ring(n, tail=0):
    names = [f"0x{k:040}" for k in range(n + tail)]
    return [(f"0x{k}", k, a, b, 1.0, 21000) for k, (a, b) in enumerate([*zip(names, names[1:n] + names[:1]), *zip(names[n - 1 :], names[n:])])]


def test_strong_components_and_closeness_go_as_far_as_the_graph(spark, monkeypatch):
    n, tail = 25, 3
    data = ring(n, tail)
    given(spark, monkeypatch, graph, data)
    names = sorted({x for r in data for x in r[2:4]})
    got = {r["node"]: (r["scc"], r["size"]) for r in QUERIES["p5_strong_components"](spark, "").collect()}
    assert got == {x: (names[0], n) if k < n else (x, 1) for k, x in enumerate(names)}
    close = {r["node"]: r["closeness_centrality"] for r in QUERIES["f3_closeness"](spark, "").collect()}
    for k, x in enumerate(names):
        # steps to x from the ring, and from the tail before it
        steps = list(range(1, n)) if k < n else [k - n + 1 + i for i in range(n)] + list(range(1, k - n + 1))
        assert close[x] == round(len(steps) / sum(steps) * len(steps) / (n + tail - 1), 6)


def test_pagerank_has_converged(spark, monkeypatch):
    data = ring(12, 8)[1:] + [("0xz", 99, "0x" + "5".zfill(40), "0xhub", 3.0, 21000)]
    given(spark, monkeypatch, graph, data)
    names = sorted({x for r in data for x in r[2:4]})
    out = {x: [(r[3], r[4]) for r in data if r[2] == x] for x in names}
    rank = {x: 1 / len(names) for x in names}
    for _ in range(500):
        lost = sum(rank[x] for x in names if not out[x])
        new = {x: (0.15 + 0.85 * lost) / len(names) for x in names}
        for x in names:
            for y, w in out[x]:
                new[y] += 0.85 * rank[x] * w / sum(v for _, v in out[x])
        rank = new
    got = {r["node"]: r["pagerank_score"] for r in QUERIES["f3_pagerank"](spark, "").collect()}
    assert set(got) == set(names) and all(abs(got[x] - rank[x]) < 1e-6 for x in names)
