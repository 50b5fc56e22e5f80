"""What shows only on larger ledgers: ties, hubs and crowds, by brute force on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from test_whole_results import QUERIES, given

from tracewright.operators import coordination as K
from tracewright.operators import fingerprints, incidence, meeting, mixers
from tracewright.plans import coordination, graph, typology


def test_peeling_takes_a_second_as_one_step(spark, monkeypatch):
    data, at = [], 1_700_000_000
    for k in range(3):
        # ten come in, nine leave in one second for two receivers
        data += [(f"0xi{k}", at + 100 * k, "0xsrc", "0xpeel", 10.0, 21000), (f"0xa{k}", at + 100 * k + 9, "0xpeel", "0xd1", 5.0, 21000), (f"0xb{k}", at + 100 * k + 9, "0xpeel", "0xd2", 4.0, 21000)]
        # as much leaves as came in, added in another order
        data += [(f"0xm{k}{i}", at + 100 * k, "0xsrc", "0xeven", v, 21000) for i, v in enumerate([0.3, 0.2, 0.1])]
        data += [(f"0xn{k}{i}", at + 100 * k + 9, "0xeven", "0xd3", v, 21000) for i, v in enumerate([0.1, 0.2, 0.3])]
    given(spark, monkeypatch, graph, data)
    assert [tuple(r) for r in QUERIES["o10_peeling_chains"](spark, "").collect()] == [("0xpeel", 3, 27.0)]


def crowd(n=60, seed=3):
    """Two hubs that pay and are paid by a crowd, and a few transfers within it."""
    rng = random.Random(seed)
    names = [f"0xu{k:03}" for k in range(n)]
    pairs = [("0xh0", x) for x in names[: n - 5]] + [("0xh1", x) for x in names[n // 2 :]] + [(x, "0xh0") for x in names[::2]] + [(x, "0xh1") for x in names[1::2]]
    pairs += [(rng.choice(names), rng.choice(names[:6])) for _ in range(40)] + [("0xh0", "0xh1"), ("0xq", names[0]), (names[3], names[3])]
    return [(f"0x{i}", i, a, b, 1.0 + i % 3, 21000) for i, (a, b) in enumerate(pairs)]


def test_closeness_searches_once_for_nodes_with_the_same_ones_before_them(spark, monkeypatch):
    data = crowd()
    given(spark, monkeypatch, graph, data)
    found, plain = [], graph.graph.distances
    monkeypatch.setattr(graph.graph, "distances", lambda *a, **k: found.append(plain(*a, **k)) or found[-1])
    got = {r["node"]: r["closeness_centrality"] for r in QUERIES["f3_closeness"](spark, "").collect()}
    names = sorted({x for r in data for x in r[2:4]})
    before = {x: {r[2] for r in data if r[3] == x and r[2] != x} for x in names}
    for x in names:
        far, front, k = {x: 0}, {x}, 0
        while front:
            k, front = k + 1, {y for z in front for y in before[z]} - set(far)
            far.update(dict.fromkeys(front, k))
        total = sum(far.values())
        assert got[x] == (round((len(far) - 1) / total * (len(far) - 1) / (len(names) - 1), 6) if total else 0.0)
    assert set(got) == set(names) and found[0].count() < len(names) ** 2 / 3


def test_band_join_steps_over_runs_and_pairs_nothing(spark, monkeypatch):
    monkeypatch.setattr(incidence, "SPAN", 8)
    rng, at = random.Random(8), 1_700_000_000
    # long stretches of one pair, which both its ends must step over; a few others; hashes that come twice
    data = [(f"0x{i}", at + i // 2 * 20, *rng.choice([("0xh", "0xg"), ("0xg", "0xh"), ("0xh", "0xh")]), 1.0, 0) for i in range(90)]
    data += [(f"0xo{i}", at + rng.randrange(900), f"0xu{rng.randrange(4)}", rng.choice(["0xh", "0xu1", "0xg"]), rng.choice([1.0, 10.0]), 0) for i in range(25)]
    data += [("0x5", at + 31, "0xu1", "0xu2", 1.0, 0), ("0x6", at + 700, "0xh", None, 1.0, 0), ("0xn", at + 5, None, "0xu3", 1.0, 0), ("0xz", at + 7, "0xu7", None, 1.0, 0), (None, at + 9, "0xu8", "0xu9", 1.0, 0)]
    given(spark, monkeypatch, typology, data)
    for width in (1, 60, 300, 5000):
        expected = {}
        for h, t, a, _, v, _ in data:
            far = [abs(t - t2) for h2, t2, f, d, v2, _ in data if None not in (h, h2, a, f, d) and v == v2 and abs(t - t2) <= width and a not in (f, d) and h != h2]
            if far:
                n, m = expected.get(h, (0, 0))
                expected[h] = n + len(far), max(m, *far)
        df = incidence.band_matches(typology.event_ledger(spark, ""), width)
        assert {r["hash"]: (r["matches"], r["farthest"]) for r in df.collect()} == expected
        assert {r["hash"]: r["matches"] for r in incidence.band_matches(typology.event_ledger(spark, ""), width, farthest=False).collect()} == {h: n for h, (n, _) in expected.items()}


def test_band_join_of_a_crowd_moves_no_pairs(spark, monkeypatch):
    n = 20000  # all within one window: 4 * 10 ** 8 pairs
    tx = spark.range(n).selectExpr("concat('0x', id) as hash", "1700000000 + id as timestamp", "concat('0xa', id) as from_addr", "concat('0xb', id) as to_addr", "1.0D as value_eth")
    paired, plain = [], incidence.near_in_time
    monkeypatch.setattr(incidence, "near_in_time", lambda left, *a: paired.append(left.count()) or plain(left, *a))
    assert incidence.band_matches(tx).agg(F.sum("matches"), F.min("farthest"), F.max("farthest")).first()[:] == (n * (n - 1), n // 2, n - 1)
    monkeypatch.setattr(coordination, "event_ledger", lambda spark, sf_dir: tx)
    assert QUERIES["l1_link_graph"](spark, "").agg(F.count("*"), F.sum("n_tx")).first()[:] == (n, n)
    assert QUERIES["l4_sized_clusters"](spark, "").agg(F.count("*"), F.min("members"), F.max("members")).first()[:] == (2 * n, 2, 2)
    assert paired == [0, 0, 0]


def test_band_join_goes_over_a_run_once(spark, monkeypatch):
    at, n = 1_700_000_000, 30_000  # one sender in every second but those of two others, so its runs are long
    tx = spark.range(n).selectExpr("concat('0x', id) as hash", f"{at} + id as timestamp", f"if(id in (0, {n - 1}), concat('0xa', id), '0xh') as from_addr", "'0xg' as to_addr", "1.0D as value_eth")
    runs, plain = [], incidence._runs
    monkeypatch.setattr(incidence, "_runs", lambda *a: runs.append(plain(*a)) or runs[-1])
    df = incidence.band_matches(tx)
    # of a hub's row only the two others match, of theirs all but themselves
    assert df.agg(F.count("*"), F.sum("matches"), F.min("farthest"), F.max("farthest")).first()[:] == (n, 2 * (n - 2) + 2 * (n - 1), n // 2, n - 1)
    # no window is gone over again for each of its rows
    assert len(runs) == 2 and not any("unboundedfollowing" in r._jdf.queryExecution().toString().lower() for r in runs)


def test_two_steps_and_cycles_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph.graph, "HUB_EDGES", 20)
    data = crowd()
    given(spark, monkeypatch, graph, data)
    after = {}
    for r in data:
        after.setdefault(r[2], set()).add(r[3])
    expected = {x: len((after[x] | {z for y in after[x] for z in after.get(y, ())}) - {x}) for x in after}
    got = {r["node"]: r["reach_2hop"] for r in QUERIES["f3_reach_two_hops"](spark, "").collect()}
    assert got == {x: n for x, n in expected.items() if n}
    rings = {(a, b, c) for a in after for b in after[a] for c in after.get(b, ()) if a in after.get(c, ()) and a < b and a < c and b != c}
    found = [tuple(r) for r in QUERIES["l12_cycles"](spark, "").collect()]
    assert len(rings) > 9 and sorted(found) == sorted(rings)
    longer = {(a, b, c, d) for a in after for b in after[a] for c in after.get(b, ()) for d in after.get(c, ()) if a in after.get(d, ()) and a < min(b, c, d) and len({a, b, c, d}) == 4}
    every = [tuple(r["path"]) for r in graph.graph.cycles(graph._edges(spark, ""), 4).collect()]
    assert sorted(every) == sorted(rings | longer)


def test_two_steps_and_cycles_make_no_rows_for_each_pair_around_a_hub(spark, monkeypatch):
    n = 150_000  # 2.2 * 10 ** 10 ways through the hub
    tx = spark.range(2 * n).selectExpr("concat('0x', id) as hash", "id as timestamp", "if(id % 2 = 0, concat('0xa', id div 2), '0xhub') as from_addr", "if(id % 2 = 0, '0xhub', concat('0xa', id div 2)) as to_addr", "1.0D as value_eth")
    monkeypatch.setattr(graph, "event_ledger", lambda spark, sf_dir: tx)
    assert QUERIES["f3_reach_two_hops"](spark, "").agg(F.count("*"), F.min("reach_2hop"), F.max("reach_2hop")).first()[:] == (n + 1, n, n)
    assert QUERIES["l12_cycles"](spark, "").count() == 0


def test_coactivity_by_blocks(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 60), ("BLOCK_ADDRESSES", 3), ("BLOCK_HOURS", 5)):
        monkeypatch.setattr(incidence, name, size)
    rng, at = random.Random(11), 1_700_000_000
    data = [(f"0x{i}", at + rng.randrange(200_000) // 50 * 50, f"0xu{i % 12}" if i % 3 else "0xhub", f"0xu{rng.randrange(12)}", 1.0, 0) for i in range(260)]
    own = {}
    for h, t, a, b, _, _ in data:
        for x in {a, b}:
            own.setdefault(x, []).append(t)
    share = {(a, b): sum(any(abs(t - u) <= 3600 for u in y) for t in x) / len(x) for a, x in own.items() for b, y in own.items() if a != b}
    given(spark, monkeypatch, typology, data)
    df = incidence.coactivity(typology.event_ledger(spark, ""), above=0.55)
    got = {(r["a"], r["b"]): r["coactivity"] for r in df.collect()}
    assert got == {k: v for k, v in share.items() if v > 0.55} and 5 < len(got) < len(share)
    # pairs of rows near each other in time are not joined: the plan has no buckets of time
    assert "bucket" not in df._jdf.queryExecution().toString()


def mixer_use(spark, n=300, users=25):
    rng, at = random.Random(6), 1_700_000_000
    rows = [(f"0xu{min(rng.randrange(users), rng.randrange(users)):02}", f"0xmix{rng.randrange(5)}", f"0x{i // 2 * 2 if i % 40 == 1 else i}", at + rng.randrange(90_000), rng.choice([0.0, 0.1, 1.0, 10.0]), rng.random() < 0.5) for i in range(n)]
    rows += [("0xone", "0xmix0", "0xa", at + 500, 1.0, True), ("0xtwo", "0xmix0", "0xb", None, 1.0, True), ("0xnull", "0xmix0", "0xc", at + 500, None, False)]
    return spark.createDataFrame(rows, "address string, contract string, hash string, timestamp long, value_eth double, deposit boolean")


def test_coordination_by_blocks_loses_no_link(spark, monkeypatch):
    rows = mixer_use(spark)
    profiles, sets = ({r["address"]: r[1] for r in df.collect()} for df in (K.volume_profile(rows), K.mixer_sets(rows)))
    use = {}
    for r in rows.collect():
        use.setdefault(r["address"], []).append(r)
    like = lambda x, y: None if None in x + y else sum((max(0, 1 - abs(p - q) / abs(p)) if p else float(q == 0)) for p, q in zip(x, y)) / 5
    parts = {}
    for a, x in use.items():
        for b, y in use.items():
            near = {r["hash"] for r in x for q in y if a != b and None not in (r["timestamp"], q["timestamp"]) and r["contract"] == q["contract"] and abs(r["timestamp"] - q["timestamp"]) <= 3600}
            v = like(list(profiles[a]), list(profiles[b]))
            if near and v is not None:
                parts[a, b] = (len(near) / len(x), len(set(sets[a]) & set(sets[b])) / len({*sets[a], *sets[b]}), v)
    pairs = spark.createDataFrame([*parts], "a string, b string")
    runs = {(r["a"], r["b"]): r["sequence"] for r in K.sequence_likeness(rows, pairs).collect()}
    every = {k: round(0.4 * t + 0.25 * j + 0.2 * v + 0.15 * runs[k], 9) for k, (t, j, v) in parts.items()}
    bar = sorted(every.values())[-20] - 1e-6
    monkeypatch.setattr(K, "BLOCK_ROWS", 80)
    monkeypatch.setattr(K, "BLOCK_ADDRESSES", 3)
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in K.coordination(rows, least=bar).collect()}
    assert got == {k: s for k, s in every.items() if s >= bar} and 5 < len(got) < len(every) / 2
    # of the pairs that the full weight of sequences could lift, the bound leaves some out
    assert K.likely(rows, 3600, bar).count() < sum(0.4 * t + 0.25 * j + 0.2 * v + 0.15 >= bar for t, j, v in parts.values())


def brute_meetings(rows, width=3600):
    """Addresses' rows, and (a, b) -> differences in time of rows that met."""
    use = {}
    for r in rows.collect():
        use.setdefault(r["address"], []).append(r)
    met = {}
    for a, x in use.items():
        for b, y in use.items():
            near = [(r["hash"], abs(r["timestamp"] - q["timestamp"])) for r in x for q in y if a != b and None not in (r["timestamp"], q["timestamp"]) and r["contract"] == q["contract"] and abs(r["timestamp"] - q["timestamp"]) <= width]
            if near:
                met[a, b] = near
    return use, met


@pytest.fixture(params=[1 << 20, 40, 4])
def small_blocks(request, monkeypatch):
    """Few meetings by their own places, and many in a table; several blocks and pieces."""
    for name, size in (("BLOCK_ROWS", 80), ("CELLS", request.param), ("MEETINGS", 30), ("SENT", 7)):
        monkeypatch.setattr(meeting, name, size)


def no_join_by_time(df):
    return "bucket" not in df._jdf.queryExecution().toString()


def test_temporal_share_in_blocks(spark, small_blocks):
    rows = mixer_use(spark)
    use, met = brute_meetings(rows)
    df = K.meetings(rows)
    assert {(r["a"], r["b"]): r["temporal"] for r in df.collect()} == {(a, b): len({h for h, _ in near}) / len(use[a]) for (a, b), near in met.items()}
    assert no_join_by_time(df)


def test_volume_likeness_in_blocks(spark, small_blocks):
    rows = mixer_use(spark)
    _, met = brute_meetings(rows)
    side = lambda c, p: K.volume_profile(rows).select(F.col("address").alias(c), F.col("profile").alias(p))
    every = side("a", "x").crossJoin(side("b", "y")).select("a", "b", F.round(K.volume_likeness(F.col("x"), F.col("y")), 6).alias("v")).collect()
    df = K.met_volumes(rows, digits=6)
    assert {(r["a"], r["b"]): r["volume"] for r in df.collect()} == {(r["a"], r["b"]): r["v"] for r in every if (r["a"], r["b"]) in met}
    assert no_join_by_time(df)


def test_mixer_overlaps_in_blocks(spark, small_blocks):
    rows = mixer_use(spark)
    _, met = brute_meetings(rows)
    df = mixers.overlaps(rows, digits=6)
    got = {(r["a"], r["b"]): (r["meetings"], r["strength"]) for r in df.collect()}
    assert {k: n for k, (n, _) in got.items()} == {(a, b): len(near) for (a, b), near in met.items() if a < b}
    assert all(abs(s - sum(1 - d / 3600 for _, d in met[k])) < 1e-6 for k, (_, s) in got.items())
    assert no_join_by_time(df)


def some_prints(spark):
    rng = random.Random(2)
    names = [c for cs in fingerprints.KINDS for c in cs]
    return spark.createDataFrame([(f"0xu{k:02}", *[0.0 if k == 4 else rng.choice([0.1, 1.0, 2.0, 7.5]) for _ in names]) for k in range(23)], "address string, " + ", ".join(f"{c} double" for c in names))


def plain_likeness(prints, met):
    of = {r["address"]: r for r in prints.collect()}

    def cosine(x, y):
        size = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
        return sum(v * w for v, w in zip(x, y)) / size if size else 0.0

    return {(a, b): sum(cosine([of[a][c] for c in cs], [of[b][c] for c in cs]) for cs in fingerprints.KINDS) / 4 for a, b in met if a < b and a in of and b in of}


def test_fingerprint_likeness_in_blocks(spark, small_blocks):
    rows, prints = mixer_use(spark), some_prints(spark)
    _, met = brute_meetings(rows)
    expected, of = plain_likeness(prints, met), {r["address"]: r for r in prints.collect()}
    df = fingerprints.likeness(prints, rows)
    got = {(r["a"], r["b"]): r for r in df.collect()}
    assert set(got) == set(expected) and all(abs(got[k]["similarity"] - s) < 1e-9 for k, s in expected.items())
    assert all(got[a, b]["evidence"] == [t for t, (c, d) in fingerprints.CLOSE.items() if abs(of[a][c] - of[b][c]) < d] for a, b in got)
    assert no_join_by_time(df)


@pytest.mark.parametrize("few", [0, 8, 2048])
def test_disjoint_pairs_keep_no_links(spark, monkeypatch, small_blocks, few):
    monkeypatch.setattr(meeting, "FEW", few)
    rows, prints = mixer_use(spark), some_prints(spark)
    _, met = brute_meetings(rows)
    used, want = set(), []
    for s, a, b in sorted((-round(s, 2), a, b) for (a, b), s in plain_likeness(prints, met).items() if s > 0.6):
        if not used & {a, b}:
            used |= {a, b}
            want.append((a, b, -s))
    kept, plain = [], meeting.cut
    monkeypatch.setattr(meeting, "cut", lambda df: kept.append(plain(df)) or kept[-1])
    got = fingerprints.disjoint_met_pairs(prints, rows, above=0.6, digits=2)
    assert sorted(map(tuple, got.select("a", "b", "similarity").collect())) == sorted(want) and len(want) > 4
    assert all(df.count() <= rows.count() for df in kept) and len(met) > rows.count() / 2


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(4)
    x = [0.0, 1.0, 0.1234565, 0.1234575, 2.0000005, 1.0000015, 123456.1234565, 0.9999995, -0.1234565, 5e-7, 1e12 + 0.3] + [rng.randrange(10**7) / 2e6 / 10 for _ in range(500)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert meeting.half_up(np.array(x), 6).tolist() == want


def test_sequences_are_compared_where_pairs_are_made(spark, monkeypatch):
    monkeypatch.setattr(K, "RUNS", 64)
    monkeypatch.setattr(K, "BLOCK_ROWS", 80)
    rows = mixer_use(spark).withColumn("deposit", F.when(F.col("timestamp") % 9 > 0, F.col("deposit")))
    p = K.likely(rows, 3600, 0.2)
    got = {(r["a"], r["b"]): r["sequence"] for r in p.collect()}
    want = {(r["a"], r["b"]): r["sequence"] for r in K.sequence_likeness(rows, p.select("a", "b")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - s) < 1e-9 for k, s in want.items()) and sum(s > 0 for s in got.values()) > 20
    # pairs are not joined with the runs of their addresses
    joined, plain = [], K.windows
    monkeypatch.setattr(K, "windows", lambda rows: joined.append(1) or plain(rows))
    assert K.coordination(rows, least=0.2).count() > 0 and not joined


def test_rows_are_packed_before_they_are_sent_to_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(meeting, "BLOCK_ROWS", 2000)
    rows = mixer_use(spark, 6000)
    sent, plain = [], meeting.visits
    monkeypatch.setattr(meeting, "visits", lambda *a: sent.append(plain(*a)) or sent[-1])
    K.met_volumes(rows), K.meetings(rows)
    volumes, shares = ([(r["i"], r["j"]) for r in df.collect()] for df in sent)
    assert max(len(volumes), len(shares)) < rows.count() / 4
    # pairs that are only judged by their facts are made once for both directions
    assert all(i <= j for i, j in volumes) and len(set(volumes)) == 10 and len(set(shares)) == 16


def test_rounds_of_ranks_take_two_actions(spark, monkeypatch):
    names = [f"0x{k}" for k in range(9)]
    rng = random.Random(1)
    e = spark.createDataFrame([(rng.choice(names[:7]), rng.choice(names), rng.random()) for _ in range(40)], "src string, dst string, weight double")
    saved, taken = [], []
    plain, first = graph.graph.cut, DataFrame.first
    monkeypatch.setattr(graph.graph, "cut", lambda df: saved.append(1) or plain(df))
    monkeypatch.setattr(DataFrame, "first", lambda df: taken.append(1) or first(df))
    out = graph.graph.hits(e, 5)
    assert (len(saved), len(taken)) == (2 + 5 + 1, 5 + 1)
    assert all(abs(x - 1) < 1e-9 for x in out.agg(F.sum("hub_score"), F.sum("authority_score")).collect()[0])
    saved.clear(), taken.clear()
    rank = {r["node"]: r["pagerank_score"] for r in graph.graph.pagerank(e).collect()}
    assert len(taken) == len(saved) - 1  # a round is saved and added up once
    w = {}
    for r in e.collect():
        w.setdefault(r["src"], {}).setdefault(r["dst"], []).append(r["weight"])
    want = dict.fromkeys(rank, 1 / len(rank))
    for _ in range(300):
        got = dict.fromkeys(rank, sum(want[x] for x in rank if x not in w) / len(rank))
        for x, to in w.items():
            for y, v in to.items():
                got[y] += want[x] * sum(v) / sum(map(sum, to.values()))
        want = {x: 0.15 / len(rank) + 0.85 * v for x, v in got.items()}
    assert all(abs(rank[x] - v) < 1e-7 for x, v in want.items()) and len(rank) > len(w)
