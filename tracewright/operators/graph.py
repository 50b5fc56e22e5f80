"""Graph operators on edge tables: joins and bounded iteration, no graph library."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


HUB_SALTS = 16
#: Edges of a hub in one salt, where their number is counted.
HUB_EDGES = 4096


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: iteration keeps no lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def edges(tx: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Directed edges: total value, transfers, first and last time."""
    rows = tx.where("from_addr is not null and to_addr is not null")
    return rows.groupBy(*(key or []), F.col("from_addr").alias("src"), F.col("to_addr").alias("dst")).agg(
        F.sum("value_eth").alias("weight"), F.count("*").alias("n_tx"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def undirected(e: DataFrame) -> DataFrame:
    """Distinct pairs u < v, without loops."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """in_degree, out_degree over distinct edges and unique_counterparties; a loop counts both ways."""
    d = e.select("src", "dst").distinct()
    ends = d.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("dst").alias("x")).unionByName(
        d.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("x"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.countDistinct("x").alias("unique_counterparties"))


def with_least(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) with m, the least v of u; and (u, m).

    Rows are dealt by u and a salt of v, so a hub's edges are spread over
    ``HUB_SALTS`` tasks, in the sum as in the join.
    """
    dealt = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int"))
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).drop("salt"), least


def components(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the least node of each connected component, by alternating stars.

    Loops and repeated pairs are ignored; a node without another one has no row.
    """
    e = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while (now := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != state:
        state = now
        # large star: every larger neighbour moves to the least one, or to the node itself
        around, _ = with_least(both_ways(e))
        e = around.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: all smaller neighbours, and the node, move to the least one
        around, least = with_least(e)
        moved = around.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def pagerank(e: DataFrame, tolerance: float = 1e-8, damping: float = 0.85) -> DataFrame:
    """Weighted by value; dangling mass is spread over all nodes; until a round changes all ranks together by less than ``tolerance``."""
    e = e.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    share = cut(e.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("src"))).select("src", "dst", "p"))
    sends = share.select(F.col("src").alias("node")).distinct().withColumn("sends", F.lit(True))
    rank = cut(nodes(share).join(sends, "node", "left").select("node", F.col("sends").isNull().alias("dangling")))
    n, lost = rank.agg(F.count("*"), F.count_if("dangling")).first()
    rank, lost = rank.withColumn("r", F.lit(1.0 / max(n, 1))), lost / max(n, 1)
    change = 1.0 if n else 0.0
    while change >= tolerance:  # a round leaves at most ``damping`` of it
        sent = share.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("s"))
        # what does not arrive anywhere is the dangling nodes' mass: one number, added up with the change
        now = rank.join(sent, "node", "left").select("node", "dangling", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + lost / n)).alias("r"), F.col("r").alias("before"))
        now = cut(now)
        change, lost = now.agg(F.sum(F.abs(F.col("r") - F.col("before"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0))).first()
        rank = now.drop("before")
    return rank.select("node", F.col("r").alias("pagerank_score"))


def hits(e: DataFrame, rounds: int = 20) -> DataFrame:
    """Hub and authority scores, weighted, each summing to 1, after a fixed number of rounds."""
    e = cut(e.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    all_nodes = cut(nodes(e))
    hub, auth = all_nodes.withColumn("h", F.lit(1.0)), None
    for k in range(rounds):
        # hubs are scaled to 1 in each round, which does for the authorities that they come from, too
        auth = e.join(hub, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("h")).alias("a"))
        auth = cut(auth) if k == rounds - 1 else auth
        hub = cut(e.join(auth, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("a")).alias("h")))
        hub = hub.select("node", (F.col("h") / (hub.agg(F.sum("h")).first()[0] or 1.0)).alias("h"))
    auth = auth.select("node", (F.col("a") / (auth.agg(F.sum("a")).first()[0] or 1.0)).alias("a"))
    return all_nodes.join(hub, "node", "left").join(auth, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub_score"), F.coalesce("a", F.lit(0.0)).alias("authority_score"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(node, triangles) for nodes in at least one: wedges from the smaller-degree end, closed by a join."""
    degree = both_ways(pairs).groupBy("u").agg(F.count("*").alias("d")).withColumnRenamed("u", "node")
    a = pairs.join(degree.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    oriented = a.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedges = oriented.alias("a").join(oriented.alias("b"), F.col("a.s") == F.col("b.s")).where("a.t < b.t").select(F.col("a.s").alias("x"), F.col("a.t").alias("u"), F.col("b.t").alias("v"))
    closed = wedges.join(pairs, ["u", "v"])
    return closed.select(F.explode(F.array("x", "u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(pairs: DataFrame) -> DataFrame:
    d = both_ways(pairs).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d"))
    c = F.when(F.col("d") < 2, 0.0).otherwise(2 * F.coalesce(F.col("triangles"), F.lit(0)) / (F.col("d") * (F.col("d") - 1)))
    return d.join(triangles(pairs), "node", "left").select("node", "d", F.coalesce("triangles", F.lit(0)).alias("triangles"), c.alias("clustering_coefficient"))


def distances(e: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, distance) along directed edges, breadth first, until nothing new is reached or up to ``most`` steps.

    ``sources``: nodes, each a source of its own, or (source, node) where a source starts from several nodes.
    A hub's edges are dealt over salts, ``HUB_EDGES`` to each.
    """
    step = e.where("src <> dst").select("src", "dst").distinct()
    salts = cut(step.groupBy("src").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("salts")))
    step = cut(step.join(salts, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst"))
    salts = salts.select(F.col("src").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    start = sources.select("source", "node") if "source" in sources.columns else sources.select(F.col("node").alias("source"), "node")
    found = frontier = cut(start.withColumn("distance", F.lit(0)))
    for k in count(1) if most is None else range(1, most + 1):
        new = frontier.join(salts, "node").join(step.withColumnRenamed("src", "node"), ["node", "salt"]).select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(found, ["source", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if k % 10 == 0:
            found = cut(found.coalesce(step.sparkSession.sparkContext.defaultParallelism))
    return found


def twins(step: DataFrame) -> DataFrame:
    """(node, first): for each node with an edge in, the least node with the same nodes before it.

    Candidates have equal hashes of their sets; each one's edges are then compared with those of the first.
    """
    mark = lambda k: F.bit_xor(F.xxhash64("src", F.lit(k)))
    sets = cut(step.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"), mark(1).alias("x"), mark(2).alias("y")))
    named = cut(sets.join(sets.groupBy("k", "x", "y").agg(F.min("node").alias("first")), ["k", "x", "y"]).select("node", "k", "first"))
    shared = step.withColumnRenamed("dst", "node").join(named.where("node <> first"), "node").join(step.withColumnRenamed("dst", "first"), ["src", "first"], "left_semi").groupBy("node").agg(F.count("*").alias("same"))
    return named.join(shared, "node", "left").select("node", F.when(F.col("same") == F.col("k"), F.col("first")).otherwise(F.col("node")).alias("first"))


def closeness(e: DataFrame) -> DataFrame:
    """Inward closeness with the Wasserman-Faust factor.

    The last step to a node comes from one of the nodes before it, so nodes with
    the same ones before them share one search, which starts from these; each
    then leaves out the way from itself.
    """
    ids = cut(nodes(e).withColumn("id", F.monotonically_increasing_id()))
    n = ids.count()
    of = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    step = cut(e.where("src <> dst").select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    group = cut(twins(step).select(F.col("node").alias("id"), F.col("first").alias("source")))
    starts = step.join(group.where("id = source").select("source"), F.col("dst") == F.col("source")).select("source", F.col("src").alias("node"))
    d = distances(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts).withColumn("steps", F.col("distance") + 1)
    whole = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("steps").alias("s"))
    own = d.select("source", F.col("node").alias("id"), F.col("steps").alias("own"))
    rows = ids.join(group, "id", "left").join(whole, "source", "left").join(own, ["source", "id"], "left")
    reach, total = F.col("n") - F.col("own").isNotNull().cast("int"), F.col("s") - F.coalesce("own", F.lit(0))
    return rows.select("node", F.when(total > 0, reach / total * reach / max(n - 1, 1)).otherwise(0.0).alias("closeness_centrality"))


#: Steps along edges between two checkpoints.
STEPS = 4


def _least_reaching(left: DataFrame, step: DataFrame) -> DataFrame:
    """(node, color): the least node from which each node can be reached, itself included."""
    color = cut(left.select("node", F.col("node").alias("color")))
    changed = True
    while changed:
        now = color
        for _ in range(STEPS):
            sent = now.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "color")
            now = now.unionByName(sent).groupBy("node").agg(F.min("color").alias("color"))
        now = cut(now)
        changed = not now.join(color.withColumnRenamed("color", "before"), "node").where("color <> before").isEmpty()
        color = now
    return color


def _reaching(back: DataFrame, step: DataFrame) -> DataFrame:
    """``back`` (node, color) and all nodes that reach one of it along ``step``."""
    back, n, before = cut(back), None, -1
    while n != before:
        before, now = n, back
        for _ in range(STEPS):
            into = now.join(step, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "color")
            now = now.unionByName(into).distinct()
        back = cut(now)
        n = back.count()
    return back


def strong_components(e: DataFrame) -> DataFrame:
    """(node, scc, size): strong components, named by their least node.

    Nodes without an edge in or out are components of their own and are trimmed.
    The rest is coloured by the least node that reaches each node; a node of its
    own colour stands for the nodes of that colour that reach it.  What is left
    goes on.  Tables hold nodes and edges, never pairs; there are as many rounds
    as the longest way is long, and no bound on it.
    """
    left, step, found = cut(nodes(e)), cut(e.where("src <> dst").select("src", "dst").distinct()), None
    while not left.isEmpty():
        ends = step.select(F.col("src").alias("node")).intersect(step.select(F.col("dst").alias("node")))
        core = cut(left.join(ends, "node", "left_semi"))
        done = left.join(core, "node", "left_anti").select("node", F.col("node").alias("scc"))
        among = lambda s, n: s.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
        step = cut(among(step, core))
        color = _least_reaching(core, step)
        of = lambda end: color.select(F.col("node").alias(end), F.col("color").alias(f"c_{end}"))  # noqa: B023, E731
        inner = cut(step.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        back = _reaching(color.where("node = color"), inner)
        done = done.unionByName(back.withColumnRenamed("color", "scc"))
        found = cut(done if found is None else found.unionByName(done).coalesce(step.sparkSession.sparkContext.defaultParallelism))
        left = cut(core.join(back, "node", "left_anti"))
        step = cut(among(step, left))
    if found is None:
        found = left.select("node", F.col("node").alias("scc"))
    return found.join(found.groupBy("scc").agg(F.count("*").alias("size")), "scc").select("node", "scc", "size")


def betweenness(e: DataFrame, pivots: int = 64, most: int = 10) -> DataFrame:
    """Estimated from ``pivots`` sources by hash of their name: path counts forward, dependencies backward."""
    all_nodes = cut(nodes(e))
    n = all_nodes.count()
    chosen = all_nodes.orderBy(F.xxhash64("node")).limit(pivots)
    d = cut(distances(e, chosen, most))
    step = e.where("src <> dst").select("src", "dst").distinct()
    near = d.alias("a").join(step, F.col("a.node") == F.col("src")).join(d.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("dst") == F.col("b.node"))).where("b.distance = a.distance + 1")
    dag = cut(near.select("a.source", "src", "dst", F.col("b.distance").alias("level")))
    depth = dag.agg(F.max("level")).first()[0] or 0
    sigma = [d.where("distance = 0").select("source", "node", F.lit(1.0).alias("s"))]
    for k in range(1, depth + 1):
        nxt = dag.where(F.col("level") == k).join(sigma[-1].withColumnRenamed("node", "src"), ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("s").alias("s"))
        sigma.append(cut(nxt))
    delta, parts = None, []
    for k in range(depth, 0, -1):
        level = sigma[k] if delta is None else sigma[k].join(delta, ["source", "node"], "left")
        level = level.withColumn("dep", F.coalesce(F.col("dep"), F.lit(0.0)) if delta is not None else F.lit(0.0))
        parts.append(level.select("source", "node", "dep"))
        back = dag.where(F.col("level") == k).join(level.select("source", F.col("node").alias("dst"), F.col("s").alias("sd"), "dep"), ["source", "dst"]).join(sigma[k - 1].withColumnRenamed("node", "src"), ["source", "src"])
        delta = cut(back.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("s") / F.col("sd") * (1 + F.col("dep"))).alias("dep")))
    if not parts:
        return all_nodes.withColumn("betweenness_centrality", F.lit(0.0))
    total = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("dep").alias("b"))
    scale = n / max(1, min(pivots, n)) / max(1, (n - 1) * (n - 2))
    return all_nodes.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness_centrality"))


def network_features(tx: DataFrame) -> DataFrame:
    """The network family, over the whole graph."""
    e = cut(edges(tx))
    n = nodes(e).count()
    base = degrees(e).select(
        "node", ((F.col("in_degree") + F.col("out_degree")) / max(n - 1, 1)).alias("degree_centrality"), (F.col("in_degree") / max(n - 1, 1)).alias("in_degree_centrality"),
        (F.col("out_degree") / max(n - 1, 1)).alias("out_degree_centrality"), "unique_counterparties",
    )
    parts = [betweenness(e), closeness(e), pagerank(e), hits(e), clustering(undirected(e)).select("node", "clustering_coefficient")]
    out = reduce(lambda a, b: a.join(b, "node", "left"), parts, base).na.fill(0.0)
    out = out.withColumn("bridge_score", F.col("betweenness_centrality")).withColumn("network_influence_score", (F.col("degree_centrality") + F.col("betweenness_centrality") + F.col("pagerank_score")) / 3)
    return out.withColumns({c: F.lit(0.0) for c in ("eigenvector_centrality", "network_reach_2hop", "local_efficiency")}).withColumnRenamed("node", "address")


def reach_two(e: DataFrame) -> DataFrame:
    """Distinct nodes within two steps, the node itself left out.

    What is reached through hubs (``HUB_EDGES`` edges out or more) is made once
    for all nodes that step to the same hubs; of each node's other ways only
    what lies outside of it is added.
    """
    step = cut(e.where("src <> dst").select("src", "dst").distinct())
    hubs = cut(step.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= HUB_EDGES).select(F.col("src").alias("hub")))
    through = cut(step.join(hubs.withColumnRenamed("hub", "dst"), "dst").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("hubs")))
    sets = cut(through.select("hubs").distinct().withColumn("set", F.monotonically_increasing_id()))
    covered = cut(sets.select("set", F.explode("hubs").alias("src")).join(step, "src").select("set", F.col("dst").alias("w")).distinct())
    sizes = covered.groupBy("set").agg(F.count("*").alias("size"))
    other = step.join(hubs.withColumnRenamed("hub", "src"), "src", "left_anti")
    two = step.select("src", F.col("dst").alias("by")).join(other.select(F.col("src").alias("by"), F.col("dst").alias("w")), "by").select("src", "w")
    # with the node itself, which what is reached through hubs may hold
    near = step.select("src", F.col("dst").alias("w")).unionByName(two).unionByName(step.select("src", F.col("src").alias("w"))).distinct()
    named = near.join(through.join(sets, "hubs").select("src", "set"), "src", "left").join(covered.withColumn("hit", F.lit(1)), ["set", "w"], "left")
    add = F.when(F.col("w") == F.col("src"), -F.coalesce("hit", F.lit(0))).otherwise(1 - F.coalesce("hit", F.lit(0)))
    return named.groupBy(F.col("src").alias("node"), "set").agg(F.sum(add).alias("k")).join(sizes, "set", "left").select("node", (F.coalesce("size", F.lit(0)) + F.col("k")).alias("reach_2hop"))


def paths(e: DataFrame, most: int = 10) -> DataFrame:
    """Simple paths of 3 to ``most`` + 1 nodes from sources (no edge in) to sinks (no edge out)."""
    step = cut(e.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"), F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi")))
    starts = step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    ends = step.select(F.col("dst").alias("tail")).distinct().join(step.select(F.col("src").alias("tail")).distinct(), "tail", "left_anti")
    frontier = starts.select(F.array("src", "dst").alias("path"), F.col("dst").alias("tail"), F.col("w").alias("volume"), "lo", "hi")
    out = None
    for k in range(2, most + 1):
        longer = frontier.join(step.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), F.col("tail") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = cut(longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"), (F.col("volume") + F.col("w")).alias("volume"), F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")))
        done = frontier.join(ends, "tail", "left_semi")
        out = done if out is None else out.unionByName(done)
        if frontier.isEmpty():
            break
    hops = F.size("path") - 1
    return out.select(F.sha2(F.array_join("path", ">"), 256).alias("path_id"), "path", hops.alias("hops"), "volume", (F.col("hi") - F.col("lo")).alias("span"))


def cycles(e: DataFrame, most: int = 3) -> DataFrame:
    """Simple directed cycles of 3 to ``most`` nodes, each once, from its least node.

    Those of three are closed from ways through their node of fewest edges, so
    that hubs are never in the middle of a way.
    """
    step = cut(e.where("src <> dst").select("src", "dst").distinct())
    degree = cut(step.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d")))
    of = lambda end: degree.select(F.col("node").alias(end), F.struct("d", "node").alias(f"rank_{end}"))
    ranked = step.join(of("src"), "src").join(of("dst"), "dst")
    out_of = ranked.where("rank_src < rank_dst").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    into = ranked.where("rank_dst < rank_src").select(F.col("dst").alias("x"), F.col("src").alias("z"))
    closed = out_of.join(into, "x").join(step.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    out = closed.select(F.when((x < y) & (x < z), F.array(x, y, z)).when(y < z, F.array(y, z, x)).otherwise(F.array(z, x, y)).alias("path"))
    if most > 3:
        front = step.where("src < dst").select(F.array("src", "dst").alias("path"))
        for k in range(3, most + 1):
            front = front.join(step, F.element_at("path", -1) == F.col("src")).where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
            if k > 3:
                out = out.unionByName(front.join(step.select(F.col("src").alias("s"), F.col("dst").alias("t")), (F.element_at("path", -1) == F.col("s")) & (F.col("path")[0] == F.col("t"))).select("path"))
    return out


def topology(e: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, volume and the largest edge."""
    d = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    n = nodes(d).agg(F.count("*").alias("n_nodes"))
    m = d.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("volume"), F.max("weight").alias("max_edge"), F.avg("weight").alias("avg_edge"), F.median("weight").alias("median_edge"))
    both = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return both.withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))
