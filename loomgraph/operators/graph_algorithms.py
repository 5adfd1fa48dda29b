"""Traversals, closures, threads, co-occurrence graphs, communities, hash chains.

Loops run on the driver, every round is a join of DataFrames, and each round's frontier is written
to the shared folder, so plans stay short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.graph_reads import live
from loomgraph.operators.joins import dealt_by
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import ROWS_IN_TASK, durable, tasks_for

MAX_HOPS = 10


def traverse(edges: DataFrame, seeds: DataFrame, hops: int, both_ways: bool = False) -> DataFrame:
    """Entities reached from ``seeds`` (entity_id) in 1 to ``hops`` steps, with the least number of steps."""
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be between 1 and {MAX_HOPS}")
    steps = edges.select("source", "target")
    if both_ways:
        steps = steps.union(edges.select("target", "source"))
    steps = durable(steps, "steps")  # read in every round
    seen = seeds.select("entity_id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(steps, F.col("entity_id") == F.col("source")).select(F.col("target").alias("entity_id")).distinct()
        frontier = durable(reached.join(seen, "entity_id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.filter("hop > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, caps: tuple[int, ...] = (100, 50)) -> DataFrame:
    """Distinct edges around the seeds in either direction; each level keeps ``caps`` edges in a fixed order."""
    level, out = seeds.select("entity_id").distinct(), None
    for k in range(depth):
        forward = edges.join(level, F.col("source") == F.col("entity_id")).select("rel_type", "source", "target", F.col("target").alias("other"))
        back = edges.join(level, F.col("target") == F.col("entity_id")).select("rel_type", "source", "target", F.col("source").alias("other"))
        found = [x.distinct().orderBy("rel_type", "source", "target").limit(caps[min(k, len(caps) - 1)]) for x in (forward, back)]
        both = durable(found[0].union(found[1]).withColumn("level", F.lit(k + 1)), "level")
        out = both if out is None else out.union(both)
        level = both.select(F.col("other").alias("entity_id")).distinct()
    return out.groupBy("rel_type", "source", "target").agg(F.min("level").alias("level"))


def transitive_closure(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """All (source, target) pairs connected by a path, by doubling path lengths."""
    closure = durable(edges.select("source", "target").distinct(), "closure")
    n = closure.count()
    for _ in range(max_rounds):
        hop = closure.select(F.col("source").alias("middle"), F.col("target").alias("end"))
        longer = closure.join(hop, F.col("target") == F.col("middle")).select("source", F.col("end").alias("target"))
        closure = durable(closure.union(longer).distinct(), "closure")
        m = closure.count()
        if m == n:
            return closure
        n = m
    raise RuntimeError("closure did not settle")


def roots(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``nodes`` (id, parent) with their root and depth by pointer doubling.

    A parent that does not exist makes its child a root; nodes on or below a cycle get no root.
    """
    known = nodes.select(F.col("id").alias("__p"))
    state = nodes.join(known, F.col("parent") == F.col("__p"), "left").select("id", F.coalesce("__p", "id").alias("up"))
    state = durable(state.withColumn("depth", (F.col("id") != F.col("up")).cast("long")), "roots")
    for _ in range(max_rounds):
        above = state.select(F.col("id").alias("__i"), F.col("up").alias("__u"), F.col("depth").alias("__d"))
        moved = state.join(above, F.col("up") == F.col("__i"))
        done = moved.filter("up <> __u").isEmpty()
        if done:
            break
        state = durable(moved.select("id", F.col("__u").alias("up"), (F.col("depth") + F.col("__d")).alias("depth")), "roots")
    tops = state.filter("id = up AND depth = 0").select(F.col("id").alias("root"))
    joined = state.join(tops, F.col("up") == F.col("root"), "left")
    return joined.select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def lineage_depth(nodes: DataFrame) -> DataFrame:
    return roots(nodes).filter("root IS NOT NULL")


def ppmi(mentions: DataFrame, group: str, name: str, tasks: int | None = None) -> DataFrame:
    """Positive pointwise mutual information of names that share a group (base 2).

    Mentions are dealt by group once (to so many ``tasks``, if given), and names are told apart, counted and paired where they then lie.
    """
    one = dealt_by(mentions.select(group, F.lower(F.trim(name)).alias("a")), [group], tasks).distinct()
    n_groups = one.agg(F.countDistinct(group).alias("n"))
    alone = one.groupBy("a").agg(F.count("*").alias("n_a"))
    pairs = one.join(one.withColumnRenamed("a", "b"), group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    joined = pairs.join(alone, "a").join(alone.toDF("b", "n_b"), "b").crossJoin(n_groups)  # one row
    score = F.log2(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
    return joined.select("a", "b", "n_ab", score.alias("ppmi")).filter("ppmi > 0")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by weighted label propagation with fixed tie-breaks (least label)."""
    edges = durable(edges.select("a", "b", "n"), "links")  # read twice in every round
    both = edges.union(edges.select("b", "a", "n"))
    labels = durable(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.sum("n").alias("w"))
        votes = votes.union(labels.select(F.col("node").alias("a"), "label", F.lit(1).cast("long")))
        votes = votes.groupBy("a", "label").agg(F.sum("w").alias("w"))
        chosen = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("w"), "label"))["label"].alias("label"))
        chosen = durable(chosen, "labels")
        if chosen.join(labels, ["node", "label"], "left_anti").isEmpty():
            break
        labels = chosen
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman modularity of weighted undirected edges (a, b, n) under ``labels``."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    typed = edges.join(la, "a").join(lb, "b")
    inside = typed.groupBy("la").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("inside")).withColumnRenamed("la", "label")
    degree = edges.select(F.col("a").alias("node"), "n").union(edges.select("b", "n")).join(labels, "node").groupBy("label").agg(F.sum("n").alias("degree"))
    total = edges.agg(F.sum("n").alias("m"))
    parts = degree.join(inside, "label", "left").na.fill(0, ["inside"]).crossJoin(total)  # one row
    return parts.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def _best_labels(n_seeds: int, contiguous: bool):
    """Reads votes (id, n, a label of each seed) and gives each id (id, labels, own): per seed the label of the greatest weight, then the greatest label, and the
    weight of the label it has. A null ``n`` marks an id's own labels, which count once. Ids come in one piece each (``contiguous``), or all of a task's are held.
    """
    import numpy as np
    import pyarrow as pa

    def best(table: pa.Table) -> pa.RecordBatch:
        ids, at = np.unique(table["id"].to_numpy(), return_inverse=True)
        mine, n = table["n"].is_null().to_numpy(), table["n"].fill_null(1).to_numpy()
        labels, own = np.empty((len(ids), n_seeds), np.int64), np.empty((len(ids), n_seeds), n.dtype)
        for k in range(n_seeds):
            label = table[f"l{k}"].to_numpy()
            key = at * (label.max() + 1) + label
            order = np.argsort(key)
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            who, which, weight = at[order[first]], label[order[first]], np.add.reduceat(n[order], first)
            most = np.maximum.reduceat(weight, np.flatnonzero(np.diff(who, prepend=-1)))
            top = np.flatnonzero(weight == most[who])
            labels[who[top], k] = which[top]  # labels ascend, and the last one stays
            has = np.empty(len(ids), np.int64)
            has[at[mine]] = label[mine]
            kept = np.flatnonzero(which == has[who])
            own[who[kept], k] = weight[kept] - 1
        lists = lambda x: pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * n_seeds, x.ravel())
        return pa.RecordBatch.from_arrays([pa.array(ids), lists(labels), lists(own)], names=["id", "labels", "own"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if contiguous and rows >= ROWS_IN_TASK:
                table = pa.Table.from_batches(held)
                ids = table["id"].to_numpy()
                whole = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
                if whole:
                    yield best(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield best(pa.Table.from_batches(held))

    return run


def _propagated(edges: DataFrame, seeds: list[int], rounds: int) -> tuple[DataFrame, DataFrame]:
    """(id, node, codes) with the code of each node as a label, and (id, labels, own, n): per seed its label's code and the weight of its links of that label; ``n`` is that of all.

    A seed's codes ascend with the hash of name and seed, then the name, so ties go to the greatest code. A node's links are one row, and the labels of all seeds
    travel together. While there are at most ROWS_IN_TASK nodes, links fetch the labels of their ends from a broadcast table, and nothing is shuffled; above that
    labels are sent along the links, to tasks that follow the rows.
    """
    from loomgraph.operators.ordered import running_within

    kind = "double" if dict(edges.dtypes)["n"] in ("float", "double") else "long"
    carried = [f"l{k}" for k in range(len(seeds))]
    tasks = tasks_for(edges.sparkSession, 2 * edges.count())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).filter("node IS NOT NULL").distinct()
    every = nodes.select("node", F.posexplode(F.array(*map(F.lit, seeds))).alias("k", "seed")).withColumn("tie", F.xxhash64("node", "seed"))
    ranked = running_within(every, ["k"], [F.col("tie"), F.col("node")]).groupBy("node")
    ranked = ranked.agg(*(F.max(F.when(F.col("k") == k, F.col("row_number"))).cast("long").alias(c) for k, c in enumerate(carried)))
    codes = durable(ranked.select(F.col("l0").alias("id"), "node", F.array(*carried).alias("labels")), "codes")
    few = codes.count() <= ROWS_IN_TASK
    near = F.broadcast if few else lambda df: df

    at = lambda end: near(codes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")))
    met = edges.select("a", "b", F.col("n").cast(kind).alias("n")).join(at("a"), "a", "left").join(at("b"), "b", "left")
    both = met.select(F.col("a_id").alias("id"), F.struct(F.col("b_id").alias("other"), "n").alias("link")).union(met.select("b_id", F.struct("a_id", "n")))
    links = both.filter("id IS NOT NULL").repartition(tasks, "id").groupBy("id").agg(F.collect_list("link").alias("links"), F.sum("link.n").alias("n"))
    known = F.filter("links", lambda x: x["other"].isNotNull() & x["n"].isNotNull())
    links = durable(links.select("id", F.concat(known, F.array(F.struct(F.col("id").alias("other"), F.lit(None).cast(kind).alias("n")))).alias("links"), "n"), "links")

    def voted(labels: DataFrame) -> DataFrame:
        sent = near(labels.select(F.col("id").alias("other"), *(F.col("labels")[k].alias(c) for k, c in enumerate(carried))))
        if few:
            votes = links.select("id", F.inline("links")).join(sent, "other").select("id", "n", *carried)
        else:
            pushed = links.withColumnRenamed("id", "other").join(sent, "other").select(F.inline("links").alias("id", "n"), *carried)
            votes = pushed.repartition(tasks, "id")
        return durable(votes.mapInArrow(_best_labels(len(seeds), few), f"id long, labels array<long>, own array<{kind}>"), "labels")

    labels = codes
    for _ in range(rounds):
        chosen = voted(labels)
        settled = chosen.join(labels, ["id", "labels"], "left_anti").isEmpty()
        labels = chosen
        if settled:
            break
    else:
        labels = labels.drop("own").join(voted(labels).select("id", "own"), "id")
    return codes, labels.join(links.select("id", "n"), "id")


def seeded_communities(edges: DataFrame, seeds: list[int], rounds: int = 10) -> DataFrame:
    """(seed, node, label): weighted label propagation with ties broken by a hash of label and seed, all seeds at once.

    A node also votes once for its own label. It stops early once no label of any seed changes.
    """
    codes, labels = _propagated(edges, seeds, rounds)
    first = codes.select(F.col("node").alias("label"), F.posexplode("labels").alias("k", "code"))
    chosen = labels.join(codes.select("id", "node"), "id").select("node", F.posexplode("labels").alias("k", "code"))
    seed = F.array(*map(F.lit, seeds))[F.col("k")].alias("seed")
    return chosen.join(first, ["k", "code"]).select(seed, "node", "label")


def seeded_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(seed, modularity, communities) of labels (seed, node, label) over weighted undirected edges (a, b, n)."""
    la, lb = labels.toDF("seed", "a", "la"), labels.toDF("seed", "b", "lb")
    inside = edges.join(la, "a").join(lb, ["seed", "b"]).filter("la = lb").groupBy("seed", F.col("la").alias("label")).agg(F.sum("n").alias("inside"))
    ends = edges.select(F.col("a").alias("node"), "n").union(edges.select("b", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    degree = ends.join(labels, "node").groupBy("seed", "label").agg(F.sum("n").alias("degree"))
    parts = degree.join(inside, ["seed", "label"], "left").na.fill(0, ["inside"]).crossJoin(F.broadcast(edges.agg(F.sum("n").alias("m"))))  # one row
    share = F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return parts.groupBy("seed").agg(F.sum(share).alias("modularity"), F.count("*").alias("communities"))


def agreement(labels: DataFrame) -> DataFrame:
    """(s, t, ari): adjusted Rand index of every two seeds' labels (seed, node, label)."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    one, two = labels.toDF("s", "node", "x"), labels.toDF("t", "node", "y")
    cells = one.join(two, "node").filter("s < t").groupBy("s", "t", "x", "y").agg(F.count("*").alias("n"))
    both = cells.groupBy("s", "t").agg(pairs("n").alias("both"), F.sum("n").alias("nodes"))
    alone = labels.groupBy("seed", "label").agg(F.count("*").alias("n")).groupBy("seed").agg(pairs("n").alias("own"))
    joined = both.join(alone.toDF("s", "own_s"), "s").join(alone.toDF("t", "own_t"), "t")
    expected = F.coalesce(F.try_divide(F.col("own_s") * F.col("own_t"), F.col("nodes") * (F.col("nodes") - 1) / 2), F.lit(0.0))
    most = (F.col("own_s") + F.col("own_t")) / 2
    return joined.select("s", "t", F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("ari"))


def community_stability(edges: DataFrame, seeds: list[int], least_agreement: float = 0.6, rounds: int = 10) -> DataFrame:
    """Per seed its modularity and communities, which one is taken (most modular, then first), the mean agreement and its flag."""
    _, found = _propagated(edges, seeds, rounds)
    seed = F.array(*map(F.lit, seeds))[F.col("k")].alias("seed")
    each = found.select("id", "n", F.posexplode(F.arrays_zip("labels", "own")).alias("k", "of"))
    each = durable(each.select(seed, F.col("id").alias("node"), F.col("of.labels").alias("label"), F.col("of.own").alias("own"), "n"), "each")
    labels = each.select("seed", "node", "label")
    # a link within a community is seen from both its ends
    parts = each.groupBy("seed", "label").agg(F.sum("n").alias("degree"), (F.sum("own") / 2).alias("inside")).crossJoin(F.broadcast(edges.agg(F.sum("n").alias("m"))))  # one row
    share = F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    scored = parts.groupBy("seed").agg(F.sum(share).alias("modularity"), F.count("*").alias("communities"))
    mean = agreement(labels).agg(F.coalesce(F.avg("ari"), F.lit(1.0)).alias("mean_ari"))  # one row
    position = F.array_position(F.array(*map(F.lit, seeds)), F.col("seed"))
    best = scored.agg(F.max_by("seed", F.struct(F.round("modularity", 12), -position)).alias("best"))  # one row
    joined = scored.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(best))
    return joined.select("seed", "modularity", "communities", (F.col("seed") == F.col("best")).alias("selected"), "mean_ari", (F.col("mean_ari") < least_agreement).alias("low_stability"))


def degrees(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges that start and end at each entity; dealt to so many ``tasks``, if given, so that none holds more entities as they grow."""
    out = edges.select(F.col("source").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.union(edges.select("target", F.lit(0), F.lit(1)))
    both = both if tasks is None else both.repartition(tasks, "entity_id")
    return both.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def chain_hashes(rows: DataFrame, order: str, payload: Column) -> DataFrame:
    """Rows with the hash of (payload, payload hash of the row before): a link per row."""
    from loomgraph.operators.ordered import global_row_number

    numbered = durable(global_row_number(rows.withColumn("own_hash", F.sha2(payload, 256)), F.col(order)), "chain")
    before = numbered.select((F.col("row_number") + 1).alias("row_number"), F.col("own_hash").alias("__before"))
    link = F.sha2(F.concat("own_hash", F.coalesce("__before", F.lit(""))), 256)
    return numbered.join(before, "row_number", "left").withColumn("link_hash", link).drop("row_number", "__before")


@query(
    "g01_outgoing_traversal",
    """WITH RECURSIVE t AS (SELECT 'customer:1' AS id, 0 AS hop UNION SELECT e.target, t.hop + 1 FROM t JOIN edges e ON e.source = t.id WHERE t.hop < 3 AND e.deprecated = false)
    SELECT id AS entity_id, min(hop) AS hop FROM t WHERE id <> 'customer:1' GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    return traverse(live(g.edges), g.vertices.filter("entity_id = 'customer:1'"), 3)


@query(
    "g02_bidirectional_neighbourhood",
    """WITH s AS (SELECT DISTINCT rel_type, source, target FROM edges WHERE rel_type IN ('located_in', 'part_of')),
    f AS (SELECT * FROM s WHERE source = 'nation:3' ORDER BY rel_type, source, target LIMIT 100), b AS (SELECT * FROM s WHERE target = 'nation:3' ORDER BY rel_type, source, target LIMIT 100)
    SELECT rel_type, source, target FROM f UNION SELECT rel_type, source, target FROM b""",
)
def _(g: Graph) -> DataFrame:
    return neighbourhood(g.edges.filter("rel_type IN ('located_in', 'part_of')"), g.vertices.filter("entity_id = 'nation:3'"), 1).drop("level")


@query("g03_transitive_closure", "WITH RECURSIVE c AS (SELECT source, target FROM edges WHERE rel_type IN ('located_in', 'part_of') UNION SELECT c.source, e.target FROM c JOIN edges e ON c.target = e.source WHERE e.rel_type IN ('located_in', 'part_of')) SELECT source, target FROM c")
def _(g: Graph) -> DataFrame:
    return transitive_closure(g.edges.filter("rel_type IN ('located_in', 'part_of')"))


@query("g04_thread_roots", "SELECT message_id, first_value(message_id) OVER (PARTITION BY thread ORDER BY turn) AS root FROM messages WHERE thread IN (SELECT thread FROM messages GROUP BY 1 HAVING count(*) = max(turn) + 1)")
def _(g: Graph) -> DataFrame:
    whole = g.messages.groupBy("thread").agg(F.count("*").alias("n"), F.max("turn").alias("m")).filter("n = m + 1").select("thread")
    nodes = g.messages.join(whole, "thread").select(F.col("message_id").alias("id"), F.col("in_reply_to").alias("parent"))
    return roots(nodes).select(F.col("id").alias("message_id"), "root")


@query(
    "g05_subject_threading",
    """SELECT message_id, first_value(message_id) OVER (PARTITION BY regexp_replace(lower(subject), '^(re|fwd|fw)\\s*:\\s*', ''), sender, sent_s // 86400 ORDER BY sent_s, message_id) AS proxy_root FROM messages WHERE turn = 0""",
)
def _(g: Graph) -> DataFrame:
    from loomgraph.functions.text import normalize_subject

    first = g.messages.filter("turn = 0").withColumn("k", normalize_subject(F.lower("subject"))).withColumn("d", F.floor(F.col("sent_s") / 86400))
    w = Window.partitionBy("k", "sender", "d").orderBy("sent_s", "message_id")
    return first.select("message_id", F.first("message_id").over(w).alias("proxy_root"))


@query(
    "g06_ppmi",
    """WITH o AS (SELECT DISTINCT chunk_id, lower(object) AS a FROM claims), n AS (SELECT count(DISTINCT chunk_id) AS n FROM o), s AS (SELECT a, count(*) AS c FROM o GROUP BY 1),
    p AS (SELECT x.a, y.a AS b, count(*) AS n_ab FROM o x JOIN o y ON x.chunk_id = y.chunk_id AND x.a < y.a GROUP BY 1, 2)
    SELECT p.a, p.b, n_ab, round(log2(n_ab * n.n / (s.c * t.c)), 6) AS ppmi FROM p JOIN s ON p.a = s.a JOIN s t ON p.b = t.a, n WHERE log2(n_ab * n.n / (s.c * t.c)) > 0""",
)
def _(g: Graph) -> DataFrame:
    return ppmi(g.claims, "chunk_id", "object", g.tasks("lineitem")).select("a", "b", "n_ab", F.round("ppmi", 6).alias("ppmi"))


def _coassociation(g: Graph) -> DataFrame:
    from loomgraph.operators.joins import cooccurring_pairs

    return cooccurring_pairs(g.claims, ["document_id"], "object", g.tasks("lineitem"))


@query("g07_community_labels")
def _(g: Graph) -> DataFrame:
    return label_propagation(_coassociation(g).filter("n >= 2"))


@query("g07_community_stability")
def _(g: Graph) -> DataFrame:
    return community_stability(durable(_coassociation(g).filter("n >= 2"), "coassociation"), [1, 2, 3, 4, 5])


@query("g08_coassociation_graph", "SELECT a.object AS a, b.object AS b, count(*) AS n FROM (SELECT DISTINCT document_id, object FROM claims) a JOIN (SELECT DISTINCT document_id, object FROM claims) b ON a.document_id = b.document_id AND a.object < b.object GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return _coassociation(g)


@query("g09_connected_groups")
def _(g: Graph) -> DataFrame:
    keyed = _coassociation(g).filter("n >= 2").select(F.regexp_extract("a", r"(\d+)", 1).cast("long").alias("u"), F.regexp_extract("b", r"(\d+)", 1).cast("long").alias("v"))
    return connected_components(keyed)


@query("g10_degrees", "SELECT entity_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS entity_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return degrees(g.edges, g.tasks("lineitem", "orders"))


@query("g11_hash_chain", "SELECT n_nationkey, sha256(sha256(n_name) || coalesce(lag(sha256(n_name)) OVER (ORDER BY n_nationkey), '')) AS link_hash FROM nation")
def _(g: Graph) -> DataFrame:
    return chain_hashes(g.table("nation"), "n_nationkey", F.col("n_name")).select("n_nationkey", "link_hash")


def chain_faults(nodes: DataFrame, node: str, parent: str, payload: str, stored: str) -> DataFrame:
    """(node, fault, first_fault) of a tree of versions whose hash is sha256(payload, parent's stored hash).

    ``fault``: ``hash`` if the stored hash is not the recomputed one, ``missing_parent``, or ``cycle`` for nodes on or below one. A parent's stored hash
    is taken as it is, so a tampered node fails alone; ``first_fault`` is the faulty node nearest to the root on a node's path, itself included,
    and is null only where the whole path is good. Paths double in each round; a node that has not met a root when all paths could is below a cycle.
    """
    known = nodes.select(F.col(node).alias("__p"), F.col(stored).alias("__hash"))
    met = nodes.join(known, F.col(parent) == F.col("__p"), "left")
    right = F.sha2(F.concat(F.coalesce(payload, F.lit("")), F.coalesce("__hash", F.lit(""))), 256)
    fault = F.when(F.col(parent).isNotNull() & F.col("__p").isNull(), "missing_parent").when(~F.col(stored).eqNullSafe(right), "hash")
    own = durable(met.select(F.col(node).alias("id"), F.coalesce("__p", F.col(node)).alias("up"), fault.alias("fault")), "chain")
    state = durable(own.select("id", "up", F.when(F.col("fault").isNotNull(), F.col("id")).alias("first")), "chain")
    for _ in range(max(1, (state.count() - 1).bit_length()) + 1):
        above = state.select(F.col("id").alias("__i"), F.col("up").alias("__u"), F.col("first").alias("__f"))
        state = durable(state.join(above, F.col("up") == F.col("__i")).select("id", F.col("__u").alias("up"), F.coalesce("__f", "first").alias("first")), "chain")
    roots_ = own.filter("id = up").select(F.col("id").alias("__root"))
    ended = state.join(roots_, F.col("up") == F.col("__root"), "left").join(own.select("id", "fault"), "id")
    lost = F.col("__root").isNull()
    return ended.select(F.col("id").alias(node), F.when(lost, "cycle").otherwise(F.col("fault")).alias("fault"), F.when(lost, F.col("id")).otherwise(F.col("first")).alias("first_fault"))


@query(
    "g11_chain_faults",
    """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_custkey % 97 <> 5 AS good FROM customer),
    t AS (SELECT id, CASE WHEN NOT good THEN id END AS first FROM s WHERE parent IS NULL
      UNION ALL SELECT s.id, coalesce(t.first, CASE WHEN NOT s.good THEN s.id END) FROM s JOIN t ON s.parent = t.id)
    SELECT s.id AS c_custkey, CASE WHEN NOT good THEN 'hash' END AS fault, t.first AS first_fault FROM s JOIN t ON s.id = t.id""",
)
def _(g: Graph) -> DataFrame:
    """A binary tree of customers, hashed level by level; every id with remainder 5 modulo 97 is tampered with after its children were hashed."""
    rows = g.table("customer").select("c_custkey", F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"), "c_name")
    top = g.table("customer").agg(F.max("c_custkey")).first()[0] or 0
    level = durable(rows.filter("parent is null").withColumn("hash", F.sha2("c_name", 256)), "hashed")
    every = level
    for _ in range(top.bit_length() - 1):  # a level of the tree a round
        above = level.select(F.col("c_custkey").alias("__p"), F.col("hash").alias("__h"))
        level = durable(rows.join(above, F.col("parent") == F.col("__p")).select("c_custkey", "parent", "c_name", F.sha2(F.concat("c_name", "__h"), 256).alias("hash")), "hashed")
        every = every.union(level)
    tampered = every.withColumn("c_name", F.when(F.col("c_custkey") % 97 == 5, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return chain_faults(tampered, "c_custkey", "parent", "c_name", "hash")


@query("g12_query_subgraph", "SELECT q.c_custkey AS query_id, v.entity_id, v.entity_type FROM customer q JOIN edges e ON e.source = 'customer:' || CAST(q.c_custkey AS STRING) JOIN vertices v ON v.entity_id = e.target")
def _(g: Graph) -> DataFrame:
    asked = g.table("customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source"))
    return asked.join(g.edges.select("source", F.col("target").alias("entity_id")), "source").join(g.vertices.select("entity_id", "entity_type"), "entity_id").select("query_id", "entity_id", "entity_type")
