"""Behaviour of operators on small hand-made rows."""

from __future__ import annotations

import datetime

import pytest
import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import claims, components, graph_algorithms, graph_reads, joins, ontology, ordered, resolution, retrieval, security, signals
from loomgraph.sources import formats


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    found = dict(values(components.connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert set(found[k] for k in range(41)) == {0} and set(found[100 + k] for k in range(30)) == {100}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rrf_sums_reciprocal_ranks(spark):
    lists = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 1), (1, "a", "y", 2)], "query_id int, strategy string, item string, rank int")
    rows = {r["item"]: r for r in retrieval.reciprocal_rank_fusion(lists).collect()}
    assert rows["x"]["score"] == pytest.approx(2 / 61) and rows["x"]["position"] == 1 and rows["x"]["strategies"] == ["a", "b"]


def test_interval_predicates_take_null_as_open(spark):
    d = datetime.date
    df = spark.createDataFrame([(None, None), (d(2020, 1, 1), d(2020, 2, 1)), (d(2020, 5, 1), None)], "a date, b date")
    low, high = F.lit(d(2020, 1, 15)), F.lit(d(2020, 3, 1))
    row = df.agg(F.count_if(graph_reads.overlaps(F.col("a"), F.col("b"), low, high)), F.count_if(graph_reads.covers(F.col("a"), F.col("b"), low, high))).first()
    assert tuple(row) == (2, 1)


def test_null_flag_is_not_live(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "deprecated boolean")
    assert graph_reads.live(df).count() == 1


def test_bar_tags(spark):
    row = spark.createDataFrame([(["b", "a", "a"], [])], "x array<string>, y array<string>").select(graph_reads.tags_to_bar(F.col("x")), graph_reads.tags_to_bar(F.col("y"))).first()
    assert tuple(row) == ("|a|b|", "")


def test_roots_with_a_missing_parent(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("o", "gone")], "id string, parent string")
    found = {r["id"]: (r["root"], r["depth"]) for r in graph_algorithms.roots(nodes).collect()}
    assert found == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "o": ("o", 0)}


def test_traversal_reports_least_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a")], "source string, target string")
    assert values(graph_algorithms.traverse(edges, spark.createDataFrame([("a",)], "entity_id string"), 3), "entity_id", "hop") == [("b", 1), ("c", 1), ("d", 2)]


def test_as_of_join_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, at long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 15, "b")], "k int, at long, v string")
    assert values(joins.as_of_join(left, right, ["k"], "at", "v").na.fill("-"), "k", "at", "prior_v") == [(1, 10, "-"), (1, 20, "b"), (2, 5, "-")]


def test_islands_and_trend(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabbb")] + [(2, 0, "a")], "k int, at int, v string")
    assert values(ordered.islands(df, ["k"], ["at"], "v"), "k", "v", "length") == [(1, "a", 2), (1, "b", 3), (2, "a", 1)]
    falling = spark.createDataFrame([("x", d, 12.0 - d) for d in range(12)], "k string, d int, y double")
    row = ordered.mann_kendall(falling, ["k"], "d", "y").first()
    assert row["s"] == -66 and row["trend"] == "decreasing"


def test_share_cap_with_backfill(spark):
    df = spark.createDataFrame([(1, k, k < 8) for k in range(10)], "q int, i int, chunk boolean")
    kept = [r["i"] for r in ordered.share_capped_top(df, ["q"], F.col("chunk"), 6, 0.5, "i").orderBy("position").collect()]
    assert kept == [0, 1, 2, 8, 9, 3]


def test_name_normalisation(spark):
    df = spark.createDataFrame([("Acme, Inc.",), ("Acme LLC",), ("Inc",), (None,)], "n string")
    assert [r[0] for r in df.select(text.normalize_entity_name(F.col("n"))).collect()] == ["acme", "acme", "inc", None]


def test_decay_and_verdicts(spark):
    df = spark.createDataFrame([(0.8, 180.0), (0.8, -5.0), (0.8, 1e6)], "c double, d double")
    assert [r[0] for r in df.select(text.decay(F.col("c"), F.col("d"), 180.0, F.lit(0.05))).collect()] == [0.4, 0.8, 0.05]


def test_close_strings_equal_all_pairs(spark):
    words = ["abcd", "abcx", "abc", "xbcd", "abdc", "zzzz", "a", ""]
    found = values(resolution.close_strings(spark.createDataFrame([(w,) for w in words], "t string"), "t", 1), "a", "b")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = sorted((a, b) for a in words for b in words if a < b and edits(a, b) <= 1)
    assert [p for p in found if "" not in p] == [p for p in want if "" not in p]


def test_explicit_deny_wins_in_its_tier(spark):
    requests = spark.createDataFrame([(1, "p", "vertex", "x", "read"), (2, "p", "vertex", "y", "read"), (3, "q", "vertex", "x", "read")], "request_id int, person string, kind string, label string, action string")
    members = spark.createDataFrame([("p", "c1"), ("p", "c2")], "person string, cluster string")
    rules = spark.createDataFrame([("c1", "vertex", "x", "read", "allow"), ("c2", "vertex", "x", "read", "deny"), ("c1", "*", "*", "read", "allow")], "cluster string, kind string, label string, action string, decision string")
    assert values(security.decide(requests, members, rules), "request_id", "decision") == [(1, "deny"), (2, "allow"), (3, "deny")]


def test_superseded_and_validated(spark):
    rows = [("c1", "part:1", "made_by", "50000", 1), ("c2", "part:1", "made_by", "75000", 2), ("c3", "part:2", "made_by", "12 Main", 1), ("c4", "part:2", "made_by", "12 Main St", 2)]
    df = spark.createDataFrame(rows, "claim_id string, subject string, predicate string, object string, at int")
    found = dict(values(claims.superseded(df, ["subject", "predicate"], "object", "at").na.fill("-"), "claim_id", "superseded_by"))
    assert found == {"c1": "c2", "c2": "-", "c3": "-", "c4": "-"}


def test_chunks_cover_the_text():
    body = "One. Two is here. Three!\n\n" + "word " * 500 + "\nlast"
    spans = claims.split_chunks(body, 100)
    assert all(b - a <= 100 for a, b in spans)
    assert "".join(body[a:b] for a, b in spans).replace("\n", "") == body.replace("\n", "")
    assert claims.split_chunks("", 10) == []


def test_schema_commands(spark):
    schema = spark.createDataFrame([("A", "p", "string"), ("B", "q", "int")], "class string, property string, type string")
    out = ontology.apply_commands(schema, [("split class", {"name": "A", "into": "C,D"}), ("rename property", {"cls": "B", "name": "q", "to": "r"})])
    assert values(out, "class", "property") == [("B", "r"), ("C", "p"), ("D", "p")]
    with pytest.raises(ValueError):
        ontology.apply_command(schema, "split class", name="A", into="C")


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: A <a@x.org>\nTo: b@y.org, c@z.org\nSubject: Re: hi\nMessage-ID: <1@x>\nIn-Reply-To: <0@x>\nReferences: <00@x> <0@x>\n\nBody here\n")
    row = formats.read_mail(spark, str(tmp_path)).first()
    assert (row["sender"], row["recipients"], row["message_id"], row["references"]) == ("a@x.org", ["b@y.org", "c@z.org"], "<1@x>", ["<00@x>", "<0@x>"])
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "m.mbox").write_bytes(b"From a\nFrom: a@x.org\nSubject: one\n\nx\n\nFrom b\nFrom: b@x.org\nSubject: two\n\ny\n")
    assert values(formats.read_mail(spark, str(tmp_path / "box"), mailbox=True), "subject", "sender") == [("one", "a@x.org"), ("two", "b@x.org")]


def test_similar_pairs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert resolution.similar_pairs(empty, "vec_id", "label", "embedding", 0.9).count() == 0


def test_pairs_at_the_threshold_are_met(spark):
    """Recall at a cosine of 0.85, on pairs made for it."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        x, y = rng.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, k // 50, x.tolist()), (2 * k + 1, k // 50, (0.8505 * x + np.sqrt(1 - 0.8505**2) * y).tolist())]
    df = spark.createDataFrame(rows, "key long, block int, vector array<double>")
    found = {(r.a, r.b) for r in resolution.similar_pairs(df, "key", "block", "vector", 0.85).collect()}
    assert len(found & {(2 * k, 2 * k + 1) for k in range(400)}) >= 396


def test_company_names(spark):
    """Names and results of the stated rules: one suffix or misreading of one, at a word's border, never the whole name."""
    names = ["Cedar Grove Residences LLO", "Apollo", "Costello", "Acme, Inc.", "Acme Company", "ACME  GmbH ", "LLC", "Acme L.L.C.", "Acme,LP", "Acme Corp. Ltd", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = ["cedar grove residences", "apollo", "costello", "acme", "acme company", "acme", "llc", "acme", "acme", "acme corp.", None]
    assert [r[0] for r in df.select(text.normalize_entity_name(F.col("n"))).collect()] == want
    read = spark.createDataFrame([("Cedar Grove Residences LLO",), ("Acme lnc.",), ("LLO",), ("Acme L.L.C.",), ("Apollo",)], "n string")
    assert [r[0] for r in read.select(text.expand_suffix_reading(F.col("n"))).collect()] == ["Cedar Grove Residences LLC", "Acme inc", "LLO", "Acme LLC", "Apollo"]


def _reference_linkage(vectors, threshold):
    """Average linkage by merging the closest two clusters until none reach the threshold."""
    x = {k: np.array(v, float) / np.linalg.norm(v) for k, v in vectors.items()}
    groups = [[k] for k in sorted(x)]
    while len(groups) > 1:
        best = max(((np.mean([x[p] @ x[q] for p in a for q in b]), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < threshold:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {k: min(m) for m in groups for k in m}


def test_average_linkage_equals_merging_one_pair_at_a_time(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    vectors = {k: list(map(float, centres[k % 6] + (0.25 + 0.1 * (k % 3)) * rng.standard_normal(16))) for k in range(60)}
    vectors[60] = vectors[7]
    df = spark.createDataFrame([(0, k, v) for k, v in vectors.items()], "block int, vec_id long, v array<double>")
    for threshold in (0.8, 0.9):
        found = dict(values(resolution.average_linkage(df, "block", "vec_id", "v", threshold), "vec_id", "cluster"))
        assert found == _reference_linkage(vectors, threshold)
        assert 6 <= len(set(found.values())) < 60


def test_average_linkage_of_nothing(spark):
    df = spark.createDataFrame([], "block int, vec_id long, v array<double>")
    assert resolution.average_linkage(df, "block", "vec_id", "v", 0.8).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_close_strings_of_any_length_equal_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    words = {"", "a", "ab", "abc"} | {"".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(60)}
    found = values(resolution.close_strings(spark.createDataFrame([(w,) for w in words], "t string"), "t", distance), "a", "b", "d")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    every = sorted((a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= distance)
    assert found == every


def test_resolution_tiers_in_order(spark):
    registry = spark.createDataFrame(
        [("r1", "org", "Acme", [1.0, 0.0]), ("r2", "person", "Ann Lee", [0.0, 1.0]), ("r3", "person", "Ann Ray", [0.6, 0.8]), ("r4", "person", "Bo Diaz", [1.0, 1.0])],
        "entity_id string, entity_type string, name string, vector array<double>",
    )
    mentions = spark.createDataFrame(
        [(1, "org", "Acme", None), (2, "org", "ACME, Inc.", None), (3, "person", "ann", [5.0, 0.1]), (4, "person", "Diaz", [0.0, 1.0]), (5, "org", "Other", [2.0, 0.1]),
         (6, "org", "Else", [0.9, 0.45]), (7, "org", "None", None), (8, "person", None, None)],
        "mention_id int, entity_type string, name string, vector array<double>",
    )
    plain = {r["mention_id"]: (r["tier"], r["candidate_id"]) for r in resolution.resolve(mentions, registry, ("person",), 0.95, 0.8).collect()}
    # "ann" opens two names, so it is no fragment of one; its vector decides
    assert plain == {1: ("exact", None), 2: ("normalized", None), 3: ("new", None), 4: ("new", "r4"), 5: ("embedding", "r1"), 6: ("new", "r1"), 7: ("new", None), 8: ("new", None)}
    judged = resolution.resolve(mentions, registry, ("person",), 0.95, 0.8, F.col("name") == "Diaz")
    assert ("adjudicated", "r4") in values(judged.filter("mention_id = 4"), "tier", "entity_id")


def test_cluster_quality_grades(spark):
    rows = [("c", 1, [1.0, 0.0], 0.9), ("c", 2, [1.0, 0.1], 0.1), ("s", 3, [1.0, 0.0], 0.9), ("s", 4, [0.0, 1.0], 0.9), ("r", 5, [1.0, 0.0], 0.5), ("r", 6, [1.0, 0.0], 0.5), ("one", 7, [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "cluster string, k int, v array<double>, p double")
    for tile in (1, 256):
        assert values(resolution.cluster_quality(df, "cluster", "k", "v", "p", tile), "cluster", "quality") == [("c", "clean"), ("one", "clean"), ("r", "review"), ("s", "suspect")]


def test_chunks_by_tokens():
    def estimate(s):
        return len(s) // 4

    def chunks(body, cap, least=100):
        return ["\n\n".join(body[a:b] for a, b in spans) for spans in claims.gather_chunks(body, cap, least)]

    assert chunks("", 10) == [] and chunks(" \n\n \n", 10) == []
    one, two, three = "a" * 400, "b" * 400, "c" * 800
    assert chunks(f"{one}\n\n\n {two}\n\n{three}", 220) == [f"{one}\n\n{two}", three]
    # a small one joins its neighbour only if both fit
    assert chunks(f"{three}\n\nend", 205) == [f"{three}\n\nend"] and chunks(f"{three}\n\nend", 200) == [three, "end"]
    long = " ".join(f"Sentence number {k} ends." for k in range(100))
    cut = chunks(long, 50, 0)
    assert "".join(cut) == long and len(cut) > 5 and all(estimate(c) <= 50 and c.startswith("Sentence") for c in cut)
    assert chunks("x" * 4000, 50) == ["x" * 4000]  # no sentence is cut


def test_chunks_are_sent_on_before_a_batch_is_done(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"Text {k}. " + "words and more. " * 30) for k in range(40)], "doc_id int, text string").coalesce(1)
    whole = sorted(map(tuple, claims.token_chunks(docs, 100, 5).collect()))
    monkeypatch.setattr(claims, "HELD_CHARS", 1000)
    sizes = []
    text = docs.toPandas()

    class Kept:
        sparkSession = spark

        def mapInPandas(self, chunk, schema):
            sizes.extend(len("".join(x.chunk_text)) for x in chunk(iter([text])))
            return docs

    rows = lambda key, body: iter([(key, body)])
    claims.chunk_rows(Kept(), rows, "doc_id long, chunk_text string")
    assert len(sizes) > 10 and max(sizes) < 2000 and sum(sizes) == sum(map(len, text.text))
    assert sorted(map(tuple, claims.token_chunks(docs, 100, 5).collect())) == whole and {r[0] for r in whole} == set(range(40))


def test_token_chunks_repeat_the_end_of_the_chunk_before(spark):
    body = "\n\n".join(f"{k:03d}" + "x" * 500 for k in range(9))
    rows = claims.token_chunks(spark.createDataFrame([(1, body, "e"), (2, None, "e"), (3, "  ", "e")], "doc_id int, text string, chunk_text string"), 400, 20).orderBy("chunk").collect()
    assert {r["doc_id"] for r in rows} == {1} and rows[0]["overlap_chars"] == 0 and len(rows) == 5
    for before, row in zip(rows, rows[1:]):
        own = row["chunk_text"][row["overlap_chars"] :]
        assert own == body[row["start"] : row["end"]] and row["chunk_text"][:80] == before["chunk_text"][-80:]


def test_decisions_on_claims(spark):
    found = spark.createDataFrame([(c, "quarantined", "o") for c in "abcd"] + [("e", "accepted", "o")], "claim_id string, status string, object string")
    day = datetime.date(2024, 1, 1)
    decisions = spark.createDataFrame(
        [("a", "accept", day, None), ("b", "reject", day, None), ("c", "edit", day, "p"), ("c", "reject", datetime.date(2024, 1, 2), None), ("e", "reject", day, None), ("zz", "accept", day, None)],
        "claim_id string, action string, decided_on date, new_object string",
    )
    rows = claims.disposed(found, decisions).collect()
    by_id = {r["claim_id"]: r for r in rows}
    fresh = by_id["c"]["superseded_by"]
    assert len(rows) == 6 and {k: r["status"] for k, r in by_id.items()} == {"a": "accepted", "b": "rejected", "c": "superseded", "d": "quarantined", "e": "accepted", fresh: "accepted"}
    assert by_id[fresh]["object"] == "p" and by_id["c"]["object"] == "o" and by_id["d"]["decision_source"] is None and by_id["e"]["decided_on"] is None


def _trend(ys):
    import math

    n = len(ys)
    s = sum(int(np.sign(ys[j] - ys[i])) for i in range(n) for j in range(i + 1, n))
    ties = sum(t * (t - 1) * (2 * t + 5) for t in (ys.count(y) for y in set(ys)))
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = 0.0 if s == 0 or var <= 0 else (s - np.sign(s)) / math.sqrt(var)
    return z, math.erfc(abs(z) / math.sqrt(2))


def test_trend_strength_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    series = {k: [int(y) for y in rng.integers(0, 9, 12) + (k - 4) * np.arange(12) // 2] for k in range(9)} | {9: [3] * 12, 10: list(range(9))}
    df = spark.createDataFrame([(k, d, y) for k, ys in series.items() for d, y in enumerate(ys)], "k int, d int, y int")
    for direction, sign in (("increasing", 1), ("decreasing", -1)):
        found = {r["k"]: r for r in signals.trend_strength(df, ["k"], "d", "y", direction).collect()}
        assert sorted(found) == list(range(10))  # the last one is too short
        for k, row in found.items():
            z, p = _trend(series[k])
            assert row["p"] == pytest.approx(min(p, 1), rel=1e-6)
            assert row["strength"] == pytest.approx(1 - p if z * sign > 0 and p < 0.05 else 0, abs=1e-6)


def test_deprecation_and_failure_signals(spark):
    start = datetime.date(2024, 1, 1)
    rows = [("m", "falls", start + datetime.timedelta(days=d), False) for d in range(12) for _ in range(20 - d)] + [("m", "flat", start + datetime.timedelta(days=d), False) for d in range(12)]
    rows += [("n", "old", start + datetime.timedelta(days=11), True)] * 2 + [(None, "old", start, True)] + [("m", None, start, True)] * 9
    df = spark.createDataFrame(rows, "module string, kind string, day date, old boolean")
    found = {r["module"]: r for r in signals.deprecation_signal(df, "module", "kind", "day", F.col("old"), F.lit(start + datetime.timedelta(days=11)), 30, 5, 4).collect()}
    assert set(found) == {"m", "n"} and found["m"]["strength"] > 0.99 and found["m"]["now"] is None
    assert (found["n"]["strength"], found["n"]["trend"]) == (0.5, None)

    runs = [("up", d, 100, d) for d in range(12)] + [("late", d, 10, 0 if d < 20 else 9) for d in range(25)] + [("few", 1, 4, 1), ("few", 2, 0, 0), ("none", 1, 0, 0)]
    failed = {r["m"]: r for r in signals.failure_signal(spark.createDataFrame(runs, "m string, d int, total int, failing int"), "m", "d", "total", "failing").collect()}
    assert failed["up"]["strength"] > 0.99 and failed["up"]["now"] == pytest.approx(0.11)
    # only the oldest twenty runs are looked at, and an empty run is not the last one
    assert failed["late"]["strength"] == 0 and failed["few"]["strength"] == 0.25 and "none" not in failed


def test_detectors_fail_alone(spark):
    good = lambda: spark.createDataFrame([("m", 0.5)], "module string, strength double")
    bad = lambda: spark.createDataFrame([("m", 1.0)], "module string, strength double").withColumn("strength", F.raise_error(F.lit("no")).cast("double"))
    for detectors, expected in (({"a": good, "b": good}, ("success", 2, 0)), ({"a": good, "b": bad}, ("partial_failure", 1, 1)), ({"b": bad}, ("error", 0, 1)), ({}, ("success", 0, 0))):
        records, status = signals.run_detectors(spark, detectors, "module string, strength double")
        row = status.first()
        assert (row["status"], row["succeeded"], row["failed"]) == expected and records.count() == expected[1] and len(row["failures"]) == expected[2]


def test_communities_of_planted_cliques(spark):
    cliques = [range(10 * c, 10 * c + 6) for c in range(4)]
    edges = [(f"{a:02d}", f"{b:02d}", 5) for m in cliques for a in m for b in m if a < b] + [("00", "10", 1), ("20", "30", 1)]
    df = spark.createDataFrame(edges, "a string, b string, n long")
    rows = graph_algorithms.community_stability(df, [7, 8, 9]).collect()
    weight, inside = sum(n for _, _, n in edges), 15 * 5
    ends = [30 * 5 + 1] * 4
    expected = sum(inside / weight - (e / (2 * weight)) ** 2 for e in ends)
    assert all(r["communities"] == 4 and r["modularity"] == pytest.approx(expected) and r["mean_ari"] == 1.0 and not r["low_stability"] for r in rows)
    assert [r["seed"] for r in rows if r["selected"]] == [7]


def test_agreement_equals_counting_pairs(spark):
    rng = np.random.default_rng(2)
    labels = {(s, k): int(rng.integers(0, 4)) for s in (1, 2, 3) for k in range(40)}
    df = spark.createDataFrame([(s, k, v) for (s, k), v in labels.items()], "seed int, node int, label int")
    for r in graph_algorithms.agreement(df).collect():
        x, y = ([labels[s, k] for k in range(40)] for s in (r["s"], r["t"]))
        pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
        a, b = sum(x[i] == x[j] for i, j in pairs), sum(y[i] == y[j] for i, j in pairs)
        both = sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs)
        assert r["ari"] == pytest.approx((both - a * b / len(pairs)) / ((a + b) / 2 - a * b / len(pairs)))


def test_formality(spark):
    words = spark.createDataFrame([(["the", "quick", "fox", "runs"],), (["i", "really", "will"],), (["and"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in words.select(text.formality(F.col("w"))).collect()] == [100.0, 0.0, 50.0, 50.0, 50.0]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "deep" / "b.md").write_text("# x")
    assert values(formats.file_inventory(spark, str(tmp_path / "in")), "suffix", "length") == [("md", 3), ("txt", 5)]
    assert values(formats.file_inventory(spark, str(tmp_path / "in"), "*.md"), "suffix") == [("md",)]
    (tmp_path / "list.json").write_text('{"path": "x"}\n{"path": "y", "other": 1}\n')
    assert values(formats.read_manifest(spark, str(tmp_path / "list.json")), "path") == [("x",), ("y",)]
    df = spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "", 0.5)], "k int, s string, x double")
    for _ in range(2):
        formats.append_events(df, str(tmp_path / "log"))
    assert values(spark.read.parquet(str(tmp_path / "log")), "k") == [(1,), (1,), (2,), (2,)]
    formats.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", "\\").csv(str(tmp_path / "csv")).orderBy("k").collect()
    assert [(r["k"], r["s"]) for r in back] == [("1", 'a,"b"\nc'), ("2", None)] or [(r["k"], r["s"]) for r in back] == [("1", 'a,"b"\nc'), ("2", "")]


def test_confident_similarity(spark):
    rows = spark.createDataFrame([(1.0, 0.0, True), (1.0, 0.0, False), (0.8, 0.2, False)], "s double, d double, same boolean")
    assert [r[0] for r in rows.select(text.confident_similarity(F.col("s"), F.col("d"), F.col("same"))).collect()] == [1.0, 0.0, 0.8]
