"""Queries over more rows than a former bound let through."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import claims, retrieval
from loomgraph.plans import registry


def test_template_overlap_takes_every_template(spark, tmp_path):
    registry.load()
    items = [(k, f"only{k} here") for k in range(1300)]
    spark.createDataFrame(items, "item_id long, text string").repartition(4).write.parquet(str(tmp_path / "benchmark.parquet"))
    asked = {k: f"Only{k} only{k + 1}" for k in range(0, 1299, 13)}
    turns = [(k, 0, "user", text) for k, text in asked.items()] + [(5000, 0, "user", "unheard of")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = set()
    for k, text in [(k, t) for k, _, _, t in turns]:
        hits = [(-len(set(text.lower().split()) & set(item.split())), i) for i, item in items]
        want |= {(f"{k}-0", i, -o) for o, i in sorted(hits)[:5]}
    rows = registry.QUERIES["e20_template_overlap"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.message_id, r.item_id, r.overlap) for r in rows} == want


def test_semantic_top_k_takes_more_queries_than_a_block(spark):
    x = np.random.default_rng(5).standard_normal((130, 4))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = vectors.selectExpr("vec_id AS query_id", "embedding AS vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {(q, int(v)) for q in range(130) for v in np.lexsort((np.arange(130), -sims[q]))[:3] if sims[q, v] > 0}
    rows = retrieval.semantic_top_k(queries, vectors, "vec_id", 3, max_queries=40).collect()
    assert len(rows) == len(want) and {(r.query_id, r.vec_id) for r in rows} == want


def test_word_edges_are_those_of_the_sql(spark):
    from loomgraph.functions.text import PII_PATTERNS, ascii_edges, stance

    texts = ["der bestä er", "übest und", "the best.", "the_best", "besten", "best", "äyesß", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(F.col("t").rlike(ascii_edges(r"\b(most|best|largest)\b"))).collect()]
    assert found == [duckdb.execute(r"SELECT regexp_matches(?, '\b(most|best|largest)\b')", [t]).fetchone()[0] for t in texts] == [True, True, True, False, False, True, False, False]
    assert rows.filter(F.col("t") == texts[6]).select(stance(F.col("t"))).first()[0] == "affirm"
    for pattern in PII_PATTERNS[1:]:
        assert ascii_edges(pattern).startswith("(?<!") and ascii_edges(pattern).endswith("_])")


def test_stance_reads_word_edges_as_its_sql_does(spark, tmp_path):
    registry.load()
    texts = ["äyes", "yesß", "the名", "ЖTHE", "٣yes", "yes_", "é wrong é", "\U00010000yes", "yes\U0001d7ce", "\U0001f600yes\U0001f600", "wrongé", "»the«", "DİSAGREE", "yesİ", "İ yes", "not true", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["f26_stance"]).fetchall())
    found = {r.doc_id: r.stance for r in registry.QUERIES["f26_stance"](spark, str(tmp_path)).collect()}
    assert found == want and set(found.values()) == {"neutral", "affirm", "contradict"}


def test_document_chunks_are_the_spans_of_every_text(spark, tmp_path):
    registry.load()
    texts = ["One. " * 900 + "\n\nTwo\n" + "x" * 4100, "", None, "\n\n", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["c01_document_chunks"](spark, str(tmp_path)).collect()
    want = {(d, k, a, b, t[a:b]) for d, t in enumerate(texts) for k, (a, b) in enumerate(claims.split_chunks(t or "", 2000))}
    assert len(rows) == len(want) > 5 and set(map(tuple, rows)) == want
