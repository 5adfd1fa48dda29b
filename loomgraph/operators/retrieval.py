"""Hybrid retrieval: lexical and vector candidates, fusion, selection, hydration, serialisation, federation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_reads import live
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query

RRF_K = 60
BM25_K1, BM25_B = 1.5, 0.75
#: Words that carry no meaning in a query.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def term_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the inverted index."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, n_docs: int, mean_length: float, key: str, queries: DataFrame, k: int) -> DataFrame:
    """Top k documents per query; ``queries`` has (query_id, term). Idf is ln(1 + (N - df + .5) / (df + .5))."""
    wanted = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / mean_length))
    weights = wanted.join(df, "term").select("term", key, (idf * part).alias("w"))
    scored = queries.distinct().join(weights, "term").groupBy("query_id", key).agg(F.round(F.sum("w"), 9).alias("score"))
    return top_k(scored.filter("score > 0"), ["query_id"], k, F.desc("score"), key)


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def semantic_top_k(queries: DataFrame, corpus: DataFrame, key: str, k: int, max_queries: int = 1000) -> DataFrame:
    """Exact cosine top k of all queries (query_id, vector) against all rows (key, embedding), in blocks of at most ``max_queries``.

    Only a block of queries, bounded by counting, is broadcast; a task multiplies it with its rows and cuts its own candidates down before anything is
    shuffled. Several blocks are written one by one.
    """
    from loomgraph.operators.vectors import exact_top_k

    return exact_top_k(queries, corpus, key, "embedding", k, max_queries)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Element-wise mean vectors in long form: label, pos, mean."""
    return df.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def assemble(long: DataFrame, label: str) -> DataFrame:
    """Long-form vectors back to arrays."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return long.groupBy(label).agg(F.transform(rows, lambda r: r["mean"]).alias("vector"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """``lists`` has query_id, strategy, item, rank; an item's score is the sum of 1 / (k + rank)."""
    scored = lists.groupBy("query_id", "item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "item")
    return scored.withColumn("position", F.row_number().over(w))


def within_budget(lines: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Lines up to the first that would overflow the budget of characters (a line costs its length plus one)."""
    w = Window.partitionBy(group).orderBy(order)
    running = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("__used", running).filter(F.col("__used") <= budget).drop("__used")


def serialize(lines: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    kept = within_budget(lines, group, order, text, budget)
    rows = F.sort_array(F.collect_list(F.struct(order, text)))
    return kept.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias("context"))


def lexical_rerank(pairs: DataFrame, query_text: Column, text: Column) -> DataFrame:
    """Default reranker: share of the query's words that the text has. Any column can take its place."""
    words = F.array_distinct(tokens(query_text))
    return pairs.withColumn("rerank_score", F.coalesce(F.try_divide(F.size(F.array_intersect(words, tokens(text))), F.size(words)), F.lit(0.0)))


_Q = "(1, 'the'), (1, 'anre'), (1, 'erthnd'), (2, 'tion'), (2, 'er'), (3, 'onand'), (3, 'ing')"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], x))"


def _queries(g: Graph) -> DataFrame:
    return g.spark.sql(f"SELECT * FROM VALUES {_Q} AS q(query_id, term)")


def _bm25(g: Graph, k: int) -> DataFrame:
    docs = g.table("documents").filter("text IS NOT NULL")
    index = term_index(docs, "doc_id", "text")
    n, mean = docs.agg(F.count("*"), F.avg(F.size(tokens(F.col("text"))))).first()
    return bm25(index, n, mean, "doc_id", _queries(g), k)


_BM25_SQL = f"""t AS (SELECT doc_id, {_TOK} AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    i AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
    q AS (SELECT * FROM (VALUES {_Q}) q(query_id, term)), df AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score
      FROM q JOIN i USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("r01_inverted_index", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return term_index(g.table("documents").filter("text IS NOT NULL"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query("r02_bm25_search", f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM b WHERE rank <= 50")
def _(g: Graph) -> DataFrame:
    return _bm25(g, 50).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_VEC = "SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


def _semantic(g: Graph, k: int) -> DataFrame:
    asked = g.table("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return semantic_top_k(asked, g.table("embeddings").select("vec_id", "embedding"), "vec_id", k)


@query("r03_semantic_top_k", f"SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({_VEC}) WHERE score > 0) WHERE r <= 20")
def _(g: Graph) -> DataFrame:
    return _semantic(g, 20).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("r05_graph_strategy", "WITH s AS (SELECT entity_id FROM vertices WHERE contains(name, 'Supplier') AND deprecated = false AND entity_key <= 20) SELECT DISTINCT e.target AS entity_id FROM edges e JOIN s ON e.source = s.entity_id WHERE e.target NOT IN (SELECT entity_id FROM s)")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.graph_algorithms import traverse

    seeds = live(g.vertices).filter(F.col("name").contains("Supplier") & (F.col("entity_key") <= 20))
    return traverse(g.edges, seeds, 1).select("entity_id")


@query("r06_temporal_filter", "SELECT entity_id FROM vertices WHERE deprecated = false AND (valid_from IS NULL OR valid_from <= DATE '2020-05-01') AND (valid_to IS NULL OR valid_to >= DATE '2020-05-31') ORDER BY valid_from DESC NULLS LAST, entity_id LIMIT 50")
def _(g: Graph) -> DataFrame:
    from loomgraph.operators.graph_reads import covers

    inside = covers(F.col("valid_from"), F.col("valid_to"), F.expr("DATE '2020-05-01'"), F.expr("DATE '2020-05-31'"))
    return live(g.vertices).filter(inside).orderBy(F.desc_nulls_last("valid_from"), "entity_id").limit(50).select("entity_id")


_LISTS = """SELECT 1 AS query_id, strategy, item, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, item)::INT AS rank FROM (
    SELECT 'amount' AS strategy, claim_id AS item, amount AS score FROM claims UNION ALL SELECT 'confidence', claim_id, confidence FROM claims
    UNION ALL SELECT 'ordinal', claim_id, ordinal FROM claims)"""


def _lists(g: Graph) -> DataFrame:
    scores = F.explode(F.create_map(F.lit("amount"), F.col("amount"), F.lit("confidence"), F.col("confidence"), F.lit("ordinal"), F.col("ordinal").cast("double"))).alias("strategy", "score")
    long = g.claims.select(F.col("claim_id").alias("item"), scores)
    ranked = top_k(long, ["strategy"], 50, F.desc("score"), "item")
    return ranked.select(F.lit(1).alias("query_id"), "strategy", "item", "rank")


@query("r07_reciprocal_rank_fusion", f"SELECT item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies FROM ({_LISTS}) WHERE rank <= 50 GROUP BY 1")
def _(g: Graph) -> DataFrame:
    fused = reciprocal_rank_fusion(_lists(g))
    return fused.select("item", F.round("score", 9).alias("score"), F.array_join("strategies", ",").alias("strategies"))


@query(
    "r09_lexical_rerank",
    f"WITH {_BM25_SQL} SELECT b.query_id, b.doc_id, round(len(list_intersect(t.w, ['anre', 'tion', 'erthnd'])) / 3, 6) AS rerank_score FROM b JOIN t USING (doc_id) WHERE rank <= 20",
)
def _(g: Graph) -> DataFrame:
    found = _bm25(g, 20).join(g.table("documents").select("doc_id", "text"), "doc_id")
    return lexical_rerank(found, F.lit("anre tion erthnd"), F.col("text")).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("r11_hydration", f"SELECT x.item, c.subject, v.name FROM (SELECT DISTINCT item FROM ({_LISTS}) WHERE rank <= 50) x JOIN claims c ON c.claim_id = x.item LEFT JOIN vertices v ON v.entity_id = c.subject")
def _(g: Graph) -> DataFrame:
    items = _lists(g).select("item").distinct()
    claims = g.claims.select(F.col("claim_id").alias("item"), "subject")
    return items.join(claims, "item").join(g.vertices.select(F.col("entity_id").alias("subject"), "name"), "subject", "left").select("item", "subject", "name")


@query(
    "r12_serialize_within_budget",
    """SELECT module, string_agg(line, chr(10) ORDER BY k) AS context FROM (SELECT module, k, line, sum(length(line) + 1) OVER (PARTITION BY module ORDER BY k ROWS UNBOUNDED PRECEDING) AS used
    FROM (SELECT module, claim_id || subject || predicate || object AS k, subject || ' ' || predicate || ' ' || object AS line FROM claims WHERE confidence > 0.9)) WHERE used <= 800 GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    key = F.concat("claim_id", "subject", "predicate", "object")
    lines = g.claims.filter("confidence > 0.9").select("module", key.alias("k"), F.concat_ws(" ", "subject", "predicate", "object").alias("line"))
    return serialize(lines, "module", "k", "line", 800)


@query(
    "r13_federated_merge",
    """WITH r AS (SELECT entity_type AS namespace, entity_key AS item, row_number() OVER (PARTITION BY entity_type ORDER BY confidence DESC, entity_key)::INT AS rank FROM vertices WHERE deprecated = false)
    SELECT item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS namespaces FROM r WHERE rank <= 20 GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    ranked = top_k(live(g.vertices), ["entity_type"], 20, F.desc("confidence"), "entity_key")
    lists = ranked.select(F.lit(1).alias("query_id"), F.col("entity_type").alias("strategy"), F.col("entity_key").alias("item"), "rank")
    return reciprocal_rank_fusion(lists).select("item", F.round("score", 9).alias("score"), F.size("strategies").cast("long").alias("namespaces"))


@query("r14_result_set_compare", "SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN a.claim_id IS NULL THEN 'added' WHEN b.claim_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT claim_id FROM claims WHERE confidence > 0.95) a FULL JOIN (SELECT claim_id FROM claims WHERE amount > 49) b ON a.claim_id = b.claim_id")
def _(g: Graph) -> DataFrame:
    a = g.claims.filter("confidence > 0.95").select("claim_id", F.lit(True).alias("old"))
    b = g.claims.filter("amount > 49").select("claim_id", F.lit(True).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return a.join(b, "claim_id", "full").select("claim_id", change.alias("change"))


@query(
    "r16_answer_grounding",
    """SELECT message_id, i::INT AS sentence, CASE WHEN max(CASE WHEN contains(lower(s), w) THEN sc END) >= 0.8 THEN 'high' WHEN max(CASE WHEN contains(lower(s), w) THEN sc END) >= 0.5 THEN 'medium' WHEN max(CASE WHEN contains(lower(s), w) THEN sc END) IS NULL THEN 'none' ELSE 'low' END AS grounding
    FROM (SELECT message_id, unnest(string_split(body, '. ')) AS s, generate_subscripts(string_split(body, '. '), 1) - 1 AS i FROM messages), (VALUES ('the', 0.9), ('er', 0.6), ('a', 0.3)) n(w, sc) GROUP BY 1, 2""",
)
def _(g: Graph) -> DataFrame:
    names = g.spark.createDataFrame([("the", 0.9), ("er", 0.6), ("a", 0.3)], "w string, sc double")  # three names
    sentences = g.messages.select("message_id", F.posexplode(F.split("body", r"\. ")).alias("sentence", "s"))
    hits = sentences.join(F.broadcast(names), F.lower("s").contains(F.col("w")), "left").groupBy("message_id", "sentence").agg(F.max("sc").alias("m"))
    grade = F.when(F.col("m") >= 0.8, "high").when(F.col("m") >= 0.5, "medium").when(F.col("m").isNull(), "none").otherwise("low")
    return hits.select("message_id", "sentence", grade.alias("grounding"))


@query("r17_prompt_within_budget", "SELECT thread, left(string_agg(sender || ': ' || subject, chr(10) ORDER BY turn), 200) AS prompt FROM messages GROUP BY 1")
def _(g: Graph) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "sender", "subject").alias("line"))))
    return g.messages.groupBy("thread").agg(F.substring(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 1, 200).alias("prompt"))


@query("r08_second_round", f"WITH l AS ({_LISTS}), f AS (SELECT item, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l WHERE rank <= 50 GROUP BY 1), t AS (SELECT item FROM f ORDER BY round(score, 12) DESC, item LIMIT 10) SELECT DISTINCT c.claim_id AS item FROM claims c JOIN claims s ON c.subject = s.subject JOIN t ON s.claim_id = t.item")
def _(g: Graph) -> DataFrame:
    top = reciprocal_rank_fusion(_lists(g)).filter("position <= 10").select(F.col("item").alias("claim_id"))
    subjects = g.claims.join(top, "claim_id", "left_semi").select("subject").distinct()
    return g.claims.join(subjects, "subject", "left_semi").select(F.col("claim_id").alias("item")).distinct()


@query("r15_permission_post_filter", f"SELECT DISTINCT x.item FROM ({_LISTS}) x JOIN claims c ON c.claim_id = x.item WHERE rank <= 50 AND c.module IN ('m1', 'm2')")
def _(g: Graph) -> DataFrame:
    allowed = g.claims.filter(F.col("module").isin("m1", "m2")).select(F.col("claim_id").alias("item"))
    return _lists(g).select("item").distinct().join(allowed, "item", "left_semi")
