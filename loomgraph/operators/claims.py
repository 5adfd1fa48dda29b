"""Claims: validation, quarantine, supersession, corroboration, decay, chunking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import decay, value_change
from loomgraph.plans.model import Graph
from loomgraph.plans.registry import query
from loomgraph.session import durable

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
HEADING = re.compile(r"#{1,6}[ \t]+(\S.*?)\s*$")
#: Whole texts of a batch that goes to a Python worker, and characters of chunks, about, that it holds before it sends them on.
TEXTS, HELD_CHARS = 1000, 1 << 21


def overlapping_claims(claims: DataFrame, days: int) -> DataFrame:
    """Pairs of equal triples whose periods [created_on, created_on + days] meet.

    Each claim looks back over its own triple only as far as the period reaches: rows meet by bucket of
    the period's length and its neighbour, so long-lived triples form no all-pairs join.
    """
    day = F.datediff("created_on", F.lit("1970-01-01").cast("date"))
    one = claims.select("subject", "predicate", "object", F.col("claim_id").alias("a"), day.alias("x"), F.floor(day / days).alias("k"))
    two = one.select("subject", "predicate", "object", F.col("a").alias("b"), F.col("x").alias("y"), F.explode(F.array(F.col("k") - 1, "k", F.col("k") + 1)).alias("k"))
    met = one.join(two, ["subject", "predicate", "object", "k"]).filter("a < b")
    return met.filter(F.abs(F.col("x") - F.col("y")) <= days).select("a", "b").distinct()


def corroborate(mentions: DataFrame, entity: str, source: str, weight: Column, gate: float = 0.85, min_sources: int = 2) -> DataFrame:
    """Noisy-or of the mentions' weights per entity, distinct sources, and the promotion gate over both."""
    score = F.round(1.0 - F.product(1.0 - weight), 6)
    grouped = mentions.groupBy(entity).agg(score.alias("score"), F.countDistinct(source).alias("n_sources"))
    first = (F.col("n_sources") >= min_sources) & (F.col("score") >= gate)
    return grouped.withColumn("status", F.when(first, "first_class").otherwise("provisional"))


def source_reliability(mentions: DataFrame, entity: str, source: str, start: float = 0.7, rounds: int = 10, stop: float = 1e-3) -> DataFrame:
    """Truth discovery: entity scores from source reliability (noisy-or), reliability from the geometric mean of
    the scores a source supports, until the direction of the reliability vector settles."""
    pairs = durable(mentions.select(entity, source).distinct(), "mentions")
    trust = pairs.select(source).distinct().withColumn("trust", F.lit(start))
    for _ in range(rounds):
        scores = pairs.join(trust, source).groupBy(entity).agg((1.0 - F.product(1.0 - 0.5 * F.col("trust"))).alias("score"))
        new = durable(pairs.join(scores, entity).groupBy(source).agg(F.exp(F.avg(F.log(F.greatest("score", F.lit(1e-10))))).alias("trust")), "trust")
        both = new.select(source, F.col("trust").alias("n")).join(trust, source)
        dot, nn, tt = both.agg(F.sum(F.col("n") * F.col("trust")), F.sum(F.col("n") * F.col("n")), F.sum(F.col("trust") * F.col("trust"))).first()
        trust = new
        if dot is None or 1 - dot / max((nn * tt) ** 0.5, 1e-12) < stop:
            break
    return trust


def violations() -> Column:
    """Constraint violations of a claim as an array of (severity, rule)."""
    rule = lambda cond, severity, name: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule")))
    return F.array_compact(
        F.array(
            rule(F.col("subject").isNull() | (F.trim("subject") == ""), "ERROR", "missing_subject"),
            rule(F.col("object").isNull() | (F.trim("object") == ""), "ERROR", "missing_object"),
            rule(F.col("subject") == F.col("object"), "ERROR", "self_relation"),
            rule(~F.col("predicate").isin("made_by", "sold_by", "shipped_by"), "ERROR", "unknown_predicate"),
            rule((F.col("subject_type") != "part") | (F.col("object_type") != "supplier"), "ERROR", "domain_range"),
            rule((F.col("confidence") < 0) | (F.col("confidence") > 1), "ERROR", "confidence_range"),
            rule(F.col("confidence") < 0.5, "WARNING", "low_confidence"),
            rule((F.col("verdict") == "REFUTED") & (F.col("status") == "accepted"), "ERROR", "refuted_accepted"),
            rule(F.col("created_on").isNull(), "WARNING", "missing_date"),
        )
    )


def validated(claims: DataFrame) -> DataFrame:
    """Claims with their violations; any ERROR quarantines."""
    checked = claims.withColumn("violations", violations())
    return checked.withColumn("quarantined", F.exists("violations", lambda v: v["severity"] == "ERROR"))


def superseded(claims: DataFrame, keys: list[str], value: str, *order) -> DataFrame:
    """Claims with the later claim of their key that contradicts them, if there is one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = claims.withColumn("__final", F.last(value).over(w)).withColumn("__by", F.last("claim_id").over(w))
    contradicts = (F.col("claim_id") != F.col("__by")) & (value_change(F.col(value), F.col("__final")) == "contradiction")
    return last.withColumn("superseded_by", F.when(contradicts, F.col("__by"))).drop("__final", "__by")


def merge_claims(claims: DataFrame) -> DataFrame:
    """One row per triple: claims, best confidence, first date, documents."""
    return claims.groupBy("subject", "predicate", "object").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("created_on").alias("first_seen"), F.countDistinct("document_id").alias("documents")
    )


def split_chunks(text: str, cap: int) -> list[tuple[int, int]]:
    """Character spans of chunks: paragraphs gathered up to the cap, longer ones cut at sentences, then anywhere."""
    units: list[tuple[int, int]] = []
    at = 0
    for paragraph in text.split("\n"):
        start, end = at, at + len(paragraph)
        at = end + 1
        if end - start <= cap:
            units.append((start, end))
            continue
        cuts = [start, *(start + m.end() for m in SENTENCE_END.finditer(paragraph)), end]
        for a, b in zip(cuts[:-1], cuts[1:]):
            units += [(x, min(x + cap, b)) for x in range(a, b, cap)]
    chunks: list[list[int]] = []
    for a, b in units:
        if a == b:
            continue
        if chunks and b - chunks[-1][0] <= cap:
            chunks[-1][1] = b
        else:
            chunks.append([a, b])
    return [(a, b) for a, b in chunks]


def chunk_documents(docs: DataFrame, cap: int = 2000) -> DataFrame:
    """Chunks of every whole text with their character spans; null and empty texts have none."""

    def rows_of(key: int, text: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(split_chunks(text, cap)):
            yield key, k, a, b, text[a:b]

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return chunk_rows(given, rows_of, "doc_id long, chunk int, start int, end int, text string")


def token_estimate(n_chars: int) -> int:
    return n_chars // 4


def paragraphs_of(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """Spans of what lies between empty lines in text[first:last], stripped."""
    found, at = [], first
    for part in text[first:last].split("\n\n"):
        if part.strip():
            start = at + len(part) - len(part.lstrip())
            found.append((start, start + len(part.strip())))
        at += len(part) + 2
    return found


def structure(text: str) -> list[tuple[str | None, str, int, int]]:
    """(section, kind, start, end) of the stretches of a text whose tables are lines that begin with a bar and whose headings are
    lines of one to six number signs and a title: kind ``table``, or ``text`` for what lies between tables and headings, which hold no text of it."""
    found: list[tuple[str | None, str, int, int]] = []
    section, kind, start, at = None, "text", 0, 0
    for line in text.splitlines(keepends=True):
        heading = HEADING.match(line)
        now = "heading" if heading else "table" if line.lstrip().startswith("|") else "text"
        if now != kind or heading:
            found.append((section, kind, start, at))
            kind, start = now, at
        if heading:
            section = heading[1]
        at += len(line)
    found.append((section, kind, start, at))
    return [x for x in found if x[1] != "heading" and text[x[2] : x[3]].strip()]


def gather_chunks(text: str, cap: int, least: int = 100, first: int = 0, last: int | None = None) -> list[list[tuple[int, int]]]:
    """Chunks of text[first:last] as lists of spans that are joined by an empty line.

    Paragraphs (between empty lines, stripped) are gathered up to ``cap`` tokens; a longer one is cut at sentences, never
    within one; a chunk under ``least`` tokens joins its neighbour where the two fit under the cap.
    """

    def tokens(spans: list[tuple[int, int]]) -> int:
        return token_estimate(sum(b - a for a, b in spans) + 2 * (len(spans) - 1))

    def gather(spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        groups: list[list[tuple[int, int]]] = []
        for span in spans:
            if groups and tokens([*groups[-1], span]) <= cap:
                groups[-1].append(span)
            else:
                groups.append([span])
        return groups

    def sentences(a: int, b: int) -> list[list[tuple[int, int]]]:
        cuts = [a, *(m.end() for m in SENTENCE_END.finditer(text, a, b)), b]
        pieces: list[list[tuple[int, int]]] = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if pieces and token_estimate(y - pieces[-1][0][0]) <= cap:
                pieces[-1] = [(pieces[-1][0][0], y)]
            elif x < y:
                pieces.append([(x, y)])
        return pieces

    chunks: list[list[tuple[int, int]]] = []
    for group in gather(paragraphs_of(text, first, len(text) if last is None else last)):
        for piece in sentences(*group[0]) if tokens(group) > cap else [group]:
            small = chunks and min(tokens(chunks[-1]), tokens(piece)) < least
            if small and tokens([*chunks[-1], *piece]) <= cap:
                chunks[-1] = [*chunks[-1], *piece]
            else:
                chunks.append(piece)
    return chunks


def chunk_rows(texts: DataFrame, rows_of: Callable[[int, str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows_of`` gives for every key and text of ``texts`` (two columns), sent on whenever HELD_CHARS of text are held, however many or long the texts are."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))
    names = [column.split()[0] for column in schema.split(", ")]

    def chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                for row in rows_of(key, text):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str))
                    if size >= HELD_CHARS:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    return texts.mapInPandas(chunk, schema)


def token_chunks(docs: DataFrame, token_cap: int = 1000, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of every whole text up to 0.8 of ``token_cap`` (four characters a token), each opened by the end of the one before.

    ``start`` and ``end`` are the chunk's own place in the text; the first ``overlap_chars`` characters of ``chunk_text``
    are repeated from the chunk before. Null and blank texts have none.
    """
    cap, overlap = int(token_cap * 0.8), overlap_tokens * 4

    def rows_of(key: int, text: str) -> Iterator[tuple]:
        before = ""
        for k, spans in enumerate(gather_chunks(text, cap)):
            own = "\n\n".join(text[a:b] for a, b in spans)
            opened = before[-overlap:] if overlap else ""
            yield key, k, spans[0][0], spans[-1][1], opened + own, len(opened), token_estimate(len(opened + own))
            before = own

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return chunk_rows(given, rows_of, "doc_id long, chunk int, start int, end int, chunk_text string, overlap_chars int, n_tokens int")


def disposed(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims after a reviewer's decisions (claim_id, action, decided_on, new_object), one per claim.

    Quarantined claims become accepted or rejected; an edit accepts a new claim with the changed object (null keeps it) under
    a new id and leaves the old one superseded by it. Decisions about other claims, and unknown actions, change nothing.
    """
    first = decisions.groupBy("claim_id").agg(F.min_by(F.struct("action", "decided_on", "new_object"), F.struct("decided_on", "action")).alias("d"))
    joined = claims.join(first, "claim_id", "left")
    decided = (F.col("status") == "quarantined") & F.col("d.action").isin("accept", "reject", "edit")
    action = F.when(decided, F.col("d.action"))
    new_id = F.concat("claim_id", F.lit(":h"), F.sha2(F.concat_ws("|", "claim_id", "d.new_object"), 256).substr(1, 8))
    stamped = joined.withColumns({
        "__action": action,
        "status": F.when(action == "accept", "accepted").when(action == "reject", "rejected").when(action == "edit", "superseded").otherwise(F.col("status")),
        "decision_source": F.when(action.isNotNull(), "human"),
        "decided_on": F.when(action.isNotNull(), F.col("d.decided_on")),
        "superseded_by": F.when(action == "edit", new_id),
    })
    # an edited claim gives two rows: itself, and the one that takes its place
    side = F.explode(F.when(F.col("__action") == "edit", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__new")
    rows = stamped.select("*", side)
    fresh = F.col("__new") == 1
    rows = rows.withColumns({
        "claim_id": F.when(fresh, F.col("superseded_by")).otherwise(F.col("claim_id")),
        "object": F.when(fresh, F.coalesce("d.new_object", "object")).otherwise(F.col("object")),
        "status": F.when(fresh, "accepted").otherwise(F.col("status")),
        "superseded_by": F.when(~fresh, F.col("superseded_by")),
    })
    return rows.drop("d", "__action", "__new")


def structured_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", token_cap: int = 1000, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of whole texts with headings and tables (see ``structure``): a table is one chunk whatever its size, text is gathered as in
    ``token_chunks`` but never across a table or a heading, and small chunks join only within that.

    ``section`` is the heading above, null before the first. ``start`` and ``end`` are a chunk's own place; text opens with the end of the chunk before
    (``overlap_chars``), a table and what follows one do not. Null and blank texts have no chunks.
    """
    cap, overlap = int(token_cap * 0.8), overlap_tokens * 4

    def pieces(body: str) -> Iterator[tuple]:
        for section, kind, first, last in structure(body):
            if kind == "table":
                inner = body[first:last]
                start = first + len(inner) - len(inner.lstrip())
                yield section, kind, [(start, start + len(inner.strip()))]
            else:
                for spans in gather_chunks(body, cap, first=first, last=last):
                    yield section, kind, spans

    def rows_of(document: int, body: str) -> Iterator[tuple]:
        before, kind_before = "", "table"
        for k, (section, kind, spans) in enumerate(pieces(body)):
            own = "\n\n".join(body[a:b] for a, b in spans)
            opened = before[-overlap:] if overlap and kind == kind_before == "text" else ""
            yield document, k, section, kind, spans[0][0], spans[-1][1], opened + own, len(opened), token_estimate(len(opened + own))
            before, kind_before = own, kind

    given = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    return chunk_rows(given, rows_of, f"{key} long, chunk int, section string, kind string, start int, end int, chunk_text string, overlap_chars int, n_tokens int")


def marked_text(html: Column) -> Column:
    """A page as text with a number sign before headings, bars before table rows, and empty lines between blocks; scripts and styles go."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"\s+", " ")
    for pattern, mark in ((r"(?i)<h[1-6]\b[^>]*>", "\n\n# "), (r"(?i)<tr\b[^>]*>", "\n| "), (r"(?i)</t[dh]>", " | "), (r"(?i)</?(h[1-6]|p|div|li|ul|ol|table|section|article|header|footer|nav|aside|title)\b[^>]*>", "\n\n"), (r"<[^>]*>", "")):
        body = F.regexp_replace(body, pattern, mark)
    return F.trim(F.regexp_replace(F.regexp_replace(body, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


@query("a41_claim_merge", "SELECT subject, predicate, object, count(*) AS n, max(confidence) AS confidence, min(created_on) AS first_seen, count(DISTINCT document_id) AS documents FROM claims GROUP BY 1, 2, 3")
def _(g: Graph) -> DataFrame:
    return merge_claims(g.claims)


@query("c01_document_chunks")
def _(g: Graph) -> DataFrame:
    return chunk_documents(g.table("documents"))


@query("c01_token_chunks")
def _(g: Graph) -> DataFrame:
    return token_chunks(g.table("documents"))


@query("c01_structured_chunks")
def _(g: Graph) -> DataFrame:
    pages = g.table("pages").select("page_id", marked_text(F.col("html")).alias("body"))
    return structured_chunks(pages, "page_id", "body", 200, 20)


@query(
    "c20_human_override",
    """WITH d AS (SELECT DISTINCT claim_id, unit % 5 AS a FROM claims WHERE unit % 4 = 0)
    SELECT status, coalesce(decision_source, 'none') AS decision_source, object = 'edited' AS edited, superseded_by IS NOT NULL AS superseded, count(*) AS n FROM (
      SELECT CASE WHEN c.status = 'quarantined' AND a = 0 THEN 'accepted' WHEN c.status = 'quarantined' AND a = 1 THEN 'rejected' WHEN c.status = 'quarantined' AND a = 2 THEN 'superseded' ELSE c.status END AS status,
        CASE WHEN c.status = 'quarantined' AND a <= 2 THEN 'human' END AS decision_source, c.object, CASE WHEN c.status = 'quarantined' AND a = 2 THEN 'new' END AS superseded_by FROM claims c LEFT JOIN d ON c.claim_id = d.claim_id
      UNION ALL SELECT 'accepted', 'human', 'edited', NULL FROM claims c JOIN d ON c.claim_id = d.claim_id WHERE c.status = 'quarantined' AND a = 2) GROUP BY 1, 2, 3, 4""",
)
def _(g: Graph) -> DataFrame:
    actions = F.element_at(F.array(*map(F.lit, ("accept", "reject", "edit", "defer", "defer"))), (F.col("unit") % 5 + 1).cast("int"))
    decisions = g.claims.filter("unit % 4 = 0").select("claim_id", actions.alias("action"), F.col("created_on").alias("decided_on"), F.lit("edited").alias("new_object"))
    after = disposed(g.claims, decisions)
    marks = [F.coalesce("decision_source", F.lit("none")).alias("decision_source"), (F.col("object") == "edited").alias("edited"), F.col("superseded_by").isNotNull().alias("superseded")]
    return after.groupBy("status", *marks).agg(F.count("*").alias("n"))


@query(
    "c03_constraint_validation",
    """SELECT claim_id, CASE WHEN verdict = 'REFUTED' AND status = 'accepted' THEN true ELSE false END AS quarantined,
    ((confidence < 0.5)::INT + (verdict = 'REFUTED' AND status = 'accepted')::INT)::INT AS n_violations FROM claims""",
)
def _(g: Graph) -> DataFrame:
    return validated(g.claims).select("claim_id", "quarantined", F.size("violations").alias("n_violations"))


@query("c04_quarantine", "SELECT module, count(*) AS n FROM claims WHERE verdict = 'REFUTED' AND status = 'accepted' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return validated(g.claims).filter("quarantined").groupBy("module").agg(F.count("*").alias("n"))


@query("c07_idempotent_append", "SELECT claim_id FROM claims WHERE ordinal <= 3 AND unit NOT IN (SELECT unit FROM claims WHERE ordinal = 7)")
def _(g: Graph) -> DataFrame:
    done = g.claims.filter("ordinal = 7").select("unit")
    return g.claims.filter("ordinal <= 3").join(done, "unit", "left_anti").select("claim_id")


@query("c08_claim_listing", "SELECT claim_id, confidence FROM claims WHERE status = 'accepted' AND verdict = 'INSUFFICIENT' ORDER BY confidence DESC, claim_id LIMIT 50 OFFSET 100")
def _(g: Graph) -> DataFrame:
    return g.claims.filter("status = 'accepted' AND verdict = 'INSUFFICIENT'").orderBy(F.desc("confidence"), "claim_id").offset(100).limit(50).select("claim_id", "confidence")


@query(
    "c10_supersession",
    """WITH f AS (SELECT *, last_value(object) OVER w AS final, last_value(claim_id) OVER w AS newer FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY created_on, claim_id, object ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT claim_id, CASE WHEN claim_id <> newer AND final <> object AND NOT contains(final, object) AND NOT contains(object, final) THEN newer END AS superseded_by FROM f""",
)
def _(g: Graph) -> DataFrame:
    return superseded(g.claims, ["subject", "predicate"], "object", "created_on", "claim_id", "object").select("claim_id", "superseded_by")


@query("c13_source_reliability")
def _(g: Graph) -> DataFrame:
    return source_reliability(g.claims.filter("verdict = 'SUPPORTED'"), "subject", "object").select("object", F.round("trust", 4).alias("trust"))


@query(
    "c14_decay_counters",
    """SELECT module, count(*) AS processed, count(*) FILTER (age >= 0 AND d < confidence) AS decayed, count(*) FILTER (d <= 0.5 + 1e-9) AS floored, count(*) FILTER (age < 0) AS skipped FROM (SELECT *,
    CASE WHEN age < 0 THEN confidence ELSE greatest(0.5::DOUBLE, confidence * pow(2.0, -age / 180.0::DOUBLE)) END AS d FROM (SELECT *, (DATE '1997-01-01' - created_on) AS age FROM claims)) GROUP BY 1""",
)
def _(g: Graph) -> DataFrame:
    age = F.datediff(F.lit("1997-01-01").cast("date"), "created_on").cast("double")
    aged = g.claims.withColumn("age", age).withColumn("d", decay(F.col("confidence"), F.col("age"), 180.0, F.lit(0.5)))
    return aged.groupBy("module").agg(
        F.count("*").alias("processed"), F.count_if((F.col("age") >= 0) & (F.col("d") < F.col("confidence"))).alias("decayed"),
        F.count_if(F.col("d") <= 0.5 + 1e-9).alias("floored"), F.count_if(F.col("age") < 0).alias("skipped"),
    )


@query("c15_store_reconciliation", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'graph_only' WHEN b.k IS NULL THEN 'store_only' ELSE 'both' END AS side FROM (SELECT DISTINCT subject AS k FROM claims) a FULL JOIN (SELECT entity_id AS k FROM vertices WHERE entity_type = 'part') b ON a.k = b.k")
def _(g: Graph) -> DataFrame:
    a = g.claims.select(F.col("subject").alias("k")).distinct().withColumn("a", F.lit(1))
    b = g.vertices.filter("entity_type = 'part'").select(F.col("entity_id").alias("k"), F.lit(1).alias("b"))
    side = F.when(F.col("a").isNull(), "graph_only").when(F.col("b").isNull(), "store_only").otherwise("both")
    return a.join(b, "k", "full").select("k", side.alias("side"))


@query("c16_origin_merge", "SELECT module, CASE WHEN count(DISTINCT origin) > 1 THEN 'hybrid' ELSE min(origin) END AS origin FROM vertices GROUP BY 1")
def _(g: Graph) -> DataFrame:
    origin = F.when(F.countDistinct("origin") > 1, "hybrid").otherwise(F.min("origin"))
    return g.vertices.groupBy("module").agg(origin.alias("origin"))


@query("c17_router_shards", "SELECT CASE WHEN lang = 'de' THEN 'privileged' WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(g: Graph) -> DataFrame:
    shard = F.when(F.col("lang") == "de", "privileged").when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    return g.table("documents").groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("c18_quality_floors", "SELECT module, CASE WHEN m < 0.3 THEN 'fail' WHEN m < 0.5 THEN 'warn' ELSE 'pass' END AS grade FROM (SELECT module, avg(confidence) AS m FROM claims GROUP BY 1)")
def _(g: Graph) -> DataFrame:
    grade = F.when(F.avg("confidence") < 0.3, "fail").when(F.avg("confidence") < 0.5, "warn").otherwise("pass")
    return g.claims.groupBy("module").agg(grade.alias("grade"))


@query("c19_live_view", "WITH f AS (SELECT *, last_value(claim_id) OVER (PARTITION BY document_id, ordinal % 2 ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM claims) SELECT claim_id FROM f WHERE newest = claim_id")
def _(g: Graph) -> DataFrame:
    w = Window.partitionBy("document_id", F.col("ordinal") % 2).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = F.last("claim_id").over(w)
    stamped = g.claims.withColumn("newest", newest).withColumn("superseded_by", F.when(F.col("newest") != F.col("claim_id"), F.col("newest")))
    return stamped.filter("superseded_by IS NULL").select("claim_id")


@query("c21_off_schema_tokens", "SELECT DISTINCT predicate FROM claims WHERE predicate NOT IN ('made_by', 'sold_by')")
def _(g: Graph) -> DataFrame:
    terms = F.array_except(F.regexp_extract_all(F.concat(F.lit("(:part)-[:"), "predicate", F.lit("]->(:supplier)")), F.lit(r":(\w+)"), 1), F.array(*map(F.lit, ("part", "supplier", "made_by", "sold_by"))))
    return g.claims.select(F.explode(terms).alias("predicate")).distinct()
