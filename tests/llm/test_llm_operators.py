"""The training-data operators against brute force, on small rows with every odd case."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import html, lm_scoring, media, mixing, packing, passages, quality, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, score double"


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


def fixture_rows() -> list[tuple]:
    """Copies, near copies, shared passages, repeated rows, nulls, empty, odd white space, long texts, ties."""
    base = words(1, 120)
    passage = words(2, 60)
    texts = [
        (1, base), (2, base), (3, base.replace("a", "b", 1)), (4, words(3, 50) + " " + passage), (5, passage + "\n" + words(4, 30)),
        (6, ""), (7, None), (8, "   \t\n "), (9, words(5, 6000)), (10, words(5, 3000) + " " + words(6, 40)), (11, "ünï çødé " * 40),
        (12, "ab " * 400), (None, base), (None, words(7, 80)), (13, words(8, 40)), (13, words(8, 40)), (13, words(9, 45)), (14, "one"),
        (15, "line one is here\nline one is here\nother line"), (16, "x" * 300), (17, "x" * 300 + "y"), (18, passage.upper()),
    ]
    return [(d, t, ("en", "de", None)[k % 3], ("s1", "s2", "s3", None)[k % 4], len(t or ""), "clash", 5, 0.1) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1 if k % 3 else 0, int(k in (4, 9))) for k in range(1, 18)] + [(1, None, None)], "doc_id long, quality int, toxic int")


def test_html_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies. Accept them all.</p></div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
    text. It goes on<p>Second &lt;para&gt; here, as well.<script>var x="</p>";</script></article><aside><p>Read this too. It is good.</p></aside>
    <div id="comments"><p>Great article. I liked it.</p></div><form><p>Sign up now. Please.</p></form><footer>&copy; 2020</footer"""
    kept, _ = html.main_blocks(page)
    assert kept == ["Title & more", "First bold text. It goes on", "Second <para> here, as well."]
    assert html.main_blocks(None) == ([], 0) and html.main_blocks("") == ([], 0) and html.main_blocks("<nav>a</nav>")[0] == []


LONG = "Many readers have asked us about this matter again and again. " * 8


@pytest.mark.parametrize(
    "clutter",
    ['<div class="comment">', '<section id="comments"><article>', '<div class="ad">', '<div class="text-ad">', '<div class="sidebar">', '<div class="cookie-notice">',
     "<aside>", "<form>", "<footer>", '<div class="comment-body">', '<div role="complementary">', '<div id="disqus_thread">', "<nav>"],
)
def test_html_clutter_inside_articles_goes(clutter):
    page = f"<body><article><h1>Title</h1><p>{LONG}</p>{clutter}<p>{LONG}clutter</p>{'</article>' if '<article' in clutter else ''}</{clutter[1:].split()[0].rstrip('>')}><p>The end.</p></article>"
    assert html.main_blocks(page)[0] == ["Title", LONG.strip(), "The end."]


@pytest.mark.parametrize("part", ['<div class="post-comments-guide">', '<div class="entry legal">', '<div class="sidebar-right"><main>', '<body class="has-sidebar">', '<div class="no-menu">'])
def test_html_names_that_only_look_like_clutter(part):
    assert html.main_blocks(f"<html>{part}<h2>How to</h2><p>{LONG}</p>")[0] == ["How to", LONG.strip()]


def test_html_cut_decides_where_blocks_say_little():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(5)) + "</ul>"
    soup = f"<body>{menu}<div><div>{LONG}</div><div>Two notes:</div><ul><li>salt</li><li>water</li></ul><div>{LONG}</div></div>{menu}<div>Imprint</div>"
    want = [LONG.strip(), "Two notes:", "salt", "water", LONG.strip()]
    blocks = html.page_blocks(soup)
    gain = [html.content_log_odds(b) for b in blocks]
    alone = [b.text for b, g in zip(blocks, gain) if g > 0]
    assert html.main_blocks(soup)[0] == want and alone != want


def test_html_never_fails_on_broken_pages():
    rng = np.random.default_rng(5)
    bits = ["<![foo[bar]]>", "<![CDATA[x", "<!", "<!--", "-->", "<!DOCTYPE", "<?php", "?>", "</", "<p", "<p>", "</p>", "<div class='", '"', "<a href=x>", "&#x", "&#99999999;", "&amp",
            "<script>", "</script>", "<article>", "</article>", "<br/>", "]]>", ">", "<", "\0", "text ", "é", "<b><i>", "</i></b>", "<table><tr><td>", "=", "<![if !IE]>", "<textarea>"]
    for _ in range(10_000):
        html.main_blocks("".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(1, 14))))
    assert html.main_blocks(f"<article><p>{LONG}</p><![foo[bar]]><p>After it, more.</p>")[0] == [LONG.strip(), "After it, more."]
    assert len(html.main_blocks("<div>x y. " * 20_000)[0]) <= 20_000


def test_minimum_cut_equals_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        gain = rng.normal(0, 2, n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]

        def cost(labels):
            wrong = sum(-g if keep else g for g, keep in zip(gain, labels) if (g < 0) == bool(keep))
            return wrong + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html.minimum_cut(gain, edges)) == pytest.approx(best)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>Hello there, you.</p>"), (2, None, "<p>Hello there, you.</p>")], "page_id long, url string, html string")
    rows = html.extract_main_text(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows)[0] == (1, "", 0) and len(rows) == 3


def n_words(text):
    return len((text or "").encode().split())


def test_mixing_meets_targets(docs):
    rows = mixing.mix_plan(docs).collect()
    plan = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in plan:
        sizes[r.source] += n_words(r.text)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= 2 * sizes[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    by_size = {sizes[s]: s for s in names}
    taken = defaultdict(int)
    for r in rows:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in names) and len(rows) == len(plan)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and sum(n_words(r.text) for r in mixed.collect()) == sum(taken.values())


def test_mixing_draws_by_key(spark):
    """Of each source exactly the documents of least key are drawn beyond whole epochs, and weight moves the key."""
    long = "w" * 200
    rows = [(k, " ".join([long] * 3) if k % 2 else words(k, 12), f"s{k % 3}") for k in range(3000)]
    found = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_source = defaultdict(list)
    for r in found:
        by_source[r.source_size, r.target].append(r)
    for (size, target), some in by_source.items():
        epochs, left = int(target // size), target - int(target // size) * size
        for r in sorted(some, key=lambda r: r.sampling_key):
            assert r.taken == epochs * r.size + max(0, min(r.size, int(left)))
            left -= r.size
    weight = {r.doc_id: 1 / (1 + abs(np.log(len(t) / r.size / 5.5))) for r, (_, t, _) in zip(sorted(found, key=lambda r: r.doc_id), rows)}
    draws = np.array([r.sampling_key * weight[r.doc_id] for r in found])  # exponential variates
    assert abs(draws.mean() - 1) < 0.08 and abs((draws < np.log(2)).mean() - 0.5) < 0.03


def test_mixing_buckets_are_small_whatever_the_weights(spark):
    keys = mixing.with_sampling_key(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w" * 200).alias("text")))
    n = 141
    most = keys.groupBy(F.floor(F.log("__key") * n)).count().agg(F.max("count")).first()[0]
    assert most < 20_000 * 0.37 / n * 2


def test_toxicity_finds_the_sentence():
    clean = [words(k, 60).replace(" ", ". ", 3).encode() for k in range(200)]
    bad = [words(1000 + k, 40).encode() + b". you zqidiot fool. " + words(2000 + k, 20).encode() for k in range(60)]
    weights, bias = toxicity.fit(clean[:150] + bad[:40], np.array([False] * 150 + [True] * 40))

    def scores(texts):
        out = []
        for t in texts:
            data = np.frombuffer(t, np.uint8)
            starts, first = toxicity.sentence_borders(data, np.array([0, len(data)]))
            out.append(toxicity.noisy_or(toxicity.sentence_logits(data, starts, weights, bias), first)[0])
        return np.array(out)

    assert (scores(bad[40:]) >= 0.3).mean() >= 0.9 and (scores(clean[150:]) >= 0.3).mean() <= 0.05
    data = np.frombuffer(bad[50], np.uint8)
    starts, _ = toxicity.sentence_borders(data, np.array([0, len(data)]))
    worst = starts[toxicity.sentence_logits(data, starts, weights, bias).argmax()]
    assert b"zqidiot" in bad[50][worst : worst + 25]


def test_toxicity_rows(docs, labels, nothing):
    rows = toxicity.score_documents(docs, labels, "tox").select("doc_id", "text", "tox").collect()
    assert len(rows) == len(fixture_rows()) and all(0 <= r.tox <= 1 for r in rows)
    assert all(r.tox == 0 for r in rows if not r.text)
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_scores_equal_brute_force(docs, labels):
    """Every score from the trained weights, sentence by sentence and n-gram by n-gram."""
    weights, bias = toxicity.train(docs, labels)
    rng = np.random.default_rng(2)
    weights, bias = np.where(rng.random(len(weights)) < 0.02, rng.normal(0, 1, len(weights)), 0).astype(np.float32), -3.0
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select("text", toxicity._score_column(model)(F.col("text")).alias("s")).collect()
    for r in rows:
        clean, sentence = 1.0, b""
        raw = (r.text or "").encode()
        parts = [p for p in __import__("re").findall(rb"[^.!?\n]*[.!?\n]|[^.!?\n]+$", raw)]
        assert b"".join(parts) == raw
        for sentence in parts:
            folded = np.array([32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 64 < c < 91 else c for c in sentence], np.uint8)
            found = {(n, int(b)) for n in toxicity.NGRAMS for b in toxicity.ngram_buckets(folded, n)}
            logit = bias + sum(float(weights[b]) for _, b in found)
            clean *= 1 - 1 / (1 + np.exp(-logit))
        assert r.s == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(k % 2, f"text {k} " * 10) for k in range(2000)] + [(4, "x" * 1000), (5, "long" * 70_000), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 0), (5, 0), (7, 0), (7, 1)], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels).collect()
    assert len(sample) == len({r.doc_id for r in sample}) and 5 not in {r.doc_id for r in sample}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 900)
    assert sum(len(r.text) for r in toxicity.training_rows(docs, labels).collect()) <= 1800


def test_quality_counts(docs):
    rows = quality.apply_quality_rules(docs).collect()
    assert len(rows) == len(fixture_rows())
    for r in rows:
        text = next(t for d, t, *_ in fixture_rows() if d == r.doc_id and n_words(t) == r.n_words)
        w = (text or "").encode().split()
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_sketch_cells_bound_the_error(spark):
    df = spark.range(0, 200_000, 37).withColumn("c", quality.sketch_cell(F.col("id")))
    assert df.filter("c > id OR id - c > id / 32").count() == 0
    assert df.select("c").distinct().count() < 32 * 14 + 64


def brute_simhash(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    import xxhash

    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("heavy", [64, 1])
def test_simhash_groups(docs, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY_BUCKET", heavy)
    rows = simhash.near_duplicate_groups(docs).collect()
    prints = [(d, brute_simhash(t)) for d, t, *_ in fixture_rows()]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in rows) == Counter(prints)
    nodes = sorted({p for _, p in prints})
    parent = {p: p for p in nodes}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, p in prints:
        least[find(p)].append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    assert all(r.component_id == name[find(r.fp % (1 << 64))] for r in rows)
    kept = simhash.drop_near_duplicates(docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(name.values()) and kept.columns == docs.columns


def test_threshold_allocation_is_optimal():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 9.0}, {-1: 0.0, 0: 2.0, 1: 30.0}, {-1: 0.0, 0: 7.0, 1: 60.0}]
    assert simhash.allocate_thresholds(costs, 2) == (8.0, [0, 0, 0, -1])


def brute_substrings(rows):
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        smaller = {u.encode()[k : k + 50] for e, u, *_ in rows if u and d is not None and e is not None and e < d for k in range(len(u.encode()) - 49)}
        mark = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in smaller:
                mark[k : k + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(np.int8)])) == 1).sum())
        out.append((d, len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot,refined", [(50_000, 4 << 20), (1, 100)])
def test_substring_dedup(docs, hot, refined, monkeypatch):
    monkeypatch.setattr(substrings, "MIN_HOT", hot)
    monkeypatch.setattr(substrings, "REFINE_BYTES", refined)
    rows = substrings.substring_digests(docs).collect()
    assert Counter(tuple(r) for r in rows) == brute_substrings(fixture_rows())


def test_substring_dedup_of_repeated_ids(spark):
    """Rows of one id lose only what they hold themselves, also where checksums of their texts agree."""
    passage = words(41, 40)
    first = "tail " + passage
    tag = zlib.crc32(first.encode()) & 0xFFFF
    other = next(t for t in (f"{words(42, 30)} {k}" for k in range(1 << 20)) if zlib.crc32(t.encode()) & 0xFFFF == tag)
    rows = [(1, passage + " " + words(43, 20)), (5, first), (5, other), (5, first), (5, other), (6, other), (3, None), (None, passage)]
    rows += [(7, words(k, 5) + passage[10:-20] + words(k + 50, 4)) for k in range(60)] + [(8, "x" * 400)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in substrings.substring_digests(df).collect()) == brute_substrings(rows)


def test_window_buckets_equal_all_comparisons():
    rng = np.random.default_rng(7)
    for _ in range(20):
        data = rng.integers(97, 99, int(rng.integers(50, 400)), dtype=np.uint8)
        data[100:160] = data[20:80] if len(data) > 160 else data[100:160]
        windows = [data[k : k + 50].tobytes() for k in range(len(data) - 49)]
        counts = Counter(windows)
        starts, bucket = substrings.window_buckets(data, np.arange(len(windows)))
        assert starts.tolist() == [k for k, w in enumerate(windows) if counts[w] > 1]
        assert len({(b, windows[s]) for s, b in zip(starts, bucket.tolist())}) == len(set(bucket.tolist())) == len({windows[s] for s in starts})


def test_anchors_do_not_depend_on_where_a_window_lies():
    rng = np.random.default_rng(0)
    shared = rng.integers(97, 101, 50, dtype=np.uint8)
    one = np.concatenate([rng.integers(97, 101, 333, dtype=np.uint8), shared, rng.integers(97, 101, 100, dtype=np.uint8)])
    two = np.concatenate([rng.integers(97, 101, 64, dtype=np.uint8), shared])
    sets = []
    for data, at in ((one, 333), (two, 64)):
        for part in (64, 1 << 16):
            places, keys, least = substrings.find_anchors(data, part)
            inside = (places >= at) & (places <= at + 34) & (keys.astype(np.uint32) == least[at])
            sets.append(sorted(zip((places[inside] - at).tolist(), keys[inside].tolist())))
    assert sets[0] and all(s == sets[0] for s in sets)


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t, *_ in fixture_rows())
    sequences = defaultdict(list)
    total = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(d == r.doc_id and len(i) == r.doc_tokens and i[r.start : r.start + r.length] == tuple(ids.tolist()) for d, i in want)
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(i) * n for (_, i), n in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packer_keeps_all_three_limits():
    done = []
    packer = packing.Packer(done.append, (64, 3, 20))
    rng = np.random.default_rng(1)
    sizes, prefixes = {}, {}
    items = []
    for k in range(60):
        n = int(rng.integers(1, 200))
        prefixes[k] = np.concatenate([[0], np.cumsum(rng.random(n) < 0.4)])
        sizes[k] = n
        items.append((k, n, prefixes[k]))
    packer.add(items)
    packer.fill(0)
    seen = defaultdict(list)
    for pieces in done:
        assert sum(p[2] for p in pieces) <= 64 and len(pieces) <= 3
        assert sum(prefixes[e][s + n] - prefixes[e][s] for e, s, n in pieces) <= 20
        for e, s, n in pieces:
            seen[e].append((s, n))
    for k, n in sizes.items():
        at = 0
        for s, m in sorted(seen[k]):
            assert s == at
            at += m
        assert at == n


def test_conversations_are_packed_under_the_loss_limit(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], words(100 * c + t, 30 + 10 * c)) for c in range(12) for t in range(5)]
    turns += [(20, 0, None, None), (21, 1, "assistant", words(9, 900)), (1, 1, "assistant", "~ later of one turn"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(2)
    examples = {(r.conv_id, r.turn): r.segments for r in packing.instruction_examples(df).collect()}
    assert len(examples) == 12 * 3 + 3 and [s.loss for s in examples[3, 1]] == [False, True] and [s.loss for s in examples[3, 5]] == [False]
    rows = packing.pack_conversations(df, limits=(512, 64, 96)).collect()
    sequences, seen = defaultdict(list), defaultdict(int)
    for r in rows:
        sequences[r.sequence_id].append(r)
        seen[r.conv_id, r.turn] += r.length
        assert r.loss_tokens <= r.length
    totals = [(sum(r.length for r in x), sum(r.loss_tokens for r in x)) for x in sequences.values()]
    assert all(n <= 512 and loss <= 96 for n, loss in totals) and max(loss for _, loss in totals) == 96
    assert seen == {(r.conv_id, r.turn): r.doc_tokens for r in rows}
    answer = [r for r in rows if (r.conv_id, r.turn) == (21, 1)]
    assert sum(r.loss_tokens for r in answer) == answer[0].doc_tokens
    assert packing.pack_conversations(df.limit(0)).count() == 0


def test_media_round_trip(docs):
    rows = media.media_columns(docs).collect()
    texts = Counter((d, (t or "").encode()) for d, t, *_ in fixture_rows())
    for r in rows:
        payload = media.decode_wav(r.media)
        assert (r.doc_id, payload[: r.n_bytes]) in texts and payload[r.n_bytes :] == bytes(len(payload) - r.n_bytes)
        assert len(payload) % 64 == 0 and len(payload) > 0 and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.fingerprints == sorted(r.fingerprints)
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert same[0].fingerprints == same[1].fingerprints and same[0].fingerprints


@pytest.mark.parametrize("batches", [1, 4])
def test_passage_dedup(docs, batches, monkeypatch):
    monkeypatch.setattr(passages, "BATCHES", batches)
    monkeypatch.setattr(passages.repeated_passages, "__defaults__", (batches,))
    rows = passages.passage_digests(docs).collect()
    fixture = [(d, (t or "").encode().split()) for d, t, *_ in fixture_rows()]
    starts = Counter(tuple(w[k : k + 35]) for _, w in fixture for k in range(len(w) - 34))
    want = Counter()
    for d, w in fixture:
        gone = {k + j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want


def test_index_is_kept_between_batches(spark, monkeypatch):
    """Later batches meet what earlier ones left, before and after the runs are compacted, and tables go at the end."""
    monkeypatch.setattr(passages, "MAX_RUNS", 1)
    shared, alone = words(31, 50), [words(60 + k, 60) for k in range(6)]
    batches = [[(1, shared + " a"), (2, alone[0])], [(3, alone[1]), (4, alone[2] + " x")], [(5, "b " + shared), (6, alone[3])], [(7, alone[2] + " y"), (8, "")]]
    index, met = passages.FingerprintIndex(spark, 3), []
    for rows in batches:
        index.add(spark.createDataFrame(rows, "row_key long, text string"))
        met.append({r.row_key for r in index.candidates().collect()})
    assert met == [set(), set(), {1, 5}, {1, 5, 4, 7}] and len(index.runs) == 1
    tables = list(index.runs)
    index.drop()
    assert not any(spark.catalog.tableExists(t) for t in tables)


@pytest.mark.parametrize("hot", [1 << 18, 1, 200])
def test_lm_scores(docs, labels, nothing, hot, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", hot)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    texts = [(d, ["^", *(t or "").encode().split(), "$"]) for d, t, *_ in fixture_rows()]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for d, ws in texts:
        if len(ws) > 2:
            uni[d not in good].update(ws[1:])
            bi[d not in good].update(zip(ws, ws[1:]))
    total, n_words = [sum(u.values()) for u in uni], len(uni[0] | uni[1])
    want = []
    for d, ws in texts:
        losses = []
        for k in (0, 1):
            scale = total[0] / total[k]
            p = []
            for a, b in zip(ws, ws[1:]):
                p1 = (uni[k][b] * scale + 1) / (total[0] + n_words)
                p.append((bi[k][a, b] * scale + 50 * p1) / (uni[k]["$" if a == "^" else a] * scale + 50))
            losses.append(-np.mean(np.log(p)) if len(ws) > 2 else 0.0)
        want.append((d is None, d or 0, len(ws) - 2, round(losses[0], 4), round(losses[1], 4)))
    rows = lm_scoring.score_documents(docs, labels).collect()
    found = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.target_loss, r.background_loss) for r in rows]
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-4)
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in rows)
    assert lm_scoring.score_documents(nothing, labels).count() == 0
    unlabelled = lm_scoring.score_documents(docs, labels.filter("quality = 7")).collect()
    assert len(unlabelled) == len(texts) and {r.score for r in unlabelled} == {0.0}


def test_empty_tables(nothing):
    assert mixing.mix_plan(nothing).count() == 0
    assert quality.apply_quality_rules(nothing).count() == 0
    assert simhash.near_duplicate_groups(nothing).count() == 0
    assert substrings.substring_digests(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert media.media_columns(nothing).count() == 0
    assert passages.passage_digests(nothing).count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0


CLASHES = "row row_key spans shorter target epochs source_size cut_key cut_words __id __hash __key __size __partial __copy __score __spans first block sampling_key taken".split()


@pytest.mark.parametrize("name", ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "packing"])
def test_stages_with_clashing_columns(spark, docs, labels, tmp_path, name):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    few = docs.filter("doc_id < 8 or doc_id is null")
    clashing = few.withColumns({c: F.lit(f"{c} stays") for c in CLASHES})
    plain = Counter(tuple(r)[:2] for r in stage(spark, few, str(tmp_path)).collect())
    out = stage(spark, clashing, str(tmp_path))
    rows = out.collect()
    assert Counter(tuple(r)[:2] for r in rows) == plain
    if name != "packing":
        assert out.columns == clashing.columns and all(r[c] == f"{c} stays" for r in rows for c in CLASHES)


def test_pipeline_equals_brute_force_in_sequence(spark, docs, labels, tmp_path):
    """Each stage's rows from the rows its predecessor kept, by plain Python where the stage is deterministic."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    given, stages = [(r.doc_id, r.text) for r in docs.collect()], dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("toxicity", "simhash_near_dedup", "suffix_array_dedup"):
        stages[name](spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in now.collect()]
        if name == "toxicity":
            assert not Counter(rows) - Counter(given)
        elif name == "simhash_near_dedup":
            shingled = [(d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))) for d, t in given for w in [(t or "").lower().encode().split()]]
            group = list(range(len(given)))
            for a in range(len(given)):
                for b in range(a):
                    x, y = shingled[a][1], shingled[b][1]
                    if 5 * len(x & y) >= 4 * len(x | y):
                        old, new = group[a], group[b]
                        group = [new if g == old else g for g in group]
            least = {}
            for g, (d, _) in zip(group, given):
                least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
            assert sorted((d is None, d or 0) for d, _ in rows) == sorted(least.values())
        else:
            want = brute_substrings(given)
            assert Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows) == Counter((w[0], w[4]) for w in want.elements())
        given = rows


def test_quality_query_matches_its_sql(spark, small_dir):
    from tests.compare import connect, differences

    assert differences(quality.op4_quality_rules(spark, small_dir), connect(small_dir), quality.OP4_SQL) == []
