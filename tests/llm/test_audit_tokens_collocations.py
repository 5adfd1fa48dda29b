"""Operators 11 to 13 against brute force, on small rows with every odd case."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import collocations, filter_audit, token_counts
from loomgraph.llm.common import table
from tests.compare import connect, differences
from tests.llm.test_llm_operators import SCHEMA, fixture_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 1 if k % 3 else 0, int(k in (4, 9))) for k in range(1, 18)] + [(1, None, None), (13, 0, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- operator 11


def replayed(rows: list[tuple], label_rows: list[tuple]) -> dict[tuple, tuple]:
    good = {d for d, q, _ in label_rows if q == 1 and d is not None}
    toxic = {d for d, _, t in label_rows if t == 1 and d is not None}
    least: dict[str, int] = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    facts = []
    for d, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and text in least and least[text] < d,
        }
        facts.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in facts if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                failing = [f for f in facts if f[0] == part and c in f[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(len(f[1]) == 1 for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows() -> list[tuple]:
    shout = "WORDS and #tags " * 90
    more = [(20, shout, "en"), (21, shout, "en"), (21, shout, "de"), (19, shout, None), (22, "a" * 50, ""), (None, shout, "en"), (23, None, "fr"), (24, "", "fr"), (24, "", "fr"), (24, "x", "fr")]
    return fixture_rows() + [(d, t, lang, "s", 0, "clash", 1, 0.5) for d, t, lang in more]


def test_audit_equals_replaying_every_order(spark, labels):
    docs = spark.createDataFrame(audit_rows(), SCHEMA).repartition(4)
    found = filter_audit.audit_filters(docs, labels)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == replayed(audit_rows(), [tuple(r) for r in labels.collect()])


def test_audit_matches_sql(spark, small_dir):
    assert differences(filter_audit.op11_filter_audit(spark, small_dir), connect(small_dir), filter_audit.OP11_SQL) == []


def test_audit_of_nothing_and_without_labels(spark, nothing, docs, labels):
    assert filter_audit.audit_filters(nothing, labels).count() == 0
    rows = filter_audit.audit_filters(docs, labels.limit(0)).collect()
    assert len(rows) == 600 * 3 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_potentials_are_the_games_shapley_values(spark):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 32)
    worth = [int(sum(counts[m] for m in range(32) if m & s)) for s in range(32)]
    row = spark.createDataFrame([(worth,)], "v array<long>").select(filter_audit.potentials(F.col("v")).alias("p")).first()
    for i in range(5):
        direct = 0
        for order in permutations(range(5)):
            before = sum(1 << k for k in order[: order.index(i)])
            direct += worth[before | 1 << i] - worth[before]
        assert row.p[31] - row.p[31 ^ 1 << i] == direct


# ---------------------------------------------------------------- operator 12


def counted(rows, least: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = []
    for (lang, *w), a in candidates.items():
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (other, *x), b in candidates.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if not any(100 * b >= 100 * a for b in longer):
            out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(best, 1)]
    return sorted(ranked)


def phrase_rows() -> list[tuple]:
    rng = np.random.default_rng(4)
    vocabulary = ["the", "The", "sea", "of", "été", "x\x00y", "a#b", "tide", "日本", "ſ"]
    rows = []
    for k in range(120):
        words = rng.choice(vocabulary, rng.integers(0, 40), p=[0.3, 0.1, 0.1, 0.2, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])
        marks = rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "!", "\x0c"], len(words))
        rows.append((k, "".join(w + m for w, m in zip(words, marks)), ("en", "de", None, "")[k % 4], "s", 0, "clash", 1, 0.5))
    return [*rows, *rows[:5], (None, "the sea the sea", "en", None, None, None, None, None), (200, None, "en", None, None, None, None, None), (201, "aa aa aa aa aa " * 3, "fr", None, None, None, None, None)]


@pytest.mark.parametrize("kept_bits", [64, 6])
def test_collocations_equal_brute_force(spark, kept_bits):
    """Six bits of a fingerprint make most phrases collide; counts stay exact."""
    docs = spark.createDataFrame(phrase_rows(), SCHEMA).repartition(3)
    found = collocations.mine_collocations(docs, least=8, top=40, kept_bits=kept_bits).collect()
    assert sorted(tuple(r)[:8] for r in found) == counted(phrase_rows(), 8, 40)
    texts = {}
    for d, text, *_ in phrase_rows():
        texts[d] = [w for w in re.split(r"[.,;:!?\x0A-\x0D\x20\x09]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    for r in found:  # pointers show the phrase
        words = r.phrase.split(" ")
        assert texts[r.example_doc_id][r.example_word : r.example_word + len(words)] == words


def test_collocations_match_sql(spark, small_dir):
    assert differences(collocations.op12_phrase_collocations(spark, small_dir), connect(small_dir), collocations.OP12_SQL) == []


def test_collocations_of_nothing(nothing):
    assert collocations.mine_collocations(nothing).count() == 0


def test_words_whose_hashes_meet_are_told_apart():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["one two one three two four"], pa.string()), "lang": ["en"], "doc_id": [1]})
    words = collocations.find_words(batch)
    words.hashes = np.array([7, 7, 7, 8, 7, 8], np.uint64)
    number, firsts = collocations.word_numbers(words)
    shown = [b"one", b"two", b"one", b"three", b"two", b"four"]
    assert [words.data[words.starts[firsts[k]] : words.ends[firsts[k]]].tobytes() for k in number] == shown
    assert len(set(number.tolist())) == 4


# ---------------------------------------------------------------- operator 13


def odd_texts() -> list[str | None]:
    rng = np.random.default_rng(1)
    bits = ["a", "b ", "  ", "\n", "▁", " ▁", "x▁y", "the", "é", "日本 ", "\t", "<s>", "</s>", "<unk>", "\x00", "\r\n", " word", "a" * 20, " " * 40, ".", "▀", "�", "▁▁▁the", "<0x0A>"]
    return [None, "", " ", "▁", "\n", *("".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(0, 30))) for _ in range(3000))]


def library_counts(texts: list[str | None]) -> list[int]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model_path())
    return [len(library.encode(t or "")) for t in texts]


@pytest.mark.parametrize("in_table", [0, 40, 4000])
@pytest.mark.parametrize("part_bytes", [64, 1 << 20])
def test_token_counts_of_odd_texts(monkeypatch, in_table, part_bytes):
    monkeypatch.setattr(token_counts, "PART_BYTES", part_bytes)
    texts = odd_texts()
    counters = token_counts.Counters(max(in_table, 1))
    for data, starts, _ in token_counts.parts(pa.array(texts, pa.string())):
        sizes = np.diff(np.append(starts, len(data)))
        short = sizes <= token_counts.KEY_BYTES
        counters.add(*token_counts.keys_of(data, starts[short], sizes[short]), np.ones(short.sum(), np.int64))
    path = token_counts.default_model_path()
    lengths = token_counts.length_table(token_counts.key_bytes(counters.low, counters.high)[:in_table], path)
    found = token_counts.token_counts(pa.array(texts, pa.string()), lengths, token_counts.PieceModel(path))
    assert [int(n) if t else 0 for n, t in zip(found, texts)] == library_counts(texts)


def test_token_counts_of_whole_tables(spark, small_dir, docs, nothing):
    for rows in (table(spark, small_dir, "documents"), docs):
        texts = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
        want = [(d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(texts, library_counts([t for _, t in texts]))]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted((tuple(r) for r in token_counts.count_tokens(rows).collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(nothing).count() == 0


def test_summaries_merge_in_tasks(spark, docs, monkeypatch):
    """With few summaries for the driver they are merged in rounds, and the heaviest pre-tokens are found."""
    monkeypatch.setattr(token_counts, "TO_DRIVER", 1)
    rows = docs.repartition(6)
    found = token_counts.frequent_pre_tokens(rows, 8)
    assert b" ab" in found and len(found) <= 8


def test_summary_keeps_what_is_certainly_frequent():
    rng = np.random.default_rng(3)
    values = np.concatenate([np.repeat(np.arange(5), 400), rng.integers(100, 3000, 3000)]).astype(np.uint64)
    rng.shuffle(values)
    counters = token_counts.Counters(16)
    for part in np.array_split(values, 40):
        counters.add(part, part, np.ones(len(part), np.int64))
    assert set(range(5)) <= set(counters.low.tolist()) and len(counters.low) <= 16
