"""The pipeline's near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from loomgraph.llm import near_copies


def five_words(text: str | None) -> set[tuple]:
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copy_rows() -> list[tuple]:
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(1 << 40):x}"
    texts: list = ["", None, "one two", "One  Two", "one two three"]
    for k in range(30):
        now = [word() for _ in range((100, 300, 1000)[k % 3])]
        texts.append(" ".join(now))
        for _ in range(3):  # a chain: its ends may be further apart than its links
            now = list(now)
            for _ in range((1, 3, 20)[k % 3]):
                now[rng.integers(len(now))] = word()
            texts.append(" ".join(now))
    return [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts)]


def test_near_copies_from_similarity_on_are_linked(spark):
    rows = near_copy_rows()
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                gone, stays = group[a], group[b]
                group = [stays if g == gone else g for g in group]
    want = {min(d for (d, _), g in zip(rows, group) if g == one) for one in set(group)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(want)


def test_bitmaps_never_differ_in_more_bits_than_the_sets_in_shingles():
    draw = np.random.default_rng(5)
    for n in (0, 1, 7, 100, 3000):
        for changed in (0, 1, 5, n // 8, n):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: max(len(a) - changed, 0)], draw.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            x, y = near_copies.bitmap(a), near_copies.bitmap(b)
            assert len(x) == near_copies.BITMAP_WORDS
            differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert differ <= len(np.setxor1d(a, b))


def test_fingerprints_name_close_candidates(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{k}" for k in range(300)), " ".join(words).upper(), ""]
    schema = "doc_id long, text_hash long, id long, n int, bits array<long>, bands array<long>, fp long"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    rows = docs.mapInArrow(lambda b: near_copies.sketch(b, 5), schema).collect()
    ids = {r.doc_id: r.id for r in rows}
    classes = spark.createDataFrame(rows, schema).dropDuplicates(["id"])
    assert ids[0] == ids[3] and {r.doc_id: r.fp for r in rows}[4] == 0
    assert {frozenset((r.rep, r.id)) for r in near_copies.fingerprint_pairs(classes).collect()} == {frozenset((ids[0], ids[1]))}
