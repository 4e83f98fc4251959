"""The pipeline's near-duplicates stage against brute force over pairs."""

import numpy as np

import corpus_pipeline
from panelforge.llm import components, near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """Rows kept: the first of each component of pairs at 0.8 or more."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (len(a & b) >= 0.8 * len(a | b) and a and b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(rows[k][0] for k in range(len(rows)) if root(k) == k)


def edited(rng, text, edits):
    w = text.split()
    for k in rng.integers(0, len(w), edits):
        w[k] = f"edit{rng.integers(1 << 30)}"
    return " ".join(w)


def test_stage_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in rng.integers(8, 400, 60)]
    texts += [edited(rng, t, int(e)) for t in texts for e in rng.integers(0, 1 + len(t.split()) // 20, 3)]
    for t in [*texts[:5]]:  # chains of edits, whose ends are far apart
        for _ in range(12):
            texts.append(t := edited(rng, t, max(1, len(t.split()) // 60)))
    rows = [(k, t) for k, t in enumerate([*texts, None, "", " \n", "A b", "a B", "a b c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == brute_force(rows)


def test_rows_with_null_or_repeated_ids_and_different_texts_stay(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[2]), (9, texts[2]), (None, texts[2]), (3, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, texts[0]), (None, texts[1]), (9, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5])], key=repr)
    for got in (corpus_pipeline.near_duplicates(spark, docs, ""), simhash.keep_one_of_each(docs)):
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_rows_whose_keys_collide_are_not_lost(spark):
    docs = spark.createDataFrame([(1, "x", 5, 1), (2, "y", 5, 2), (3, "y", 6, 3)], "doc_id long, text string, __row_key long, __row_check long")
    found = spark.createDataFrame([(5, 5), (5, 6), (6, 6)], "row_key long, component long")
    assert sorted(map(tuple, near_copies.one_of_each(docs, found).collect())) == [(1, "x"), (2, "y")]


def test_candidates_miss_next_to_nothing_at_the_threshold():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2)
        a, b = h[:81], h[9:]  # 72 of 90 shared: 0.8
        assert near_copies.similarity(np.sort(a), np.sort(b)) == 0.8
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed <= 2


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(300)] + [(1000 + k, 1500) for k in range(200)] + [(5000, 5000)] + [(int(a), int(b)) for a, b in rng.integers(7000, 7200, (90, 2))]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {k: k for p in pairs for k in p}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
