"""The near-duplicate stage, against exact Jaccard coefficients."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tabula.llm import resemblance, simhash
from tests.llm.test_exact import docs


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in range(len(texts)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def texts(families, copies, length, changes):
    rng = random.Random(4)
    out = {}
    for _ in range(families):
        base = [f"w{rng.randrange(9000)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, changes)):
                words[rng.randrange(length)] = f"x{rng.randrange(9000)}"
            out[len(out)] = " ".join(words)
    return out | {len(out): None, len(out) + 1: " "}


@pytest.mark.parametrize("shape", [(20, 6, 120, 4), (2, 60, 150, 2)])
def test_stage_drops_exactly_the_near_copies(spark, shape):
    given = texts(*shape)
    want = {i for i, low in brute(given).items() if i == low}
    left = corpus_pipeline.without_copies(spark, docs(spark, [(i, t, "s") for i, t in given.items()]), "")
    assert {r["doc_id"] for r in left.collect()} == want


def test_rows_without_id_stay_and_empty_tables_work(spark):
    rows = docs(spark, [(None, "a b c d e f", "s"), (3, "A b c  d e f", "s"), (5, "a b c d e f", "s"), (3, "a b c d e f", "s")])
    assert sorted(map(repr, (r["doc_id"] for r in resemblance.deduplicated(rows).collect()))) == ["3", "None"]
    assert resemblance.deduplicated(rows.filter("false")).count() == 0


@pytest.mark.parametrize("crowd", [2, 64])
def test_groups_of_loose_copies_equal_brute_force(spark, crowd):
    """Copies of which only some pairs reach 0.8, in whole cells and in split ones."""
    given = texts(3, 25, 80, 5)
    found = resemblance.groups(docs(spark, [(i, t, "s") for i, t in given.items()]), crowd=crowd).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(given)


def test_equal_minima_of_sketches(spark):
    rng = np.random.default_rng(3)
    lows = rng.integers(0, 1 << 63, (40, 96), dtype=np.uint64)
    lows[1::2] = np.where(rng.random((20, 96)) < 0.5, lows[::2], lows[1::2])
    rows = [(resemblance.sketch(a), resemblance.sketch(b)) for a, b in zip(lows[::2], lows[1::2])]
    want = [int(((a >> np.uint64(24)) % 64 == (b >> np.uint64(24)) % 64).sum()) for a, b in zip(lows[::2], lows[1::2])]
    made = spark.createDataFrame(rows, "x array<long>, y array<long>").select(resemblance.equal_minima("x", "y").alias("n"))
    assert sorted(r["n"] for r in made.collect()) == sorted(want)


def test_stage_keeps_what_operator_10_links(spark):
    """Texts of one fingerprint whose coefficient is low: one of them goes."""
    cycle = "one two three four five " * 60
    given = {n: cycle + " ".join(f"{name}{i}" for i in range(8)) for n, name in enumerate("ab")}
    assert brute(given)[1] == 1
    rows = docs(spark, [(i, t, "s") for i, t in given.items()])
    assert {r["component_id"] for r in simhash.near_duplicates(rows).collect()} == {0}
    assert [r["doc_id"] for r in corpus_pipeline.without_copies(spark, rows, "").collect()] == [0]


def test_crowded_cells_in_several_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "LEAST_BLOCK", 4)
    given = texts(3, 25, 80, 5)
    found = resemblance.groups(docs(spark, [(i, t, "s") for i, t in given.items()]), crowd=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(given)


def test_pairs_of_a_block():
    """A forest joins a group of copies by one pair less than its sets; all pairs come from their first cell only."""
    made = list(texts(1, 60, 200, 3).values())[:60]
    hashes = [resemblance.shingle_set(t.encode()) for t in made]
    fine = np.array([list(resemblance.fine_sketch(h)) for h in hashes], np.uint8)
    keys = np.array([resemblance.band_keys(resemblance.minima(h)) for h in hashes])
    at, size = np.arange(60), np.array([len(h) for h in hashes])
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if (fine[a] == fine[b]).mean() >= 0.8 - resemblance.FINE_FAINT}
    ones, others = resemblance.met_pairs(at * 0, at, size, fine, None, 3, 0.8)
    assert len(near) > 400 and 40 < len(ones) < 60 and set(zip(ones, others)) <= near
    for band in (0, 3):
        pairs = set(zip(*resemblance.met_pairs(at * 0, at, size, fine, keys, band, 0.8)))
        assert pairs == {(a, b) for a, b in near if not (keys[a, :band] == keys[b, :band]).any()}
    assert resemblance.met_pairs(at * 0, at * 0, size, fine, keys, 0, 0.8) == ([], [])
    low = set(zip(*resemblance.met_pairs(at % 2, at, size, fine, keys, 0, 0.8)))
    assert {(min(p), max(p)) for p in low} == {(a, b) for a, b in near if a % 2 != b % 2}
