"""The pipeline's near-copy stage against brute-force Jaccard on five-word shingles."""

import itertools
import random

import pytest

import corpus_pipeline
from tripweave.llm import resemblance, simhash
from tripweave.llm.common import ship


def brute_components(texts):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng):
    """Texts of 200 words and copies with one to nine words replaced (Jaccard about 0.95 to 0.63)."""
    texts = [None, "", "one two", "One  two", "one two three four five six"]
    for base in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for edits in range(1, 10):
            copy = list(words)
            for at in rng.sample(range(200), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    # a passage in common, and a crowd
    passage = [f"p{i}" for i in range(150)]
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([10, 25, 40, 60]))]) for _ in range(60)]
    return texts


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_by_brute_force(spark, block):
    ship(spark)
    texts = edited(random.Random(4))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(frame, block=block).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert resemblance.near_copies(frame.limit(0)).count() == 0


def test_stage_drops_copies_of_four_fifths(spark):
    texts = edited(random.Random(9))
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, x int")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()}
    assert kept == set(brute_components(texts))


def test_fingerprints_find_copies_before_any_band(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(resemblance, "ROUNDS", ())
    rng = random.Random(27)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        texts += [" ".join(words), " ".join([*words[:-1], "x"])]
    texts.append("alone " * 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(frame).collect()}
    want = {i: simhash_pairs(texts)[i] for i in range(len(texts))}
    assert got == want and sum(i != c for i, c in got.items()) >= 15


def test_a_crowd_costs_a_link_per_member_once(spark, monkeypatch):
    ship(spark)
    rng, given = random.Random(5), []
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(5)]) for _ in range(200)]
    real = resemblance.components
    monkeypatch.setattr(resemblance, "components", lambda links: given.append(links.distinct().count()) or real(links))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(frame, block=8).collect()}
    assert set(got.values()) == {0}
    assert sum(given[1:]) <= 2 * len(texts)


def simhash_pairs(texts):
    """Each copy with its original if their fingerprints differ in four bits or fewer."""
    marks = [simhash.fingerprint(t, resemblance.SHINGLE) for t in texts]
    return [i - 1 if i % 2 and (marks[i] ^ marks[i - 1]).bit_count() <= 4 else i for i in range(len(texts))]
