"""Mixing, spelling variants and the Merkle manifest against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tripweave.llm import merkle, mixing, variants
from tripweave.llm.common import ship, table

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, source string, lang string, n_chars long, sid int, size string, h int, class string, target int, pack int, word string, n int, `a.b` int, i string, tree string, leaf int, given int"


def rows(spark, given, partitions=3):
    ship(spark)
    filled = [(i, t, s, g, n, 1, "s", 2, "c", 3, 4, "w", 5, 6, "i", "t", 7, 8) for i, t, s, g, n in given]
    return spark.createDataFrame(filled, CLASHING).repartition(partitions)


# --- mixing ---------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in stopped]
        if not rest:
            return stopped
        level = (budget - sum(stopped.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > ceiling * sizes[s]]
        if not over:
            return {**stopped, **{s: weight[s] * level for s in rest}}
        stopped.update({s: ceiling * sizes[s] for s in over})


def test_mix_meets_targets_and_is_stable(spark):
    rng = random.Random(5)
    given = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), None if i % 37 == 0 else "hot" if i % 3 else f"s{rng.randrange(8)}é", "en", i) for i in range(3000)]
    given += [(None, None, "empty", None, None), (None, "", "empty", None, None)]
    first = mixing.mix(rows(spark, given), ["doc_id", "source", "a.b"]).collect()
    again = mixing.mix(rows(spark, given[::-1], 7), ["doc_id", "source"]).collect()
    assert Counter((r.pack.doc_id, r.taken) for r in first) == Counter((r.pack.doc_id, r.taken) for r in again)
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in first:
        sizes[r.pack.source] += r.size
        taken[r.pack.source] += r.taken
        largest[r.pack.source] = max(largest[r.pack.source], r.size)
        target[r.pack.source] = r.target
        assert r.size == len(WORDS.findall(given[r.pack.doc_id][1])) if r.pack.doc_id is not None else r.size == 0
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    for s in sizes:
        texts = sum(1 for r in first if r.pack.source == s)
        assert abs(taken[s] - target[s]) <= 1 + sizes[s] / texts, s
    assert taken["hot"] != 2 * sizes["hot"]


def test_mix_is_nested(spark):
    given = [(i, "w " * (1 + i % 90), "a" if i % 2 else "b", "en", i) for i in range(800)]
    held = [{r.pack.doc_id: r.taken // r.size for r in mixing.mix(rows(spark, given), ["doc_id"], weights=(1, 1), share=share).collect()} for share in (0.3, 0.6, 1.2)]
    for less, more in zip(held, held[1:]):
        # carried remainders move a threshold by a text at most
        assert sum(less[i] > more[i] for i in less) <= 3


def test_thresholds_refine_ties_and_crowds(spark):
    # equal hashes, neighbours in the last bits and a crowd in one bucket
    hashes = [7, 7, 7, 8, 9, (1 << 48) + 5, (1 << 59) + 1] + list(range(100, 400))
    given = [(1, 0, h, 10 + k % 3) for k, h in enumerate(hashes)]
    frame = spark.createDataFrame(given, "sid int, class int, h long, size long")
    sums = frame.groupBy("sid", "class", mixing._bucket(0).alias("prefix")).agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    for budget in (0, 4, 16, 20, 33, 45, 500, 1801, 3300):
        got = mixing.thresholds(frame, sums, spark.createDataFrame([(1, budget)], "sid int, rest long"), 0).first()
        by_hash = Counter()
        for _, _, h, size in given:
            by_hash[h] += size
        spent = 0
        for h in sorted(by_hash):
            if spent + by_hash[h] <= budget or 2 * (budget - spent) >= by_hash[h] and spent < budget:
                spent += by_hash[h]
            else:
                break
            if spent >= budget:
                break
        assert (got.spent, sum(s for _, _, h, s in given if h < got.cut)) == (spent, spent), budget


def test_mix_of_nothing(spark):
    assert mixing.mix(rows(spark, []), ["doc_id"]).collect() == []
    alone = mixing.mix(rows(spark, [(1, None, None, None, None)] * 3), ["doc_id"]).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(0, 0.0, 0)] * 3


# --- spelling variants ----------------------------------------------------------


def brute_variants(given):
    counts = Counter()
    for i, text in given:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for alike in holes.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def result(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_variants_by_brute_force(spark):
    ship(spark)
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 400")
    want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 2000 and any(r[1] for r in want) and result(variants.group_variants(docs)) == want


def test_blocks_of_any_size_find_the_same_pairs(spark):
    rng = random.Random(9)
    words = {"".join(rng.choices("abàé", k=rng.randint(7, 9))) for _ in range(300)}
    ship(spark)
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = [sorted(map(tuple, variants.near_words(vocab, block).collect())) for block in (1, 16, 1024)]
    assert found[0] == found[1] == found[2]
    assert len(set(found[0])) == len(found[0])
    want = {(a, b, 2) for a in words for b in words if a != b and one_edit(a, b)}
    assert set(found[0]) == want


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_variants_of_awkward_rows(spark):
    long = "ab" * 40_000
    crowd = " ".join(["Wonderful"] * 1200 + ["wonderfull"] * 110 + ["wonderfulls"] * 9 + ["ÀÉÎÕÜßÿ"] * 2 + ["Àéîõüßÿ"] * 3 + [long] * 2 + [long + "c"] * 3)
    given = [(5, crowd), (5, crowd), (None, crowd), (None, None), (6, ""), (7, "×÷×÷×÷× ×÷×÷×÷×")]
    docs = rows(spark, [(i, t, "s", "en", 1) for i, t in given])
    got = result(variants.group_variants(docs))
    assert got == brute_variants(given)
    chain = {r[0]: r for r in got}
    assert chain["wonderfulls"][1:3] == ("wonderfull", "wonderful")
    assert result(variants.group_variants(docs.limit(0))) == []


# --- Merkle manifest ------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        if (i ^ 1) < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 11, 16, 29])
def test_positions_in_the_log(n):
    leaves = [H(str(k)) for k in range(n)]
    builder = merkle.Builder()
    for leaf in leaves:
        builder.add(leaf)
    levels = merkle.height(n)
    root, want = builder.close(levels), tree(leaves)
    assert root == want[-1][0]
    for level in range(levels + 1):
        for j, h in enumerate(want[level]):
            assert builder.log[merkle.position(j << level, level, n)] == h
    assert len(builder.log) == sum(map(len, want))
    log = bytes.fromhex("".join(builder.log))
    for i in range(n):
        sides, held = merkle.read_siblings(log, i, n, levels)
        assert merkle.fold(leaves[i], sides, held.hex()) == root and merkle.proof_digest(sides, held.hex()) == H(*proof(want, i))


def brute_manifest(given):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s, g, n: H(*map(field, (i, s, g, n, t)))
    trees = defaultdict(list)
    for row in given:
        trees[row[3]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in names}
    top = tree([built[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, h, row) in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            out.append((row[0], h, built[g][-1][0], top[-1][0], H(*proof(built[g], i), *proof(top, k)), not bad))
    return Counter(out)


def proved(frame, **options):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(frame, {n: F.col(n) for n in names}, ["doc_id"], shown={"n_chars": more}, **options).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return Counter((r.pack.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in found)


@pytest.mark.parametrize("height", [2, 12])
def test_manifest_by_brute_force(spark, height):
    # blocks of four leaves need several tiers
    rng = random.Random(4)
    given = [(rng.choice([None, k, k, k, 7]), rng.choice([None, "", "é" * k, "x"]), rng.choice([None, "s"]), rng.choice([None, "", "en", "en", "en", "dé"]), rng.choice([None, k])) for k in range(130)]
    given += [(3, "same", "s", "en", 4)] * 9 + [(1, "alone", "s", "zz", 5)]
    assert proved(rows(spark, given), height=height) == brute_manifest(given)


def test_manifest_of_many_blocks(spark):
    given = [(k, None, None, "en", k) for k in range(2 * 4096 + 5)] + [(0, "x", "y", None, 1)]
    assert proved(rows(spark, given)) == brute_manifest(given)


def test_manifest_of_nothing(spark):
    assert proved(rows(spark, [])) == Counter()
