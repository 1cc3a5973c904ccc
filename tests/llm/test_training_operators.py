"""The training-data operators against brute force, round trips and awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import bpe, chat, components, extract, hnsw, packing, quality, shuffle, simhash, toxicity, warc
from tripweave.llm.common import packed, ship, unpacked

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, pack string, fp long, "
    "component_id long, kept boolean, words string, place int, `a.b` string"
)


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = words(30_000, 1)
    base = words(300, 2)
    near = base.replace(base.split()[150], "other", 1)
    return [
        (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "one", "en"), (5, base, "en"), (6, base, "de"), (7, near, "en"),
        (7, near, "en"), (8, long, "fr"), (None, base, "en"), (9, "A b C d", "xx"), (10, "a b c d", None), (11, "λόγος ’s \x1c  ½ ２ 漢字!?\n\n  it's", "en"),
        (12, "aaaa" * 50 + "     \n\n\n   end", "en"), (None, None, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    rows = [(i, t, g, "src", len(t or ""), 0.5, "p", 1, 2, True, "w", 3, "d") for i, t, g in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (5, 0, 1), (8, 1, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


# --- components -----------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(60)] + [(None, 4), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2: SimHash -----------------------------------------------------------------


def brute_groups(prints, bits=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(prints):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return Counter((name, f"{fp:016x}", least.get(find(i))) for i, (name, fp) in enumerate(prints))


def test_fingerprint_by_definition():
    import xxhash

    text = "The QUICK\tbrown fox  jumps\nover é the"
    tokens = text.encode().lower().split()
    grams = [b" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_copies_of_awkward_rows(docs, texts):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect())
    assert got == brute_groups([(i, simhash.fingerprint(t)) for i, t, _ in texts])
    assert simhash.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("shared", [4, 5, 7])
def test_position_sets_cover(shared, width):
    sets = simhash.position_sets(shared, min(width, shared))
    for chosen in itertools.combinations(range(8), shared):
        assert any(set(s) <= set(chosen) for s in sets)


@pytest.mark.parametrize("block, list_length", [(512, 256), (8, 256), (16, 0)])
def test_links_lose_no_pair(spark, block, list_length):
    """Crowds of near fingerprints over blocks of any size and keys of any width."""
    ship(spark)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    links = simhash.linked(frame, 4, block, list_length).collect()
    flat = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links]
    assert all(bin(a ^ b).count("1") <= 64 for a, b in flat)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in flat:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = brute_groups(list(zip(prints, prints)))
    assert Counter((p, f"{p:016x}", find(p)) for p in prints) == want


# --- 1: toxicity ----------------------------------------------------------------


def brute_segments(scores):
    """All maximal segments by their definition, recursively from the best one."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (found is None or total > found[2] + 1e-9):
                    found = (i, j + 1, total)
        return found

    def walk(a, b):
        found = best(a, b)
        return [] if found is None else walk(a, found[0]) + [found] + walk(found[1], b)

    return walk(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = np.array([rng.choice([-1.0, -0.5, -0.25, 0.75, 2.0]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))])
        got, want = toxicity.segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_rate_is_the_positive_root():
    values, counts = np.array([-1.0, 2.0]), np.array([9.0, 1.0])
    rate = toxicity.karlin_rate(values, counts)
    assert 0.9 * np.exp(-rate) + 0.1 * np.exp(2 * rate) == pytest.approx(1, abs=1e-6) and rate > 0


def test_scores_of_awkward_rows(docs, labels):
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    back = unpacked(scored, docs.columns)
    assert back.columns == docs.columns and Counter(map(tuple, back.collect())) == Counter(map(tuple, docs.collect()))
    rows = scored.select("score", "predicted").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    from pyspark.sql import Row

    ship(spark)
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        body = words(60, i).split()
        toxic = i % 5 == 2
        if toxic:
            at = rng.randrange(50)
            body[at:at] = rng.sample(["vileword", "scumbag", "vilest"], 3)
        rows.append((i, " ".join(body)))
        marks.append(Row(doc_id=i, toxic=int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).select("pack.doc_id", "predicted", "passages").collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([scored[i].predicted == int(i % 5 == 2) for i in held]) > 0.95
    hit = scored[next(i for i in held if i % 5 == 2)]
    assert any(p.end_token - p.start_token >= 3 for p in hit.passages)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned, ~toxicity.held_out(F.col("doc_id"))) == model


@pytest.mark.parametrize("rivals, n", [(15, 100), (10, 60), (40, 120), (300, 330), (5, 3), (0.2, 1), (60, 20)])
def test_evidence_counts_every_segment(rivals, n):
    """The Poisson tail over all segments, however many there are and are expected."""
    import math

    length, rate, scale = 5000, 0.7, 0.3
    score = math.log(scale * length / rivals) / rate
    log_tail = lambda r: math.log(math.fsum(math.exp(k * math.log(rivals) - rivals - math.lgamma(k + 1)) for k in range(r, r + 2000)))
    want = max(-log_tail(r) for r in range(1, n + 1))
    assert toxicity.evidence([(0, 0, score)] * n, length, rate, scale) == pytest.approx(min(want, 200), rel=1e-9, abs=1e-12)


# --- 4: quality -----------------------------------------------------------------


def brute_measures(text):
    import re

    text = text or ""
    tokens = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(tokens, tokens[1:], tokens[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_by_brute_force(spark, docs, texts, labels):
    extra = ["a b c a b c a b c", "x y z x y", "# ** | <a>\nline\nline\n line\n\n", "é\x0bü\x0cß\r1 é ü ß 1", "a a a a", "a b c d a b c e b c d"]
    more = spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(extra)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(more)
    got = Counter((r.doc_id, *[r[c] for c in quality.BASE]) for r in quality.measure(rows, ["doc_id"]).select("pack.doc_id", *quality.BASE).collect())
    assert got == Counter((i, *brute_measures(t)) for i, t in [(i, t) for i, t, _ in texts] + [(100 + i, t) for i, t in enumerate(extra)])
    judged = quality.assess(docs, labels, docs.columns)
    assert judged.count() == docs.count() and unpacked(judged, docs.columns).columns == docs.columns
    assert quality.assess(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb, log

    cases = [(0, 1), (0, 500), (1, 300), (3, 1000), (7, 2000), (25, 4000), (0, 0)]
    got = spark.createDataFrame(cases, "k int, n int").select("k", "n", quality.log_binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        want = log(sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))) if r.k < r.n * 0.01 else 0.0
        assert r.p == pytest.approx(want, abs=1e-8)


def test_cutoffs_bound_false_rejections(spark):
    """Good texts with few symbols, bad ones with many, in two strata; a third has too few labels."""
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(2600):
        bad = i % 4 == 0
        body = words(60, i).split()
        for j in rng.sample(range(60), 30 if bad else rng.randint(0, 3)):
            body[j] += "%%"
        rows.append((i, " ".join(body), "few" if i < 40 else "ab"[i % 2]))
        marks.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.assess(docs, labels, ["doc_id"]).select("pack.doc_id", "kept").collect()}
    assert all(kept[i] for i in range(40))
    good = [i for i in range(40, 2600) if i % 4]
    assert np.mean([not kept[i] for i in good]) <= len(quality.RULES) * quality.RISK
    assert not any(kept[i] for i in range(40, 2600, 4))


# --- 5: shuffle -----------------------------------------------------------------


def test_shuffle_places_every_row_once(spark, docs):
    got = shuffle.shuffle(docs, 4, seed=3).select("pack.*", F.col("shard").alias("_s"), F.col("slot").alias("_t"))
    rows = got.collect()
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, docs.collect()))
    sizes = Counter(r._s for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r._t for r in rows if r._s == s) == list(range(sizes[s]))
    assert shuffle.shuffle(docs.limit(0), 4).count() == 0


def test_shuffle_ranges_stay_gapless(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "RANGE_ROWS", 50)
    rows = shuffle.shuffle(spark.range(2000), 3).collect()
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    first = [r.pack.id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(first, range(2000))[0, 1]) < 0.1


def test_matrix_is_exact_and_uniform():
    counts, sizes = [10, 0, 25, 5], [14, 13, 13]
    draws = np.array([shuffle.communication_matrix(counts, sizes, s) for s in range(2000)])
    assert (draws.sum(axis=2) == counts).all() and (draws.sum(axis=1) == sizes).all()
    assert draws[:, 2, 0].mean() == pytest.approx(25 * 14 / 40, abs=0.2)


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    good, bad, drawn = 3 * 10**9, 9 * 10**9, 100_000
    draws = [shuffle.hypergeometric(rng, good, bad, drawn) for _ in range(400)]
    assert np.mean(draws) == pytest.approx(25_000, abs=40)
    assert np.std(draws) == pytest.approx((drawn * 0.25 * 0.75) ** 0.5, rel=0.15)


# --- 6: chat --------------------------------------------------------------------


def test_conversations_read_back(spark):
    rows = [
        (1, 0, "system", "be [INST] good"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\[<\\\\ é"), (1, 2, "assistant", "a\\[<\\\\ é"), (1, 3, None, None),
        (2, None, "assistant", ""), (None, 0, "us[/INST] er", "x </s> y"), (3, 5, "user", "only"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").repartition(3)
    rendered = chat.render(chat.fold(chat.log_of(frame)))
    got = {r.conv_id: r for r in rendered.select("conv_id", "formatted", "loss_mask", chat.parse(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    by = {}
    for conv, seq, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == by
    for c, r in got.items():
        assert r.loss == "".join(t for role, t in by[c] if role == "assistant")
        assert r.formatted.count(" </s>") == len(by[c])
        for span in r.loss_mask:
            assert chat.START not in r.formatted[span.start : span.start + span.length]
    assert chat.render(chat.fold(chat.log_of(frame.limit(0)))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, "message", 0, "user", "Hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "Hel"), (1, 4, "delta", 1, None, "lo"),
        (1, 5, "message", 2, "user", "more"), (1, 6, "regenerate", 1, "assistant", None), (1, 7, "delta", 1, None, "Bye"),
        (1, 8, "edit", 0, None, "Hey"), (1, 9, "delta", 0, None, "!"),
        (2, 1, "message", 0, "user", "a"), (2, 2, "edit", 0, None, "b"), (2, 3, "edit", 0, "user", "c"), (2, 4, None, 1, "assistant", "d"),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(4)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(frame).collect())
    assert got == [(1, 0, "user", "Hey!"), (1, 1, "assistant", "Bye"), (2, 0, "user", "c"), (2, 1, "assistant", "d")]


# --- 7: packing -----------------------------------------------------------------


def test_packing_covers_every_id_once(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, length=64, with_ids=True).collect()
    want = Counter(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t, _ in texts)
    for doc, group in itertools.groupby(sorted((r for r in got if r.doc_id is not None and r.doc_id != 7), key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        group = list(group)
        ids = tuple(i for r in group for i in r.ids)
        assert want[ids] and [r.start for r in group] == list(np.cumsum([0] + [r.length for r in group])[:-1])
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in group)
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        group = list(group)
        size = sum(r.length for r in group)
        assert [r.offset for r in group] == list(np.cumsum([0] + [r.length for r in group])[:-1])
        assert size == 64 or size & (size - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_word_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for text in ["Don't <|endoftext|> a\x01b \x01 ć É\xa0x y", "", "a", "ΣΑΣ 12345 ½\x85z", "\x01"]:
        found = packing.word_encoder(path)(text.encode().split() or [b"x"])
        assert (list(found[0]) if text.split() else []) == tokenizer.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_choice():
    packer = packing.Packer(10)
    packer.levels[4], packer.levels[7] = 3, 1
    assert packer._level(3) == 4  # 4 -> 7: change -2*3+1 + 2*1+1 = -2; completing 7 -> 10: -2*1+1 = -1
    packer.levels[4] = 1
    assert packer._level(3) == 7


# --- 8: pages -------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header><article><h1>Title &amp; more</h1><p>One\n two<br>three"
     "<p><b>Bold</b> text<div class='ad-box'>Buy!</div><p>End</p><aside>Side</aside><p>x</p></article><footer>&copy; me</footer>", "Title & more\nOne two three\nBold text\nEnd\nx"),
    ("", ""), (None, ""), ("just text, no markup at all", "just text, no markup at all"),
    ("<div id=menu><a href=a>A</a> <a href=b>B</a></div><div>" + "Long text here. " * 10 + "</div><div>Second para with enough text.</div><div class='comments'><p>" + "I disagree strongly. " * 10 + "</p></div>",
     ("Long text here. " * 10).strip() + "\nSecond para with enough text."),
    ("<main><p>a &lt; b &#233; &nbsp;c</p><script>var x='<p>no</p>';</script><!-- <p>no</p> --><ul><li>i<li>j</ul><form><p>Name</p></form></main><p>outside</p>", "a < b é c\ni\nj"),
    ("<body><div class='cookie-notice'>We use cookies to serve you a better experience, please accept them all.</div><article><p>Short.</p></article></body>", "Short."),
    ("<article><p>unclosed <b>bold <p>next</article", "unclosed bold\nnext"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert extract.main_text(page) == want


def test_extract_rows(spark):
    ship(spark)
    rows = [(1, "u", PAGES[0][0], "t"), (None, None, None, None), (2, "u", "", "t"), (2, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extract(pages).collect()]
    assert Counter(got) == Counter([(1, PAGES[0][1], len(PAGES[0][1])), (None, "", 0), (2, "", 0), (2, "", 0)])
    assert extract.extract(pages.limit(0)).count() == 0


def test_very_long_page():
    body = "".join(f"<p>Paragraph number {i} of the page.</p>" for i in range(20_000))
    assert len(extract.main_text(f"<article>{body}</article>").split("\n")) == 20_000


# --- 9: WARC --------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    import base64

    ship(spark)
    same = "<p>same</p>"
    rows = [(1, "http://a/ü x\r\ny", same, "d"), (5, None, same, "d"), (5, None, same, "d"), (3, "u", same, None), (7, "u", "big" * 100_000, ""), (8, "u", None, ""), (9, "u", "", ""), (None, "u", "lonely", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index, folder = warc.archive(pages, str(tmp_path / "bundles"))
    got = warc.read(index, folder, with_payload=True).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    size = len(same)
    assert kinds == Counter([
        (1, size, sha(same), "revisit", 5), (5, size, sha(same), "response", None), (5, size, sha(same), "revisit", 5), (3, size, sha(same), "revisit", 5),
        (7, 300_000, sha("big" * 100_000), "response", None), (8, 0, sha(""), "revisit", 9), (9, 0, sha(""), "response", None), (None, 6, sha("lonely"), "response", None),
    ])
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {same.encode(), b"big" * 100_000, b"", b"lonely"}
    assert len({r.record_id for r in index.collect()}) == len(rows)
    empty, folder = warc.archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(empty, folder).count() == 0


def test_frames_stand_alone(tmp_path):
    import pyarrow.fs
    import zstandard

    path = str(tmp_path / "x.warc.zst")
    writer = warc.BundleWriter(open(path, "wb"))
    raws = [warc.record("response", f"urn:page:{i}:0", "u", bytes([i % 251]) * 90_000, "D") for i in range(30)]
    places = [writer.add(r) for r in raws]
    writer.close()
    reader = warc.BundleReader(pyarrow.fs.LocalFileSystem().open_input_file(path))
    assert len(reader.frames) > 3
    for (frame, offset), raw in reversed(list(zip(places, raws))):
        assert reader.frame(frame)[offset : offset + len(raw)] == raw
    with open(path, "rb") as whole:  # any reader of the format sees one stream
        assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"".join(raws)


# --- 10: BPE --------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_bpe():
    import public_tokenizers
    import tiktoken

    known = bpe.Bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return known, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def test_ids_are_tiktokens(docs, texts, tiktoken_bpe):
    known, other = tiktoken_bpe
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in bpe.encode(docs, with_ids=True).collect())
    want = Counter()
    for i, t, _ in texts:
        ids = other.encode_ordinary(t or "")
        want[i, tuple(ids), len(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(docs.limit(0)).count() == 0


def test_random_texts_and_long_pieces(tiktoken_bpe):
    known, other = tiktoken_bpe
    rng = random.Random(2)
    alphabet = "aabbee  \n\t\x0b\x1c\x1f\x85\xa0 é½²٣一𝒳'sdmtlr.,!<|>0123ÀßɐΩ​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)] + ["a" * 5000, "ab" * 3000, "é" * 999, "".join(rng.choices("aetoin", k=4000))]
    for text in texts:
        pieces = known.split(text)
        assert "".join(pieces) == text
        assert known.encode_pieces(pieces)[0].tolist() == other.encode_ordinary(text), repr(text)


def test_vocabularies_out_of_order():
    """Merges that make a pair of lower rank possible are taken one at a time."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"ca": 259, b"abcab": 260, b"aa": 261, b"aaa": 262}
    known = bpe.Bpe(ranks)
    other = tiktoken.Encoding("odd", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        assert known.encode_pieces([text])[0].tolist() == other.encode_ordinary(text), text


# --- 3: vectors -----------------------------------------------------------------


def brute_vectors(rows, threshold=0.98):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i, j in itertools.combinations(range(n), 2):
        if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], links[i], least.get(find(i)), r[0] is None or least[find(i)] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("shard_rows", [65_536, 60])
def test_near_vectors_by_brute_force(spark, shard_rows):
    ship(spark)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)
        rows.append((i + 10, [float(np.float32(x)) for x in v], i % 2))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (501, rows[0][1], 1), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, [None] + [1.0] * 15, 1)]
    rows += [(506, rows[1][1], None), (507, [1.0, 2.0], 1), (508, [], 1), (509, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1))
    got = Counter(tuple(r) for r in hnsw.near_vectors(frame, shard_rows=shard_rows).collect())
    assert got == brute_vectors(rows)
    assert hnsw.near_vectors(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    x = hnsw._unit(np.concatenate([centres[rng.integers(0, 60, 2000)] + rng.normal(size=(2000, 32)) * 0.05, rng.normal(size=(1000, 32))]))
    graph = hnsw.Graph(x)
    truth = x @ x.T >= 0.98
    for own in (np.arange(len(x)), None):
        rows, hits, _ = hnsw.lookup(graph, x, x, own)
        assert truth[rows, hits].all()
        assert len(set(zip(rows.tolist(), hits.tolist()))) >= 0.99 * truth.sum()


@pytest.mark.parametrize("own", [True, False])
def test_audit_counts_real_links_only(own):
    """A graph that finds only the start points does not pass for a few links, or for none."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x[1::300] = x[0::300] + rng.normal(size=(10, 32)) * 0.01
    x = hnsw._unit(x)
    graph = hnsw.Graph(x)
    graph.layers[0][:] = -1
    queries = x if own else hnsw._unit(np.where(np.arange(3000)[:, None] % 300, rng.normal(size=x.shape), x))
    rows, hits, _ = hnsw.lookup(graph, x, queries, np.arange(len(x)) if own else None)
    assert set(zip(rows.tolist(), hits.tolist())) == set(zip(*(i.tolist() for i in np.nonzero(queries @ x.T >= 0.98))))
