"""One registered query per training-data operator, over its whole table, and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, chat, extract, hnsw, merkle, mixing, packing, quality, shuffle, simhash, toxicity, variants, warc
from .common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(prepare(spark))
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select(
        F.col("pack.doc_id").alias("doc_id"), toxicity.held_out(F.col("pack.doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select(F.col("pack.doc_id").alias("doc_id"), *quality.BASE, "base_failed", "kept")


@query
def op5_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffle.shuffle(docs, 24)
    return placed.select("pack.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), "role", "text").union(
        spark.sql(f"SELECT CAST(-1 AS BIGINT), CAST(t AS BIGINT), r, '{said}' FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    )
    rendered = chat.render(chat.fold(chat.log_of(rows)))
    read = rendered.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(F.col("pack.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    proved = merkle.manifest(table(spark, sf_dir, "documents"), {n: F.col(n) for n in names}, ["doc_id"], shown={"n_chars": more})
    return proved.select(F.col("pack.doc_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op6_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + 9 + 5 + length(regexp_replace(role || text, '([<\[\\])', '\1\\', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_DIGITS}', CAST(1 + ((('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31) AS BIGINT), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

ORACLES["op9_warc"] = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (SELECT hex, max(page_id) AS winner FROM payloads GROUP BY hex)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM payloads JOIN best USING (hex)
"""

ORACLES["op8_extract"] = r"""
WITH bodies AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), blocks AS (
  SELECT page_id, url, unnest(regexp_split_to_array(body, '</?(?:p|h1)>')) AS block, generate_subscripts(regexp_split_to_array(body, '</?(?:p|h1)>'), 1) AS place FROM bodies
), plain AS (
  SELECT page_id, url, place,
         trim(regexp_replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS line
  FROM blocks
), texts AS (
  SELECT page_id, string_agg(line, chr(10) ORDER BY place) AS text FROM plain WHERE line <> '' GROUP BY page_id
)
SELECT p.page_id, p.url, coalesce(t.text, '') AS text, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars
FROM pages p LEFT JOIN texts t USING (page_id)
"""


def _class(i: int) -> str:
    """One class of the mix: what it should take, where the running sum over hashes ends, what it leaves."""
    return f"""
b{i} AS (
  SELECT sid, sum(size)::BIGINT AS held, any_value(target) AS target, any_value(source_size) AS source_size FROM classed WHERE class = {i} AND size > 0 GROUP BY sid
), w{i} AS (
  SELECT sid, held, CAST(floor(target * held / source_size + 0.5) AS BIGINT) + missed AS wanted FROM b{i} JOIN m{i} USING (sid)
), k{i} AS (
  SELECT sid, held, wanted, least(greatest(wanted, 0), 2 * held) // held AS copies, least(greatest(wanted, 0), 2 * held) % held AS rest FROM w{i}
), r{i} AS (
  SELECT sid, h, sum(size)::BIGINT AS unit, (sum(sum(size)) OVER (PARTITION BY sid ORDER BY h) - sum(size))::BIGINT AS before FROM classed WHERE class = {i} AND size > 0 GROUP BY sid, h
), t{i} AS (
  SELECT sid, h, unit, copies, before + unit <= rest OR before <= rest AND 2 * (rest - before) >= unit AS more FROM r{i} JOIN k{i} USING (sid)
), m{i + 1} AS (
  SELECT sid, coalesce(wanted - copies * held - spent, missed) AS missed
  FROM m{i} LEFT JOIN k{i} USING (sid) LEFT JOIN (SELECT sid, coalesce(sum(unit) FILTER (WHERE more), 0)::BIGINT AS spent FROM t{i} GROUP BY sid) USING (sid)
)"""


ORACLES["op11_mixing"] = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM given GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][1 + (sid - 1) % 3] AS w FROM sources
), rounds AS (
  SELECT 0 AS r, list({{'sid': sid, 'w': w, 'cap': 2 * source_size, 'stopped': false}}) AS s, 1.5 * sum(source_size) AS budget FROM weighed
  UNION ALL
  SELECT r + 1,
         list_transform(s, lambda x: {{'sid': x.sid, 'w': x.w, 'cap': x.cap, 'stopped': x.stopped OR x.w * left_over / weights > x.cap}}), budget
  FROM (SELECT *, budget - coalesce(list_sum(list_transform(list_filter(s, lambda x: x.stopped), lambda x: x.cap)), 0) AS left_over,
               list_sum(list_transform(list_filter(s, lambda x: NOT x.stopped), lambda x: x.w)) AS weights FROM rounds)
  WHERE len(list_filter(s, lambda x: NOT x.stopped AND x.w * left_over / weights > x.cap)) > 0
), settled AS (
  SELECT unnest(s) AS x, budget - coalesce(list_sum(list_transform(list_filter(s, lambda x: x.stopped), lambda x: x.cap)), 0) AS left_over,
         list_sum(list_transform(list_filter(s, lambda x: NOT x.stopped), lambda x: x.w)) AS weights FROM rounds QUALIFY r = max(r) OVER ()
), aimed AS (
  SELECT x.sid AS sid, CASE WHEN x.stopped THEN CAST(x.cap AS DOUBLE) ELSE x.w * (CAST(left_over AS DOUBLE) / weights) END AS target FROM settled
), classed AS (
  SELECT g.doc_id, g.size, g.h, s.sid, s.source_size, a.target,
         CASE WHEN g.size > 2.0::DOUBLE * (s.source_size / s.n) THEN 0 WHEN g.size > 0.25::DOUBLE * (s.source_size / s.n) THEN 1 ELSE 2 END AS class
  FROM given g JOIN weighed s ON g.source IS NOT DISTINCT FROM s.source JOIN aimed a ON a.sid = s.sid
), m0 AS (SELECT sid, 0::BIGINT AS missed FROM weighed), {_class(0)}, {_class(1)}, {_class(2)}
, taken AS (SELECT 0 AS class, * FROM t0 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2)
SELECT c.doc_id, c.size, c.source_size, c.target, c.size * CAST(coalesce(t.copies + CAST(t.more AS BIGINT), 0) AS BIGINT) AS taken
FROM classed c LEFT JOIN taken t ON t.class = c.class AND t.sid = c.sid AND t.h = c.h
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

ORACLES["op13_merkle"] = f"""
WITH RECURSIVE checks AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(list_reduce(
           list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda acc, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(acc, b)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS shown FROM checks
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), nodes AS (
  SELECT 0 AS level, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT any_value(level) + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, i // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, level AS levels FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM tops WHERE n > 1 GROUP BY i // 2
), steps AS (
  SELECT p.doc_id, p.leaf, p.shown, p.lang, p.i AS leaf_i, k.level AS step, coalesce(x.h, '') AS other, (p.i >> k.level) % 2 AS odd
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT level FROM nodes) k ON k.level < s.levels
  LEFT JOIN nodes x ON x.level = k.level AND x.lang IS NOT DISTINCT FROM p.lang AND x.i = xor(p.i >> k.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.shown, p.lang, p.i, s.levels + k.level, coalesce(x.h, ''), (s.i >> k.level) % 2
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT level FROM tops) k ON k.level < (SELECT max(level) FROM tops)
  LEFT JOIN tops x ON x.level = k.level AND x.i = xor(s.i >> k.level, 1)
), folded AS (
  SELECT p.lang, p.i, list_reduce(coalesce(list({{'h': t.other, 'odd': t.odd}} ORDER BY t.step) FILTER (WHERE t.step IS NOT NULL), []),
           lambda acc, x: {{'h': CASE WHEN x.odd = 1 THEN sha256(x.h || acc.h) ELSE sha256(acc.h || x.h) END, 'odd': x.odd}}, {{'h': any_value(p.shown), 'odd': 0::BIGINT}}).h AS folded_root,
         sha256(coalesce(string_agg(t.other, '' ORDER BY t.step), '')) AS proof_sha256
  FROM placed p LEFT JOIN steps t ON t.lang IS NOT DISTINCT FROM p.lang AND t.leaf_i = p.i GROUP BY p.lang, p.i
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, f.proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.i = p.i
CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""
