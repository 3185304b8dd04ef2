"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import chat, forest, infill, jaccard, media, mixing, packing, periods, pii, sharding, simhash, toxicity, urls

_SAMPLE_TEXT = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_SAMPLE_TEXT).alias("text"),
    )
    told = chat.chats(chat.conversations_as_replies(rows.unionByName(extra)))
    read = told.select(
        F.substring_index("root_id", "/", 1).try_cast("long").alias("conv_id"),
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")), "").alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '[^\\<#\n]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op4_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.store_payloads(docs)
    pages = stored.select("doc_id", media.payload_page(F.col("doc_id"), F.col("digest")).alias("html"))
    found = media.interleave(pages, media.payload_features(stored), key="doc_id")
    shown = F.filter("sequence", lambda x: x["media"].isNotNull())
    one = found.select("doc_id", F.element_at(shown, 1).alias("item"))
    return one.select("doc_id", "item.media.*", "item.caption", "item.position").drop("digest")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken")


_OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM sources
), -- levels at which the k sources of least cap per weight are full; the right one is the first that fills no more
steps AS (
  SELECT cap, w, cap * 1.0::DOUBLE / w AS full_at,
    (SELECT sum(cap) / 3 FROM weighed) - coalesce(sum(cap) OVER earlier, 0) AS rest,
    (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER earlier, 0) AS open
  FROM weighed WINDOW earlier AS (ORDER BY cap * 1.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(arg_min(rest::DOUBLE / open::DOUBLE, full_at) FILTER (full_at > rest::DOUBLE / open::DOUBLE), 0) AS level FROM steps
), goals AS (
  SELECT source, source_size, least(level * w, cap::DOUBLE) AS target,
    floor(least(level * w, cap::DOUBLE) + 0.5)::BIGINT AS budget FROM weighed, level
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix', doc_id::VARCHAR))
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + least(size, greatest(0, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.learn(docs))
    counts = ("n_email", "n_ip", "n_card", "n_phone")
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def _captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day, which their table does not hold: spread over four years by page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int")).alias("fetched"))


def _entries(pages: DataFrame) -> DataFrame:
    """List entries derived from all pages: a page puts its host, or the domain above it, on one of three lists or takes it off."""
    id_, host = F.col("page_id"), urls.host_of(F.col("url"))
    above = F.regexp_replace(host, r"^[^.]+\.", "")
    return pages.select(
        F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.pmod(id_ * 7, F.lit(3)) + 1).cast("int")).alias("list"),
        F.when(F.pmod(id_ * 11, F.lit(8)) == 0, above).otherwise(host).alias("domain"),
        F.when(F.pmod(id_ * 13, F.lit(5)) < 2, "add").otherwise("remove").alias("action"),
        F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(id_ * 101, F.lit(1461)).cast("int")).alias("day"),
    )


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge(_captures(pages), _entries(pages))
    return found.withColumn("fetched", F.col("fetched").cast("string")).withColumn("since", F.col("since").cast("string"))


_OP9_SQL = r"""
WITH hosts AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages
), captures AS (
  SELECT page_id, host, DATE '2021-01-01' + ((page_id * 37) % 1461)::INT AS fetched FROM hosts
), entries AS (
  SELECT (['adult', 'malware', 'spam'])[1 + (page_id * 7) % 3] AS list,
    CASE WHEN (page_id * 11) % 8 = 0 THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END AS domain,
    (page_id * 13) % 5 >= 2 AS off, DATE '2021-01-01' + ((page_id * 101) % 1461)::INT AS day
  FROM hosts
), days AS (
  SELECT list, domain, day, bool_or(off) AS off FROM entries WHERE domain IS NOT NULL GROUP BY ALL
), changes AS (
  SELECT *, coalesce(lag(off) OVER w, true) AS was FROM days WINDOW w AS (PARTITION BY list, domain ORDER BY day)
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM changes WHERE off <> was
), held AS (
  SELECT page_id, list, count(*) AS n, max(day) AS since
  FROM captures JOIN spans ON (host = domain OR ends_with(host, '.' || domain)) AND NOT off AND fetched >= day
    AND (until IS NULL OR fetched < until)
  GROUP BY page_id, list
), verdicts AS (
  SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, sum(n)::BIGINT AS n_entries, max(since) AS since
  FROM held GROUP BY page_id
)
SELECT page_id, host, fetched::VARCHAR AS fetched, coalesce(lists, '') AS lists, coalesce(n_entries, 0)::BIGINT AS n_entries,
  since::VARCHAR AS since, lists IS NOT NULL AS blocked
FROM captures LEFT JOIN verdicts USING (page_id)
"""


def op10_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = infill.transform(_table(spark, sf_dir, "documents"))
    return told.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        infill.restored_sha256("output", "form").alias("restored_sha256"),
    )


_OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
  FROM documents
), numbers AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
    array_to_string(tokens[b + 1:], '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents repeat a stretch of theirs to the end, as told by the checksum of the id (null: of no digits)."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), prepare=_repeated)
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), 1)
    one = F.when(F.size("runs") > 0, longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.select("doc_id", "runs", "collapsed", one.alias("one"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"))
    length = -F.col("one.col1")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("one.start").alias("start"),
        length.alias("length"),
        F.col("one.period").alias("period"),
        F.expr("-one.col1 * 1000 div one.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_reply_trees, op2_toxicity_crf, op3_prefix_forest, op4_jump_hash, op5_media_columns, op6_mixing, op7_simhash,
        op8_pii_boosting, op9_url_lists, op10_bin_slack, op11_infill, op12_baier_runs,
        op13_jaccard,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_reply_trees": _OP1_SQL, "op6_mixing": _OP6_SQL, "op9_url_lists": _OP9_SQL, "op11_infill": _OP11_SQL}
