"""Readers and writers: the driver's tables as files in the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators.feeds import normalize_feed, with_year
from exposure.plans.catalog.registry import flat, query
from exposure.plans.catalog.views_sql import code_sql, ts_sql
from exposure.plans.demo import Views
from exposure.session import checkpoint_dir
from exposure.sources import documents, feeds, files, sinks
from exposure.streaming import jobs


def _folder(v: Views) -> str:
    return f"{checkpoint_dir(v.spark)}/exposure-{v.spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def _documents(rows: DataFrame, path: str, head: str, tail: str) -> list[str]:
    """One JSON document per file_seq, written as lines in order of ``pos.row``; returns the files in order of file_seq.

    Rows have file_seq, pos and ``item`` (JSON). A comma stands before every record but the first.
    """
    last = F.lit(1 << 62)
    body = rows.select("file_seq", F.col("pos.row").alias("at"), F.concat(F.lit(","), "item").alias("value"))
    seqs = rows.select("file_seq").distinct()
    edges = seqs.select("file_seq", F.lit(-2).cast("bigint").alias("at"), F.lit(head).alias("value")).unionByName(
        seqs.select("file_seq", last.alias("at"), F.lit(tail).alias("value"))
    )
    first = rows.groupBy("file_seq").agg(F.min("pos.row").alias("_first"))
    whole = body.join(first, "file_seq").withColumn(
        "value", F.when(F.col("at") == F.col("_first"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    ).drop("_first").unionByName(edges)
    tasks = max(5, seqs.count())
    # by a hash of its own: dealt by file_seq alike, Spark would take the join's deal for it, and a join changed while it runs
    # would leave a document in several files
    whole.repartition(tasks, F.xxhash64("file_seq")).sortWithinPartitions("file_seq", "at").select("file_seq", "value").write.partitionBy("file_seq").text(path)
    listed = files.list_files(rows.sparkSession, path).select("path").collect()  # one file per document
    return sorted((r["path"] for r in listed), key=lambda p: int(p.split("file_seq=")[1].split("/")[0]))


# Rows of a written file; more rows make more files.
_FILE_ROWS = 20_000


def _parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows dealt over several files for each of the given ones, and their number: file ``file_seq * number + part``."""
    seqs, total = rows.agg(F.count_distinct("file_seq"), F.count("*")).first()
    n = max(1, -(-total // (_FILE_ROWS * max(1, seqs))))
    return rows.withColumn("file_seq", F.expr(f"CAST(file_seq * {n} + pmod(xxhash64(pos.row), {n}) AS INT)")), n


def _given(records: DataFrame, paths: list[str], n: int) -> DataFrame:
    """Records with the ``file_seq`` that their rows had before they were dealt; a part without rows has no file."""
    seqs = [int(p.split("file_seq=")[1].split("/")[0]) // n for p in paths]
    return records.withColumn("file_seq", F.get(F.array(*[F.lit(s) for s in seqs]), F.col("file_seq")))


_RECORD_SQL = """SELECT cve_id, product_key, kind, severity, cvss_score, description, CAST(published_at AS VARCHAR) AS published_at, source,
    file_seq FROM x_record"""


def _record_columns(df: DataFrame) -> DataFrame:
    return flat(df.select(
        "cve_id", "product_key", F.col("version_rule.kind").alias("kind"), "severity", "cvss_score", "description", "published_at",
        "source", "file_seq",
    ))


@query("read_internal_feed", _RECORD_SQL)
def _(v: Views) -> DataFrame:
    rows, n = _parts(v.feed_record)
    item = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file_seq", "pos")])).alias("item")
    paths = _documents(rows.select("file_seq", "pos", item), _folder(v), '{"cves":[', "]}")
    return _record_columns(_given(feeds.read_feed(v.spark, paths), paths, n))


@query("read_csv_feed", _RECORD_SQL.replace("severity,", "CASE WHEN severity = 'MEDIUM' AND s_zero THEN 'LOW' ELSE severity END AS severity,")
       .replace("cvss_score,", "CASE WHEN s_zero THEN 0 ELSE cvss_score END AS cvss_score,").replace("FROM x_record", """FROM (
    SELECT x.*, CAST(trunc(o.o_totalprice) AS BIGINT) % 11 = 0 AND left(o.o_orderpriority, 1) NOT IN ('1', '2', '5') AS by_score,
        CAST(trunc(o.o_totalprice) AS BIGINT) % 11 = 0 AS s_zero FROM x_record x JOIN orders o ON o.o_orderkey = x.pos)"""))
def _(v: Views) -> DataFrame:
    folder, (rows, n) = _folder(v), _parts(v.feed_record)
    columns = [c for c in rows.columns if c not in ("file_seq", "pos")]
    rows.select("file_seq", *columns).repartition(5 * n, "file_seq").write.partitionBy("file_seq").option("header", True).option(
        "escape", '"').csv(folder)
    listed = [r["path"] for r in files.list_files(v.spark, folder).select("path").collect()]
    paths = sorted(listed, key=lambda p: int(p.split("file_seq=")[1].split("/")[0]))
    return _record_columns(_given(feeds.read_feed(v.spark, paths), paths, n))


def _parts_of(v: Views) -> DataFrame:
    """Parts with a code and a place: id, file_seq, pos."""
    return v.table("part").selectExpr(
        "*", "concat('CVE-', 2000 + p_partkey % 27, '-', lpad(p_partkey, greatest(5, length(p_partkey)), '0')) AS id",
        "CAST(p_partkey % 3 AS INT) AS file_seq", "struct(p_partkey AS row) AS pos",
    )


def _nvd(v: Views) -> DataFrame:
    """Parts as NVD records: file_seq, pos, item."""
    part = _parts_of(v)
    text = F.array(F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value")))
    cve = F.struct("id", F.lit("2024-01-02T00:00:00").alias("published"), text.alias("descriptions"))
    return part.select(
        "file_seq", "pos",
        F.concat(F.lit('{"cve":'), F.to_json(cve), F.lit("}")).alias("item"),
    )


@query("read_nvd_feed", f"SELECT {code_sql('p_partkey')} AS cve_id, p_name AS description, CAST(p_partkey % 3 AS INTEGER) AS file_seq FROM part")
def _(v: Views) -> DataFrame:
    paths = _documents(_nvd(v), _folder(v), '{"format":"NVD_CVE","vulnerabilities":[', "]}")
    return feeds.read_feed(v.spark, paths).select("cve_id", "description", "file_seq")


@query("read_kev_feed", f"""
    SELECT {code_sql('p_partkey')} AS "cveID", p_type AS "vendorProject", p_name AS product, CAST(p_partkey % 3 AS INTEGER) AS file_seq FROM part""")
def _(v: Views) -> DataFrame:
    entry = F.struct(F.col("id").alias("cveID"), F.col("p_type").alias("vendorProject"), F.col("p_name").alias("product"))
    paths = _documents(_parts_of(v).select("file_seq", "pos", F.to_json(entry).alias("item")), _folder(v), '{"title":"KEV","vulnerabilities":[', "]}")
    return feeds.read_kev_feed(v.spark, paths).select("cveID", "vendorProject", "product", "file_seq")


@query("feed_kinds", """
    SELECT 'nvd' AS kind, true AS compact, count(DISTINCT p_partkey % 3)::INTEGER AS n FROM part
    UNION ALL SELECT 'internal', false, count(DISTINCT o_orderkey % 5)::INTEGER FROM orders""")
def _(v: Views) -> DataFrame:
    nvd = _documents(_nvd(v), _folder(v), '{"vulnerabilities":[', "]}")
    rows = v.feed_record
    item = F.to_json(F.struct("cve_id", "description")).alias("item")
    internal = _documents(rows.select("file_seq", "pos", item), _folder(v), '{"cves":[', "]}")
    kinds = feeds.sniff_feeds(v.spark, [*nvd, *internal])
    return kinds.groupBy("kind", "compact").agg(F.count("*").cast("int").alias("n"))


@query("payload_hashes", "SELECT upper(sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey))) AS sha256, sum(length(c_name) + 1)::BIGINT AS payload_bytes FROM customer")
def _(v: Views) -> DataFrame:
    folder = _folder(v)
    v.table("customer").orderBy("c_custkey").select("c_name").coalesce(1).write.option("compression", "gzip").text(folder)
    return files.payload_hashes(files.list_files(v.spark, folder, "*.gz")).select("sha256", "payload_bytes")


@query("payload_hashes_by_range", """
    SELECT CAST(c_custkey // 1000 AS INTEGER) AS part, upper(sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey))) AS sha256,
        sum(length(c_name) + 1)::BIGINT AS payload_bytes FROM customer GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """One file for each range of customers, so that writing and hashing spread and their number grows with the table."""
    folder, rows = _folder(v), v.table("customer").selectExpr("c_custkey", "c_name", "CAST(c_custkey div 1000 AS INT) AS part")
    rows = rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "c_name")
    rows.write.partitionBy("part").option("compression", "gzip").text(folder)
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int").alias("part")
    return files.payload_hashes(files.list_files(v.spark, folder, "*.gz")).select(part, "sha256", "payload_bytes")


@query("read_asset_grid", "SELECT import_id, row_no, array_to_string(list_transform(cells, lambda c: coalesce(c, '~')), '|') AS cells FROM x_grid")
def _(v: Views) -> DataFrame:
    folder = _folder(v)
    v.grid.write.parquet(folder)
    return flat(documents.read_asset_grid(v.spark, folder).select("import_id", "row_no", "cells"))


@query("grid_from_csv", """
    SELECT CAST(0 AS INTEGER) AS row_no, 'Nations' AS cells UNION ALL SELECT 1, ''
    UNION ALL SELECT CAST(n_nationkey + 2 AS INTEGER), n_nationkey || '|' || n_name || '|~' FROM nation""")
def _(v: Views) -> DataFrame:
    folder = _folder(v)
    title = v.spark.range(2).select((F.col("id") - 2).alias("k"), F.when(F.col("id") == 0, "Nations").otherwise("").alias("value"))
    lines = v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.concat_ws(",", "n_nationkey", "n_name", F.lit("")).alias("value"))
    title.unionByName(lines).orderBy("k").coalesce(1).select("value").write.text(folder)
    (path,) = [r["path"] for r in files.list_files(v.spark, folder, "*.txt").select("path").collect()]
    return flat(documents.grid_from_csv(v.spark, path, 1).select("row_no", "cells"))


@query("read_advisory_docs", """
    SELECT CAST(s_nationkey AS INTEGER) AS name, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256,
        sum(strlen(s_name) + 1)::BIGINT AS size_bytes, left(min_by(s_name, s_suppkey), 5) AS head FROM supplier GROUP BY 1""")
def _(v: Views) -> DataFrame:
    folder, rows = _folder(v), v.table("supplier")
    rows = rows.repartition(8, "s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(folder)
    docs = documents.read_advisory_docs(v.spark, folder, "*.txt")
    name = F.regexp_extract("path", "s_nationkey=([0-9]+)/", 1).cast("int")
    return docs.select(name.alias("name"), "sha256", "size_bytes", F.col("head").cast("string").alias("head"))


@query("write_outbox", "SELECT event_id, event_type AS channel, props AS body FROM events")
def _(v: Views) -> DataFrame:
    folder, rows = _folder(v), v.table("events").select("event_id", F.col("event_type").alias("channel"), F.col("props").alias("body"))
    sinks.write_outbox(rows.where("event_id % 2 = 0"), folder)
    sinks.write_outbox(rows.where("event_id % 2 = 1"), folder)
    return v.spark.read.schema(rows.schema).json(folder)


@query("append_audit", f"SELECT event_id AS entity_id, 'NOTIFY_SEND' AS action, {ts_sql('ts')} AS created_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS action_date FROM events")
def _(v: Views) -> DataFrame:
    folder, e = _folder(v), v.table("events")
    rows = sinks.audit_events(e, "NOTIFY_SEND", "event", F.col("event_id"), F.struct("event_type"), F.col("ts").cast("timestamp"))
    sinks.append_audit(rows, folder)
    return flat(v.spark.read.parquet(folder).select("entity_id", "action", "created_at", "action_date"))


def _local(v: Views) -> DataFrame:
    item = F.to_json(F.struct("cve_id", "description"))
    return with_year(v.cve).select("cve_id", "cve_year", item.alias("item"))


@query("export_by_year", """
    SELECT cve_id, CAST(substr(cve_id, 5, 4) AS INTEGER) AS cve_year, '{"cve_id":"' || cve_id || '","description":"' || description || '"}' AS item FROM x_cve""")
def _(v: Views) -> DataFrame:
    folder = _folder(v)
    sinks.export_by_year(_local(v), folder)
    return v.spark.read.schema("cve_id string, item string, cve_year int").json(folder)


@query("export_combined", """
    SELECT '{"cve_id":"' || cve_id || '","description":"' || description || '"}' AS item FROM x_cve
    WHERE CAST(substr(cve_id, 5, 4) AS INTEGER) BETWEEN 2003 AND 2019""")
def _(v: Views) -> DataFrame:
    folder = _folder(v)
    sinks.export_combined(_local(v), folder, 2003, 2019)
    return v.spark.read.text(folder).withColumnRenamed("value", "item")


@query("stream_modified", """
    SELECT cve_id, description AS item FROM x_record_last
    UNION ALL SELECT cve_id, description FROM x_cve WHERE cve_id NOT IN (SELECT cve_id FROM x_record)""")
def _(v: Views) -> DataFrame:
    import datetime as dt

    folder, now = _folder(v), dt.datetime(2024, 5, 5)
    local = with_year(v.cve).select("cve_id", "cve_year", F.col("description").alias("item"))
    sinks.write_parts(local, f"{folder}/local", "cve_year", ["cve_id"], "start")
    changed = normalize_feed(v.feed_record).select(
        "cve_id", F.col("description").alias("item"), "file_seq",
        F.struct(F.col("pos.block").cast("bigint").alias("block"), F.col("pos.row").cast("bigint").alias("row")).alias("pos"),
    )
    changed.write.parquet(f"{folder}/in")
    jobs.stream_modified(v.spark, f"{folder}/in", f"{folder}/local", f"{folder}/checkpoint", now, now).awaitTermination()
    return sinks.read_parts(v.spark, f"{folder}/local", "cve_year").select("cve_id", "item")


@query("stream_modified_state", """
    SELECT CAST(substr(cve_id, 5, 4) AS INTEGER) AS cve_year, count(DISTINCT cve_id) AS entries,
           CAST(max(old) + max(new) AS BIGINT) AS writes
    FROM (SELECT cve_id, 1 AS old, 0 AS new FROM x_cve UNION ALL SELECT cve_id, 0, 1 FROM x_record_last) GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """Entries of each year and how often it was written, after the same feed came twice: the second time no year is."""
    import datetime as dt

    folder, now = _folder(v), dt.datetime(2024, 5, 5)
    local = with_year(v.cve).select("cve_id", "cve_year", F.col("description").alias("item"))
    sinks.write_parts(local, f"{folder}/local", "cve_year", ["cve_id"], "start")
    feed = normalize_feed(v.feed_record).select(
        "cve_id", F.col("description").alias("item"), "file_seq",
        F.struct(F.col("pos.block").cast("bigint").alias("block"), F.col("pos.row").cast("bigint").alias("row")).alias("pos"),
    )
    for day in range(2):
        feed.withColumn("file_seq", F.col("file_seq") + 1000 * day).write.mode("append").parquet(f"{folder}/in")
        at = now + dt.timedelta(days=5 * day)
        jobs.stream_modified(v.spark, f"{folder}/in", f"{folder}/local", f"{folder}/checkpoint", now, at).awaitTermination()
    log = v.spark.read.parquet(f"{folder}/local/log").where("part IS NOT NULL")
    writes = log.groupBy(F.col("part").cast("int").alias("cve_year")).agg(F.count("*").alias("writes"))
    entries = sinks.read_parts(v.spark, f"{folder}/local", "cve_year").groupBy("cve_year").agg(F.count("*").alias("entries"))
    return entries.join(writes, "cve_year")
