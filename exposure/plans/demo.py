"""The library's tables derived from the driver's parquet tables (see FIXTURES.md).

Every view covers its whole source table. The tables that the data model keeps (assets, CVEs, codes, matches)
are written once per session, as an installation would have them stored; product keys and version rules are
thus computed once, when a row comes in.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.constants import AUTO_DEPLOY_OWNER
from exposure.functions.product import normalize_product
from exposure.functions.severity import severity_from_cvss
from exposure.functions.text import strip
from exposure.functions.version import parse_version_rule
from exposure.operators.advisories import extract_codes
from exposure.operators.matching import lookup_cves, match_assets
from exposure.session import store

PRODUCTS = (
    "Windows 11", "win10 Pro", "Microsoft Windows Server 2022", "MS Office", "Google Chrome", "한컴오피스",
    "Adobe Acrobat DC", "msedge", "Linux Kernel", "Ubuntu Linux", "IBM AIX", "OpenSSL", "Apache HTTP Server",
    "Acme Widget-Pro",
)
VERSIONS = ("23H2", "22H2", "2021", "2019", "122.x", "124", "DC 2021", "10.0.19045", "1.0", None, "n/a")
AS_OF = "1998-06-15"
ADVISORY_STATUS = (
    "UPLOADED", "EXTRACTING", "EXTRACTED", "NEEDS_CVE_UPDATE", "MATCHED", "NOTIFYING", "COMPLETED", "ARCHIVED",
)


def pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _product(key: str) -> Column:
    """One key in ten is a well-known product, the others spread over many vendor products."""
    return F.expr(_sql_product(key))


class Views:
    """Lazily derived tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def department(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS department_id", "n_name AS name",
            "concat('D', n_nationkey) AS code", "concat('m', n_nationkey) AS messenger_id",
            "concat('d', n_nationkey, '@example.org') AS email", "n_nationkey % 12 <> 11 AS is_active",
        )

    @cached_property
    def asset(self) -> DataFrame:
        return store(self._asset(), "asset")

    def _asset(self) -> DataFrame:
        c = self.table("customer")
        version = pick(VERSIONS, F.expr("(c_custkey * 7 + 3) % 11"))
        product = _product("c_custkey")
        return c.select(
            F.col("c_custkey").alias("asset_id"),
            F.col("c_name").alias("asset_no"),
            F.col("c_nationkey").cast("bigint").alias("department_id"),
            product.alias("product_raw"),
            normalize_product(product).alias("product_key"),
            version.alias("version_raw"),
            F.when(F.expr("c_custkey % 5 = 0"), "21.001.20155").otherwise(F.coalesce(strip(version), F.lit(""))).alias(
                "version_norm"
            ),
            F.expr("concat('10.0.', (c_custkey div 250) % 250, '.', c_custkey % 250)").alias("ip"),
            F.when(F.expr("c_custkey % 9 = 0"), AUTO_DEPLOY_OWNER)
            .otherwise(F.expr("concat('owner', c_custkey % 40)")).alias("owner_name"),
            F.col("c_mktsegment").alias("owner_team"),
            F.expr("concat('010-', lpad(c_custkey, 8, '0'))").alias("owner_contact"),
            F.expr("CASE WHEN c_custkey % 17 = 0 THEN 'RETIRED' WHEN c_custkey % 13 = 0 THEN 'RETIRING' ELSE 'NORMAL' END")
            .alias("status"),
        )

    @cached_property
    def cve(self) -> DataFrame:
        return store(self._cve(), "cve")

    def _cve(self) -> DataFrame:
        p = self.table("part")
        bounds = tuple(v for v in VERSIONS[:9])
        a, b = pick(bounds, F.expr("p_size % 9")), pick(bounds, F.expr("(p_size * 5 + 1) % 9"))

        def obj(key: str) -> Column:
            return F.concat(F.lit('{"' + key + '":"'), a, F.lit('"}'))

        kind = F.expr("p_size % 7")
        versions = (
            F.when(kind == 0, "*")
            .when(kind == 1, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]')))
            .when(kind == 2, obj("lt")).when(kind == 3, obj("lte")).when(kind == 4, obj("gt"))
            .when(kind == 5, F.concat(F.lit('{"range":["'), a, F.lit('","'), b, F.lit('"]}')))
            .otherwise('{"note":"see vendor"}')
        )
        score = F.expr("CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size / 5.0 AS DECIMAL(3,1)) END")
        return p.select(
            F.expr("concat('CVE-', 2000 + p_partkey % 27, '-', lpad(p_partkey, greatest(5, length(p_partkey)), '0'))").alias("cve_id"),
            _product("p_partkey").alias("product_name"),
            normalize_product(_product("p_partkey")).alias("product_key"),
            versions.alias("affected_versions"),
            parse_version_rule(versions).alias("version_rule"),
            F.array(F.concat(F.lit("cpe:2.3:a:"), F.col("p_brand"))).alias("cpe_list"),
            severity_from_cvss(score).alias("severity"),
            score.alias("cvss_score"),
            F.concat_ws(" ", "p_name", "p_type").alias("description"),
            F.expr("CASE WHEN p_partkey % 19 <> 0 THEN date_add(DATE'2000-01-01', CAST(p_partkey % 9000 AS INT)) END")
            .alias("published_at"),
            F.col("p_brand").alias("source"),
            F.lit(None).cast("bigint").alias("feed_import_id"),
            F.lit("2020-01-01 00:00:00").cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def line(self) -> DataFrame:
        """Codes named by each advisory, and how the document spells them."""
        known = "(l_partkey + l_linenumber) % 10 <> 0"
        key = f"CASE WHEN {known} THEN l_partkey ELSE l_partkey + 1000000 END"
        sep = "element_at(array('-', ' ', '_', '  '), CAST(l_linenumber % 4 + 1 AS INT))"
        base = self.table("lineitem").selectExpr(
            "l_orderkey AS advisory_id", "l_linenumber", "l_suppkey", f"{key} AS k", f"{sep} AS sep"
        )
        return base.selectExpr(
            "advisory_id", "l_linenumber", "l_suppkey",
            "concat('CVE-', 2000 + k % 27, '-', lpad(k, greatest(5, length(k)), '0')) AS code",
            "concat('CVE', sep, 2000 + k % 27, sep, lpad(k, greatest(5, length(k)), '0')) AS spelled",
        )

    @cached_property
    def advisory_text(self) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "code", "spelled")))
        return self.line.groupBy("advisory_id").agg(
            F.array_join(F.transform(ordered, lambda x: x["spelled"]), ", ").alias("text")
        )

    @cached_property
    def advisory(self) -> DataFrame:
        o = self.table("orders").selectExpr(
            "o_orderkey AS advisory_id",
            "concat('DOC-', o_custkey) AS doc_no",
            "concat('Advisory ', o_orderkey) AS title",
            "o_orderstatus AS source_org",
            "element_at(array('NCST', 'WEBMAIL', 'OFFICIAL_DOC'), CAST(o_orderkey % 3 + 1 AS INT)) AS receive_channel",
            "CAST(o_orderdate AS DATE) AS received_at",
            "CASE WHEN o_orderkey % 11 <> 0 THEN date_add(CAST(o_orderdate AS DATE), CAST(14 + o_orderkey % 30 AS INT)) END"
            " AS due_at",
            "element_at(array(" + ", ".join(f"'{s}'" for s in ADVISORY_STATUS) + "), CAST(o_orderkey % 8 + 1 AS INT)) AS status",
            "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(date_add(CAST(o_orderdate AS DATE), 1) AS TIMESTAMP) END"
            " AS board_published_at",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        )
        return o

    @cached_property
    def advisory_docs(self) -> DataFrame:
        return self.advisory.join(self.advisory_text, "advisory_id", "left")

    @cached_property
    def advisory_cve(self) -> DataFrame:
        """Codes read from the documents' text, looked up in the CVE table."""
        return lookup_cves(extract_codes(self.advisory_text).drop("pos"), self.cve)

    @cached_property
    def codes(self) -> DataFrame:
        """The same codes taken from the lines, for queries that are not about extraction."""
        lines = self.line.select("advisory_id", F.col("code").alias("cve_id_text"))
        return store(lookup_cves(lines.distinct(), self.cve), "advisory_cve")

    @cached_property
    def exclusion_rule(self) -> DataFrame:
        return self.asset.join(
            self.table("customer").select(F.col("c_custkey").alias("asset_id"), "c_acctbal"), "asset_id"
        ).select(
            "asset_id", "product_key", F.concat(F.lit("known "), "asset_id").alias("reason"),
            (F.col("c_acctbal") < 1000).alias("is_active"),
        )

    @cached_property
    def found(self) -> DataFrame:
        return match_assets(self.codes, self.cve, self.asset)

    @cached_property
    def match(self) -> DataFrame:
        """Stored matches: results of the core join with analyst decisions and replies.

        They grow with the square of the tables, so they are not written: each reader gets the columns it names from the join.
        """
        m = match_assets(self.codes, self.cve, self.asset, self.exclusion_rule)
        excluded = F.expr("(advisory_id + asset_id) % 11 = 0")
        ack = F.expr(
            "CASE WHEN (advisory_id + department_id) % 4 = 0 THEN 'DONE' ELSE "
            "element_at(array('DONE', 'IN_PROGRESS', 'UNABLE', 'NONE', 'NONE'), CAST((advisory_id * 3 + asset_id) % 5 + 1 AS INT)) END"
        )
        text, ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
        return m.select(
            "advisory_id", "cve_id_text", "asset_id", "reason",
            F.when(excluded, "EXCLUDED").otherwise("MATCHED").alias("status"),
            F.when(excluded, "not applicable").alias("excluded_reason"),
            ack.alias("ack_status"), text.alias("ack_by"), text.alias("ack_note"), ts.alias("ack_at"),
        )

    @cached_property
    def notification_asset(self) -> DataFrame:
        """Assets of each notification, each once."""
        rows = self.table("lineitem").selectExpr("l_orderkey * 1000000 + l_suppkey AS notification_id", "l_partkey AS asset_id")
        return rows.distinct()

    @cached_property
    def notification(self) -> DataFrame:
        """One notification per (order, supplier) of the lines; several can fall to one department."""
        g = self.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(
            F.sort_array(F.collect_set("l_partkey")).alias("asset_ids"),
            F.min("l_linenumber").alias("ln"), F.max("l_shipdate").cast("timestamp").alias("sent_at"),
            F.min("l_returnflag").alias("flag"),
        )
        text, ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
        ack = F.expr("element_at(array('NONE', 'IN_PROGRESS', 'DONE', 'UNABLE', 'DONE', 'DONE', 'NONE'), CAST(ln AS INT))")
        return g.select(
            F.expr("l_orderkey * 1000000 + l_suppkey").alias("notification_id"),
            F.col("l_orderkey").alias("advisory_id"),
            F.expr("l_suppkey % 25").alias("department_id"),
            F.array(F.lit("MAIL"), F.lit("WEB_UI")).alias("channels"),
            text.alias("message"), "asset_ids",
            F.expr("CASE flag WHEN 'A' THEN 'SENT' WHEN 'N' THEN 'FAILED' ELSE 'ACKED' END").alias("status"),
            ack.alias("ack_status"), text.alias("ack_note"), text.alias("ack_by"),
            F.when(ack != "NONE", F.col("sent_at")).alias("ack_updated_at"),
            F.expr("CASE WHEN ln <> 7 THEN sent_at END").alias("sent_at"), ts.alias("reminded_at"),
            F.expr("CAST(ln % 3 AS INT)").alias("reminder_count"),
            F.expr("sha2(concat(l_orderkey, ':', l_suppkey), 256)").alias("idempotency_key"),
            text.alias("evidence_name"), text.alias("evidence_path"),
        )

    @cached_property
    def comment(self) -> DataFrame:
        e = self.table("events")
        dept = "CASE WHEN event_id % 4 <> 0 THEN event_id % 25 END"
        return e.selectExpr(
            "event_id AS comment_id", "user_id * 20 AS advisory_id", "concat('user', user_id) AS author_name",
            f"{dept} AS department_id",
            "CASE WHEN event_id % 4 = 0 THEN concat('NATION_', event_id % 25) END AS department_name",
            "props AS body",
            "CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'error' THEN 'UNABLE' END"
            " AS ack_status",
            "event_id % 10 = 0 AS is_admin",
            "CASE WHEN event_id % 7 = 0 THEN concat('file', event_id, '.png') END AS evidence_name",
            "CASE WHEN event_id % 7 = 0 THEN concat('/evidence/', event_id) END AS evidence_path",
            "CAST(ts AS TIMESTAMP) AS created_at",
        )

    @cached_property
    def ack_event(self) -> DataFrame:
        return self.ack_events(self.table("events"))

    @staticmethod
    def ack_events(events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id * 20 AS advisory_id", "event_id % 25 AS department_id",
            "CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'error' THEN 'UNABLE'"
            " ELSE 'NONE' END AS ack_status",
        )

    @cached_property
    def audit(self) -> DataFrame:
        actions = (
            "ADVISORY_UPLOAD", "ADVISORY_EXTRACT", "ADVISORY_MATCH", "MATCH_EXCLUDE", "NOTIFY_SEND", "MATCH_RESTORE",
        )
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("audit_id"), F.col("ts").cast("timestamp").alias("created_at"),
            F.expr("CASE WHEN event_id % 6 <> 5 THEN user_id END").alias("actor_id"),
            pick(actions, F.expr("event_id % 6")).alias("action"),
            F.expr("CASE WHEN event_id % 6 IN (3, 5) THEN 'match' ELSE 'advisory' END").alias("entity_type"),
            F.expr("user_id * 20").alias("entity_id"), F.col("props").alias("detail"),
        )

    @cached_property
    def app_user(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS user_id", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS display_name"
        )

    @cached_property
    def feed_record(self) -> DataFrame:
        """Raw feed records with repeated ids, known and new, in several files."""
        o = self.table("orders").selectExpr("o_orderkey", "o_custkey * 2 AS k", "o_orderstatus", "o_totalprice", "o_orderdate",
                                            "o_orderpriority")
        return o.select(
            F.expr("concat('cve_', 2000 + k % 27, '_', lpad(k, greatest(5, length(k)), '0'))").alias("cve_id"),
            F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN " + _sql_product("k") + " END").alias("product"),
            F.expr("CASE o_orderkey % 5 WHEN 0 THEN '*' WHEN 1 THEN '22H2; 23H2' WHEN 2 THEN '{\"lt\":\"124\"}' WHEN 3 THEN '[]' END")
            .alias("versions"),
            F.expr("element_at(array('긴급', 'high', '', 'x', '낮음'), CAST(left(o_orderpriority, 1) AS INT))").alias("severity"),
            F.expr("CAST(CAST(o_totalprice AS BIGINT) % 11 AS STRING)").alias("cvss"),
            F.expr("concat('order ', o_orderkey)").alias("description"),
            F.expr("date_format(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'yyyy.MM.dd' ELSE 'yyyy/MM/dd' END)").alias("published"),
            F.expr("CASE WHEN o_orderstatus <> 'P' THEN concat('SRC-', o_orderstatus) END").alias("source"),
            F.expr("CAST(o_orderkey % 5 AS INT)").alias("file_seq"),
            F.struct(F.lit(0).cast("bigint").alias("block"), F.col("o_orderkey").alias("row")).alias("pos"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """One ledger sheet per nation: a title row, a header row, then one row per customer."""
        nation = self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("import_id"), "n_name")
        sheet = F.lit("ledger").alias("sheet")

        def fixed(row_no: int, *cells: Column) -> DataFrame:
            return nation.select("import_id", sheet, F.lit(row_no).alias("row_no"), F.array(*cells).alias("cells"))

        none = F.lit(None).cast("string")
        title = fixed(0, F.concat(F.lit("Ledger of "), "n_name"), none, none, none, none, none)
        header = fixed(1, *[F.lit(h) for h in ("자산번호", "사용부서", "운영체제", "IP", "담당자", "비고")])
        k = "c_custkey"
        body = self.table("customer").select(
            F.col("c_nationkey").cast("bigint").alias("import_id"), sheet,
            F.expr(f"CAST({k} + 2 AS INT)").alias("row_no"),
            F.array(
                F.expr(f"CASE WHEN {k} % 6 <> 0 THEN c_name END"),
                F.expr(f"CASE WHEN {k} % 7 <> 0 THEN concat(' NATION_', c_nationkey + 5 * (c_nationkey % 2)) END"),
                F.expr(f"CASE WHEN {k} % 11 <> 0 THEN concat(" + _sql_product(k) + f", CASE WHEN {k} % 3 = 0 THEN ' v' || {k} % 9 ELSE '' END) END"),
                F.expr(f"concat('10.1.', ({k} div 250) % 250, '.', {k} % 250)"),
                F.expr(f"concat('team', {k} % 5, ', ', 'owner', {k} % 40)"),
                F.expr(f"CASE WHEN {k} % 4 = 0 THEN c_mktsegment END"),
            ).alias("cells"),
        )
        return title.unionByName(header).unionByName(body)

    @cached_property
    def merged_range(self) -> DataFrame:
        """Vertical merges of the department column that start at a customer's row."""
        title = self.table("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS import_id", "'ledger' AS sheet", "0 AS r0", "0 AS c0", "0 AS r1", "5 AS c1"
        )
        down = self.table("customer").selectExpr(
            "CAST(c_nationkey AS BIGINT) AS import_id", "'ledger' AS sheet", "CAST(c_custkey + 2 AS INT) AS r0", "1 AS c0",
            "CAST(c_custkey + 2 + 30 * (CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS INT) AS r1", "1 AS c1",
        )
        return title.unionByName(down)


def _sql_product(key: str) -> str:
    names = ", ".join(repr(p) for p in PRODUCTS)
    return (
        f"CASE WHEN {key} % 10 = 0 THEN get(array({names}), CAST(({key} div 10) % 14 AS INT)) "
        f"ELSE concat('Acme Widget-', CAST({key} % 997 AS STRING)) END"
    )
