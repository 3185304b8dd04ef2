"""Column types of the tables and of the feed formats."""

from __future__ import annotations

from exposure.functions.version import RULE_TYPE

NVD_CVE = """
    id string, published string,
    descriptions array<struct<lang:string,value:string>>,
    metrics struct<
        cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>,
        cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>,
        cvssMetricV2:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>>,
    configurations array<struct<nodes:array<struct<cpeMatch:array<struct<
        vulnerable:boolean,criteria:string,versionStartIncluding:string,
        versionEndIncluding:string,versionEndExcluding:string>>>>>>
"""

# Every field is read as text: a JSON string arrives bare, a list or an object as its JSON text.
RECORD_FIELDS = (
    "cve_id", "id", "product_name", "product", "matchKey", "product_key", "affected_versions", "versions",
    "cpe_list", "cpe", "severity", "cvss_score", "cvss", "description", "desc", "published_at", "published",
    "source",
)
RECORD = ", ".join(f"`{c}` string" for c in RECORD_FIELDS)

CVE_RECORD_COLUMNS = (
    "cve_id", "product_name", "product_key", "version_rule", "cpe_list", "severity", "cvss_score",
    "description", "published_at", "source",
)
CVE = f"""
    cve_id string, product_name string, product_key string, version_rule {RULE_TYPE}, cpe_list array<string>,
    severity string, cvss_score decimal(3,1), description string, published_at date, source string,
    feed_import_id bigint, created_at timestamp, updated_at timestamp
"""
ASSET = """
    asset_no string, department string, product_raw string, product_key string, version_raw string,
    version_norm string, ip string, owner_name string, owner_team string, owner_contact string, status string,
    import_batch_id bigint, extra map<string,string>
"""
GRID = "import_id bigint, sheet string, row_no int, cells array<string>"
MERGED_RANGE = "import_id bigint, sheet string, r0 int, c0 int, r1 int, c1 int"
AUDIT = """
    actor_id bigint, action string, entity_type string, entity_id bigint, detail string, ip string,
    user_agent string, created_at timestamp
"""
ACK_EVENT = "event_id bigint, ts timestamp, advisory_id bigint, department_id bigint, ack_status string"
