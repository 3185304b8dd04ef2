"""Asset ledgers: merged cells, header detection, column mapping, load into the asset table.

A ledger is a set of rows ``(import_id, sheet, row_no, cells)``; many ledgers are handled at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import HEADER_SCAN_ROWS, LEDGER_FIELD_HINTS
from exposure.functions.grid import CellSpec, col_letter, resolve_cell
from exposure.functions.product import normalize_product, split_product_version
from exposure.functions.text import any_of, blank_to_null, is_blank, let, strip
from exposure.functions.version import normalize_version
from exposure.operators.ranks import dense_ids
from exposure.operators.skew import first_per
from exposure.operators.state import upsert

SHEET = ["import_id", "sheet"]
Hints = Mapping[str, Sequence[str]]
REQUIRED_FIELDS = ("department", "product_key")
# Rows of one sheet are handled in blocks of this many, so a merged range meets the blocks it spans only.
ROW_BLOCK = 1024


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# --- merged cells --------------------------------------------------------------------------------
def fill_merged(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """Give every cell of a merged range the value of its top-left cell.

    Ranges meet rows by (sheet, block of rows); the values found for a row are put into its cells in place.
    Where ranges overlap, the one that starts last wins.
    """
    anchor = ranges.join(
        grid.select(*SHEET, F.col("row_no").alias("r0"), F.col("cells").alias("_at")), [*SHEET, "r0"]
    ).where(F.size("_at") > F.col("c0"))
    value = anchor.select(
        *SHEET, "r0", "r1", "c0", "c1", F.get("_at", F.col("c0")).alias("v"),
        F.explode(F.sequence(F.floor(F.col("r0") / ROW_BLOCK), F.floor(F.col("r1") / ROW_BLOCK))).alias("_block"),
    )
    rows = grid.select(*SHEET, "row_no", F.floor(F.col("row_no") / ROW_BLOCK).alias("_block"))
    hits = (
        rows.join(value, [*SHEET, "_block"])
        .where(F.col("row_no").between(F.col("r0"), F.col("r1")))
        .groupBy(*SHEET, "row_no")
        .agg(F.sort_array(F.collect_list(F.struct("r0", "c0", "c1", "v")), asc=False).alias("_fills"))
    )

    def fill(cell: Column, i: Column) -> Column:
        covering = F.filter("_fills", lambda f: (f["c0"] <= i) & (i <= f["c1"]))
        return let(F.get(covering, F.lit(0)), lambda f: F.when(f.isNotNull(), f["v"]).otherwise(cell))

    filled = F.when(F.col("_fills").isNull(), F.col("cells")).otherwise(F.transform("cells", fill))
    return grid.join(hits, [*SHEET, "row_no"], "left").withColumn("cells", filled).select(*grid.columns)


# --- headers -------------------------------------------------------------------------------------
def header_scores(grid: DataFrame, hints: Hints | None = None, scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Score of each leading row as a header: hint hits count 3, filled cells 1, number-like cells -2."""
    words = [w for ws in (LEDGER_FIELD_HINTS if hints is None else hints).values() for w in ws]
    texts = F.transform(F.filter("cells", _filled), lambda c: F.lower(strip(c)))
    hit = F.size(F.filter("_t", lambda t: any_of(F.contains(t, F.lit(w)) for w in words)))
    numeric = F.size(F.filter("_t", lambda t: F.regexp_replace(t, r"[.\-/]", "").rlike(r"(?U)^\d+$")))
    return (
        grid.where(F.col("row_no") < scan)
        .withColumn("_t", texts)
        .where(F.size("_t") > 0)
        .select(*SHEET, "row_no", (hit * 3 + F.size("_t") - numeric * 2).alias("score"))
    )


def detect_header_row(grid: DataFrame, hints: Hints | None = None, scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """Most likely header row of each sheet, 0-based; the first of equal scores."""
    best = header_scores(grid, hints, scan).groupBy(*SHEET).agg(
        F.max_by("row_no", F.struct("score", -F.col("row_no"))).alias("header_row")
    )
    sheets = grid.select(*SHEET).distinct()
    return sheets.join(best, SHEET, "left").select(*SHEET, F.coalesce("header_row", F.lit(0)).alias("header_row"))


def combine_headers(grid: DataFrame, header: DataFrame, header_rows: int = 1) -> DataFrame:
    """One label per column: the distinct non-blank texts of its header rows joined by `` / ``.

    ``header`` gives the first header row per sheet. Result: ``import_id, sheet, headers ARRAY<STRING>``.
    """
    n = max(1, header_rows)
    rows = grid.join(header, SHEET).where(
        (F.col("row_no") >= F.col("header_row")) & (F.col("row_no") < F.col("header_row") + n)
    )
    cells = rows.select(*SHEET, "row_no", F.posexplode("cells").alias("col", "v"))
    text = strip(F.coalesce("v", F.lit("")))
    labels = cells.groupBy(*SHEET, "col").agg(
        F.array_sort(F.collect_list(F.struct("row_no", text.alias("t")))).alias("_l")
    )
    distinct = F.array_distinct(F.filter(F.transform("_l", lambda x: x["t"]), lambda t: t != ""))
    joined = labels.select(*SHEET, "col", F.array_join(distinct, " / ").alias("label"))
    ordered = F.array_sort(F.collect_list(F.struct("col", "label")))
    return joined.groupBy(*SHEET).agg(F.transform(ordered, lambda x: x["label"]).alias("headers"))


def suggest_mapping(headers: Column | str, hints: Hints | None = None) -> Column:
    """``MAP<field, column letter>``: per field, in order, the first free column whose label has a hint."""
    table = LEDGER_FIELD_HINTS if hints is None else hints
    labels = F.transform(headers, lambda h: F.lower(strip(F.coalesce(h, F.lit("")))))
    state = F.struct(
        F.array().cast("array<int>").alias("used"),
        F.array().cast("array<struct<key:string,value:string>>").alias("out"),
    )
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.array(*[F.lit(w) for w in ws]).alias("words")) for f, ws in table.items()
    ])

    def assign(acc: Column, field: Column, cols: Column) -> Column:
        fitting = F.filter(
            F.transform(cols, lambda h, i: F.when(
                (h != "") & F.exists(field["words"], lambda w: F.contains(h, w)) & ~F.array_contains(acc["used"], i), i
            )),
            lambda i: i.isNotNull(),
        )

        def take(i: Column) -> Column:
            entry = F.struct(field["field"].alias("key"), col_letter(i).alias("value"))
            return F.when(i.isNull(), acc).otherwise(
                F.struct(F.array_append(acc["used"], i).alias("used"), F.array_append(acc["out"], entry).alias("out"))
            )

        return let(F.get(fitting, F.lit(0)), take)

    return let(labels, lambda cols: F.map_from_entries(
        F.aggregate(fields, state, lambda acc, f: assign(acc, f, cols))["out"]
    ))


def body_rows(grid: DataFrame, header: DataFrame, header_rows: int = 1) -> DataFrame:
    """Rows below the header that hold any value."""
    n = max(1, header_rows)
    rows = grid.join(header, SHEET).where(F.col("row_no") >= F.col("header_row") + n)
    return rows.where(F.exists("cells", _filled)).select(*grid.columns)


def preview_columns(grid: DataFrame, header: DataFrame, header_rows: int = 1, sample_n: int = 5) -> DataFrame:
    """Per column: letter, header and the values of the first body rows."""
    n = max(1, header_rows)
    labels = combine_headers(grid, header, header_rows).select(*SHEET, F.posexplode("headers").alias("col", "header"))
    body = grid.join(header, SHEET).where(
        (F.col("row_no") >= F.col("header_row") + n) & (F.col("row_no") < F.col("header_row") + n + sample_n)
    )
    values = (
        body.select(*SHEET, "row_no", F.posexplode("cells").alias("col", "v")).where(_filled(F.col("v")))
        .groupBy(*SHEET, "col").agg(F.array_sort(F.collect_list(F.struct("row_no", "v"))).alias("_s"))
    )
    samples = F.coalesce(F.transform("_s", lambda x: x["v"]), F.array().cast("array<string>"))
    return labels.join(values, [*SHEET, "col"], "left").select(
        *SHEET, "col", col_letter("col").alias("letter"), "header", samples.alias("samples")
    )


def preview_rows(grid: DataFrame, n: int = 12) -> DataFrame:
    """First rows of each sheet with blanks for empty cells, to choose the header from."""
    return grid.where(F.col("row_no") < n).select(
        *SHEET, "row_no", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells")
    )


# --- load ----------------------------------------------------------------------------------------
def specs_of(mapping: Mapping[str, object]) -> dict[str, CellSpec]:
    """Mapping values to cell specifications; department and product have to be mapped."""
    missing = [f for f in REQUIRED_FIELDS if not mapping.get(f)]
    if missing:
        raise ValueError(f"mapping lacks {', '.join(missing)}")
    specs = {f: CellSpec.of(v) for f, v in mapping.items()}
    return {f: s for f, s in specs.items() if s is not None}


def map_rows(body: DataFrame, mapping: Mapping[str, object]) -> DataFrame:
    """Mapped fields of each body row, with version split off the product cell where none is given."""
    specs = specs_of(mapping)

    def cell(field: str) -> Column:
        return resolve_cell("cells", specs.get(field))

    product = cell("product_key")
    whole = resolve_cell("cells", CellSpec(specs["product_key"].index))
    version = F.coalesce(cell("version_norm"), blank_to_null(split_product_version(whole)["version"]))
    used = F.array(*[F.lit(s.index) for s in specs.values()])
    entries = F.filter(
        F.transform("cells", lambda c, i: F.struct(
            F.when(_filled(c) & ~F.array_contains(used, i), col_letter(i)).alias("key"), strip(c).alias("value")
        )),
        lambda e: e["key"].isNotNull(),
    )
    return body.select(
        *SHEET, "row_no",
        (F.col("row_no") + 1).alias("line"),
        F.coalesce(
            cell("asset_no"),
            F.concat_ws("-", F.lit("AUTO"), F.col("import_id").cast("string"), (F.col("row_no") + 1).cast("string")),
        ).alias("asset_no"),
        cell("department").alias("department"),
        product.alias("product_raw"),
        F.when(product.isNotNull(), normalize_product(
            F.coalesce(blank_to_null(split_product_version(product)["product"]), product)
        )).otherwise(F.lit("")).alias("product_key"),
        version.alias("version_raw"),
        normalize_version(version).alias("version_norm"),
        cell("ip").alias("ip"), cell("owner_name").alias("owner_name"), cell("owner_team").alias("owner_team"),
        cell("owner_contact").alias("owner_contact"),
        F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias("extra"),
    )


def missing_departments(rows: DataFrame, department: DataFrame) -> DataFrame:
    """Department names of a ledger that do not exist yet."""
    named = rows.where(~is_blank("department")).select(F.col("department").alias("name")).distinct()
    return named.join(department.select("name"), "name", "left_anti")


def with_issues(rows: DataFrame, department: DataFrame, create_departments: bool = True) -> DataFrame:
    """Add ``issues ARRAY<STRUCT<code,value>>`` to mapped rows."""
    known = department.select(F.col("name").alias("department"), F.lit(True).alias("_known"))

    def issue(code: str, value: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), value.alias("value"))

    nothing = F.lit(None).cast("struct<code:string,value:string>")
    unknown = F.lit(False) if create_departments else F.col("_known").isNull()
    issues = F.array(
        F.when(F.col("department").isNull(), issue("MISSING_DEPARTMENT", F.lit("")))
        .when(unknown, issue("UNKNOWN_DEPARTMENT", F.col("department"))).otherwise(nothing),
        F.when(F.col("product_raw").isNull(), issue("MISSING_PRODUCT", F.lit(""))).otherwise(nothing),
        F.when(F.col("version_raw").isNull(), issue("MISSING_VERSION", F.lit(""))).otherwise(nothing),
    )
    return rows.join(known, "department", "left").select(*rows.columns, F.array_compact(issues).alias("issues"))


def _has(*codes: str) -> Column:
    return F.exists("issues", lambda i: i["code"].isin(*codes))


def loadable(rows: DataFrame, on_warning: str = "skip") -> DataFrame:
    """Rows that go into the table. Without a department a row cannot be loaded; without a product only
    when ``on_warning`` is ``reject``."""
    blocked = ["MISSING_DEPARTMENT", "UNKNOWN_DEPARTMENT"] + (["MISSING_PRODUCT"] if on_warning == "reject" else [])
    return rows.where(~_has(*blocked))


def import_warnings(rows: DataFrame) -> DataFrame:
    """One row per issue with the sheet's own row number."""
    return rows.select(*SHEET, "line", F.explode("issues").alias("i")).select(
        *SHEET, "line", F.col("i.code").alias("issue"), F.col("i.value").alias("value")
    )


def duplicate_asset_numbers(rows: DataFrame) -> DataFrame:
    """Earlier rows of a ledger that a later row with the same asset number replaces."""
    last = rows.groupBy("asset_no").agg(F.max(F.struct("import_id", "row_no")).alias("_last"), F.count("*").alias("_n"))
    repeated = last.where("_n > 1").select("asset_no", "_last")
    return rows.join(repeated, "asset_no").where(F.struct("import_id", "row_no") != F.col("_last")).select(
        *SHEET, "line", F.lit("DUPLICATE_ASSET_NO").alias("issue"), F.col("asset_no").alias("value")
    )


def import_stats(body: DataFrame, rows: DataFrame, department: DataFrame, on_warning: str = "skip") -> DataFrame:
    """Per import: rows of the body, loaded rows, warnings and departments created.

    ``body``: all rows below the header; ``rows``: mapped rows with issues.
    """
    ok = ~_has("MISSING_DEPARTMENT", "UNKNOWN_DEPARTMENT", *(["MISSING_PRODUCT"] if on_warning == "reject" else []))
    total = body.groupBy("import_id").agg(F.count("*").alias("total_rows"))
    per = rows.groupBy("import_id").agg(
        F.count_if(ok).alias("committed"), F.sum(F.size("issues")).alias("warnings")
    )
    fresh = (
        rows.join(missing_departments(rows, department).withColumnRenamed("name", "department"), "department", "left_semi")
        .groupBy("import_id").agg(F.count_distinct("department").alias("created_departments"))
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("committed", "warnings", "created_departments")}
    return total.join(per, "import_id", "left").join(fresh, "import_id", "left").withColumns(zero)


def commit_assets(
    body: DataFrame, mapping: Mapping[str, object], asset: DataFrame, department: DataFrame,
    mode: str = "append", on_warning: str = "skip", create_departments: bool = True,
) -> dict[str, DataFrame]:
    """Load mapped ledger rows: next ``asset`` and ``department`` tables, ``warnings`` and the mapped ``rows``.

    Keys are asset number and department name. ``mode='replace'`` starts from an empty asset table. The last
    row of an asset number wins, and the earlier ones are reported. Where the tables have ``department_id`` and ``asset_id``,
    new rows get one (see :func:`with_keys`); the ids follow from the names, so they are the same at every evaluation.
    """
    rows = with_issues(map_rows(body, mapping), department, create_departments)
    good = loadable(rows, on_warning)
    created = missing_departments(rows, department) if create_departments else None
    last = first_per(good, ["asset_no"], F.col("import_id").desc(), F.col("row_no").desc())
    changes = last.select(
        "asset_no", "department", "product_raw", "product_key", "version_raw", "version_norm", "ip", "owner_name",
        "owner_team", "owner_contact", F.lit("NORMAL").alias("status"),
        F.col("import_id").alias("import_batch_id"), "extra",
    )
    base = asset.where(F.lit(False)) if mode == "replace" else asset
    next_department = department
    if created is not None:
        if "department_id" in department.columns:
            created = _new_ids(created, department, "department_id")
        next_department = department.unionByName(
            created.withColumn("is_active", F.lit(True)) if "is_active" in department.columns else created,
            allowMissingColumns=True,
        )
    return {
        "asset": upsert(base, changes, ["asset_no"]).drop("_action"),
        "department": next_department,
        "warnings": import_warnings(rows).unionByName(duplicate_asset_numbers(good)),
        "rows": rows,
    }


def _new_ids(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Ids above those of ``table``, gapless in the order of the names."""
    last = table.agg(F.max(key)).first()[0] or 0
    return dense_ids(rows, key, ["name"], last).withColumn(key, F.col(key).cast(table.schema[key].dataType))


def with_keys(asset: DataFrame, department: DataFrame) -> DataFrame:
    """A loaded asset table with ``asset_id`` and ``department_id``, ready for matching.

    Assets that have an id keep it, others get the next ones in the order of their numbers; the department's id follows from its
    name, which is unique.
    ``department`` is the stored table that :func:`commit_assets` returned.
    """
    named = department.select(F.col("name").alias("department"), F.col("department_id").alias("_department_id"))
    rows = asset.join(named, "department", "left")
    old = F.col("department_id") if "department_id" in asset.columns else F.lit(None).cast("bigint")
    rows = rows.withColumn("department_id", F.coalesce("_department_id", old)).drop("_department_id")
    if "asset_id" not in asset.columns:
        rows = rows.withColumn("asset_id", F.lit(None).cast("bigint"))
    last = rows.agg(F.max("asset_id")).first()[0] or 0
    new = dense_ids(rows.where("asset_id IS NULL"), "asset_id", ["asset_no"], last)
    return rows.where("asset_id IS NOT NULL").unionByName(new)


def saved_mapping(mappings: DataFrame, name: str) -> dict[str, object]:
    """A saved column mapping by its name, ready for :func:`map_rows`.

    ``mappings``: ``name, mapping MAP<field, STRUCT<col,sep,part,mode>>``, one row per name.
    """
    row = mappings.where(F.col("name") == name).select("mapping").first()
    if row is None:
        raise ValueError(f"no mapping named {name}")
    return {f: {k: v for k, v in spec.asDict().items() if v is not None} for f, spec in row["mapping"].items()}
