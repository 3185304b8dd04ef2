"""Notification planning: department groups, messages, keys, delivery results, reminders."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.constants import (
    AUTO_DEPLOY_OWNER, CLOSED_ACKS, DEFAULT_CHANNELS, DELIVERED, OPEN_ACKS, SYSTEM_LABEL, TRACKED_STATUSES,
)
from exposure.functions.deadlines import d_day
from exposure.functions.messages import message_frame, message_line
from exposure.operators.ranks import dense_ids
from exposure.operators.skew import first_per
from exposure.operators.state import overlay

GROUP = ["advisory_id", "department_id"]


def _line() -> Column:
    return message_line(
        F.col("asset_no"),
        F.coalesce(F.nullif(F.col("product_raw"), F.lit("")), F.col("product_key")),
        F.coalesce(F.nullif(F.col("version_raw"), F.lit("")), F.col("version_norm")),
        F.col("cve_id_text"), F.col("severity"),
    )


def message_lines(active: DataFrame, cve: DataFrame) -> DataFrame:
    """Lines of the messages as a keyed table: the group, the place (code, asset), the line.

    ``active`` are active matches with their asset. No group is brought together for this.
    """
    severity = cve.select(F.col("cve_id").alias("cve_id_text"), "severity")
    return active.join(severity, "cve_id_text", "left").select(*GROUP, "cve_id_text", "asset_id", _line().alias("line"))


def message_assets(active: DataFrame) -> DataFrame:
    """Assets of the messages as a keyed table: the group, the asset, each once. No group is brought together for this."""
    return active.where("asset_id IS NOT NULL").select(*GROUP, "asset_id").distinct()


def message_keys(active: DataFrame) -> DataFrame:
    """Per (advisory, department) the number of assets and the key, SHA-256 of ``advisory:department:[sorted distinct asset ids]``.

    A digest needs its text in order, not at once: the ids of a group are sorted within a task, which may spill, and pass
    through the digest one batch after the other. No list of a group is built, whatever its size; groups that begin and end in a
    batch are told together.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, n, last = None, None, 0, None  # the group that may go on in the next batch, and its last id
        names = [*GROUP, "asset_total", "idempotency_key"]

        def finished(first: pa.Array, second: pa.Array, totals: list[int], keys: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([first, second, pa.array(totals, pa.int64()), pa.array(keys, pa.string())], names)

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            columns = [batch.column(c) for c in GROUP]
            change = np.zeros(rows - 1, bool)
            for c in columns:
                later, earlier = c.slice(1), c.slice(0, rows - 1)
                same = pc.fill_null(pc.equal(later, earlier), False)
                both = pc.and_(pc.is_null(later), pc.is_null(earlier))
                change |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(change) + 1]
            heads = [c.take(pa.array(starts)) for c in columns]
            ids = batch.column("id")
            again = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, rows - 1)), False).to_numpy(zero_copy_only=False) & ~change
            first_again = digest is not None and last is not None and ids[0].as_py() == last and tuple(h[0].as_py() for h in heads) == group
            kept = pc.is_valid(ids).to_numpy(zero_copy_only=False) & ~np.r_[first_again, again]
            edges = np.r_[0, np.cumsum(kept)][np.r_[starts, rows]]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids.filter(pa.array(kept)))
            sizes, joined, last = np.diff(edges).tolist(), pc.binary_join(lists, ", "), ids[rows - 1].as_py()
            parts = [pc.fill_null(pc.binary_join_element_wise(h, "", ":"), "") for h in heads]
            texts = pc.binary_join_element_wise(*parts, "[", joined, "").to_pylist()
            totals, keys, at = [], [], 0
            head = tuple(h[0].as_py() for h in heads)
            if digest is not None and head == group:
                if sizes[0]:
                    digest.update(((", " if n else "") + joined[0].as_py()).encode())
                    n, at = n + sizes[0], 1
                else:
                    at = 1
            if digest is not None and (at == 0 or len(texts) > 1):
                digest.update(b"]")
                yield finished(pa.array([group[0]], pa.string()), pa.array([group[1]], pa.string()), [n], [digest.hexdigest()])
                digest = None
            done = len(texts) - 1
            if done > at:
                keys = [hashlib.sha256(f"{t}]".encode()).hexdigest() for t in texts[at:done]]
                totals = sizes[at:done]
                yield finished(heads[0].slice(at, done - at), heads[1].slice(at, done - at), totals, keys)
            if digest is None:
                group, n = tuple(h[done].as_py() for h in heads), sizes[done]
                digest = hashlib.sha256(texts[done].encode())
        if digest is not None:
            digest.update(b"]")
            yield finished(pa.array([group[0]], pa.string()), pa.array([group[1]], pa.string()), [n], [digest.hexdigest()])

    text = [F.col(c).cast("string").alias(c) for c in GROUP]
    ids = active.select(*GROUP, "asset_id").repartition(*GROUP).sortWithinPartitions(*GROUP, "asset_id")
    found = ids.select(*text, F.col("asset_id").cast("string").alias("id")).mapInArrow(
        digests, "advisory_id string, department_id string, asset_total bigint, idempotency_key string"
    )
    return found.select(*[F.col(c).cast(active.schema[c].dataType).alias(c) for c in GROUP], "asset_total", "idempotency_key")


def _by_group(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of both sides of a group; a missing department is a group, too."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in GROUP})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP]
    return left.join(right, same[0] & same[1], how).drop(*[f"_{c}" for c in GROUP])


def message_headers(active: DataFrame, sentinel: str = AUTO_DEPLOY_OWNER) -> DataFrame:
    """One row per (advisory, department) of any size: rows, owners and codes in first-seen order, number of assets, key.

    Only the distinct owners and codes of a group come together, after a first aggregation by owner and by code.
    The assets are the rows of :func:`message_assets`.
    """
    by_owner = active.groupBy(*GROUP, "owner_name").agg(
        F.count("*").alias("_n"), F.min(F.struct("cve_id_text", "asset_id")).alias("_at")
    )
    named = F.when(~F.col("owner_name").isin("", sentinel), F.struct("_at", F.col("owner_name").alias("owner")))
    groups = by_owner.groupBy(*GROUP).agg(
        F.sum("_n").alias("asset_count"), F.array_sort(F.collect_list(named)).alias("_owners")
    )
    codes = active.select(*GROUP, "cve_id_text").distinct().groupBy(*GROUP).agg(F.array_sort(F.collect_list("cve_id_text")).alias("cves"))
    owners = F.array_join(F.transform("_owners", lambda o: o["owner"]), ", ")
    return _by_group(_by_group(groups, codes), message_keys(active)).select(
        *GROUP, "asset_count", F.coalesce(F.nullif(owners, F.lit("")), F.lit(SYSTEM_LABEL)).alias("owners"), "cves",
        "asset_total", "idempotency_key",
    )


def with_assets(groups: DataFrame, active: DataFrame) -> DataFrame:
    """The rows with the sorted asset ids of their group in one value, for where a list is asked for: eight bytes an asset,
    and at most 2 GB a row."""
    listed = active.groupBy(*GROUP).agg(F.array_sort(F.collect_set("asset_id")).alias("asset_ids"))
    return _by_group(groups, listed)


def message_groups(active: DataFrame, sentinel: str = AUTO_DEPLOY_OWNER) -> DataFrame:
    """:func:`message_headers` with the asset ids as a list."""
    return with_assets(message_headers(active, sentinel), active)


def messages(
    active: DataFrame, department: DataFrame, advisory: DataFrame, sentinel: str = AUTO_DEPLOY_OWNER
) -> DataFrame:
    """Header of every message: group, department, codes, number of assets, key, and the text before and after the lines."""
    dept = department.select("department_id", F.col("name").alias("department"))
    head, foot = message_frame(
        F.col("title"), F.col("doc_no"), F.col("source_org"), F.col("due_at"), F.col("department"), F.col("owners"),
        F.col("asset_count"),
    )
    return (
        message_headers(active, sentinel)
        .join(dept, "department_id", "left")
        .withColumn("department", F.coalesce("department", F.col("department_id").cast("string")))
        .join(advisory.select("advisory_id", "title", "doc_no", "source_org", "due_at"), "advisory_id")
        .select(
            *GROUP, "department", "asset_count", "owners", "cves", "asset_total", "idempotency_key",
            head.alias("message_head"), foot.alias("message_foot"),
        )
    )


def with_text(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """The complete text of each header's message, for delivery: a text names every line of its group."""
    own = _by_group(lines, headers.select(*GROUP).distinct(), "left_semi")
    listed = own.groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct("cve_id_text", "asset_id", "line"))).alias("_lines")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return _by_group(headers, listed, "left").withColumn(
        "message", F.concat("message_head", F.coalesce(text, F.lit("")), "message_foot")
    ).drop("_lines")


def notification_preview(
    active: DataFrame, department: DataFrame, advisory: DataFrame, notifications: DataFrame,
    sentinel: str = AUTO_DEPLOY_OWNER,
) -> DataFrame:
    """Per (advisory, department): rows, owners, codes in first-seen order, message frame, already sent?"""
    sent = (
        notifications.where(F.col("status").isin(*DELIVERED)).select(*GROUP).distinct()
        .withColumn("_sent", F.lit(True))
    )
    return (
        _by_group(messages(active, department, advisory, sentinel), sent, "left")
        .select(
            *GROUP, "department", "asset_count", "owners",
            F.size("cves").alias("issue_count"), F.array_join("cves", ", ").alias("cve_list"),
            "message_head", "message_foot",
            F.array(*[F.lit(c) for c in DEFAULT_CHANNELS]).alias("default_channels"),
            F.coalesce("_sent", F.lit(False)).alias("sent"),
        )
    )


def sent_targets(groups: DataFrame, notifications: DataFrame) -> DataFrame:
    """Per advisory: matched departments, how many of them were sent to, and whether all were."""
    sent = notifications.where(F.col("status").isin(*DELIVERED)).select(*GROUP).distinct()
    marked = _by_group(groups.select(*GROUP).distinct(), sent.withColumn("_sent", F.lit(True)), "left")
    return marked.groupBy("advisory_id").agg(
        F.count("*").alias("total_departments"),
        F.count("_sent").alias("sent_count"),
        F.bool_and(F.col("_sent").isNotNull()).alias("all_sent"),
    )


def all_sent(groups: DataFrame, notifications: DataFrame) -> DataFrame:
    """Advisories whose every matched department has been sent to."""
    return sent_targets(groups, notifications).where("all_sent").select("advisory_id")


def plan_notifications(
    active: DataFrame, department: DataFrame, advisory: DataFrame, notifications: DataFrame,
    targets: DataFrame | None = None, channels: Sequence[str] = DEFAULT_CHANNELS, listed: bool = False,
) -> DataFrame:
    """What to send: one row per target department with its key, assets, message frame and action.

    ``action``: ``skip`` when the same key was already delivered, ``retry`` when it failed before, else
    ``send``. ``targets`` (advisory_id, department_id[, channels]) narrows the departments. :func:`with_text` adds the
    complete texts. The asset ids are the rows of :func:`message_assets`, so that no value grows with a group; ``listed`` adds them as a list.
    """
    default = F.array(*[F.lit(c) for c in channels])
    if targets is not None:
        active = _by_group(active, targets.select(*GROUP).distinct(), "left_semi")
    plan = messages(active, department, advisory)
    if listed:
        plan = with_assets(plan, active)
    if targets is not None and "channels" in targets.columns:
        plan = _by_group(plan, targets.select(*GROUP, "channels"))
    else:
        plan = plan.withColumn("channels", F.lit(None).cast("array<string>"))
    known = first_per(notifications, ["idempotency_key"], F.col("notification_id")).select(
        "idempotency_key", F.col("notification_id").alias("existing_id"), F.col("status").alias("_status")
    )
    action = F.when(F.col("_status").isin(*DELIVERED), "skip").when(F.col("_status").isNotNull(), "retry").otherwise("send")
    return plan.join(known, "idempotency_key", "left").select(
        *GROUP, "department", "idempotency_key", *(["asset_ids"] if listed else []), "asset_total",
        F.coalesce("channels", default).alias("channels"), "message_head", "message_foot", action.alias("action"), "existing_id",
    )


def planned_rows(plan: DataFrame, last_id: int) -> DataFrame:
    """Notification rows of a plan, with its texts and lists where it has them: a new id above ``last_id`` for ``send``, the failed row's id for ``retry``.

    New ids are gapless in the order of advisory and department, so they are the same at every evaluation.
    """
    fresh = dense_ids(plan.where("action NOT IN ('skip', 'retry')"), "notification_id", GROUP, last_id)
    retried = plan.where("action = 'retry'").withColumn("notification_id", F.col("existing_id"))
    return fresh.unionByName(retried.select(*fresh.columns)).select(
        "notification_id", *GROUP, "channels",
        *[c for c in ("message", "asset_ids") if c in plan.columns],
        "idempotency_key", F.lit("PENDING").alias("status"), F.lit("NONE").alias("ack_status"),
        F.lit(0).alias("reminder_count"),
    )


def notification_assets(notifications: DataFrame, active: DataFrame) -> DataFrame:
    """Assets of written notification rows as a keyed table: ``notification_id, idempotency_key, asset_id``."""
    rows = _by_group(message_assets(active), notifications.select(*GROUP, "notification_id", "idempotency_key"))
    return rows.select("notification_id", "idempotency_key", "asset_id")


def delivery_outcome(results: DataFrame) -> DataFrame:
    """Channel results to one status per notification: SENT when every channel worked."""
    return results.groupBy("notification_id").agg(
        F.when(F.bool_and("ok"), "SENT").otherwise("FAILED").alias("status")
    )


def apply_delivery(notifications: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Record the outcome and the sending time."""
    return overlay(
        notifications, delivery_outcome(results), ["notification_id"],
        {"status": F.col("new_status"), "sent_at": at},
    )


def finish_sending(
    advisory: DataFrame, groups: DataFrame, notifications: DataFrame, targets: DataFrame
) -> DataFrame:
    """Advisories of this run become COMPLETED once every matched department was sent to, else NOTIFYING.

    ``targets`` (advisory_id, ..) are what this run sent, ``groups`` all matched departments. Advisories without a target
    and archived ones keep their status.
    """
    sent = targets.select("advisory_id").distinct()
    state = sent_targets(groups.join(sent, "advisory_id", "left_semi"), notifications).select("advisory_id", "all_sent")
    moved = F.col("all_sent").isNotNull() & (F.col("status") != "ARCHIVED")
    status = F.when(moved & F.col("all_sent"), "COMPLETED").when(moved, "NOTIFYING")
    return advisory.join(state, "advisory_id", "left").withColumn(
        "status", F.coalesce(status, F.col("status"))
    ).select(*advisory.columns)


# --- reminders -----------------------------------------------------------------------------------
def open_targets(notifications: DataFrame, department_ids: Sequence[int] | None = None) -> DataFrame:
    """Notifications without a final reply, optionally of some departments only."""
    out = notifications.where(F.col("ack_status").isin(*OPEN_ACKS))
    return out.where(F.col("department_id").isin(*department_ids)) if department_ids else out


def due_reminders(
    advisory: DataFrame, notifications: DataFrame, as_of: dt.date | str | Column, within_days: int = 3
) -> DataFrame:
    """Open notifications of tracked advisories that are due within some days or overdue."""
    due = (
        advisory.where(F.col("status").isin(*TRACKED_STATUSES) & F.col("due_at").isNotNull())
        .select("advisory_id", "doc_no", d_day("due_at", as_of).alias("d_day"))
        .where(F.col("d_day") <= within_days)
    )
    waiting = notifications.where(~F.col("ack_status").isin(*CLOSED_ACKS))
    return waiting.join(due, "advisory_id").select(
        "advisory_id", "doc_no", "notification_id", "department_id", "ack_status", "d_day",
        (F.col("d_day") < 0).alias("overdue"), "reminder_count", F.col("reminded_at").alias("last_reminded"),
    )


def apply_reminders(notifications: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Count a reminder and note its time where the delivery worked; only open notifications take part."""
    ok = delivery_outcome(results).where("status = 'SENT'").select("notification_id")
    targets = open_targets(notifications).select("notification_id").join(ok, "notification_id", "left_semi")
    return overlay(
        notifications, targets, ["notification_id"],
        {"reminder_count": F.coalesce("reminder_count", F.lit(0)) + 1, "reminded_at": at},
    )
