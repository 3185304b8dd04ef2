"""URL filters over time: dated list entries become validity intervals, and each capture is judged as of its fetch day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.session import store

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and every domain above it: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, domain, action 'add' or 'remove', day) -> (list, domain, valid_from, valid_to), end exclusive.

    Within a list and domain an addition opens an interval unless one is open, and a removal closes it; valid_to is null
    while it is open. If a day has both, the removal counts. A list and domain keep at most one change per day, so once the
    days are merged (with partial aggregates) a group is bounded by the calendar, however many entries repeat. Domains are
    compared in lower case without a final dot. Entries with a null field or another action are left out.
    """
    domain = F.rtrim(F.lower("domain"), F.lit("."))
    off = F.when(F.col("action") == REMOVE, True).when(F.col("action") == ADD, False)
    rows = entries.select("list", domain.alias("domain"), off.alias("off"), F.col("day").cast("date").alias("day"))
    rows = rows.dropna().groupBy("list", "domain", "day").agg(F.bool_or("off").alias("off"))
    by_day = Window.partitionBy("list", "domain").orderBy("day")
    changed = rows.withColumn("was_off", F.lag("off", 1, True).over(by_day)).where("off <> was_off")
    spans = changed.withColumn("valid_to", F.lead("day").over(by_day)).where("NOT off")
    return spans.select("list", "domain", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """Every capture (key, url, fetched) with the lists that held its host or a domain above it on the fetch day.

    Columns: key, host, fetched, lists (names in order, comma-joined; empty if none), n_entries, since (the latest start of
    an interval that holds), blocked. The verdict hangs on host and day only, so captures are first reduced to distinct hosts
    and days: a host with a third of all captures costs one row per day. Hosts are split into domains and joined with the
    intervals by domain and year; an interval stands in each year it touches, up to the last fetch, so a domain and year
    holds at most a few hundred intervals of a list. The verdicts return to the captures by an equi-join with one row per
    host and day, which Spark splits where a host is hot.

    A capture without host or day is not blocked and has n_entries 0. Repeated captures stay. Other columns are left out, of
    either table. No captures: no rows; no entries: nothing is blocked.
    """
    rows = captures.select(F.col(key).alias("_key"), host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    asked = store(rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct(), "asked")
    first, last = asked.agg(F.year(F.min("fetched")), F.year(F.max("fetched"))).first()
    spans = intervals(entries)
    from_year = F.greatest(F.year("valid_from"), F.lit(first))
    to_year = F.least(F.year(F.coalesce(F.date_sub("valid_to", 1), F.lit("9999-12-31").cast("date"))), F.lit(last))
    yearly = spans.where(from_year <= to_year).withColumn("year", F.explode(F.sequence(from_year, to_year)))
    probes = asked.select("host", "fetched", F.year("fetched").alias("_year"), F.explode(domains_of(F.col("host"))).alias("_domain"))
    active = (
        (F.col("_domain") == F.col("domain"))
        & (F.col("_year") == F.col("year"))
        & (F.col("fetched") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    held = probes.join(yearly, active)
    by_list = held.groupBy("host", "fetched", "list").agg(F.count("*").alias("n"), F.max("valid_from").alias("since"))
    verdicts = by_list.groupBy(F.col("host").alias("_host"), F.col("fetched").alias("_day")).agg(
        F.array_join(F.sort_array(F.collect_list("list")), ",").alias("lists"),
        F.sum("n").alias("n_entries"),
        F.max("since").alias("since"),
    )
    here = (F.col("host") == F.col("_host")) & (F.col("fetched") == F.col("_day"))
    return rows.join(verdicts, here, "left").select(
        F.col("_key").alias(key), "host", "fetched",
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        "since",
        F.col("lists").isNotNull().alias("blocked"),
    )
