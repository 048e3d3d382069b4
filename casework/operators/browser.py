"""Browser history, activity timeline and download quarantine extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casework.functions import paths, text, time

FILE_KEYS = ["case_id", "os_path"]

# Chromium visit sources; any other code reads as Local.
VISIT_SOURCES = {
    0: "Synced",
    1: "Local",
    2: "Extension",
    3: "ImportFromFirefox",
    4: "ImportFromSafari",
    6: "ImportFromChromeOrEdge",
    7: "ImportFromEdgeHTML",
}


def visit_source_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in VISIT_SOURCES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("Local"))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return _n(name) != 0


def chromium_visits(
    urls: DataFrame, visits: DataFrame, visit_source: DataFrame, browser: Column, user: Column | None = None
) -> DataFrame:
    """One row per visit: url and source attached, codes named, missing counters zero.

    Visits meet the sparse source table first (unique visit ids), so that the join on url ids, the
    one with hot keys, comes last where the adaptive skew split may act on it.
    """
    v = visits.select(
        *FILE_KEYS, F.col("id").alias("visit_id"), F.col("url").alias("url_id"),
        "visit_time", "from_visit", "visit_duration", "transition",
    )
    s = visit_source.select(*FILE_KEYS, F.col("id").alias("visit_id"), "source")
    u = urls.withColumnsRenamed({"id": "url_id", "url": "visited_url"})
    joined = v.join(s, [*FILE_KEYS, "visit_id"], "left").join(u, [*FILE_KEYS, "url_id"])
    return joined.select(
        "case_id",
        browser.alias("browser"),
        (user if user is not None else paths.windows_user(F.col("os_path"))).alias("user"),
        "url_id",
        "visited_url",
        _s("title").alias("title"),
        _n("visit_count").alias("visit_count"),
        _n("typed_count").alias("typed_count"),
        _flag("hidden").alias("hidden"),
        _n("from_visit").alias("from_url_id"),
        visit_source_name(F.coalesce("source", F.lit(1))).alias("source"),
        _n("visit_duration").alias("visit_duration_microseconds"),
        _n("transition").alias("transition"),
        "os_path",
        time.webkit_text(F.col("visit_time")).alias("visit_time"),
        time.webkit_text(F.col("last_visit_time")).alias("last_visit_time"),
    )


def firefox_visits(places: DataFrame, historyvisits: DataFrame) -> DataFrame:
    h = historyvisits.select(*FILE_KEYS, F.col("id").alias("visit_id"), "from_visit", "visit_date", "place_id")
    p = places.withColumnsRenamed({"id": "place_id", "url": "visited_url"})
    return h.join(p, [*FILE_KEYS, "place_id"]).select(
        "case_id",
        F.lit("firefox").alias("browser"),
        paths.windows_user(F.col("os_path")).alias("user"),
        "visit_id",
        _n("from_visit").alias("from_visit"),
        "visited_url",
        _s("title").alias("title"),
        _s("rev_host").alias("rev_host"),
        _n("visit_count").alias("visit_count"),
        _flag("hidden").alias("hidden"),
        _flag("typed").alias("typed"),
        _s("description").alias("description"),
        "os_path",
        time.unix_us_text(F.col("visit_date")).alias("visit_time"),
    )


def timeline_activity(activity: DataFrame) -> DataFrame:
    return activity.select(
        "case_id",
        paths.windows_user(F.col("os_path")).alias("user"),
        text.app_from_json(_s("AppId")).alias("application"),
        _s("AppId").alias("app_id"),
        F.col("LastModifiedTime").alias("last_modified"),
        "os_path",
    )


def mac_chrome_urls(urls: DataFrame) -> DataFrame:
    return urls.select(
        "case_id",
        F.lit("chrome").alias("browser"),
        paths.mac_user(F.col("os_path")).alias("user"),
        F.col("url").alias("visited_url"),
        _s("title").alias("title"),
        _n("visit_count").alias("visit_count"),
        _n("typed_count").alias("typed_count"),
        "os_path",
        time.webkit_text(F.col("last_visit_time")).alias("last_visit_time"),
    )


# Quarantine table columns -> output columns.
QUARANTINE_COLUMNS = {
    "LSQuarantineDataURLString": "download_url",
    "LSQuarantineOriginURLString": "origin",
    "LSQuarantineAgentName": "agent_name",
    "LSQuarantineAgentBundleIdentifier": "agent_bundle",
    "LSQuarantineEventIdentifier": "event_uuid",
}


def quarantine_events(events: DataFrame) -> DataFrame:
    return events.select(
        "case_id",
        paths.mac_user(F.col("os_path")).alias("user"),
        *[_s(src).alias(out) for src, out in QUARANTINE_COLUMNS.items()],
        "os_path",
        time.cocoa_text(F.col("LSQuarantineTimeStamp")).alias("download_time"),
    )
