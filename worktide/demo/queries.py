"""One runnable query per operator, over evidence derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktide.demo import evidence as demo
from worktide.demo import raw as logs
from worktide.evidence import COUNTERS, Evidence
from worktide.functions import labels
from worktide.functions.time import calendar_columns, elapsed_micros, is_fresh, local_date, local_midnight
from worktide.operators import attribution, hierarchy, intervals, pricing, usage
from worktide.operators import quota as quotas
from worktide.operators import normalize, select, status
from worktide.plans import listing, quota_reports, time_reports, token_reports
from worktide.plans.overview import overview as build_overview
from worktide.plans.period import Period, evidence_dates
from worktide.sources import metadata, rollouts, sinks
from worktide.sources.evidence import load_period as near_period
from worktide.streaming import samples as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WEEK = Period(date(2024, 1, 8), date(2024, 1, 14), demo.TZ)
DAY = Period(date(2024, 1, 10), date(2024, 1, 10), demo.TZ)


def flat(df: DataFrame) -> DataFrame:
    """Plain columns only: instants as µs, dates as text, arrays joined."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            columns.append(F.unix_micros(column).alias(f"{field.name}_us"))
        elif isinstance(field.dataType, T.DateType):
            columns.append(column.cast("string").alias(field.name))
        elif isinstance(field.dataType, T.ArrayType):
            columns.append(F.array_join(column, ",").alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            columns.append(F.round(column.cast("double"), 6).alias(field.name))
        else:
            columns.append(column.alias(field.name))
    return df.select(*columns)


def query(build: Callable[[Evidence], DataFrame]) -> Callable[[Evidence], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: flat(build(demo.evidence(spark, sf_dir)))
    return build


def table_query(build: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from worktide.session import prepare

        prepare(spark)
        return flat(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


# --- intervals -------------------------------------------------------------------


@query
def merge_spans(ev: Evidence) -> DataFrame:
    return intervals.merge_spans(ev.turns, ["session_id"])


@query
def subtract_spans(ev: Evidence) -> DataFrame:
    pieces = intervals.turn_pieces(ev.turns, ev.coverage)
    return intervals.subtract_spans(pieces, ev.waits, ["session_id"])


@query
def work_segments(ev: Evidence) -> DataFrame:
    return intervals.work_segments(ev.turns, ev.waits, ev.coverage)


@query
def split_by_local_day(ev: Evidence) -> DataFrame:
    split = intervals.split_by_local_day(ev.turns, demo.TZ)
    return split.select("session_id", F.col("id").alias("turn_id"), "day", "micros")


@query
def overlap_join(ev: Evidence) -> DataFrame:
    left = ev.turns.select("session_id", F.col("id").alias("turn_id"), "start", "end")
    right = ev.waits.select("session_id", F.col("turn_id").alias("waiting"), "start", "end")
    pairs = intervals.overlap_join(left, right, ["session_id"])
    return pairs.groupBy("session_id", "turn_id").agg(F.sum("micros").alias("micros"))


@query
def overlap_measure(ev: Evidence) -> DataFrame:
    windows = ev.turns.select("session_id", F.col("id").alias("window"), "start", "end")
    spans = ev.turns.select("session_id", "cwd", "start", "end")
    return intervals.overlap_measure(windows, spans, ["session_id"], ["cwd"]).withColumnRenamed(
        "window", "turn_id")


@query
def elapsed(ev: Evidence) -> DataFrame:
    return ev.turns.where(F.col("end") >= F.col("start")).select(
        "session_id", F.col("id").alias("turn_id"),
        elapsed_micros(F.col("start"), F.col("end")).alias("micros"))


QUERIES["elapsed_micros"] = QUERIES.pop("elapsed")


@query
def prune_to_period(ev: Evidence) -> DataFrame:
    return intervals.prune_to_period(
        ev.sessions, ev.turns, ev.coverage, DAY.start, DAY.end).select("id")


# --- model attribution -----------------------------------------------------------


@query
def context_timeline(ev: Evidence) -> DataFrame:
    return attribution.context_timeline(ev.turns, ev.contexts)


@query
def context_conflicts(ev: Evidence) -> DataFrame:
    return attribution.context_conflicts(ev.contexts)


@query
def latest_model(ev: Evidence) -> DataFrame:
    return attribution.latest_model(ev.contexts).drop("at")


@query
def attributed_segments(ev: Evidence) -> DataFrame:
    return attribution.attributed_segments(
        ev.sessions, ev.turns, ev.waits, ev.coverage, ev.contexts)


# --- working time ----------------------------------------------------------------


@query
def history_report(ev: Evidence) -> DataFrame:
    return time_reports.history_report(ev, demo.TZ, archive="all")


@query
def history_active_week(ev: Evidence) -> DataFrame:
    return time_reports.history_report(
        ev, demo.TZ, WEEK.first, WEEK.last, cwd="/view/", archive="active")


@query
def history_quality(ev: Evidence) -> DataFrame:
    return time_reports.history_quality(ev, archive="all")


@query
def model_time_report(ev: Evidence) -> DataFrame:
    return time_reports.model_time_report(ev, WEEK)


@query
def model_only_rollup(ev: Evidence) -> DataFrame:
    return time_reports.model_time_report(ev, WEEK, model_only=True)


@query
def distinct_uncertainty_sum(ev: Evidence) -> DataFrame:
    return time_reports.model_uncertainty_total(ev, WEEK)


# --- tokens and cost -------------------------------------------------------------

EXCLUDED = ("m3",)
RATE = Decimal("1.35")


def session_query(build: Callable[[SparkSession, Evidence], DataFrame]):
    QUERIES[build.__name__] = lambda spark, sf_dir: flat(
        build(spark, demo.evidence(spark, sf_dir)))
    return build


@table_query
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.counter_delta(demo.counter_rows(demo.events(spark, sf_dir)))
    return rows.select("event_id", *[F.col(f"delta.{n}").alias(n) for n in COUNTERS],
                       "diagnostics")


@table_query
def request_input_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.counter_delta(demo.counter_rows(demo.events(spark, sf_dir)))
    return rows.select(
        "event_id", usage.request_input(F.col("delta"), F.col("last_usage")).alias("request"))


@query
def usage_identity(ev: Evidence) -> DataFrame:
    """As many ids as readings, and each a 64-digit hash."""
    twice = ev.usage.unionByName(ev.usage)
    return twice.agg(F.countDistinct("id").alias("ids"), F.count("*").alias("readings"),
                     F.max(F.length("id")).alias("digits"))


@query
def dedupe_usage(ev: Evidence) -> DataFrame:
    once = token_reports.dedupe_usage(ev.usage.unionByName(ev.usage))
    return once.groupBy("session_id").agg(F.count("*").alias("observations"))


@query
def root_session(ev: Evidence) -> DataFrame:
    return hierarchy.root_sessions(ev.sessions)


@session_query
def price_usage(spark: SparkSession, ev: Evidence) -> DataFrame:
    priced = pricing.price_usage(ev.usage, demo.catalog(spark))
    return priced.select("session_id", "turn_id", "micro_usd", "priced_tokens", "unpriced_tokens",
                         "complete", "tier", "reasons")


def _cells(spark: SparkSession, ev: Evidence) -> DataFrame:
    return token_reports.token_cells(ev, WEEK, demo.catalog(spark), excluded_models=EXCLUDED)


@session_query
def coverage_gaps(spark: SparkSession, ev: Evidence) -> DataFrame:
    return _cells(spark, ev).where("missing").select("session_id", "cwd", "root_id", "attached")


@session_query
def token_rollup(spark: SparkSession, ev: Evidence) -> DataFrame:
    rows = token_reports.token_report(
        ev, WEEK, demo.catalog(spark), rate=RATE, excluded_models=EXCLUDED)
    # Exact amounts, in units small enough to be whole.
    return rows.withColumns({
        "usd_e9": (F.col("usd").cast("decimal(20,9)") * 1_000_000_000).cast("bigint"),
        "cad_e11": (F.col("cad").cast("decimal(22,11)") * 100_000_000_000).cast("bigint"),
    }).drop("usd", "cad")


@session_query
def token_report_filtered(spark: SparkSession, ev: Evidence) -> DataFrame:
    return token_reports.token_report(
        ev, WEEK, demo.catalog(spark), cwd="/view", archive="active"
    ).where("level = 'session'").select("root_id", "status", "total_tokens", "priced_tokens",
                                        "unavailable_sessions", "cost_complete")


@session_query
def projects_report(spark: SparkSession, ev: Evidence) -> DataFrame:
    return token_reports.projects_report(
        ev, WEEK, demo.catalog(spark), rate=RATE, excluded_models=EXCLUDED
    ).select("level", "cwd", "root_id", "title", "micros", "share_percent", "quality", "status",
             "total_tokens", "micro_usd", "cost_complete")


# --- quota -----------------------------------------------------------------------


def _selected(ev: Evidence, end=None) -> DataFrame:
    return quotas.quota_select(ev.quota, demo.LIMIT, demo.WINDOW_MINUTES, end)


@query
def quota_select(ev: Evidence) -> DataFrame:
    return _selected(ev.with_tables(quota=ev.quota.unionByName(ev.quota))).select(
        "at", "resets_at", "used_percent")


@query
def reset_cohorts(ev: Evidence) -> DataFrame:
    return quotas.reset_cohorts(_selected(ev)).drop("stream")


@table_query
def rolling_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets a few seconds apart, so that all of a stream are one chain."""
    rows = demo.events(spark, sf_dir).select(
        F.col("event_type").alias("stream"), (F.lit(1706000000) + F.col("event_id")).cast("bigint").alias("resets_at"),
        F.col("ts").alias("at"))
    return quotas.reset_cohorts(rows)


def _judged(ev: Evidence, end=None) -> DataFrame:
    selected = _selected(ev, end)
    return quotas.judge_readings(quotas.quota_moments(selected, quotas.reset_cohorts(selected)))


@query
def quota_verdicts(ev: Evidence) -> DataFrame:
    return _judged(ev).select("at", "cohort", "used_percent", "verdict",
                              F.col("previous.at").alias("previous"))


@query
def classify_pairs(ev: Evidence) -> DataFrame:
    pairs = quotas.classify_pairs(
        _judged(ev, WEEK.end), WEEK.start, WEEK.end, WEEK.tz, demo.MAX_GAP_SECONDS)
    return pairs.select("at", "cohort", "day", "kind", "points")


def _burn(ev: Evidence) -> quota_reports.BurnReport:
    return quota_reports.burn_report(
        ev, WEEK, limit_id=demo.LIMIT, window_minutes=demo.WINDOW_MINUTES,
        max_gap_seconds=demo.MAX_GAP_SECONDS)


@query
def burn_rows(ev: Evidence) -> DataFrame:
    return _burn(ev).rows.drop("plan_type")


@query
def burn_mix(ev: Evidence) -> DataFrame:
    return _burn(ev).mix.drop("plan_type", "bucket")


@query
def latest_reading(ev: Evidence) -> DataFrame:
    judged = _judged(ev, WEEK.end)
    return quotas.latest_reading(
        judged.where((F.col("verdict") == "accepted") & WEEK.covers(F.col("at")))
    ).select("at", "resets_at", "used_percent", "remaining_percent")


@query
def all_time_snapshot(ev: Evidence) -> DataFrame:
    return quota_reports.all_time_snapshot(
        ev, demo.TZ, limit_id=demo.LIMIT, window_minutes=demo.WINDOW_MINUTES
    ).select("at", "resets_at", "used_percent", "remaining_percent")


@query
def observed_usage_total(ev: Evidence) -> DataFrame:
    recorded = time_reports.root_work(ev, WEEK.tz, WEEK.start, WEEK.end).agg(
        F.sum("micros").alias("micros"))
    return quota_reports.observed_usage_total(_burn(ev).rows, recorded)


# --- session list and state ------------------------------------------------------

NOW = datetime(2024, 1, 20, 12, tzinfo=UTC)


@query
def session_list(ev: Evidence) -> DataFrame:
    return listing.session_list(ev, NOW, demo.TZ, archive="active", query="USER 1").drop(
        "created", "updated")


def _live(ev: Evidence) -> DataFrame:
    """The newest sample of each session moved to just before the clock."""
    newest = ev.turns.where("end IS NULL").groupBy("session_id").agg(
        F.max("start").alias("start"))
    return newest.select(
        F.lit(1).cast("bigint").alias("poll_id"), "session_id", F.lit("working").alias("state"),
        F.lit(datetime(2024, 1, 20, 11, 59, 58, tzinfo=UTC)).alias("at"),
        F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("string").alias("cwd"),
        F.lit(1.0).alias("uncertainty_seconds"))


@query
def live_extrapolation(ev: Evidence) -> DataFrame:
    shown = listing.live_extrapolation(ev, _live(ev), NOW)
    fresh = shown.coverage.where(F.col("end") == F.lit(NOW))
    flagged = shown.turns.where(F.array_contains("quality", "live_sample_estimate")).select(
        "session_id", F.col("id").alias("turn_id"))
    return fresh.join(flagged, ["session_id", "turn_id"])


@query
def top_sessions(ev: Evidence) -> DataFrame:
    rows = ev.sessions.withColumnRenamed("id", "session_id")
    first, omitted = listing.top_sessions(rows)
    return first.select("session_id", F.lit(None).cast("bigint").alias("omitted")).unionByName(
        omitted.select(F.lit(None).cast("string").alias("session_id"), "omitted"))


@table_query
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.session_status(demo.conversation_records(spark, sf_dir))


@table_query
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.conversation_records(spark, sf_dir).where("event = 'message'")
    return rows.select("file_path", "ord", F.sha2(status.message_text(F.col("content")), 256).alias("digest"))


@table_query
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.conversation_records(spark, sf_dir)
    # The first turns come at this instant; all later ones are a minute apart.
    before = status.session_status(rows, as_of=datetime.fromtimestamp(1_700_000_000, UTC))
    return status.status_transitions(before, status.session_status(rows)).select("file_path")


@query
def heartbeat_fresh(ev: Evidence) -> DataFrame:
    return ev.samples.groupBy("session_id").agg(F.max("at").alias("at")).select(
        "session_id", is_fresh(F.col("at"), F.lit(datetime(2024, 1, 31, tzinfo=UTC)), 7200.0)
        .alias("fresh"))


# --- calendar, selection, labels -------------------------------------------------


@query
def calendar_dates(ev: Evidence) -> DataFrame:
    days = ev.turns.select(local_date(F.col("start"), demo.TZ).alias("day")).distinct()
    bounds = {p: calendar_columns(F.col("day"), p) for p in ("week", "month")}
    return days.select("day", *[c.alias(f"{p}_{side}") for p, pair in bounds.items()
                                for side, c in zip(("first", "last"), pair)])


@query
def local_day_range(ev: Evidence) -> DataFrame:
    days = ev.turns.select(local_date(F.col("start"), demo.TZ).alias("day")).distinct()
    return days.select("day", local_midnight(F.col("day"), demo.TZ).alias("opens"),
                       local_midnight(F.date_add("day", 1), demo.TZ).alias("closes"))


@query
def report_dates(ev: Evidence) -> DataFrame:
    return evidence_dates(ev, demo.TZ)


@query
def select_sessions(ev: Evidence) -> DataFrame:
    return select.select_sessions(ev.sessions, ev.turns, cwd="/x/../click/.", archive="archived"
                                  ).select("id")


@query
def search_sessions(ev: Evidence) -> DataFrame:
    return select.search_sessions(ev.sessions, "uSeR 12").select("id")


@query
def roots_only(ev: Evidence) -> DataFrame:
    return select.roots_only(ev.sessions).select("id")


@query
def exclude_models(ev: Evidence) -> DataFrame:
    return select.exclude_models(ev.usage, ["m3"]).groupBy("excluded").agg(
        F.count("*").alias("observations"))


@query
def normalise_path(ev: Evidence) -> DataFrame:
    noisy = F.concat(F.lit("//a/./b/.."), F.col("cwd"), F.lit("/"))
    return ev.turns.groupBy(select.normalise_path(noisy).alias("path")).agg(
        F.count("*").alias("turns"))


@query
def text_labels(ev: Evidence) -> DataFrame:
    us = elapsed_micros(F.col("start"), F.col("end"))
    return ev.turns.where("end IS NOT NULL").select(
        F.col("id").alias("turn_id"), labels.duration_label(us).alias("duration"),
        labels.clock_label(us / 1_000_000).alias("clock"),
        labels.compact_tokens(F.floor(us / 1000).cast("bigint")).alias("compact"),
        labels.quality_note(F.col("quality")).alias("note"),
        labels.basename(F.col("cwd")).alias("base"))


# --- raw logs --------------------------------------------------------------------


def log_query(build: Callable[[DataFrame], DataFrame]):
    QUERIES[build.__name__] = lambda spark, sf_dir: flat(build(
        rollouts.parse_lines(logs.log_lines(demo.events(spark, sf_dir)))))
    return build


@log_query
def read_rollouts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("kind", F.coalesce("payload.type", F.lit("")).alias("event")).agg(
        F.count("*").alias("records"), F.min("at").alias("first"), F.max("at").alias("last"))


@table_query
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As read_rollouts, of logs that grew, were cut and rewritten under a stream."""
    raw = rollouts.parse_lines(logs.streamed_lines(logs.log_lines(demo.events(spark, sf_dir))))
    return raw.groupBy("kind", F.coalesce("payload.type", F.lit("")).alias("event")).agg(
        F.count("*").alias("records"), F.min("at").alias("first"), F.max("at").alias("last"))


@log_query
def quarantine_malformed(raw: DataFrame) -> DataFrame:
    return raw.where("kind = 'gap'").groupBy("file_path", "problem").agg(
        F.count("*").alias("records"))


@log_query
def session_upsert(raw: DataFrame) -> DataFrame:
    return normalize.session_upsert(normalize.annotate(raw))


@log_query
def turn_pairing(raw: DataFrame) -> DataFrame:
    return normalize.turn_pairing(normalize.annotate(raw)).select(
        "session_id", F.col("id").alias("turn_id"), "cwd", "start", "end", "outcome")


@log_query
def collect_contexts(raw: DataFrame) -> DataFrame:
    return normalize.collect_contexts(normalize.annotate(raw))


@log_query
def wait_pairing(raw: DataFrame) -> DataFrame:
    return normalize.wait_pairing(normalize.annotate(raw))


@log_query
def extract_quota(raw: DataFrame) -> DataFrame:
    good, bad = normalize.extract_quota(normalize.annotate(raw))
    return good.select("at", "limit_id", "bucket", "resets_at", "used_percent").withColumn(
        "valid", F.lit(True)).unionByName(
        bad.select("at", "limit_id", "bucket", "resets_at", "used_percent").withColumn(
            "valid", F.lit(False)))


@log_query
def diagnostics_distinct(raw: DataFrame) -> DataFrame:
    return normalize.diagnostics_of(normalize.annotate(raw)).select("reason", "occurrences")


def _attributed(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "at", "cwd", "model_id", "turn_id",
                       F.col("delta.input_tokens").alias("input_tokens"),
                       F.col("delta.total_tokens").alias("total_tokens"),
                       F.col("request_input_tokens").alias("request"),
                       F.array_sort("diagnostics").alias("diagnostics"))


@log_query
def usage_attribution(raw: DataFrame) -> DataFrame:
    return _attributed(usage.usage_from_lines(normalize.usage_lines(normalize.annotate(raw))))


@table_query
def maintained_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As usage_attribution, kept up by a stream while the logs grew, were cut and rewritten."""
    return _attributed(logs.maintained_usage(logs.log_lines(demo.events(spark, sf_dir))))


# --- metadata, sinks, samples ----------------------------------------------------


def _threads(ev: Evidence) -> DataFrame:
    number = F.substring("id", 2, 20).cast("bigint")
    return ev.sessions.select(
        "id", F.lit("/meta").alias("cwd"),
        F.unix_seconds("created").alias("created_at"), F.unix_seconds("updated").alias("updated_at"),
        F.when(number % 2 == 0, F.unix_millis("created") - 5).otherwise(0).alias("created_at_ms"),
        F.when(number % 3 == 0, F.concat(F.lit(" T"), "id")).alias("name"),
        F.col("archived").cast("int").alias("archived"), F.lit("cli").alias("source"),
        "parent_id").withColumnRenamed("parent_id", "parent_thread_id").where(number % 10 != 9)


@query
def read_threads(ev: Evidence) -> DataFrame:
    return metadata.read_threads(_threads(ev))


@query
def merge_thread_metadata(ev: Evidence) -> DataFrame:
    titles = ev.sessions.where("id LIKE '%7'").select(
        "id", F.lit(" named ").alias("thread_name"), F.lit(1).alias("ord"))
    edges = ev.sessions.where("id LIKE '%8'").select(
        F.lit("u0").alias("parent_thread_id"), F.col("id").alias("child_thread_id"))
    return metadata.merge_metadata(
        ev.sessions, metadata.read_threads(_threads(ev)), edges, metadata.read_titles(titles)
    ).select("id", "cwd", "title", "created", "archived", "parent_id", "is_child")


@query
def merge_precise_over_metadata(ev: Evidence) -> DataFrame:
    raw = ev.turns.select(
        F.col("session_id").alias("thread_id"), F.col("id").alias("turn_id"),
        F.lit("done").alias("status"), F.unix_seconds("start").alias("started_at"),
        (F.unix_seconds("start") + 60).alias("completed_at"))
    precise = ev.turns.where("CAST(id AS BIGINT) % 3 <> 0")
    return metadata.merge_turns(precise, metadata.read_turns(raw), ev.sessions).select(
        "session_id", F.col("id").alias("turn_id"), "start", "end", "outcome", "quality",
        "provenance")


@query
def append_quota(ev: Evidence) -> DataFrame:
    stored = ev.quota.where(F.col("at") < F.lit("2024-01-15").cast("timestamp"))
    return sinks.new_quota(ev.quota, stored).select("at", "resets_at", "used_percent")


@query
def append_usage(ev: Evidence) -> DataFrame:
    stored = ev.usage.where(F.col("at") < F.lit("2024-01-15").cast("timestamp"))
    return sinks.new_usage(ev.usage.unionByName(ev.usage), stored).groupBy("session_id").agg(
        F.count("*").alias("appended"))


@query
def write_daily_records(ev: Evidence) -> DataFrame:
    segments = intervals.work_segments(ev.turns, ev.waits, ev.coverage)
    return sinks.daily_records(segments, ev.sessions).select(
        F.length("id").alias("digits"), "date", "session_id", "start", "end", "cwd", "tags")


@query
def verify_evidence(ev: Evidence) -> DataFrame:
    return sinks.verify_evidence(ev)


@query
def export_report(ev: Evidence) -> DataFrame:
    return sinks.flat_columns(ev.turns.select(F.col("id").alias("turn_id"), "quality"))


@query
def report_parity(ev: Evidence) -> DataFrame:
    a = ev.turns.select(F.col("id").alias("turn_id"), "cwd")
    b = a.withColumn("cwd", F.when(F.col("turn_id").endswith("77"), "/moved").otherwise(
        F.col("cwd")))
    return sinks.report_parity(a, b)


@query
def load_period(ev: Evidence) -> DataFrame:
    near = near_period(ev, DAY, demo.LIMIT, demo.WINDOW_MINUTES)
    return near.usage.select(F.lit("usage").alias("kind")).unionAll(
        near.quota.select(F.lit("quota").alias("kind"))).groupBy("kind").agg(
        F.count("*").alias("readings"))


@query
def samples_to_spans(ev: Evidence) -> DataFrame:
    return live.samples_to_spans(_polls(ev), ev.turns, 86_400.0)


def _polls(ev: Evidence) -> DataFrame:
    """The first sample of each session and poll."""
    return ev.samples.groupBy("session_id", "poll_id").agg(
        F.min_by(F.struct("state", "at", "turn_id", "cwd", "uncertainty_seconds"), "at").alias("o")
    ).select("session_id", "poll_id", "o.*")


@query
def observation_gap(ev: Evidence) -> DataFrame:
    stored = ev.coverage.unionByName(ev.waits)
    return live.observation_gap(_polls(ev), ev.turns, 86_400.0, stored).select(
        F.col("id").alias("turn_id"), "quality")


@query
def gap_events(ev: Evidence) -> DataFrame:
    return live.gap_events(_polls(ev), ev.turns, ev.coverage.unionByName(ev.waits), 86_400.0)


@session_query
def overview(spark: SparkSession, ev: Evidence) -> DataFrame:
    """All parts of one overview as one table: what a row is about, its time or tokens, and its share."""
    parts = build_overview(
        ev, demo.catalog(spark), tz=demo.TZ, limit_id=demo.LIMIT, period="week",
        selected=date(2024, 1, 10), window_minutes=demo.WINDOW_MINUTES,
        max_gap_seconds=demo.MAX_GAP_SECONDS, excluded_models=EXCLUDED)
    columns = {
        "allowance": (("day", "resets_at"), "micros", "matched_points"),
        "mix": (("day", "resets_at", "model_id", "reasoning_level"), "micros", "percentage"),
        "latest": (("at", "resets_at"), "used_percent", "remaining_percent"),
        "token_usage": (("level", "cwd", "root_id", "child_id", "model_id", "status"), "total_tokens", "priced_tokens"),
        "model_totals": (("rank", "model_id", "session_count"), "micros", "percentage"),
        "reasoning": (("rank", "model_id", "reasoning_level", "session_count"), "micros", "percentage"),
    }
    rows = []
    for part, (keys, value, amount) in columns.items():
        at = F.unix_micros("at") if part == "latest" else None
        texts = [F.coalesce((at if k == "at" else F.col(k)).cast("string"), F.lit("-")) for k in keys]
        rows.append(parts[part].select(
            F.lit(part).alias("part"), F.concat_ws("|", *texts).alias("about"),
            F.col(value).cast("bigint").alias("value"), F.col(amount).cast("double").alias("amount")))
    return reduce(DataFrame.unionByName, rows)
