"""Evidence derived from the events and conversations tables.

Every rule here has a twin in `worktide.demo.oracle`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.evidence import Evidence
from worktide.operators.scan import DAY_MICROS, running_sum, scan
from worktide.session import prepare

TZ = "America/Toronto"
LIMIT = "shared"
WINDOW_MINUTES = 10080
MAX_GAP_SECONDS = 1800


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _shift(at, seconds):
    return F.timestamp_micros(F.unix_micros(at) + seconds * 1_000_000)


def _session(column="user_id"):
    return F.concat(F.lit("u"), F.col(column).cast("string"))


def sessions(ev: DataFrame) -> DataFrame:
    kinds = ev.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    per_user = kinds.groupBy("user_id").agg(
        F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("cwd"),
        F.min("lo").alias("created"),
        F.max("hi").alias("updated"),
    )
    user = F.col("user_id")
    parent = (
        F.when(user == 1, 2)
        .when(user == 2, 3)
        .when(user == 3, 2)
        .when((user % 37 == 0) & (user > 0), 10_000_000 + user)
        .when((user % 5).isin(0, 1) & (user > 1), user - 1)
    )
    parent_id = F.concat(F.lit("u"), parent.cast("string"))
    return per_user.select(
        _session().alias("id"),
        F.concat(F.lit("/"), "cwd").alias("cwd"),
        F.concat(F.lit("User "), user.cast("string")).alias("title"),
        "created",
        "updated",
        (user % 4 == 0).alias("archived"),
        parent_id.alias("parent_id"),
        parent.isNotNull().alias("is_child"),
        F.when(user % 7 == 0, F.array(F.lit("no_title"))).otherwise(
            F.array().cast("array<string>")
        ).alias("quality"),
    )


def _turn_id(column="event_id"):
    return F.lpad(F.col(column).cast("string"), 12, "0")


def turns(ev: DataFrame) -> DataFrame:
    is_open = F.col("event_id") % 17 == 0
    return ev.select(
        _session().alias("session_id"),
        _turn_id().alias("id"),
        F.concat(F.lit("/"), "event_type").alias("cwd"),
        F.col("ts").alias("start"),
        F.when(~is_open, _shift(F.col("ts"), F.col("cents") * 6)).alias("end"),
        F.when(is_open, F.lit(None).cast("string"))
        .otherwise(F.lit("task_complete")).alias("outcome"),
        F.when(is_open, F.array(F.lit("historical_upper_bound"), F.lit("unfinished_observed_only")))
        .otherwise(F.array(F.lit("historical_upper_bound"))).alias("quality"),
        F.array(F.lit("rollout")).alias("provenance"),
        F.when(is_open, F.lit(60.0)).otherwise(F.lit(0.0)).alias("sampling_uncertainty_seconds"),
    )


def coverage(ev: DataFrame) -> DataFrame:
    return ev.where("event_id % 17 = 0 AND k > 0").select(
        _session().alias("session_id"),
        _turn_id().alias("turn_id"),
        F.col("ts").alias("start"),
        _shift(F.col("ts"), F.col("k") * 60).alias("end"),
    )


def waits(ev: DataFrame) -> DataFrame:
    stop = _shift(F.col("ts"), F.col("cents") * 6)
    return ev.where("event_type = 'error'").select(
        _session().alias("session_id"),
        _turn_id().alias("turn_id"),
        F.least(_shift(F.col("ts"), F.col("k") * 10), stop).alias("start"),
        F.least(_shift(F.col("ts"), F.col("k") * 10 + 300), stop).alias("end"),
    ).where(F.col("end") > F.col("start"))


def contexts(ev: DataFrame) -> DataFrame:
    event = F.col("event_id")
    model = F.concat(F.lit("m"), (event % 4).cast("string"))
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")),
                         (event % 3 + 1).cast("int"))
    ts = F.col("ts")
    other = F.concat(F.lit("m"), ((event + 1) % 4).cast("string"))
    rows = F.array(
        F.when(event % 13 != 0, F.struct(
            ts.alias("at"), model.alias("model_id"), level.alias("reasoning_level"))),
        F.when(event % 3 == 0, F.struct(
            _shift(ts, F.col("cents") * 3).alias("at"), other.alias("model_id"),
            level.alias("reasoning_level"))),
        F.when(event % 11 == 0, F.struct(
            ts.alias("at"), F.lit("m9").alias("model_id"), level.alias("reasoning_level"))),
    )
    return ev.select(
        _session().alias("session_id"),
        _turn_id().alias("turn_id"),
        F.explode(rows).alias("c"),
    ).where("c IS NOT NULL").select("session_id", "turn_id", "c.*")


def _reading(resets_at, used_percent):
    return F.struct(resets_at.alias("resets_at"), used_percent.alias("used_percent"))


def quota(ev: DataFrame) -> DataFrame:
    bought = ev.where("event_type = 'purchase'").select(
        "event_id",
        "ts",
        F.date_trunc("week", "ts").alias("week"),
        F.floor(F.unix_micros("ts") / DAY_MICROS).cast("bigint").alias("chunk"),
        F.lit(1).alias("one"),
    )
    placed = scan(bought, ["week"], "chunk", ["ts", "event_id"], rn=running_sum(F.col("one")))
    total = bought.groupBy("week").agg(F.count("*").alias("n"))
    used = F.floor(100 * F.col("rn") / F.col("n"))
    event = F.col("event_id")
    resets = F.unix_seconds("week") + 7 * 86_400 + event % 7
    low = F.when(event % 19 == 0, F.greatest(used - 5, F.lit(0))).otherwise(used)
    second_week = F.lit("2024-01-08").cast("timestamp")
    readings = F.array(
        _reading(resets, low.cast("double")),
        # Two percentages at one instant, and a reading of last week's reset.
        F.when(event % 211 == 0, _reading(resets, (low + 1).cast("double"))),
        F.when(
            (event % 43 == 0) & (F.col("ts") >= second_week),
            _reading(resets - 7 * 86_400, F.lit(99.0)),
        ),
    )
    return placed.join(total, "week").select(
        "ts", "event_id", F.explode(readings).alias("r"),
    ).where("r IS NOT NULL").select(
        # The old reset arrives a second later, so that it is no conflict.
        F.when(F.col("r.used_percent") == 99.0, _shift(F.col("ts"), F.lit(1)))
        .otherwise(F.col("ts")).alias("at"),
        F.lit(LIMIT).alias("limit_id"),
        F.lit(None).cast("string").alias("plan_type"),
        F.lit("primary").alias("bucket"),
        F.lit(WINDOW_MINUTES).cast("bigint").alias("window_minutes"),
        "r.resets_at",
        "r.used_percent",
    )


def usage_readings(ev: DataFrame) -> DataFrame:
    """Counter readings of view and click events, before increments are taken."""
    seen = ev.where("event_type IN ('view', 'click')").select(
        "event_id", "ts", "user_id", "event_type", "cents", "k",
        F.floor(F.unix_micros("ts") / (30 * DAY_MICROS)).cast("bigint").alias("block"),
        (F.col("event_id") % 97 == 0).cast("bigint").alias("restart"),
    )
    eras = scan(seen, ["user_id"], "block", ["ts", "event_id"], era=running_sum(F.col("restart")))
    return scan(eras, ["user_id", "era"], "block", ["ts", "event_id"],
                total=running_sum(F.col("cents")))


def usage_counts(total, event_id):
    """The six counters of a reading; writes are missing on every fifth event."""
    return F.struct(
        total.alias("input_tokens"),
        F.floor(total / 4).cast("bigint").alias("cached_input_tokens"),
        F.when(event_id % 5 != 0, F.floor(total / 10).cast("bigint"))
        .alias("cache_write_input_tokens"),
        F.floor(total / 2).cast("bigint").alias("output_tokens"),
        F.floor(total / 8).cast("bigint").alias("reasoning_output_tokens"),
        (total + F.floor(total / 2)).cast("bigint").alias("total_tokens"),
    )


def counter_rows(ev: DataFrame) -> DataFrame:
    """Readings as a source: one file per user, in time order."""
    event = F.col("event_id")
    return usage_readings(ev).select(
        _session().alias("file_path"),
        "block",
        F.struct(F.unix_micros("ts").alias("us"), "event_id").alias("ord"),
        _session().alias("session_id"),
        F.col("ts").alias("at"),
        F.concat(F.lit("/"), "event_type").alias("cwd"),
        F.when(event % 13 != 0, F.concat(F.lit("m"), (event % 4).cast("string"))).alias("model_id"),
        _turn_id().alias("turn_id"),
        usage_counts(F.col("total"), event).alias("cumulative"),
        usage_counts(F.col("cents"), event).alias("last_usage"),
        "event_id",
    )


def usage(ev: DataFrame) -> DataFrame:
    from worktide.operators.usage import counter_delta, usage_identity

    # Only the increment between readings is shared with the raw pipeline here;
    # attribution columns are given.
    reads = counter_delta(counter_rows(ev))
    return reads.select(
        usage_identity("session_id", "at", "cumulative", "last_usage").alias("id"),
        "session_id", "at", "cwd", "model_id", "turn_id", "cumulative", "last_usage", "delta",
        F.when(F.col("event_id") % 6 != 0, F.col("delta.input_tokens")).alias(
            "request_input_tokens"),
        "diagnostics",
    )


def evidence(spark: SparkSession, sf_dir: str) -> Evidence:
    ev = events(spark, sf_dir)
    builders = {
        "sessions": sessions, "turns": turns, "waits": waits, "coverage": coverage,
        "contexts": contexts, "quota": quota, "usage": usage, "samples": samples,
    }
    return Evidence(**{name: partial(build, ev) for name, build in builders.items()})


# Demo prices, laid out like STANDARD_PRICES; model m3 has none on purpose.
PRICES = """
m0  ordinary  -     2    0.5   -      10  -    -    -      -
m1  separate  -     2.5  0.25  3.125  12  -    -    -      -
m2  separate  2000  4    0.4   5      20  8    0.8  10     30
"""


def catalog(spark: SparkSession) -> DataFrame:
    from datetime import date

    from worktide.operators.pricing import price_rows

    return price_rows(spark, PRICES, date(2024, 1, 1))


def samples(ev: DataFrame) -> DataFrame:
    """Live samples: one per event, polled every half day."""
    states = F.array(F.lit("working"), F.lit("waiting"), F.lit("idle"), F.lit("working"))
    state = F.when(F.col("event_id") % 29 == 0, "unknown").otherwise(
        F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")))
    return ev.select(
        F.floor(F.unix_micros("ts") / 43_200_000_000).cast("bigint").alias("poll_id"),
        _session().alias("session_id"),
        state.alias("state"),
        # A minute before the event, so that a sample never falls on a turn's start.
        _shift(F.col("ts"), F.lit(-60)).alias("at"),
        F.lit(None).cast("string").alias("turn_id"),
        F.lit(None).cast("string").alias("cwd"),
        F.lit(1.0).alias("uncertainty_seconds"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message records: a user line starts a turn, long replies end it."""
    prepare(spark)
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.lit("/conv/"), F.col("conv_id").cast("string"))
    none = F.lit(None).cast("string")
    turn = F.col("turn").cast("string")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    empty = F.lit(None).cast("array<struct<type:string,text:string>>")

    def row(step, kind, event, session, cwd, turn_id, role, message, final, content):
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.lit(event).alias("event"),
            session.alias("session_id"), cwd.alias("cwd"), turn_id.alias("turn_id"),
            role.alias("role"), message.alias("message"), final.alias("last_agent_message"),
            content.alias("content"))

    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    rows = F.array(
        F.when(F.col("turn") == 0, row(
            0, "session_meta", "", F.concat(F.lit("c"), F.col("conv_id").cast("string")),
            F.lit("/home"), none, none, none, none, empty)),
        F.when(user, row(1, "event_msg", "task_started", none, none,
                         F.when(F.col("conv_id") % 3 != 0, turn), none, none, none, empty)),
        F.when(user, row(2, "event_msg", "user_message", none, none, none, none,
                         F.col("text"), none, empty)),
        row(3, "response_item", "message", none, none, none, F.col("role"), none, none, block),
        F.when(reply & (F.col("conv_id") % 2 == 0), row(
            4, "event_msg", "task_complete", none, none,
            F.when(F.col("conv_id") % 4 == 0, (F.col("turn") - 1).cast("string")), none, none,
            F.concat(F.lit("done: "), "text"), empty)),
    )
    return conv.select(
        path.alias("file_path"), F.floor(F.col("turn") / 64).cast("bigint").alias("block"),
        "conv_id", "turn", F.explode(rows).alias("r"),
    ).where("r IS NOT NULL").select(
        "file_path", "block", (F.col("turn") * 10 + F.col("r.step")).alias("ord"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("at"),
        *[f"r.{n}" for n in ("kind", "event", "session_id", "cwd", "turn_id", "role", "message",
                             "last_agent_message", "content")],
    )
