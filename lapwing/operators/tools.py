"""Eight named tools over a table of requests.

A request is a row (request_id, user_id, ms, tool, args): the prompt's user and time, and the arguments as JSON.  Each
tool reads the arguments of its requests by its schema (defaults filled in, numbers held to their bounds) and answers
all of them in one job; what a tool may see has ended by the request's time, always.  ``answers`` gives the results of
all tools under one schema, as VARIANT.

The data is a ``World``: hours (user_id, hour, and the columns of COLUMNS at hand), prompts (prompt_id, user_id, ms,
desire, available), events (user_id, ms, event_id, stream, label) and diaries (case_id, user_id, text).  User, time and
request id are never null; a request without arguments that it needs, or with unknown ones, is told so by ``problems``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import times as T
from ..sources.scratch import written
from . import similar as S
from .pit import visible

#: fixed values: names of the hourly columns of each modality
COLUMNS = {
    "accelerometer": ("accel_activity_counts", "accel_coverage_pct"),
    "gps": ("gps_distance_km", "gps_at_home_min", "gps_n_captures"),
    "motion": ("motion_walking_min", "motion_stationary_min", "motion_automotive_min", "motion_running_min"),
    "screen": ("screen_on_min", "screen_n_sessions"),
    "keyboard": ("key_chars_typed", "key_words_typed", "key_prop_neg", "key_prop_pos"),
    "music": ("mus_is_listening", "mus_n_tracks"),
    "light": ("light_mean_lux",),
}
#: columns that are averaged over hours; the others are summed
AVERAGED = {"accel_coverage_pct", "key_prop_neg", "key_prop_pos", "light_mean_lux"}
FINGERPRINT = ("accel_activity_counts", "screen_on_min", "gps_distance_km", "motion_walking_min", "key_chars_typed", "motion_stationary_min")
STREAMS = ("screen", "app", "motion", "keyboard", "music")


@dataclass(frozen=True)
class World:
    hours: DataFrame
    prompts: DataFrame
    events: DataFrame
    diaries: DataFrame | None = None


@dataclass(frozen=True)
class Argument:
    """``kind``: long, double, string, boolean or date; without a default it must be given."""

    name: str
    kind: str
    default: object = None
    low: float | None = None
    high: float | None = None
    one_of: tuple[str, ...] = ()
    required: bool = False


#: fixed values: the tools' arguments, defaults and bounds
SCHEMAS: dict[str, tuple[Argument, ...]] = {
    "query_sensing": (
        Argument("modality", "string", one_of=tuple(COLUMNS), required=True), Argument("hours_before_ema", "long", low=1, high=48, required=True),
        Argument("hours_duration", "long", 1, 1, 24), Argument("granularity", "string", "hourly", one_of=("hourly", "daily")),
    ),
    "get_daily_summary": (Argument("date", "date", required=True), Argument("lookback_days", "long", 0, 0, 7)),
    "get_behavioral_timeline": (Argument("date", "date", required=True), Argument("segment_hours", "long", 3, 1, 6)),
    "compare_to_baseline": (Argument("modality", "string", required=True), Argument("feature", "string", required=True), Argument("current_value", "double", required=True)),
    "get_receptivity_history": (Argument("n_days", "long", 14, 1, 366), Argument("include_emotion_driver", "boolean", False)),
    "find_similar_days": (Argument("n", "long", 5, 1, 50),),
    "query_raw_events": (
        Argument("modality", "string", one_of=STREAMS, required=True), Argument("hours_before_ema", "long", low=1, high=168, required=True),
        Argument("hours_duration", "long", 4, 1, 168), Argument("max_events", "long", 30, 1, 100),
    ),
    "find_peer_cases": (Argument("search_mode", "string", "text", one_of=("text", "sensing")), Argument("query_text", "string", ""), Argument("top_k", "long", 5, 1, 10)),
}


def _value(a: Argument) -> Column:
    """The argument from its JSON text; null if it is none of its kind."""
    raw = F.get_json_object("args", f"$.{a.name}")
    if a.kind == "date":
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.datediff(raw.try_cast("date"), F.lit("1970-01-01").cast("date"))).cast("long")
    if a.kind == "boolean":
        return C.truth(raw)
    if a.kind == "string":
        return raw
    return F.floor(C.number(raw)).cast("long") if a.kind == "long" else C.number(raw)


def _arguments(tool: str) -> tuple[dict[str, Column], Column]:
    """(value of each argument, what is wrong or null)."""
    values, wrong = {}, []
    for a in SCHEMAS[tool]:
        value = _value(a)
        if a.required:
            wrong.append(F.when(value.isNull(), f"{a.name} is missing"))
        if a.default is not None:
            value = F.coalesce(value, F.lit(a.default))
        if a.one_of:
            wrong.append(F.when(~value.isin(*a.one_of), f"unknown {a.name}"))
        if a.low is not None:
            value = F.greatest(F.lit(a.low), F.least(F.lit(a.high), value)).cast(a.kind)
        values[a.name] = value
    said = F.concat_ws("; ", *wrong) if wrong else F.lit("")
    return values, F.when(said != "", said)


def problems(requests: DataFrame) -> DataFrame:
    """(request_id, tool, problem) of the requests that no tool answers."""
    problem = F.when(F.coalesce(~F.col("tool").isin(*SCHEMAS), F.lit(True)), "unknown tool")
    for tool in SCHEMAS:
        problem = problem.when(F.col("tool") == tool, _arguments(tool)[1])
    return requests.select("request_id", "tool", problem.alias("problem")).where("problem is not null")


def _asked(requests: DataFrame, tool: str) -> DataFrame:
    values, wrong = _arguments(tool)
    read = requests.where(F.col("tool") == tool).select("request_id", "user_id", "ms", F.struct(wrong.alias("wrong"), *(v.alias(n) for n, v in values.items())).alias("read"))
    # an explode of one: filters on arguments stay above it and do not read the JSON once more for each of their terms
    return read.select("request_id", "user_id", "ms", F.explode(F.array("read")).alias("read")).where("read.wrong is null").select("request_id", "user_id", "ms", *(f"read.{n}" for n in values))


def _fixed(x: Column, digits: int = 0) -> Column:
    """A number as text with so many digits behind the point; halves away from zero, for sums that miss them by rounding too."""
    return F.round(x + F.signum(x) * 1e-9, digits).cast(f"decimal(20,{digits})").cast("string")


def _percent(x: Column) -> Column:
    return F.concat(_fixed(x * 100), F.lit("%"))


def _said(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *parts)


def _or(text: Column, otherwise: str) -> Column:
    return F.when(text != "", text).otherwise(otherwise)


def _have(hours: DataFrame, modality: str) -> list[str]:
    return [c for c in COLUMNS[modality] if c in hours.columns]


def _seen(hours: DataFrame, modality: str) -> Column:
    """Whether an hour has a row of the modality."""
    columns = _have(hours, modality)
    return reduce(Column.__or__, [F.col(c).isNotNull() for c in columns]) if columns else F.lit(False)


def _c(names: list[str], name: str) -> Column:
    return F.col(name).cast("double") if name in names else F.lit(None).cast("double")


# -- query_sensing -------------------------------------------------------------------------------------------------


def _details(have: list[str]) -> dict[str, Column]:
    """What a row of hourly (or summed) columns says, by modality."""
    c = lambda name: _c(have, name)
    minutes = F.array(*(F.struct(c(f"motion_{n}_min").alias("m"), F.lit(n).alias("n")) for n in ("walking", "stationary", "automotive", "running")))
    active = F.reverse(F.array_sort(F.filter(minutes, lambda x: x["m"] > 0)))
    return {
        "motion": _or(F.array_join(F.transform(active, lambda x: F.concat(x["n"], F.lit(" "), _fixed(x["m"]), F.lit("min"))), ", "), "no activity data"),
        "gps": _or(
            _said(", ", F.when(c("gps_distance_km") > 0, F.concat(F.lit("traveled "), _fixed(c("gps_distance_km"), 2), F.lit(" km"))), F.concat(F.lit("home "), _fixed(c("gps_at_home_min")), F.lit("min")), F.concat(_fixed(c("gps_n_captures")), F.lit(" GPS fixes"))),
            UNTOLD_FIXES,
        ),
        "screen": _or(_said(", ", F.concat(F.lit("screen on "), _fixed(c("screen_on_min")), F.lit("min")), F.concat(_fixed(c("screen_n_sessions")), F.lit(" sessions"))), "screen data present"),
        "keyboard": _or(
            _said(", ", F.when(c("key_chars_typed") > 0, F.concat(_fixed(c("key_chars_typed")), F.lit(" chars typed"))), *(F.when(c(n) > 0, F.concat(_percent(c(n)), F.lit(f" {kind} sentiment"))) for n, kind in (("key_prop_neg", "negative"), ("key_prop_pos", "positive")))),
            "no typing data",
        ),
        "accelerometer": _or(_said(", ", F.concat(F.lit("activity counts "), _fixed(c("accel_activity_counts"), 1)), F.concat(F.lit("coverage "), _fixed(c("accel_coverage_pct")), F.lit("%"))), "actigraphy data present"),
        "music": _or(_said(", ", F.when(c("mus_is_listening") > 0, "listening to music").when(c("mus_is_listening").isNotNull(), "not listening"), F.when(c("mus_n_tracks") > 0, F.concat(_fixed(c("mus_n_tracks")), F.lit(" tracks")))), "no music data"),
        "light": F.coalesce(F.concat(F.lit("ambient light "), _fixed(c("light_mean_lux")), F.lit(" lux")), F.lit("no light data")),
    }


def _by_modality(parts: dict[str, Column]) -> Column:
    out = None
    for name, c in parts.items():
        out = F.when(F.col("modality") == name, c) if out is None else out.when(F.col("modality") == name, c)
    return out


#: fixed values: said of fixes with neither a way, nor time at home, nor a number
UNTOLD_FIXES = "GPS data present"


def query_sensing(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, hour, detail, coverage): a row for each hour of the window (hour null for one line a day); detail is null
    without data; coverage is good, partial or off."""
    asked = _asked(requests, "query_sensing")
    stop = F.least(F.col("ms") - (F.col("hours_before_ema") - F.col("hours_duration")) * T.HOUR_MS, T.hour_of(F.col("ms")) * T.HOUR_MS)
    slots = asked.withColumn("hour", F.explode(F.sequence(T.hour_of(F.col("ms") - F.col("hours_before_ema") * T.HOUR_MS), F.ceil(stop / T.HOUR_MS).cast("long") - 1)))
    have = [c for m in COLUMNS for c in _have(world.hours, m)]
    met = slots.join(world.hours.select("user_id", "hour", *have), ["user_id", "hour"], "left")
    met = met.withColumn("here", F.coalesce(_by_modality({m: _seen(world.hours, m) for m in COLUMNS}), F.lit(False)))
    missing = F.count_if(~F.col("here")).over(Window.partitionBy("request_id"))
    met = met.withColumn("coverage", F.when(missing == 0, "good").when(missing < F.col("hours_duration"), "partial").otherwise("off"))
    hourly = met.where("granularity = 'hourly'").select("request_id", "hour", F.when(F.col("here"), _by_modality(_details(have))).alias("detail"), "coverage")
    sums = [(F.avg(c) if c in AVERAGED else F.max(c) if c == "mus_is_listening" else F.sum(c)).alias(c) for c in have]
    daily = met.where("granularity = 'daily'").groupBy("request_id", "modality", "coverage").agg(F.bool_or("here").alias("here"), *sums)
    daily = daily.select("request_id", F.lit(None).cast("long").alias("hour"), F.when(F.col("here"), _by_modality(_details(have))).alias("detail"), "coverage")
    return hourly.unionByName(daily)


# -- days and their parts ------------------------------------------------------------------------------------------


def _sums(hours: DataFrame, when: Column | None = None, prefix: str = "") -> list[Column]:
    """Sums and means of all columns at hand, and whether each modality has rows, over hours for which ``when`` holds.

    With rows a sum is never null."""
    held = lambda c: c if when is None else F.when(when, c)
    out = []
    for modality in COLUMNS:
        seen = F.coalesce(F.bool_or(held(_seen(hours, modality))), F.lit(False))
        out.append(seen.alias(f"{prefix}{modality}"))
        for c in COLUMNS[modality]:
            x = held(F.col(c).cast("double")) if c in hours.columns else F.lit(None).cast("double")
            value = F.avg(x) if c in AVERAGED else F.when(seen, F.coalesce(F.sum(x), F.lit(0.0)) if c in hours.columns else F.lit(None).cast("double"))
            out.append(value.alias(f"{prefix}{c}"))
    return out


def _shorts(p: str = "") -> dict[str, Column]:
    """What is said of motion, gps, screen and typing over some hours; null where there is nothing to say."""
    c = lambda name: F.col(f"{p}{name}")
    stat, walk, auto = (c(f"motion_{n}_min") for n in ("stationary", "walking", "automotive"))
    all_ = F.coalesce(stat, F.lit(0.0)) + F.coalesce(walk, F.lit(0.0)) + F.coalesce(auto, F.lit(0.0))
    motion = _said(
        ", ", F.when((all_ > 0) & stat.isNotNull(), F.concat(F.lit("mostly stationary ("), _percent(stat / all_), F.lit(")"))),
        F.when(walk > 0, F.concat(F.lit("walking "), _fixed(walk), F.lit("min"))), F.when(auto > 0, F.concat(F.lit("driving "), _fixed(auto), F.lit("min"))),
    )
    on, chars, neg = c("screen_on_min"), c("key_chars_typed"), c("key_prop_neg")
    typed = F.concat(_fixed(chars), F.lit(" chars typed"), F.when(neg > 0.15, F.concat(F.lit(" ("), _percent(neg), F.lit(" negative)"))).otherwise(""))
    return {
        "motion": F.when(motion != "", motion), "gps": F.when(c("gps_distance_km") > 0, F.concat(F.lit("traveled "), _fixed(c("gps_distance_km"), 1), F.lit("km"))),
        "screen": F.concat(F.when(on >= 60, "screen on ~").otherwise("screen on "), _fixed(on), F.lit("min")), "keyboard": F.when(chars > 0, typed),
    }


PERIODS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 23)}


def daily_summary(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, day, sleep_hours, morning, afternoon, evening, overall) of the asked day and the days before that were
    asked for; sleep_hours is null without hours to tell it by, overall without anything to say."""
    asked = _asked(requests, "get_daily_summary")
    days = asked.withColumn("day", F.explode(F.expr("sequence(date - lookback_days, date)")))
    hours = world.hours.where(F.lit(True))
    slots = days.select("request_id", "user_id", "ms", "day", F.explode(F.expr("sequence(day * 24, day * 24 + 23)")).alias("hour")).where(visible(F.col("hour"), F.col("ms")))
    clock = F.pmod("hour", F.lit(24))
    met = slots.join(hours, ["user_id", "hour"])
    inside = lambda low, high: (clock >= low) & (clock < high)
    counts = F.when(inside(0, 8), F.col("accel_activity_counts").cast("double")) if "accel_activity_counts" in hours.columns else F.lit(None).cast("double")
    parts = [c for name, span in PERIODS.items() for c in _sums(hours, inside(*span), f"{name}_")]
    # at most eight hours a day
    sums = met.groupBy("request_id", "day").agg(*_sums(hours), *parts, F.collect_list(counts).alias("_night"), F.percentile(counts, F.lit(0.25)).alias("_low"))
    rows = days.select("request_id", "ms", "day").join(sums, ["request_id", "day"], "left")
    sleep = F.size(F.filter("_night", lambda x: x <= F.col("_low")))

    def period(name: str) -> Column:
        short = _shorts(f"{name}_")
        said = _said("; ", *(F.when(F.col(f"{name}_{m}"), short[m]) for m in ("motion", "gps", "screen", "keyboard")))
        late = (F.col("day") * 24 + PERIODS[name][0]) * T.HOUR_MS >= F.col("ms")
        return F.when(late, "no data (after EMA cutoff)").otherwise(_or(said, "no data"))

    walk, stat, on, neg = (F.col(c) for c in ("motion_walking_min", "motion_stationary_min", "screen_on_min", "key_prop_neg"))
    overall = _said(
        "; ", F.when(F.col("motion") & walk.isNotNull(), F.concat(F.when(walk > 60, "active day").otherwise("low-mobility day"), F.lit(" ("), _fixed(walk), F.lit("min walking)"))).when(F.col("motion") & (stat > 600), "low-mobility day (mostly stationary)"),
        F.when(F.col("screen") & on.isNotNull(), F.concat(F.when(on > 300, "elevated").otherwise("moderate"), F.lit(" screen activity ("), _fixed(on), F.lit("min)"))),
        F.when(F.col("keyboard") & (neg > 0.15), F.concat(F.lit("elevated negative typing sentiment ("), _percent(neg), F.lit(")"))),
    )
    return rows.select("request_id", "day", F.when(F.size("_night") > 0, sleep).cast("long").alias("sleep_hours"), *(period(n).alias(n) for n in PERIODS), F.when(overall != "", overall).alias("overall"))


def behavioural_timeline(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, start_min, end_min, observed, behaviour, cue): segments of the asked day up to the request's time, minutes
    since midnight; a day that has not begun has no rows."""
    asked = _asked(requests, "get_behavioral_timeline")
    begin = F.col("date") * T.DAY_MS
    asked = asked.withColumn("cut", F.least(F.col("ms") - begin, F.lit(T.DAY_MS))).where("cut > 0")
    slots = asked.withColumn("clock", F.explode(F.sequence(F.lit(0), F.ceil(F.col("cut") / T.HOUR_MS).cast("int") - 1)))
    slots = slots.select("request_id", "user_id", "ms", "cut", "segment_hours", F.floor(F.col("clock") / F.col("segment_hours")).alias("segment"), (F.col("date") * 24 + F.col("clock")).alias("hour"))
    hours = world.hours
    met = slots.join(hours, ["user_id", "hour"], "left")
    sums = met.groupBy("request_id", "segment", "segment_hours", "cut").agg(*_sums(hours, visible(F.col("hour"), F.col("ms"))))
    start = F.col("segment") * F.col("segment_hours") * 60
    sums = sums.withColumn("start_min", start.cast("double")).withColumn("end_min", F.least(start + F.col("segment_hours") * 60, F.col("cut") / 60_000).cast("double"))
    minutes = F.greatest(F.col("end_min") - F.col("start_min"), F.lit(1.0))
    short, zero = _shorts(), lambda name: F.coalesce(F.col(name), F.lit(0.0))
    lux, neg, pos = F.col("light_mean_lux"), F.col("key_prop_neg"), F.col("key_prop_pos")
    light = F.concat(F.when(lux < 50, "low light / likely indoors").otherwise("brighter environment"), F.lit(" ("), _fixed(lux), F.lit(" lux)"))
    observed = _said("; ", *(F.when(F.col(m), short[m]) for m in ("motion", "gps", "screen", "keyboard")), light)
    #: fixed values: labels and the bounds of each
    rules = {
        "physically active": zero("motion_walking_min") >= 20,
        "out-of-home / mobile": (zero("gps_distance_km") >= 2) | (zero("motion_automotive_min") >= 30),
        "sedentary": zero("motion_stationary_min") >= F.greatest(F.lit(60.0), minutes * 0.7),
        "mostly at home": zero("gps_at_home_min") >= F.greatest(F.lit(90.0), minutes * 0.7),
        "digitally engaged": (zero("screen_on_min") >= 45) | (zero("screen_n_sessions") >= F.greatest(F.lit(4.0), minutes / 60 * 2)),
        "communication-heavy": (zero("key_chars_typed") >= 200) | (zero("key_words_typed") >= 40),
    }
    labels = _said(", ", *(F.when(rule, name) for name, rule in rules.items()))
    behaviour = F.when(labels != "", labels).otherwise(F.when(observed != "", "mixed / low-signal activity").otherwise("no sensed activity"))
    bad = F.coalesce(neg >= 0.15, F.lit(False))
    mood = (
        F.when(rules["physically active"] & (rules["digitally engaged"] | rules["communication-heavy"]), "possible engaged / activated state")
        .when(rules["sedentary"] & rules["mostly at home"] & (zero("screen_on_min") < 15) & (zero("key_chars_typed") < 50), "possible low-energy / withdrawn state")
        .when(rules["sedentary"] & rules["digitally engaged"] & bad, "possible stress / rumination pattern")
    )
    cue = _said(", ", F.when(bad, "possible negative tone in typing"), F.when(pos >= 0.15, "possible positive tone in typing"), mood)
    return sums.select("request_id", "start_min", "end_min", _or(observed, "no data").alias("observed"), behaviour.alias("behaviour"), _or(cue, "affect unclear from sensors").alias("cue"))


# -- the user's past -----------------------------------------------------------------------------------------------


def compare_to_baseline(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, n, mean, sd, z, phrase, week_mean): the given value against the user's hours at the same time of day, and the
    mean of the week before the newest hour seen; n is 0 where there is no such feature, or no hour; there is no z against a deviation
    of nothing."""
    names = [c for m in COLUMNS for c in _have(world.hours, m)]
    asked = _asked(requests, "compare_to_baseline")
    # a column is asked for by its name, or by its name without the sensor's prefix
    plain = {n.split("_", 1)[1]: n for n in reversed(names)}
    known = F.create_map(*(F.lit(x) for pair in (plain | {n: n for n in names}).items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    asked = asked.withColumn("feature", F.coalesce(known[F.col("feature")], F.lit("")))
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x"), _seen(world.hours, m).alias("seen")) for m in COLUMNS for n in _have(world.hours, m))))
    bins = world.hours.select("user_id", "hour", values.alias("v")).select("user_id", "hour", "v.*").where("seen")
    none = lambda kind: F.lit(None).cast(kind)
    rows = bins.select("user_id", "feature", T.time_of_day(F.pmod("hour", F.lit(24))).alias("tod"), (F.col("hour") * T.HOUR_MS).alias("at"), "x", none("string").alias("request_id"), none("double").alias("now"))
    asks = asked.select("user_id", "feature", T.time_of_day(T.clock_hour(F.col("ms"))).alias("tod"), F.col("ms").alias("at"), none("double").alias("x"), F.col("request_id").cast("string").alias("request_id"), F.col("current_value").alias("now"))
    both = rows.unionByName(asks)
    own = Window.partitionBy("user_id", "feature", "tod").orderBy("at").rangeBetween(Window.unboundedPreceding, -T.HOUR_MS)
    any_ = Window.partitionBy("user_id", "feature").orderBy("at")
    week = F.when(F.col("request_id").isNull(), F.struct(F.avg("x").over(any_.rangeBetween(-7 * T.DAY_MS, 0)).alias("mean")))
    both = both.withColumn("week", week).withColumn("week", F.last("week", True).over(any_.rangeBetween(Window.unboundedPreceding, -T.HOUR_MS)))
    both = both.withColumn("n", F.count("x").over(own)).withColumn("mean", F.avg("x").over(own)).withColumn("sd", F.coalesce(F.stddev_samp("x").over(own), F.lit(0.0))).where("request_id is not null")
    z = F.when(F.col("n") > 0, (F.col("now") - F.col("mean")) / F.greatest("sd", F.lit(1e-6)))
    kind = requests.schema["request_id"].dataType
    told = F.when(F.col("n") > 0, F.col("week.mean"))
    sure = F.col("sd") > 0.001
    return both.select(F.col("request_id").cast(kind).alias("request_id"), "n", "mean", F.when(F.col("n") > 0, F.col("sd")).alias("sd"), F.when(sure, z).alias("z"), F.when(sure, C.z_phrase(z)).alias("phrase"), told.alias("week_mean"))


def receptivity_history(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, turn, prompt_id, desire, available, receptive, n, n_receptive, morning, afternoon, evening[, diary]): the user's
    prompts of the last days, newest first, with shares over all of them and by time of day; a request without any has no rows."""
    asked = _asked(requests, "get_receptivity_history")
    since = F.col("ms") - F.col("n_days") * T.DAY_MS
    days = asked.withColumn("since", since).withColumn("day", F.explode(F.sequence(T.day_of(since), T.day_of(F.col("ms")))))
    past = world.prompts.select("user_id", T.day_of(F.col("ms")).alias("day"), "prompt_id", F.col("ms").alias("at"), "desire", "available", *(c for c in ("diary",) if c in world.prompts.columns))
    met = days.join(past, ["user_id", "day"]).where((F.col("at") < F.col("ms")) & (F.col("at") >= F.col("since")))
    yes = F.coalesce((F.col("desire") >= 5) & F.lower(F.trim(F.col("available").cast("string"))).isin("yes", "1", "true"), F.lit(False))
    met = met.withColumn("receptive", yes).withColumn("tod", T.time_of_day(T.clock_hour(F.col("at"))))
    w = Window.partitionBy("request_id")
    shares = [F.avg(F.when(F.col("tod") == t, F.col("receptive").cast("double"))).over(w).alias(t) for t in ("morning", "afternoon", "evening")]
    diary = [F.when(F.col("include_emotion_driver"), F.col("diary")).alias("diary")] if "diary" in met.columns else []
    turn = F.row_number().over(w.orderBy(F.col("at").desc(), F.col("prompt_id").desc()))
    return met.select("request_id", turn.alias("turn"), "prompt_id", "desire", "available", "receptive", F.count("*").over(w).alias("n"), F.count_if("receptive").over(w).alias("n_receptive"), *shares, *diary)


def _fingerprints(rows: DataFrame, keys: list[str], hours: DataFrame) -> DataFrame:
    """Sums of the six features a key; keys with less than two that are not zero are left out."""
    have = [c for c in FINGERPRINT if c in hours.columns]
    sums = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in have))
    return sums.where(reduce(Column.__add__, [F.when(F.col(c) != 0, 1).otherwise(0) for c in have], F.lit(0)) >= 2)


def _today(asked: DataFrame, hours: DataFrame) -> DataFrame:
    """Fingerprint of each request's day up to its time."""
    slots = asked.withColumn("day", T.day_of(F.col("ms"))).withColumn("hour", F.explode(F.expr("sequence(day * 24, day * 24 + 23)"))).where(visible(F.col("hour"), F.col("ms")))
    return _fingerprints(slots.join(hours, ["user_id", "hour"]), ["request_id", "user_id", "ms", "day"], hours)


def _past_days(world: World) -> DataFrame:
    """(user_id, day, features, last desire and available) of days with a prompt."""
    by_day = world.hours.withColumn("day", F.floor(F.col("hour") / 24).cast("long"))
    last = F.max_by(F.struct("desire", "available"), F.struct("ms", "prompt_id")).alias("last")
    told = world.prompts.groupBy("user_id", T.day_of(F.col("ms")).alias("day")).agg(last)
    return _fingerprints(by_day, ["user_id", "day"], world.hours).join(told, ["user_id", "day"]).select("*", "last.desire", "last.available").drop("last")


def similar_days(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, place, day, similarity, desire, available): the user's earlier days with a prompt that are most like the request's
    day so far, by cosine; ties by day.  A user's days are few."""
    have = [c for c in FINGERPRINT if c in world.hours.columns]
    asked = _asked(requests, "find_similar_days")
    today = _today(asked, world.hours).join(asked.select("request_id", "n"), "request_id")
    past = _past_days(world).select("user_id", F.col("day").alias("past"), "desire", "available", *(F.col(c).alias(f"p_{c}") for c in have))
    dot = lambda a, b: reduce(Column.__add__, [F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in have])
    met = today.join(past, "user_id").where("past < day").withColumn("similarity", dot("", "p_") / F.sqrt(dot("", "") * dot("p_", "p_")))
    w = Window.partitionBy("request_id").orderBy(F.round("similarity", 9).desc(), "past")
    return met.withColumn("place", F.row_number().over(w)).where("place <= n").select("request_id", "place", F.col("past").alias("day"), "similarity", "desire", "available")


#: hours of a piece of time in which requests meet events: a window of a week touches 15 pieces, and what is met outside it lies within a piece of it
PIECE_HOURS = 12


def raw_events(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, turn, ms, event_id, label, more): the first events of the stream in the window, and how many more there are."""
    piece = lambda ms: F.floor(ms / (PIECE_HOURS * T.HOUR_MS)).cast("long")
    asked = _asked(requests, "query_raw_events")
    begin, stop = F.col("ms") - F.col("hours_before_ema") * T.HOUR_MS, F.least(F.col("ms"), F.col("ms") - (F.col("hours_before_ema") - F.col("hours_duration")) * T.HOUR_MS)
    slots = asked.select("request_id", "user_id", "max_events", F.col("modality").alias("stream"), begin.alias("begin"), stop.alias("stop"))
    slots = slots.withColumn("piece", F.explode(F.sequence(piece(F.col("begin")), piece(F.col("stop")))))
    events = world.events.select("user_id", "stream", piece(F.col("ms")).alias("piece"), "ms", "event_id", "label")
    met = slots.join(events, ["user_id", "stream", "piece"]).where("ms >= begin and ms < stop")
    w = Window.partitionBy("request_id")
    met = met.withColumn("turn", F.row_number().over(w.orderBy("ms", "event_id"))).withColumn("more", F.greatest(F.count("*").over(w) - F.col("max_events"), F.lit(0)))
    return met.where("turn <= max_events").select("request_id", "turn", "ms", "event_id", "label", "more")


# -- other people --------------------------------------------------------------------------------------------------


#: days that have a number beside their user's
DAY_NUMBERS = 1 << 20


def peer_days(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, place, peer, day, similarity, desire, available): days of other users most like the request's day so far, features
    standardised over all days; ties by user and day.  request_id and user_id are whole numbers here.  The requests are a query
    set: they meet all days part by part."""
    have = [c for c in FINGERPRINT if c in world.hours.columns]
    asked = _asked(requests, "find_peer_cases").where("search_mode = 'sensing'")
    # numbered in the order of user and day, so that ties at the last place go by them
    days = written(_past_days(world).withColumn("case_id", F.col("user_id").cast("long") * DAY_NUMBERS + F.col("day") + DAY_NUMBERS // 2), "peer-days")
    stats = days.agg(*(f(c).alias(f"{n}_{c}") for c in have for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    z = F.array(*((F.col(c) - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c in have))
    rows = days.select(F.col("case_id").alias("id"), z.alias("v"), "user_id")
    asks = written(_today(asked, world.hours).select(F.col("request_id").cast("long").alias("id"), z.alias("v"), "user_id"), "peer-asks")
    near = S.nearest_vectors(rows, asks, "id", "v", "user_id", 10)
    told = days.select(F.col("case_id").alias("found"), F.col("user_id").alias("peer"), "day", "desire", "available")
    met = near.select("query", "found", "similarity").join(told, "found").join(asked.select(F.col("request_id").cast("long").alias("query"), "top_k"), "query")
    w = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "peer", "day")
    return met.withColumn("place", F.row_number().over(w)).where("place <= top_k").select(F.col("query").alias("request_id"), "place", "peer", "day", "similarity", "desire", "available")


def peer_texts(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, place, peer, case_id, similarity): diary texts of other users most like the asked text, by tf-idf of words and pairs
    counted over the diaries; ties by case.  request_id and case_id are whole numbers here, cases not below 0."""
    asked = _asked(requests, "find_peer_cases").where("search_mode = 'text' and trim(query_text) <> ''")
    # requests take the numbers below 0
    asks = asked.select((-1 - F.col("request_id").cast("long")).alias("number"), F.col("query_text").alias("text"), "user_id", F.lit(False).alias("known"))
    cases = world.diaries.select(F.col("case_id").cast("long").alias("number"), F.coalesce("text", F.lit("")).alias("text"), "user_id", F.lit(True).alias("known"))
    weights = S.term_weights(cases.unionByName(asks), "number", "text", min_df=1, max_terms=None, fit="known", asks=~F.col("known"))
    owned = lambda df: weights.join(df.select("number", F.col("user_id").alias("owner")), "number")
    found = S.nearest_to(owned(cases), owned(asks), "number", "owner", 10)
    met = found.select((-1 - F.col("query")).alias("request_id"), F.col("found").alias("case_id"), "similarity", "place").join(asked.select(F.col("request_id").cast("long").alias("request_id"), "top_k"), "request_id")
    return met.where("place <= top_k").join(world.diaries.select("case_id", F.col("user_id").alias("peer")), "case_id").select("request_id", "place", "peer", "case_id", "similarity")


TOOLS: dict[str, tuple[Callable[[DataFrame, World], DataFrame], ...]] = {
    "query_sensing": (query_sensing,), "get_daily_summary": (daily_summary,), "get_behavioral_timeline": (behavioural_timeline,), "compare_to_baseline": (compare_to_baseline,),
    "get_receptivity_history": (receptivity_history,), "find_similar_days": (similar_days,), "query_raw_events": (raw_events,), "find_peer_cases": (peer_days, peer_texts),
}


def answers(requests: DataFrame, world: World) -> DataFrame:
    """(request_id, tool, problem, result) for every request: result is a VARIANT with an array of the tool's rows, empty where it
    finds nothing, null where there is a problem.  All requests of a tool are answered in one job; a request's rows are
    bounded by its window."""
    kind = requests.schema["request_id"].dataType
    found = []
    for tool, works in TOOLS.items():
        for work in works:
            if work is peer_texts and world.diaries is None:
                continue
            rows = work(requests, world)
            rest = [c for c in rows.columns if c != "request_id"]
            row = F.struct(*(F.col(c) for c in sorted(rest, key=lambda c: (c not in ("turn", "place", "day", "hour", "start_min"), rest.index(c)))))
            listed = rows.groupBy(F.col("request_id").cast(kind).alias("request_id")).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("rows"))
            found.append(listed.select("request_id", F.lit(tool).alias("tool"), "rows"))
    rows = reduce(DataFrame.unionByName, found)
    told = requests.select("request_id", "tool").join(problems(requests).drop("tool"), "request_id", "left").join(rows, ["request_id", "tool"], "left")
    return told.select("request_id", "tool", "problem", F.when(F.col("problem").isNull(), F.parse_json(F.coalesce("rows", F.lit("[]")))).alias("result"))
