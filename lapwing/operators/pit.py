"""Point-in-time features: what an hour bin may tell a prompt, it must have ended by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from .intervals import first_by


def visible(hour: Column, ms: Column) -> Column:
    """Whether the bin of ``hour`` has ended by ``ms``."""
    return (hour + 1) * T.HOUR_MS <= ms


def lookback_slots(prompts: DataFrame, hours: int = 24) -> DataFrame:
    """The ``hours`` hour slots before each prompt's own hour, h = 0 the oldest: an explode, so that the join
    with bins is an equi-join."""
    own = T.hour_of(F.col("ms"))
    return prompts.withColumn("hour", F.explode(F.sequence(own - hours, own - 1))).withColumn("h", (F.col("hour") - own + hours).cast("int"))


def lookback(prompts: DataFrame, bins: DataFrame, hours: int = 24) -> DataFrame:
    """Slots with the user's bins of that hour; slots without a bin stay."""
    return lookback_slots(prompts, hours).join(bins, ["user_id", "hour"], "left")


def recent(prompts: DataFrame, bins: DataFrame, features: list[str], hours: int = 24) -> DataFrame:
    """Prompts with ``seen``: an array of (h, features) of the user's bins in the ``hours`` slots before each prompt's own hour, in
    the order of slots, empty without any.

    A bin goes to the days whose prompts may look back to it (two for a day's lookback), where they are one row a user and day, and
    each prompt meets its day's row: prompts are never copied, nor put together again.
    """
    own = T.hour_of(F.col("ms"))
    days = F.sequence(F.floor((F.col("hour") + 1) / 24).cast("long"), F.floor((F.col("hour") + hours) / 24).cast("long"))
    dealt = bins.select("user_id", F.explode(days).alias("_day"), F.struct("hour", *features).alias("_bin"))
    dealt = dealt.groupBy("user_id", "_day").agg(F.array_sort(F.collect_list("_bin")).alias("_bins"))
    met = prompts.withColumn("_own", own).withColumn("_day", F.floor(F.col("_own") / 24).cast("long")).join(dealt, ["user_id", "_day"], "left")
    inside = F.filter("_bins", lambda b: (b["hour"] >= F.col("_own") - hours) & (b["hour"] < F.col("_own")))
    seen = F.transform(inside, lambda b: F.struct((b["hour"] - F.col("_own") + hours).cast("int").alias("h"), *(b[f].alias(f) for f in features)))
    return met.select(*prompts.columns, F.coalesce(seen, F.array()).alias("seen"))


def offset_window(prompts: DataFrame, bins: DataFrame, before: int, duration: int, keep: list[str]) -> DataFrame:
    """Bins of [t - before, min(t - before + duration, t)) hours, the start floored to an hour, that have ended by t."""
    start = T.hour_of(F.col("ms") - before * T.HOUR_MS)
    stop = F.least(F.col("ms") - (before - duration) * T.HOUR_MS, F.col("ms"))
    slots = prompts.withColumn("hour", F.explode(F.sequence(start, start + duration)))
    slots = slots.where((F.col("hour") * T.HOUR_MS < stop) & visible(F.col("hour"), F.col("ms")))
    return slots.select(*keep, "user_id", "hour").join(bins, ["user_id", "hour"])


def before_and_yesterday(prompts: DataFrame, bins: DataFrame, sums: list[str]) -> DataFrame:
    """For each prompt the sums of today's bins that have ended, and of all of yesterday's."""
    day = T.day_of(F.col("ms"))
    two = prompts.withColumn("_when", F.explode(F.array(F.struct(day.alias("day"), F.lit("today").alias("part")), F.struct((day - 1).alias("day"), F.lit("yesterday").alias("part")))))
    two = two.select("prompt_id", "user_id", "ms", "_when.day", "_when.part")
    met = two.join(bins.withColumn("day", F.floor(F.col("hour") / 24).cast("long")), ["user_id", "day"], "left").where(F.col("hour").isNull() | visible(F.col("hour"), F.col("ms")))
    of = lambda c, part: F.sum(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    sums_ = met.groupBy("prompt_id").agg(*(of(c, part) for part in ("today", "yesterday") for c in sums))
    return prompts.select("prompt_id", "user_id").join(sums_, "prompt_id", "left")


def _moments(x: Column, of=lambda a: a) -> dict[str, Column]:
    """Number, mean, sum of squared deviations, least and greatest of ``x``; ``of`` says over what."""
    n = of(F.count(x))
    return {"n": n, "mean": of(F.avg(x)), "m2": of(F.var_pop(x)) * n, "lo": of(F.min(x)), "hi": of(F.max(x))}


def _earlier_moments(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` (keys, _piece, of_<moment>) with to_<moment>, those of all earlier pieces of the key together.

    Means are held against the mean of the key's pieces, so that little is lost where they are far from zero."""
    key = Window.partitionBy(*keys)
    past = key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("_mid", F.avg("of_mean").over(key))
    off = F.col("of_mean") - F.col("_mid")
    n, first, second = (F.coalesce(F.sum(c).over(past), F.lit(0)) for c in (F.col("of_n"), F.col("of_n") * off, F.col("of_m2") + F.col("of_n") * off * off))
    rows = rows.select("*", n.alias("to_n"), first.alias("_first"), second.alias("_second"), F.min("of_lo").over(past).alias("to_lo"), F.max("of_hi").over(past).alias("to_hi"))
    share = F.when(F.col("to_n") > 0, F.col("_first") / F.col("to_n"))
    return rows.select("*", (F.col("_mid") + share).alias("to_mean"), F.greatest(F.col("_second") - F.col("_first") * share, F.lit(0.0)).alias("to_m2")).drop("_mid", "_first", "_second")


def _merged(a: str, b: str) -> dict[str, Column]:
    """Moments ``a``_* and ``b``_* together; equal values deviate by nothing."""
    at = lambda side, name: F.col(f"{side}_{name}")
    na, nb = F.coalesce(at(a, "n"), F.lit(0)), F.coalesce(at(b, "n"), F.lit(0))
    n, apart = na + nb, at(b, "mean") - at(a, "mean")
    lo, hi = F.least(at(a, "lo"), at(b, "lo")), F.greatest(at(a, "hi"), at(b, "hi"))
    mean = F.when(na == 0, at(b, "mean")).when(nb == 0, at(a, "mean")).otherwise(at(a, "mean") + apart * nb / n)
    m2 = F.when(na == 0, at(b, "m2")).when(nb == 0, at(a, "m2")).otherwise(at(a, "m2") + at(b, "m2") + apart * apart * na * nb / n)
    return {"n": n, "mean": F.when(lo == hi, lo).otherwise(mean), "m2": F.when(lo == hi, 0.0).otherwise(m2)}


WEEK = 7 * 86400


def personal_baseline(prompts: DataFrame, bins: DataFrame, value: str, floor: float = 1e-6, piece_days: int = 32) -> DataFrame:
    """For each prompt: n, mean and sample deviation (0 of one) of the user's bins at the same time of day
    that have ended, the z of the prompt's own ``value``, and the mean of the week before the newest bin seen.

    Bins and prompts go through windows in the order of time, so that no pair of prompt and bin is made.  A user's past is
    cut into pieces of ``piece_days`` days (seven at least): a window holds one piece and the week before it, and what is known
    of earlier pieces is one row of moments a piece, so a user with very many bins is many tasks' work.
    """
    if piece_days < 7:
        raise ValueError("a piece has seven days at least")
    tod, span = T.time_of_day, piece_days * 86400
    at = F.col("hour") * 3600
    piece = lambda t: F.floor(t / span).cast("long")
    rows = bins.select("user_id", tod(F.pmod("hour", F.lit(24))).alias("tod"), at.alias("t"), F.col(value).cast("double").alias("x"), F.lit(None).cast("long").alias("prompt_id"), F.lit(None).cast("double").alias("now"), F.explode(F.sequence(piece(at), piece(at + WEEK - 1))).alias("_piece"))
    # a prompt sees the bins that began an hour before it or earlier
    asked = F.floor(F.col("ms") / 1000).cast("long") - 3600
    asks = prompts.select("user_id", tod(T.clock_hour(F.col("ms"))).alias("tod"), asked.alias("t"), F.lit(None).cast("double").alias("x"), "prompt_id", F.col("value").alias("now"), piece(asked).alias("_piece"))
    keys = ["user_id", "tod"]
    spread = rows.unionByName(asks).repartition(*keys, "_piece")
    own = F.when(piece(F.col("t")) == F.col("_piece"), F.col("x"))  # not what is there for the week alone
    w = Window.partitionBy(*keys, "_piece").orderBy("t")
    spread = spread.withColumn("week", F.when(own.isNotNull(), F.avg("x").over(w.rangeBetween(-WEEK + 1, 0)))).withColumn("x", own)
    newest = F.when(F.col("x").isNotNull(), F.col("t"))
    pieces = spread.groupBy(*keys, "_piece").agg(*(c.alias(f"of_{k}") for k, c in _moments(F.col("x")).items()), F.max_by("week", newest).alias("of_week"))
    past = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _earlier_moments(pieces, keys).withColumn("to_week", F.last("of_week", True).over(past))
    pieces = pieces.select(F.col("user_id").alias("_user"), F.col("tod").alias("_tod"), F.col("_piece").alias("_at"), *(f"to_{k}" for k in ("n", "mean", "m2", "lo", "hi", "week")))
    so_far = w.rangeBetween(Window.unboundedPreceding, 0)
    within = spread.select("*", *(c.alias(f"in_{k}") for k, c in _moments(F.col("x"), lambda a: a.over(so_far)).items()), F.last("week", True).over(so_far).alias("in_week")).where("prompt_id is not null")
    both = within.join(pieces, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("tod").eqNullSafe(F.col("_tod")) & F.col("_piece").eqNullSafe(F.col("_at")))
    m = _merged("to", "in")
    both = both.select("prompt_id", "user_id", "now", m["n"].alias("n"), m["mean"].alias("mean"), m["m2"].alias("m2"), F.coalesce("in_week", "to_week").alias("week_mean"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    z = F.when(F.col("n") > 0, (F.col("now") - F.col("mean")) / F.greatest(sd, F.lit(floor)))
    return both.select("prompt_id", "user_id", "n", "mean", F.when(F.col("n") > 0, sd).alias("sd"), z.alias("z"), "week_mean")


def daily_baseline(days: DataFrame, value: str, span: int = 30, least: int = 3) -> DataFrame:
    """For each day: n, mean, sd and z over the ``span`` days before, and the share of them strictly below."""
    w = Window.partitionBy("participant").orderBy("day").rangeBetween(-span, -1)
    x = F.col(value)
    rows = days.withColumn("n", F.count(x).over(w)).withColumn("mean", F.avg(x).over(w)).withColumn("sd", F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))).withColumn("_past", F.collect_list(x).over(w))
    z = F.when(F.col("sd") > 0, (x - F.col("mean")) / F.col("sd")).otherwise(0.0)
    below = F.size(F.filter("_past", lambda p: p < x)) / F.col("n")
    return rows.where(F.col("n") >= least).select("participant", "day", "n", "mean", "sd", z.alias("z"), below.alias("below"))


def history(prompts: DataFrame, days: int = 14) -> DataFrame:
    """Share of receptive prompts among the user's last ``days`` days, strictly before, overall and at the
    prompt's time of day."""
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-days * T.DAY_MS, -1)
    yes = ((F.col("desire") >= 5) & (F.col("available") == "yes")).cast("double")
    rows = prompts.withColumn("tod", T.time_of_day(T.clock_hour(F.col("ms")))).withColumn("yes", yes)
    rows = rows.withColumn("n", F.count("yes").over(w)).withColumn("rate", F.avg("yes").over(w))
    same = {t: F.avg(F.when(F.col("tod") == t, F.col("yes"))).over(w) for t in ("night", "morning", "afternoon", "evening")}
    at = None
    for t, c in same.items():
        at = F.when(F.col("tod") == t, c) if at is None else at.when(F.col("tod") == t, c)
    return rows.select("prompt_id", "n", "rate", at.alias("rate_tod"))


def earlier_sums(rows: DataFrame, key: str, order: list[str], piece: Column, sums: dict[str, Column]) -> DataFrame:
    """``rows`` and, by name, each of ``sums`` over the key's rows strictly before each row in ``order``: 0 where there are none.

    ``piece`` cuts a key's past into pieces and rises with the order.  Sums before a row are those of earlier pieces, from one row a
    piece, and those inside its own; so a key with very many rows is as many tasks' work as it has pieces.
    """
    spread = rows.select("*", piece.alias("_piece"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_of_{name}") for name, c in sums.items())).repartition(key, "_piece")
    pieces = spread.groupBy(key, "_piece").agg(*(F.sum(f"_of_{name}").alias(f"_to_{name}") for name in sums))
    past = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col(key).alias("_key"), F.col("_piece").alias("_at"), *(F.sum(f"_to_{name}").over(past).alias(f"_to_{name}") for name in sums))
    own = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = spread.select("*", *(F.sum(f"_of_{name}").over(own).alias(f"_in_{name}") for name in sums))
    met = within.join(pieces, F.col(key).eqNullSafe(F.col("_key")) & F.col("_piece").eqNullSafe(F.col("_at")))
    zero = F.lit(0.0)
    return met.select(*rows.columns, *((F.coalesce(f"_to_{name}", zero) + F.coalesce(f"_in_{name}", zero)).alias(name) for name in sums))


def profile(prompts: DataFrame) -> DataFrame:
    """For each prompt, the user's shares and base rate over all earlier prompts (the rate needs three).  A user's past
    is cut by days."""
    wish, ready = F.col("desire") >= 5, F.col("available") == "yes"
    morning = F.when(F.floor(F.pmod(F.floor(F.col("ms") / T.HOUR_MS), F.lit(24))) < 12, F.col("state"))
    sums = {"n": F.lit(1)}
    for name, c in (("receptive", wish & ready), ("desire_share", wish), ("available_share", ready), ("state_rate", F.col("state")), ("morning_rate", morning)):
        sums |= {f"_yes_{name}": c, f"_all_{name}": c.isNotNull()}
    rows = earlier_sums(prompts.select("prompt_id", "user_id", "ms", "desire", "available", "state"), "user_id", ["ms", "prompt_id"], T.day_of(F.col("ms")), sums)
    share = lambda name: F.when(F.col(f"_all_{name}") > 0, F.col(f"_yes_{name}") / F.col(f"_all_{name}"))
    rate = lambda name: F.when(F.col("n") >= 3, share(name)).alias(name)
    return rows.select("prompt_id", F.col("n").cast("long").alias("n"), *(share(x).alias(x) for x in ("receptive", "desire_share", "available_share")), rate("state_rate"), rate("morning_rate"))


def profile_details(prompts: DataFrame) -> DataFrame:
    """For each prompt, from the user's earlier prompts: n, the split of those without an intervention taken (no_desire of them, and
    unavailable), receptive share and number in each slot of the day (from three), and the first two diaries when receptive and when
    not (from five diaries and two of the kind).  prompts: prompt_id, user_id, ms, desire, available, diary; a null desire is none.
    A user's past is cut by days.
    """
    slots, kinds = ("morning", "afternoon", "evening"), ("receptive", "other")
    wish = F.coalesce(F.col("desire") >= 5, F.lit(False))
    taken = wish & F.coalesce(F.lower(F.trim("available")) == "yes", F.lit(False))
    slot = T.prompt_slot(T.clock_hour(F.col("ms")))
    told = {"receptive": F.when(taken, F.col("diary")), "other": F.when(~taken, F.col("diary"))}
    sums = {"n": F.lit(1), "_not_taken": ~taken, "_no_wish": ~wish, "_diaries": F.col("diary").isNotNull()} | {f"_{k}": told[k].isNotNull() for k in kinds}
    for s in slots:
        sums |= {f"_{s}": slot == s, f"_{s}_taken": (slot == s) & taken}
    kept = prompts.select("prompt_id", "user_id", "ms", "desire", "available", "diary")
    rows = earlier_sums(kept, "user_id", ["ms", "prompt_id"], T.day_of(F.col("ms")), sums)
    # a diary with none, or one, of its kind before it is the user's first, or second
    first = {f"{k}_diary_{i + 1}": F.max(F.when(F.col(f"_{k}") == i, told[k])) for k in kinds for i in (0, 1)}
    opening = rows.where("diary is not null and (_receptive < 2 or _other < 2)").groupBy(F.col("user_id").alias("_user")).agg(*(c.alias(f"_{name}") for name, c in first.items()))
    rows = rows.join(opening, F.col("user_id").eqNullSafe(F.col("_user")), "left")
    no_wish = F.when(F.col("_not_taken") > 0, F.col("_no_wish") / F.col("_not_taken"))
    out = [F.col("n").cast("long").alias("n"), no_wish.alias("no_desire"), (1 - no_wish).alias("unavailable")]
    for s in slots:
        n = F.col(f"_{s}")
        out += [n.cast("long").alias(f"{s}_n"), F.when(n >= 3, F.col(f"_{s}_taken") / n).alias(f"{s}_rate")]
    for k in kinds:
        enough = (F.col("_diaries") >= 5) & (F.col(f"_{k}") >= 2)
        out += [F.when(enough, F.col(f"_{k}_diary_{i}")).alias(f"{k}_diary_{i}") for i in (1, 2)]
    return rows.select("prompt_id", *out)


def replayed(context: DataFrame, scorer, adds: str, outcomes: DataFrame) -> DataFrame:
    """``context`` (prompt_id, user_id, ms, what is known by then) scored, and only afterwards joined with ``outcomes`` (prompt_id, ...).

    ``scorer`` takes and yields pandas frames (an iterator, as mapInPandas) with the columns of ``adds`` (DDL) beside the given ones; a
    row holds nothing later than its prompt, and the outcome is not among its columns.  ``turn`` numbers a user's prompts in time.
    """
    clash = set(context.columns) & (set(outcomes.columns) - {"prompt_id"})
    if clash:
        raise ValueError(f"outcomes among what is known: {sorted(clash)}")
    turns = context.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "prompt_id")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema) + f", {adds}"
    return turns.mapInPandas(scorer, schema).join(outcomes, "prompt_id", "left")


def running_personal(prompts: DataFrame, folds: int = 5) -> DataFrame:
    """Deviation from the user's own past (three rows at least, else from all rows of the other folds, which are
    the training rows where this fold is the test), and rates of the last ten.

    A user's past is cut by days: windows hold one user's day, earlier days are a row of moments and the last ten rows each.
    """
    train = prompts.select("fold", "value").withColumn("_test", F.explode(F.sequence(F.lit(1), F.lit(folds)))).where(F.col("fold") != F.col("_test"))
    people = train.groupBy("_test").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    wish, ready = F.col("desire") >= 5, F.col("available") == "yes"
    said = F.struct(*(c.cast("double").alias(k) for k, c in (("desire", wish), ("available", ready), ("joint", wish & ready))))
    rows = prompts.select("prompt_id", "user_id", "ms", "fold", F.col("value").cast("double").alias("value"), said.alias("said"), T.day_of(F.col("ms")).alias("_piece")).repartition("user_id", "_piece")
    order = Window.partitionBy("user_id", "_piece").orderBy("ms", "prompt_id")
    rows = rows.withColumn("ten", F.collect_list("said").over(order.rowsBetween(-10, -1)))
    upto = F.concat("ten", F.array("said"))
    pieces = rows.groupBy("user_id", "_piece").agg(*(c.alias(f"of_{k}") for k, c in _moments(F.col("value")).items()), F.count("*").alias("of_rows"), F.max_by(upto, F.struct("ms", "prompt_id")).alias("of_ten"))
    by_day = Window.partitionBy("user_id").orderBy("_piece")
    past = by_day.rowsBetween(Window.unboundedPreceding, -1)
    # a day has a row at least, so ten days hold the last ten
    pieces = _earlier_moments(pieces, ["user_id"]).withColumn("to_rows", F.coalesce(F.sum("of_rows").over(past), F.lit(0))).withColumn("to_ten", F.flatten(F.collect_list("of_ten").over(by_day.rowsBetween(-10, -1))))
    pieces = pieces.select(F.col("user_id").alias("_user"), F.col("_piece").alias("_at"), *(f"to_{k}" for k in ("n", "mean", "m2", "lo", "hi", "rows", "ten")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select("*", *(c.alias(f"in_{k}") for k, c in _moments(F.col("value"), lambda a: a.over(before)).items()), F.count("*").over(before).alias("in_rows"))
    met = within.join(pieces, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_piece").eqNullSafe(F.col("_at")))
    met = met.join(F.broadcast(people), F.col("fold") == F.col("_test"), "left")  # one row a fold
    m, all_ten = _merged("to", "in"), F.concat("to_ten", "ten")
    x, n = F.col("value"), F.col("in_rows") + F.col("to_rows")
    met = met.select("prompt_id", "value", "_mean", "_sd", n.alias("rows"), m["mean"].alias("own"), F.sqrt(m["m2"] / m["n"]).alias("own_sd"), F.slice(all_ten, F.greatest(F.size(all_ten) - 9, F.lit(1)), F.lit(10)).alias("ten"))
    z = F.when(F.col("rows") >= 3, (x - F.col("own")) / (F.col("own_sd") + 1e-8)).otherwise((x - F.col("_mean")) / (F.col("_sd") + 1e-8))

    def rate(name: str) -> Column:
        known = F.filter(F.transform("ten", lambda s: s[name]), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)).otherwise(0.0).alias(f"{name}_rate")

    return met.select("prompt_id", z.alias("deviation"), F.least(F.col("rows") / 20, F.lit(1.0)).alias("volume"), rate("desire"), rate("available"), rate("joint"))


def last_of_day(prompts: DataFrame, columns: list[str]) -> DataFrame:
    """(user_id, day, last_<column>): the last prompt of each user and day."""
    last = F.max_by(F.struct(*columns), F.struct("ms", "prompt_id")).alias("last")
    rows = prompts.groupBy("user_id", T.day_of(F.col("ms")).alias("day")).agg(last)
    return rows.select("user_id", "day", *(F.col(f"last.{c}").alias(f"last_{c}") for c in columns))


def narratives_for(prompts: DataFrame, narratives: DataFrame) -> DataFrame:
    """prompt_id, narrative: that of the prompt's own day and time, or where there is none that of the day alone (one
    without a time); of several the first by tie; blank ones are null.  narratives: user_id, day, ms, tie, narrative."""
    text = F.when(F.trim("narrative") != "", F.col("narrative"))
    exact = first_by(narratives.where("ms is not null"), ["user_id", "day", "ms"], F.col("tie")).select("user_id", "day", "ms", text.alias("own"), F.lit(True).alias("hit"))
    whole = first_by(narratives.where("ms is null"), ["user_id", "day"], F.col("tie")).select("user_id", "day", text.alias("daily"))
    rows = prompts.select("prompt_id", "user_id", "ms", T.day_of(F.col("ms")).alias("day")).join(exact, ["user_id", "day", "ms"], "left").join(whole, ["user_id", "day"], "left")
    return rows.select("prompt_id", F.when(F.col("hit"), F.col("own")).otherwise(F.col("daily")).alias("narrative"))


def last_prompts(prompts: DataFrame, asks: DataFrame, n: int = 5) -> DataFrame:
    """For each ask (user_id, ask_day), the last ``n`` prompts of earlier days, newest first, with states raised."""
    day = T.day_of(F.col("ms"))
    numbered = prompts.withColumn("_rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "prompt_id")))
    both = prompts.select("user_id", day.alias("day"), F.lit(1).alias("is_prompt")).unionByName(asks.select("user_id", F.col("ask_day").alias("day"), F.lit(0).alias("is_prompt")))
    earlier = F.sum("is_prompt").over(Window.partitionBy("user_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1))
    wanted = both.withColumn("c", F.coalesce(earlier, F.lit(0))).where("is_prompt = 0 and c > 0").select("user_id", F.col("day").alias("ask_day"), "c").distinct()
    wanted = wanted.withColumn("_rn", F.explode(F.sequence(F.greatest(F.col("c") - n + 1, F.lit(1)).cast("int"), F.col("c").cast("int"))))
    raised = F.concat_ws(",", F.when(F.col("state"), "state"), F.when(F.col("desire") >= 5, "desire"))
    return wanted.join(numbered, ["user_id", "_rn"]).select("user_id", "ask_day", (F.col("c") - F.col("_rn") + 1).alias("turn"), "prompt_id", raised.alias("raised"))


def first_events(prompts: DataFrame, events: DataFrame, hours: int = 4, most: int = 30) -> DataFrame:
    """The first ``most`` events of the ``hours`` before each prompt, and how many more there are."""
    slots = prompts.select("prompt_id", "user_id", "ms", F.explode(F.sequence(T.hour_of(F.col("ms") - hours * T.HOUR_MS), T.hour_of(F.col("ms")))).alias("hour"))
    rows = events.select("user_id", T.hour_of(F.col("ms")).alias("hour"), F.col("ms").alias("at"), "event_id")
    met = slots.join(rows, ["user_id", "hour"]).where((F.col("at") >= F.col("ms") - hours * T.HOUR_MS) & (F.col("at") < F.col("ms")))
    w = Window.partitionBy("prompt_id")
    met = met.withColumn("turn", F.row_number().over(w.orderBy("at", "event_id"))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return met.where(F.col("turn") <= most).select("prompt_id", "turn", "event_id", "more")


def sleep_bins(prompts: DataFrame, bins: DataFrame, value: str) -> DataFrame:
    """Night hours (0 to 8) of each prompt's day that have ended with activity at most their 25th percentile."""
    slots = lookback(prompts, bins, 24).where((F.floor(F.col("hour") / 24) == T.day_of(F.col("ms"))) & (F.pmod("hour", F.lit(24)) < 8) & F.col(value).isNotNull())
    low = slots.groupBy("prompt_id").agg(F.percentile(value, F.lit(0.25)).alias("low"))
    return slots.join(low, "prompt_id").groupBy("prompt_id").agg(F.count_if(F.col(value) <= F.col("low")).alias("sleep_hours"), F.count("*").alias("n"))
