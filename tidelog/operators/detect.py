"""Detectors over event time: critical messages, floods, silence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions import fixed
from tidelog.functions.text import clean_text, critical_class, critical_title, spam_group
from tidelog.functions.values import at, contains_ci, from_micros, half_even, micros
from tidelog.operators.bounded import small_side
from tidelog.operators.cooldown import passing_times, throttle
from tidelog.operators.ordered import slot_of
from tidelog.operators.scope import owned_containers
from tidelog.operators.search import not_gateway
from tidelog.operators.services import with_service_key
from tidelog.session import cut_lineage


EVENT_COLUMNS = ["LogId", "Timestamp", "type", "severity", "title", "message", "container_id", "container_name"]


def _error_like(df: DataFrame) -> DataFrame:
    return not_gateway(df).filter(
        (F.col("SeverityText") == "ERROR") | contains_ci("Body", "error") | contains_ci("Body", "fatal"))


def _as_events(rows: DataFrame, rules, *more: str) -> DataFrame:
    return rows.select(*more, "LogId", "Timestamp", "type", F.lit("critical").alias("severity"),
                       critical_title("type", rules).alias("title"),
                       F.substring("Body", 1, fixed.CRITICAL_MESSAGE_CHARS).alias("message"),
                       F.col("ContainerId").alias("container_id"), F.col("ContainerName").alias("container_name"))


def critical_events(df: DataFrame, rules=None) -> DataFrame:
    """Error-like rows that fall in a critical class, with their first class (no cooldown)."""
    rows = _error_like(df).withColumn("type", critical_class("Body", rules))
    return _as_events(rows.filter(F.col("type").isNotNull()), rules)


def critical_alerts(df: DataFrame, cooldown: float = fixed.CRITICAL_COOLDOWN_SECONDS, rules=None) -> DataFrame:
    """Critical events after the cooldown: a row goes to its first class that is not cooling down.

    Rows of one class never affect an earlier class, so the classes are taken in order and
    each sees the rows the earlier ones let fall through. The log is read once: its hits are
    written to the checkpoint folder with a number of their own, as rows may share a LogId. What a
    class let pass is written too, one row per cooldown at most.
    """
    rules = rules or fixed.CRITICAL_CLASSES
    classes = F.array_compact(F.array(*[F.when(F.col("Body").rlike("(?i)" + p), F.lit(n)) for n, p, _ in rules]))
    hits = cut_lineage(_error_like(df).withColumn("_classes", classes).filter(F.size("_classes") > 0)
                       .withColumn("_hit", F.monotonically_increasing_id()))
    passed = None
    for name, _, _ in rules:
        rows = hits.filter(F.array_contains("_classes", name)).withColumn("type", F.lit(name))
        if passed is not None:
            rows = rows.join(passed.select("_hit"), "_hit", "left_anti")
        events = _as_events(rows, rules, "_hit")
        alerts = cut_lineage(throttle(events, ["type"], "Timestamp", cooldown, order=["LogId", "_hit"]))
        passed = alerts if passed is None else passed.unionByName(alerts)
    return passed.drop("_hit")


def spam_groups(df: DataFrame, window: str = "1 minute", slide: str | None = None,
                rate: float = fixed.SPAM_RATE_PER_SECOND, count: int = fixed.SPAM_COUNT,
                hits: int = fixed.SPAM_FLOOD_HITS, seconds: float = 60.0) -> DataFrame:
    """Message groups of a container and window that look like spam or a flood.

    `seconds` is the length of `window`, the divisor of the rate.
    """
    grouped = _spam_counts(df, window, slide).withColumn("req_per_sec", half_even(F.col("cnt") / seconds, 2))
    flagged = (F.col("req_per_sec") >= rate) | ((F.col("cnt") >= count) & (F.col("ddos_hits") >= hits))
    return grouped.filter(flagged).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ContainerId", "grp",
        "container_name", "cnt", "req_per_sec", "ddos_hits")


def _spam_counts(df: DataFrame, window: str, slide: str | None) -> DataFrame:
    flood = F.lower("Body").rlike(fixed.FLOOD_WORDS)
    w = F.window("Timestamp", window, slide) if slide else F.window("Timestamp", window)
    # The name is a grouping key of the first step, so the row-level step aggregates numbers only.
    return (not_gateway(df)
            .groupBy(w.alias("w"), "ContainerId", spam_group("Body").alias("grp"), "ContainerName")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(flood).alias("h"))
            .groupBy("w", "ContainerId", "grp")
            .agg(F.min("ContainerName").alias("container_name"), F.sum("n").alias("cnt"), F.sum("h").alias("ddos_hits")))


def spam_samples(df: DataFrame, groups: DataFrame, window: str = "1 minute") -> DataFrame:
    """Adds the sample message: the greatest body of the group, read for flagged groups only.

    The flagged groups are computed once; the rows are not shuffled to find theirs.
    """
    keys = ["window_start", "ContainerId", "grp"]
    groups = small_side(groups)
    bodies = (not_gateway(df)
              .select(F.window("Timestamp", window)["start"].alias("window_start"), "ContainerId",
                      spam_group("Body").alias("grp"), "Body"))
    # A flagged group may lack a container or a body: its rows are found by equality that knows NULL.
    named = [F.col(c).alias(f"_{c}") for c in keys]
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    samples = (bodies.join(groups.select(*named), alike, "left_semi")
               .groupBy(*named).agg(F.max("Body").alias("sample_msg")))
    return groups.join(samples, alike, "left").select(*groups.columns, "sample_msg")


def spam_message(groups: DataFrame) -> DataFrame:
    """Flagged groups with their sample as notification rows."""
    note = F.when(F.col("ddos_hits") > 0, "Likely DDOS/flood pattern.").otherwise("Repeated spam pattern.")
    name = F.coalesce(F.nullif("container_name", F.lit("")), "ContainerId")
    message = F.concat(
        F.lit("Container '"), name, F.lit("' is emitting abnormal volume: "), F.col("req_per_sec").cast("string"),
        F.lit(" req/sec ("), F.col("cnt").cast("string"), F.lit("/min). "), note, F.lit(" Sample: "),
        F.substring("sample_msg", 1, 120), F.lit("..."))
    return groups.select(F.lit("log_spam").alias("type"), F.lit("critical").alias("severity"),
                         F.lit("Spam / DDOS Pattern Detected").alias("title"), message.alias("message"),
                         F.col("ContainerId").alias("container_id"), "container_name",
                         F.col("window_end").alias("created_at"))


def anomaly_episodes(groups: DataFrame, keys: Sequence[str] = ("ContainerId", "grp"),
                     window_seconds: float = 60.0) -> DataFrame:
    """Runs of consecutive anomalous windows: one alert per run, armed again after a clear window.

    The input has one row per key and window, so a key's rows are bounded by the time range.
    """
    keys = list(keys)
    index = slot_of(micros("window_start"), int(window_seconds * 1_000_000))
    by_time = Window.partitionBy(*keys).orderBy("_i")
    return (groups.withColumn("_i", index)
            .withColumn("_run", F.col("_i") - F.row_number().over(by_time))
            .groupBy(*keys, "_run")
            .agg(F.min("window_start").alias("alert_window"), F.max("window_start").alias("last_window"),
                 F.count(F.lit(1)).alias("windows"), F.sum("cnt").alias("cnt"), F.sum("ddos_hits").alias("ddos_hits"))
            .drop("_run"))


def silences(df: DataFrame, keys: Sequence[str] = ("ContainerId",), gap: float = fixed.SILENCE_SECONDS,
             as_of: str | Column | None = None, lookback: float | None = None,
             runtime: DataFrame | None = None) -> DataFrame:
    """Pauses of more than `gap` seconds between the logs of a key.

    With `as_of`, also the pause that still lasts then (`until` is NULL), for keys seen
    within `lookback` seconds. With `runtime` (keys, state), only keys that are not running.
    Rows are first reduced to first and last time per key and slot of the gap's length; two
    rows in a slot cannot be that far apart, so the pauses between slots are all there are.
    """
    keys = list(keys)
    width = max(1, int(gap * 1_000_000))
    rows = not_gateway(df)
    if as_of is not None:
        rows = rows.filter(F.col("Timestamp") <= at(as_of))
    slots = (rows.groupBy(*keys, slot_of(micros("Timestamp"), width).alias("_slot"))
             .agg(F.min("Timestamp").alias("_first"), F.max("Timestamp").alias("last_log")))
    by_time = Window.partitionBy(*keys).orderBy("_slot")
    pauses = slots.withColumn("until", F.lead("_first").over(by_time))
    end = F.col("until")
    if as_of is not None:
        end = F.coalesce(end, at(as_of))
        if lookback is not None:
            oldest = at(as_of) - F.make_dt_interval(secs=F.lit(float(lookback)).cast("decimal(18,6)"))
            pauses = pauses.filter(F.col("until").isNotNull() | (F.col("last_log") > oldest))
    seconds = (micros(end) - micros("last_log")) / 1_000_000
    found = (pauses.withColumn("seconds", seconds).filter(F.col("seconds") > gap)
             .select(*keys, "last_log", "until", "seconds"))
    if runtime is not None:
        found = found.join(runtime.filter(F.col("state") != "running").select(*keys), keys, "left_semi")
    return found


def service_silences(df: DataFrame, gap: float = fixed.SILENCE_SECONDS, as_of: str | Column | None = None) -> DataFrame:
    """Silence of whole services: a pause counts only where no instance logs."""
    return silences(with_service_key(df), ["service_key"], gap, as_of)


def state_at(moments: DataFrame, snapshots: DataFrame, keys: Sequence[str], ts: str, snapshot_ts: str,
             state: str) -> DataFrame:
    """Adds `state` of the latest snapshot at or before each moment.

    Both sides are merged in time order, so moments and snapshots are not paired up.
    """
    keys = list(keys)
    # A day bucket keeps the windows small; each day starts with the last state before it.
    day = lambda c: F.to_date(c)
    left = moments.withColumn("_t", F.col(ts)).withColumn("_kind", F.lit(1))
    right = snapshots.select(*keys, F.col(snapshot_ts).alias("_t"), F.col(state).alias("_s"), F.lit(0).alias("_kind"))
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("_day", day("_t"))
    daily = merged.groupBy(*keys, "_day").agg(F.max_by("_s", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select(*keys, "_day", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    within = (Window.partitionBy(*keys, "_day").orderBy("_t", "_kind")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("_seen", F.last("_s", ignorenulls=True).over(within))
            .filter(F.col("_kind") == 1).join(carried, [*keys, "_day"], "left")
            .withColumn(state, F.coalesce("_seen", "_carry"))
            .drop("_t", "_kind", "_s", "_seen", "_carry", "_day"))


def down_up_transitions(df: DataFrame, gap: float = fixed.SILENCE_SECONDS, as_of: str | Column | None = None,
                        keys: Sequence[str] = ("ContainerId",), snapshots: DataFrame | None = None,
                        second_look: float = fixed.SECOND_LOOK_SECONDS) -> DataFrame:
    """One row per state change: down once the silence has lasted `gap` seconds, recovered at the next log.

    With `snapshots` (keys, snapshot_ts, state), a container counts as down only if it does
    not run at that moment (unknown counts as running), and it recovers `second_look`
    seconds later already if it runs again by then.
    """
    keys = list(keys)
    pauses = silences(df, keys, gap, as_of)
    pauses = pauses.withColumn("down_at", from_micros(micros("last_log") + int(gap * 1_000_000)))
    back = F.col("until")
    if snapshots is not None:
        pauses = state_at(pauses, snapshots, keys, "down_at", "snapshot_ts", "state")
        pauses = pauses.filter(F.coalesce("state", F.lit("running")) != "running").drop("state")
        pauses = pauses.withColumn("look_at", from_micros(micros("down_at") + int(second_look * 1_000_000)))
        pauses = state_at(pauses, snapshots, keys, "look_at", "snapshot_ts", "state")
        early = F.when(F.col("state") == "running", F.col("look_at"))
        back = F.least(back, early)
    change = lambda kind, severity, moment: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                                     moment.alias("at"))
    changes = F.array(change("container_down", "critical", F.col("down_at")),
                      change("container_recovered", "info", back))
    return (pauses.select(*keys, "last_log", F.explode(changes).alias("c"))
            .select(*keys, "c.type", "c.severity", "c.at", "last_log")
            .filter(F.col("at").isNotNull()))


def _fold_states(batches: Iterator[pd.DataFrame], look_us: int, until_us: int | None) -> Iterator[pd.DataFrame]:
    """Down and recovered changes from moments sorted by key, time and kind.

    Kinds: 0 a snapshot (value 1: running), 1 logs resume, 2 a silence is noticed (value: the last log). Of a key
    only a few numbers are kept, however many moments it has.
    """
    key = running = down = silent = look = last = None

    def looked(upto, out):
        """The second look, if it is due."""
        nonlocal look, down
        if look is not None and (upto is None or look <= upto):
            if down and silent and running:
                out.append((key, "container_recovered", look, last))
                down = False
            look = None

    def ended(out):
        if key is not None and until_us is not None:
            looked(until_us, out)

    for pdf in batches:
        out = []
        for k, at_us, kind, value in zip(pdf["_key"], pdf["_us"].tolist(), pdf["_kind"].tolist(), pdf["_value"].tolist()):
            if k != key:
                ended(out)
                key, running, down, silent, look, last = k, True, False, False, None, None
            looked(at_us - 1, out)
            if kind == 0:
                running = value == 1
            elif kind == 1:
                silent = False
            else:
                silent, last = True, int(value)
            if down and not silent and running:
                out.append((key, "container_recovered", at_us, last))
                down, look = False, None
            elif silent and not running and not down:
                out.append((key, "container_down", at_us, last))
                down, look = True, at_us + look_us
        yield pd.DataFrame(out, columns=["_key", "type", "_us", "_last"]).astype({"_key": object, "type": object, "_us": "int64", "_last": "int64"})
    out = []
    ended(out)
    yield pd.DataFrame(out, columns=["_key", "type", "_us", "_last"]).astype({"_key": object, "type": object, "_us": "int64", "_last": "int64"})


def state_transitions(df: DataFrame, snapshots: DataFrame, gap: float = fixed.SILENCE_SECONDS, as_of: str | Column | None = None,
                      keys: Sequence[str] = ("ContainerId",), second_look: float = fixed.SECOND_LOOK_SECONDS) -> DataFrame:
    """Down and recovered changes, with the state followed through each silence.

    A key is down once it has been silent for `gap` seconds and does not run: at that moment, or when a snapshot
    (keys, snapshot_ts, state) says so later in the same silence. It recovers `second_look` seconds after that if it runs again by
    then, or else when it logs and runs; logs alone are not enough. After a recovery within a silence it may go down again. A key
    without snapshots counts as running. Each change is told once.
    """
    keys = list(keys)
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    moment = lambda us, kind, value: [us.alias("_us"), F.lit(kind).alias("_kind"), value.cast("bigint").alias("_value")]
    pauses = silences(df, keys, gap, as_of)
    noticed = pauses.select(packed, *moment(micros("last_log") + int(gap * 1_000_000), 2, micros("last_log")))
    resumed = pauses.filter(F.col("until").isNotNull()).select(packed, *moment(micros("until"), 1, F.lit(0)))
    # Only changes of state say something. They are looked for day by day, so that no task sees all snapshots of a key.
    up = F.coalesce(F.col("state") == "running", F.lit(False)).cast("int")
    by_day = Window.partitionBy("_key", F.floor(F.col("_us") / F.lit(86_400_000_000))).orderBy("_us", "_value")
    states = (snapshots.select(packed, *moment(micros("snapshot_ts"), 0, up)).withColumn("_before", F.lag("_value").over(by_day))
              .filter(F.col("_before").isNull() | (F.col("_before") != F.col("_value"))).drop("_before"))
    end = None if as_of is None else df.sparkSession.range(1).select(micros(at(as_of))).first()[0]
    if end is not None:
        states = states.filter(F.col("_us") <= end)
    moments = noticed.unionByName(resumed).unionByName(states)
    look_us = int(second_look * 1_000_000)
    changes = (moments.repartition("_key").sortWithinPartitions("_key", "_us", "_kind", "_value")
               .mapInPandas(lambda batches: _fold_states(batches, look_us, end), "_key string, type string, _us bigint, _last bigint"))
    names = F.from_json("_key", df.select(*keys).schema).alias("_k")
    severity = F.when(F.col("type") == "container_down", "critical").otherwise("info")
    return (changes.select(names, "type", severity.alias("severity"), from_micros(F.col("_us")).alias("at"), from_micros(F.col("_last")).alias("last_log"))
            .select(*[F.col(f"_k.{c}").alias(c) for c in keys], "type", "severity", "at", "last_log"))


def request_floods(acc: DataFrame, per_minute: int = fixed.FLOOD_REQUESTS_PER_MINUTE,
                   cooldown: float | None = fixed.FLOOD_COOLDOWN_SECONDS) -> DataFrame:
    """Clients with too many requests in a minute; with a cooldown, one alert per pause.

    Requests are first combined per path, so the latest path comes from few rows.
    """
    found = (acc.groupBy(F.window("Timestamp", "1 minute").alias("w"), "remote_addr", "path")
             .agg(F.count(F.lit(1)).alias("n"), F.max("Timestamp").alias("seen"))
             .groupBy("w", "remote_addr")
             .agg(F.sum("n").alias("requests"), F.max_by("path", F.struct("seen", "path")).alias("latest_path"))
             .filter(F.col("requests") >= per_minute)
             .select(F.col("w.start").alias("minute"), "remote_addr", "requests", "latest_path"))
    return throttle(found, ["remote_addr"], "minute", cooldown, order=["requests"]) if cooldown else found


WINDOW_US = 60_000_000


def first_request_floods(acc: DataFrame, per_minute: int = fixed.FLOOD_REQUESTS_PER_MINUTE,
                         cooldown: float | None = fixed.FLOOD_COOLDOWN_SECONDS) -> DataFrame:
    """As `request_floods`, but a client's minute starts with its first request: (opened, remote_addr, at, requests, latest_path).

    The request after a minute is over opens the next one, which is a cooldown of a minute over all requests. The
    `per_minute`-th request of a minute and each one after it would be an alert; with a cooldown, one passes per pause.
    Requests of one time go by path. A null client is a client; requests without a time are none.

    A minute reaches into two slots of the clock at most, and a slot sees at most one opened in it. So requests find theirs by client and
    slot: a client with a third of all requests is spread over its minutes.
    """
    client = F.coalesce(F.col("remote_addr"), F.lit("")).alias("client")
    counted = cut_lineage(acc.filter(F.col("Timestamp").isNotNull())
                          .groupBy(client, F.col("remote_addr").isNull().alias("unknown"), micros("Timestamp").alias("us"), "path").agg(F.count(F.lit(1)).alias("n")))
    key = ["client", "unknown"]
    slot = lambda us: F.floor(us / F.lit(WINDOW_US)).cast("bigint")
    mark = F.when(F.col("unknown"), "?").otherwise("=")  # a client's name follows it
    opened = passing_times(counted.select(F.concat(mark, "client").alias("_key"), F.col("us").alias("_us")), WINDOW_US, max(3_600_000_000, 10 * WINDOW_US))
    openers = opened.select(F.expr("substring(_key, 2)").alias("client"), F.col("_key").startswith("?").alias("unknown"), F.col("_us").alias("start"),
                            F.explode(F.array(slot(F.col("_us")), slot(F.col("_us")) + 1)).alias("slot"))
    placed = (counted.withColumn("slot", slot(F.col("us"))).join(openers, [*key, "slot"])
              .filter((F.col("us") >= F.col("start")) & (F.col("us") < F.col("start") + WINDOW_US)))
    so_far = Window.partitionBy(*key, "start").orderBy("us", F.col("path").isNotNull(), "path").rowsBetween(Window.unboundedPreceding, 0)
    found = (placed.withColumn("total", F.sum("n").over(so_far)).filter(F.col("total") >= per_minute)
             .select(from_micros(F.col("start")).alias("opened"), F.when(~F.col("unknown"), F.col("client")).alias("remote_addr"), from_micros(F.col("us")).alias("at"),
                     F.greatest(F.lit(per_minute), F.col("total") - F.col("n") + 1).cast("bigint").alias("requests"), F.col("path").alias("latest_path")))
    return throttle(found, ["remote_addr"], "at", cooldown, order=["requests"]) if cooldown else found


def flood_message(floods: DataFrame) -> DataFrame:
    """Flooding clients as notification rows."""
    message = F.concat(F.lit("High request volume from IP "), "remote_addr", F.lit(": "), F.col("requests").cast("string"),
                       F.lit(" requests/min. Latest path: "), "latest_path")
    return floods.select(F.lit("log_spam").alias("type"), F.lit("critical").alias("severity"),
                         F.lit("Request Spam Detected").alias("title"), message.alias("message"),
                         F.lit("backend").alias("container_id"), F.lit("backend").alias("container_name"),
                         F.col("minute").alias("created_at"))


def transition_message(changes: DataFrame, container: str = "ContainerName") -> DataFrame:
    """Down and recovered changes as notification rows."""
    down = F.col("type") == "container_down"
    last = F.col("last_log").cast("string")
    message = F.when(down, F.concat(F.lit("Container '"), container, F.lit("' has stopped running. Last log: "), last, F.lit("."))
                     ).otherwise(F.concat(F.lit("Container '"), container, F.lit("' is running again. Last log: "), last, F.lit(".")))
    return changes.select("type", "severity", F.when(down, "Container Down").otherwise("Container Recovered").alias("title"),
                          message.alias("message"), F.col(container).alias("container_id"),
                          F.col(container).alias("container_name"), F.col("at").alias("created_at"))


def cleaned(df: DataFrame, columns: Sequence[str] = ("title", "message")) -> DataFrame:
    return df.withColumns({c: clean_text(c) for c in columns})


def notifications(feed: DataFrame, n: int = 200, kind: str | None = None, ownership: DataFrame | None = None,
                  user_id: int | None = None, role: str = "admin") -> DataFrame:
    """Newest notifications with read flag; developers see those of their containers.

    The scope precedes the limit and compares container names.
    """
    rows = feed.filter(F.col("type") == kind) if kind else feed
    if role == "developer":
        own = owned_containers(ownership, user_id).withColumnRenamed("ContainerName", "container_name")
        rows = rows.join(own, "container_name", "left_semi")
    return (cleaned(rows).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
            .select("id", "type", "severity", "title", "message", "container_id", "container_name", "created_at",
                    F.col("read_at").isNotNull().alias("read")))
