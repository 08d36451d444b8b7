"""Deviations on arrival: one keyed state per address instead of earlier batches.

An address's state holds its baseline row, its known values in small buckets, its newest 49
events and its events per day, so a batch reads what it touches and nothing else, and a
thousandth batch costs what a tenth one does.  The first state is loaded from the baseline
tables and the log table.  States of idle addresses time out.  The processor only puts events in
their context; the rules are those of a scan, applied by Spark to what it returns.
"""

import json
import zlib
from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.times import ago, moment, since, until
from ..operators import baseline as B

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "src_ip string, at long, event_id long, threat_type string, severity string, port string, dst string, place string, subnet string"
_PROFILE = ("avg_daily_events double, avg_severity_score double, total_successes long, total_failures long, "
            + ", ".join(f"n_{d} long" for d in B.DIMENSIONS) + ", hours_mask long, weekdays_mask long, last_day string")
_PROFILE_TYPES = [tuple(f.split()) for f in _PROFILE.split(", ")]
_PROFILE_NAMES = [n for n, _ in _PROFILE_TYPES]
_LOOKED = {"ports": "port", "subnets": "subnet", "countries": "place", "threat_types": "threat_type"}
_CONTEXT = (_EVENT + ", recent_dsts long, recent_gaps long, avg_gap double, std_gap double, today long, "
            + ", ".join(f"new_{d} boolean" for d in B.LOOKED_UP) + ", " + _PROFILE)
_CONTEXT_NAMES = [f.split()[0] for f in _CONTEXT.split(", ")]
GAPS = 19
_DAY = 86_400_000_000


def in_context(times: np.ndarray, dsts: list, new: int) -> pd.DataFrame:
    """Of the ``new`` last ones of events in order: different destinations of the last 50
    events, and count, mean and deviation of the last 19 gaps."""
    window, counts, distinct = deque(), Counter(), []
    for dst in dsts:
        window.append(dst)
        counts[dst] += 1
        if len(window) > B.CONTEXT + 1:
            old = window.popleft()
            counts[old] -= 1
            if not counts[old]:
                del counts[old]
        distinct.append(len(counts) - ("" in counts))
    gaps = np.concatenate([np.full(GAPS, np.nan), np.diff(times / 1e6)])
    frames = np.lib.stride_tricks.sliding_window_view(gaps, GAPS)[-len(times):]
    have = (~np.isnan(frames)).sum(axis=1)
    mean = np.where(have > 0, np.nansum(frames, axis=1) / np.maximum(have, 1), np.nan)
    apart = np.nansum((frames - mean[:, None]) ** 2, axis=1)
    std = np.where(have > 1, np.sqrt(apart / np.maximum(have - 1, 1)), 0.0)
    return pd.DataFrame({"recent_dsts": distinct, "recent_gaps": have, "avg_gap": mean, "std_gap": std}).iloc[len(times) - new:]


class Watch(StatefulProcessor):
    """One address's events, put in the context of its state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.profile = handle.getValueState("profile", _PROFILE)
        self.known = handle.getMapState("known", "dimension string, bucket long", "names string")
        self.recent = handle.getListState("recent", "at long, dst string", self.idle_ms)
        self.days = handle.getMapState("days", "day long", "events long", self.idle_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """May come in several parts."""
        recent = []
        for r in initialState.itertuples():
            if r.kind == "profile":
                self.profile.update(tuple(_plain(getattr(r, n), kind) for n, kind in _PROFILE_TYPES))
            elif r.kind == "values":
                self.known.updateValue((r.dimension, int(r.at)), (r.value,))
            elif r.kind == "day":
                self.days.updateValue((int(r.at),), (int(r.events),))
            else:
                recent.append((int(r.at), int(r.events), r.value))
        if recent:
            self.recent.put([*self.recent.get(), *[(at, dst) for at, _, dst in sorted(recent)]])

    def _unknown(self, dimension, values, size):
        buckets = {}
        for value in values:
            buckets.setdefault(zlib.crc32(value.encode()) % buckets_of(size), []).append(value)
        found = set()
        for bucket, names in buckets.items():
            held = self.known.getValue((dimension, bucket))
            found.update(names if held is None else set(names) - set(json.loads(held[0])))
        return found

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], kind="stable", ignore_index=True)
        before = list(self.recent.get())
        times = np.concatenate([np.array([b[0] for b in before], np.int64), new["at"].to_numpy(np.int64)])
        dsts = [b[1] for b in before] + new["dst"].fillna("").tolist()
        first = np.argsort(times, kind="stable")             # a late event takes its place among the newest
        order = {int(place): spot for spot, place in enumerate(first)}
        context = in_context(times[first], [dsts[i] for i in first], len(times))
        spots = [order[len(before) + i] for i in range(len(new))]
        kept = first[-B.CONTEXT:]
        self.recent.put([(int(times[i]), dsts[i]) for i in kept])
        day = new["at"] // _DAY
        today = new.groupby(day).cumcount() + 1
        for number, count in day.value_counts().items():
            earlier = (self.days.getValue((int(number),)) or (0,))[0]
            today = today.where(day != number, today + earlier)
            self.days.updateValue((int(number),), (int(earlier + count),))
        profile = self.profile.get()
        if profile is None:
            return
        known = dict(zip(_PROFILE_NAMES, profile))
        out = pd.concat([new, context.iloc[spots].reset_index(drop=True)], axis=1)
        out["today"] = today
        for dimension, column in _LOOKED.items():
            unknown = self._unknown(dimension, new[column].dropna().unique(), known[f"n_{dimension}"])
            out[f"new_{dimension}"] = new[column].isin(unknown)
        yield out.assign(**known)[_CONTEXT_NAMES]

    def close(self) -> None:
        pass


def buckets_of(values: int) -> int:
    """In how many buckets an address's values of a dimension lie, 64 in each on the average."""
    return max(1, values // 64)


def _plain(value, kind):
    """A cell of a pandas frame as its column's type (pandas turns longs with gaps into doubles)."""
    if value is None or value != value:
        return None
    return {"long": int, "double": float}.get(kind, str)(value)


def first_state(base: B.Baselines, logs: DataFrame | None = None, as_of=None, hours: int = 0) -> DataFrame:
    """Rows of all addresses' first states: baselines and, of ``logs``, what came before
    the stream's first event (``hours`` before ``as_of``)."""
    empty = {"kind": "string", "dimension": "string", "value": "string", "at": "long", "events": "long",
             **dict(_PROFILE_TYPES)}
    def rows(df, kind, **found):
        cells = {"kind": F.lit(kind), **found}
        return df.select("src_ip", *[cells.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()])
    profiles = base.addresses.withColumnRenamed("ip", "src_ip")
    sizes = F.expr("CASE dimension " + " ".join(f"WHEN '{d}' THEN n_{d}" for d in B.LOOKED_UP) + " END")
    bucket = F.pmod(F.crc32(c("value").cast("binary")), F.greatest(F.lit(1), F.expr("size div 64")))
    values = (base.values.where(c("dimension").isin(B.LOOKED_UP)).withColumnRenamed("ip", "src_ip")
              .join(profiles.select("src_ip", *[f"n_{d}" for d in B.LOOKED_UP]), "src_ip").withColumn("size", sizes)
              .groupBy("src_ip", "dimension", bucket.alias("bucket")).agg(F.to_json(F.collect_list("value")).alias("names")))
    out = rows(profiles, "profile", **{n: c(n) for n in _PROFILE_NAMES}).unionByName(
        rows(values, "values", dimension=c("dimension"), value=c("names"), at=c("bucket")))
    if logs is None:
        return out
    start = ago(moment(as_of, logs), hours=hours)
    older = until(logs, start)
    tie = c("event_id") if "event_id" in logs.columns else F.lit(0)
    newest = B.newest_rows(older, B.CONTEXT).select("src_ip", F.unix_micros("ts").alias("m"), F.coalesce(B._known("dst_ip"), F.lit("")).alias("d"),
                                                    tie.alias("t"))
    days = B.day_counts(since(older, F.date_trunc("day", start)))
    return (out.unionByName(rows(newest, "recent", value=c("d"), at=c("m"), events=c("t")))
            .unionByName(rows(days, "day", at=F.datediff("day", F.lit("1970-01-01").cast("date")), events=c("events"))))


def deviations_on_arrival(stream: DataFrame, base: B.Baselines, before: DataFrame | None = None, as_of=None,
                          hours: int = 0, idle: str = "7 days") -> DataFrame:
    """Streamed log rows to deviations (ip, ts, event_id, type, severity, detail), each event
    judged when it arrives.  ``before`` is the log table that ends where the stream begins.
    What is remembered of an address's latest events is dropped after ``idle``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")     # nothing is due without events
    shown = B.shown_values(stream)
    tie = c("event_id").cast("long") if "event_id" in stream.columns else F.lit(0).cast("long")
    events = shown.select("src_ip", F.unix_micros("ts").alias("at"), tie.alias("event_id"), "threat_type", "severity",
                          "port", "dst", "place", "subnet")
    state = first_state(base, before, as_of, hours)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    context = events.groupBy("src_ip").transformWithStateInPandas(
        Watch(idle_ms), _CONTEXT, "Append", "ProcessingTime", initialState=state.groupBy("src_ip"))
    judged = context.withColumns({"ts": F.timestamp_micros("at"), "last_day": c("last_day").cast("date")})
    found = B.raised(B.judged_values(judged), ["ts", "event_id"], {d: f"new_{d}" for d in B.LOOKED_UP})
    return found.select("ip", "ts", "event_id", "type", "severity", "detail")
