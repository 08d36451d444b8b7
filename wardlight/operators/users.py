"""User and host risk: own baseline against the last day, and peer outliers."""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, moment, since
from .counts import entity_aggregates
from .sequence import top_per

c = F.col
SETS = {"agent": "hosts", "country": "countries", "dst_port": "ports", "src_ip": "srcs"}


def peer_outliers(rows, least_z=2.5) -> DataFrame:
    """Entities far above their population on any of six features.

    Mean and deviation come from one aggregate read as a scalar subquery."""
    names = X.PEER_FEATURES
    stats = rows.select(F.struct(row_count("n"), *[F.avg(f).alias(f"m_{f}") for f in names],
                                 *[F.stddev_pop(f).alias(f"s_{f}") for f in names]).alias("s")).scalar()
    spread = lambda f: F.when(c("_s")[f"s_{f}"] > 1e-9, (c(f) - c("_s")[f"m_{f}"]) / c("_s")[f"s_{f}"])
    rated = (C.with_one_value(rows, "_s", stats).where(c("_s")["n"] >= 5)
             .select("entity", "_s", *names, *[spread(f).alias(f"z_{f}") for f in names]))
    top = F.greatest(F.lit(0.0), *[c(f"z_{f}") for f in names])
    entry = lambda f: F.when(c(f"z_{f}") >= least_z, F.struct(
        (-c(f"z_{f}")).alias("minus"), F.lit(f).alias("feature"), c(f).cast("double").alias("value"),
        F.bround(c("_s")[f"m_{f}"], 2).alias("peer_mean")))
    hits = F.array_sort(F.filter(F.array(*[entry(f) for f in names]), lambda d: d.isNotNull()))
    drivers = F.transform(hits, lambda d: F.struct(d["feature"].alias("feature"), d["value"].alias("value"),
                                                   F.bround(-d["minus"], 2).alias("z"), d["peer_mean"].alias("peer_mean")))
    return (rated.withColumn("top", top).where(c("top") >= least_z)
            .select("entity", F.bround("top", 2).alias("max_z"),
                    F.when(c("top") >= least_z * 1.6, "high").otherwise("medium").alias("severity"),
                    drivers.alias("drivers")))


def entity_outliers(logs, column="username") -> DataFrame:
    """Mean and deviation are those of all entities."""
    return peer_outliers(entity_aggregates(logs, column))


def people(logs) -> DataFrame:
    """Rows of named persons: no machine accounts, no host names as users."""
    return logs.where((c("username") != "") & ~c("username").endswith("$")
                      & (F.lower("username") != F.lower("agent")))


def user_scalars(rows, day_start, least=5) -> DataFrame:
    new = c("ts") >= day_start
    fails = c("threat_type").isin(X.FAILURE_TYPES)
    return rows.groupBy("username").agg(
        F.count_if(~new).alias("ev_base"), F.count_if(new).alias("ev_24"),
        F.count_if(fails & new).alias("fails_24"),
        F.count_if((c("threat_type") == "login_success") & new).alias("success_24"),
        F.count_if(c("severity").isin("high", "critical") & new).alias("crit_24"),
        F.max("ts").alias("last_ts")).where(c("ev_base") + c("ev_24") >= least)


def user_values(rows, day_start) -> DataFrame:
    """Long form (username, dimension, value, base, day): how often each host,
    country, port, source, hour and date of a user occurs before and within the
    last day.  Counted per combination first, then unrolled."""
    new = c("ts") >= day_start
    keys = {name: F.nullif(column, F.lit("")) for column, name in SETS.items()}
    keys |= {"hours": F.hour("ts").cast("string"), "dates": F.date_format("ts", "yyyy-MM-dd")}
    combos = rows.groupBy("username", *[k.alias(n) for n, k in keys.items()]).agg(
        F.count_if(~new).alias("base"), F.count_if(new).alias("day"))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c(n).alias("value")) for n in keys])
    return (combos.select("username", F.explode(pairs).alias("p"), "base", "day")
            .select("username", "p.dimension", "p.value", "base", "day").where("value is not null")
            .groupBy("username", "dimension", "value").agg(F.sum("base").alias("base"), F.sum("day").alias("day")))


def new_values(values) -> DataFrame:
    """Values of the last day that a user never had before, from the long form of
    :func:`user_values`, so all known values count."""
    return values.where((c("day") > 0) & (c("base") == 0))


def user_profiles(logs, days=30, as_of=None, least=5, listed=None) -> DataFrame:
    """Per user: counts, exact numbers of old, current and new values per dimension,
    the values of each in order (for display; at most ``listed``), hour maps and the
    last seven days."""
    now = moment(as_of, logs)
    start = ago(now, days=1)
    rows = people(since(logs, ago(now, days=days)))
    values = user_values(rows, start)
    scalars = user_scalars(rows, start, least)
    in_dim = lambda d: c("dimension") == d
    sums = []
    for name in SETS.values():
        sums += [F.count_if(in_dim(name) & (c("base") > 0)).alias(f"{name}_base_n"),
                 F.count_if(in_dim(name) & (c("day") > 0)).alias(f"{name}_24_n"),
                 F.count_if(in_dim(name) & (c("day") > 0) & (c("base") == 0)).alias(f"{name}_new_n")]
    counted = values.groupBy("username").agg(*sums)
    shown = []
    for name in SETS.values():
        for side, flag in (("base", "base"), ("24", "day")):
            best = top_per(values.where(in_dim(name) & (c(flag) > 0)), ["username"], ["value"], listed)
            shown.append(best.groupBy("username").agg(F.array_sort(F.collect_list("value")).alias(f"{name}_{side}")))
    as_map = lambda cond, col: F.map_from_entries(F.array_sort(F.collect_list(F.when(cond, F.struct("value", col)))))
    week = F.date_format(ago(now, days=7), "yyyy-MM-dd")
    maps = values.where("dimension in ('hours', 'dates')").withColumn("both", c("base") + c("day")) \
        .groupBy("username").agg(
            as_map(in_dim("hours") & (c("base") > 0), "base").alias("hours_base"),
            as_map(in_dim("hours") & (c("day") > 0), "day").alias("hours_24"),
            as_map(in_dim("dates") & (c("value") >= week), "both").alias("days_7"))
    out = scalars.join(counted, "username").join(maps, "username")
    for part in shown:
        out = out.join(part, "username", "left")
    return out


def off_hours(values) -> DataFrame:
    """Busiest hour of the last day outside the hours that hold at least 2 % of the
    baseline (needs three events and a non-empty usual set)."""
    hours = values.where("dimension = 'hours'")
    total = hours.groupBy("username").agg(F.sum("base").alias("total"))
    tagged = hours.join(total, "username").withColumn(
        "usual", (c("base") > 0) & (c("base") / F.greatest(c("total"), F.lit(1)) >= 0.02))
    hour = c("value").cast("int")
    return tagged.groupBy("username").agg(
        F.max_by(hour, F.when(~c("usual") & (c("day") >= 3), F.struct("day", (-hour).alias("h")))).alias("odd_hour"),
        F.max(F.when(~c("usual") & (c("day") >= 3), c("day"))).alias("odd_events"),
        F.min(F.when(c("usual"), hour)).alias("usual_from"), F.max(F.when(c("usual"), hour)).alias("usual_to"))


def user_risk(logs, travel=None, days=30, as_of=None) -> DataFrame:
    """Eight additive drivers per user, capped at 100, with a level.  ``travel`` are
    impossible-travel findings."""
    now = moment(as_of, logs)
    start = ago(now, days=1)
    rows = people(since(logs, ago(now, days=days)))
    values = user_values(rows, start)
    wanted = {"hosts": ("base", "new"), "countries": ("base", "new", "24"), "ports": ("24",), "srcs": ("24",)}
    conds = {"base": c("base") > 0, "24": c("day") > 0, "new": (c("day") > 0) & (c("base") == 0)}
    sums = [F.count_if((c("dimension") == d) & conds[k]).alias(f"{d}_{k}") for d, ks in wanted.items() for k in ks]
    users = (user_scalars(rows, start).join(values.groupBy("username").agg(*sums), "username")
             .join(off_hours(values), "username", "left"))
    peers = peer_outliers(users.select(
        c("username").alias("entity"), c("ev_24").alias("events"), c("crit_24").alias("crit"),
        c("ports_24").alias("dsts"), c("ports_24").alias("ports"), c("countries_24").alias("countries"),
        c("srcs_24").alias("srcs")))
    users = users.join(peers.select(c("entity").alias("username"), c("max_z").alias("peer_z")), "username", "left")
    if travel is None:
        users = users.withColumn("travels", F.lit(0))
    else:
        hops = travel.groupBy("username").agg(row_count("travels"))
        users = users.join(hops, "username", "left")
    mature = c("ev_base") >= 50
    daily = c("ev_base") / F.lit(max(1, days - 1))
    two = lambda n, pts: F.least(c(n), F.lit(2)) * pts
    drivers = [
        ("new_host", mature & (c("hosts_base") > 0) & (c("hosts_new") > 0), two("hosts_new", 22)),
        ("new_country", mature & (c("countries_base") > 0) & (c("countries_new") > 0), two("countries_new", 28)),
        ("off_hours", mature & c("odd_hour").isNotNull() & c("usual_from").isNotNull(), F.lit(18)),
        ("volume_spike", mature & (daily >= 2) & (c("ev_24") >= 30) & (c("ev_24") / daily >= 5), F.lit(15)),
        ("ato_pattern", (c("fails_24") >= 20) & (c("success_24") >= 1), F.lit(30)),
        ("fail_burst", (c("fails_24") >= 20) & (c("success_24") == 0), F.lit(15)),
        ("critical_hits", c("crit_24") > 0, F.least(F.lit(20), c("crit_24") * 4)),
        ("impossible_travel", F.coalesce("travels", F.lit(0)) > 0, F.lit(35)),
        ("peer_outlier", c("peer_z").isNotNull(), F.lit(12)),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct((-points.cast("long")).alias("minus"), F.lit(kind).alias("kind")))
                               for kind, test, points in drivers]), lambda d: d.isNotNull())
    total = F.aggregate("found", F.lit(0).cast("long"), lambda acc, d: acc - d["minus"])
    scored = (users.withColumn("found", F.array_sort(found)).where(F.size("found") > 0)
              .withColumn("score", F.least(F.lit(100), total)))
    return scored.select(
        "username", "score", C.band(c("score"), C.USER_BANDS, "low").alias("level"),
        F.transform("found", lambda d: F.struct(d["kind"].alias("kind"), (-d["minus"]).alias("points"))).alias("drivers"),
        "ev_24", "ev_base", mature.alias("mature"), "odd_hour", "usual_from", "usual_to", "peer_z", "last_ts")


def user_names(logs, days=30, as_of=None, keep=6) -> DataFrame:
    """First hosts and countries of every user, over baseline and last day."""
    now = moment(as_of, logs)
    values = user_values(people(since(logs, ago(now, days=days))), ago(now, days=1))
    best = top_per(values.where("dimension in ('hosts', 'countries')"), ["username", "dimension"], ["value"], keep)
    pick = lambda d: F.array_sort(F.collect_list(F.when(c("dimension") == d, c("value"))))
    return best.groupBy("username").agg(pick("hosts").alias("hosts"), pick("countries").alias("countries"))


PROFILE_DIMENSIONS = {"country": "country", "agent": "host", "src_ip": "src_ip", "threat_type": "threat_type",
                      "severity": "severity", "rule": "rule", "rule_id": "rule_id", "dst_port": "dst_port"}


def entity_values(logs, column, keep=10) -> DataFrame:
    """Long form (entity, dimension, value, events): busiest values of an entity
    (all threat types and severities, ``keep`` of the others)."""
    combos = logs.where(c(column) != "").groupBy(c(column).alias("entity"), *[
        F.trim(k).alias(f"d_{k}") for k in PROFILE_DIMENSIONS]).agg(row_count("events"))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c(f"d_{k}").alias("value"))
                      for k, n in PROFILE_DIMENSIONS.items()])
    per = (combos.select("entity", F.explode(pairs).alias("p"), "events")
           .select("entity", "p.dimension", "p.value", "events").where("value <> ''")
           .groupBy("entity", "dimension", "value").agg(F.sum("events").alias("events")))
    ranked = top_per(per.where("dimension not in ('threat_type', 'severity')"), ["entity", "dimension"],
                     [F.desc("events"), "value"], keep)
    return ranked.unionByName(per.where("dimension in ('threat_type', 'severity')"))


def entity_profiles(logs, column="username", keep=10) -> DataFrame:
    """One row per entity: totals, firewall outcome, origin and value maps."""
    base = logs.where(c(column) != "").groupBy(c(column).alias("entity")).agg(
        row_count("total_events"), F.count_if(C.is_allowed(c("action"))).alias("allowed"),
        F.count_if(C.is_blocked(c("action"))).alias("blocked"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    values = entity_values(logs, column, keep)
    names = list(PROFILE_DIMENSIONS.values())
    # `collect_list` holds at most `keep` entries per entity, or the known types
    maps = values.groupBy("entity").pivot("dimension", names).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "events")))))
    lead = values.groupBy("entity").pivot("dimension", ["host", "country", "src_ip"]).agg(
        F.min_by("value", F.struct((-c("events")).alias("minus"), "value"))) \
        .select("entity", c("host").alias("top_host"), c("country").alias("top_country"), c("src_ip").alias("top_src"))
    origin = (F.when(c("top_host").isNotNull(), F.concat(
        F.lit("host "), c("top_host"), F.coalesce(F.concat(F.lit(" ("), c("top_country"), F.lit(")")), F.lit(""))))
        .when(c("top_country").isNotNull() | c("top_src").isNotNull(), F.concat(
            F.lit("network origin "), F.coalesce("top_src", F.lit("?")), F.lit(" in "),
            F.coalesce("top_country", F.lit("unknown country")))).otherwise("unknown"))
    return (base.join(maps, "entity", "left").join(lead, "entity", "left").withColumn("origin", origin)
            .drop("top_host", "top_country", "top_src"))
