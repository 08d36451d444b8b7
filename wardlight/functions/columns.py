"""Row-level expressions.  Every function returns a Column, so the work stays
inside generated code and unused results are pruned by the optimizer."""

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed as X


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def _any_word(text: Column, words) -> Column:
    """True when ``text`` holds any of the words as a plain substring."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_group(text: Column, groups, otherwise: Column) -> Column:
    chain = None
    for name, words in groups:
        test = _any_word(text, words)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(otherwise)


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def row_count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def with_one_value(df, name: str, value: Column):
    """Adds a scalar subquery's value as a column that is worked out once.  Going
    through a one-element explode keeps the optimizer from copying the subquery into
    every expression that uses the column."""
    return df.withColumn(name, F.explode(F.array(value)))


# --- plain picks ----------------------------------------------------------

def filled(value: Column) -> Column:
    """null for null, blank and the word None."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("None"))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[filled(v) for v in values], F.lit(""))


def event_time(text: Column, fallback: Column | None = None) -> Column:
    """Parses ``Z``, ``+0000``, ``+00:00`` and zone-less times as UTC."""
    return F.coalesce(F.trim(text).try_cast("timestamp"),
                      F.current_timestamp() if fallback is None else fallback)


def source_address(columns) -> Column:
    """First usable address among the candidate fields that exist; else null."""
    present = [f for f in X.SOURCE_IP_FIELDS if f in columns]
    if not present:
        return F.lit(None).cast("string")
    usable = lambda c: F.when(~F.lower(F.trim(c)).isin(X.NO_IP_WORDS), c)
    return F.coalesce(*[usable(F.col(f"`{f}`")) for f in present])


def whole(text: Column) -> Column:
    """Integer part of a number written as text; 0 when it is not a number."""
    return F.coalesce(text.try_cast("double").try_cast("long"), F.lit(0))


# --- severity and threat type -----------------------------------------------

def band(score: Column, bounds, lowest: str) -> Column:
    """``band(s, [(80, 'critical'), (60, 'high')], 'low')``, highest first."""
    chain = None
    for limit, name in bounds:
        chain = F.when(score >= limit, name) if chain is None else chain.when(score >= limit, name)
    return chain.otherwise(lowest)


RISK_BANDS = [(80, "critical"), (60, "high"), (35, "medium")]
ENTITY_BANDS = [(80, "critical"), (55, "high"), (30, "medium")]
USER_BANDS = [(70, "critical"), (45, "high"), (25, "medium")]
VERDICT_BANDS = [(70, "malicious"), (40, "suspicious"), (15, "watch")]
GRADE_BANDS = [(80, "A"), (65, "B"), (50, "C"), (35, "D")]


def severity_of_level(level: Column) -> Column:
    return band(level, [(12, "critical"), (8, "high"), (4, "medium")], "low")


def severity_rank(severity: Column) -> Column:
    """low 0 … critical 3; anything else 0."""
    return F.coalesce(_map({s: i for i, s in enumerate(X.SEVERITIES)})[severity], F.lit(0))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, X.SEVERITIES)), (rank + 1).cast("int"))


def severity_points(severity: Column) -> Column:
    """1 for low and unknown words up to 4 for critical."""
    return severity_rank(severity) + 1


def risk_weight(severity: Column) -> Column:
    return F.coalesce(_map(X.RISK_WEIGHTS)[severity], F.lit(X.RISK_WEIGHT_OTHER))


def stream_threat(groups: Column, description: Column, pci: Column) -> Column:
    return threat_of_words(_joined(groups, description, pci))


def threat_of_words(words: Column) -> Column:
    return _first_group(words, X.STREAM_THREAT_WORDS, F.lit("unknown"))


def flat_class(text: Column, level: Column) -> Column:
    """Struct (threat_type, severity) for a flat row: a success is told from a
    failure first, failures are split by protocol, other intents follow."""
    lvl = F.lower(level)
    base = F.when(lvl.rlike(r"^[0-9]+$"), severity_of_level(lvl.try_cast("long"))) \
        .otherwise(F.coalesce(_map(X.SEVERITY_WORDS)[lvl], F.lit("low")))
    at_least = lambda floor: severity_name(
        F.greatest(severity_rank(base), F.lit(X.SEVERITIES.index(floor))))
    verdict = lambda kind, severity: F.struct(F.lit(kind).alias("threat_type"),
                                              severity.alias("severity"))
    has = lambda words: _any_word(text, words)
    failed = has(X.FLAT_FAILURE_WORDS)
    chain = F.when(has(X.FLAT_SUCCESS_WORDS), verdict("login_success", base))
    for kind, words in [("ssh_bruteforce", X.FLAT_SSH_WORDS), ("vpn_bruteforce", X.FLAT_VPN_WORDS),
                        ("rdp_relay", X.FLAT_RDP_WORDS)]:
        chain = chain.when(failed & has(words), verdict(kind, at_least("high")))
    chain = (chain.when(failed, verdict("brute_force", at_least("high")))
             .when(has(X.FLAT_RDP_WORDS), verdict("rdp_relay", at_least("high"))))
    for kind, words, floor in X.FLAT_INTENTS:
        chain = chain.when(has(words), verdict(kind, at_least(floor) if floor else base))
    return (chain.when(has(X.FLAT_POLICY_WORDS), verdict("policy_violation", F.lit("low")))
            .otherwise(verdict("unknown", base)))


def flat_text(fields) -> Column:
    return _joined(*fields)


# --- addresses ---------------------------------------------------------------

def is_internal(ip: Column) -> Column:
    return ip.rlike(X.INTERNAL_PATTERN)


def subnet24(ip: Column, otherwise: Column | None = None) -> Column:
    """First three parts of a four-part address; else blank (or ``otherwise``)."""
    return F.when(F.length(F.regexp_replace(ip, "[^.]", "")) == 3, F.substring_index(ip, ".", 3)) \
        .otherwise(F.lit("") if otherwise is None else otherwise)


def has_prefix(ip: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in prefixes])


def is_known_bad(ip: Column) -> Column:
    return has_prefix(ip, X.KNOWN_BAD_PREFIXES)


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a bigint; null for anything else."""
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long")
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def is_sensitive_port(port: Column) -> Column:
    return port.isin(list(X.SENSITIVE_PORTS))


def sensitive_service(port: Column) -> Column:
    return F.coalesce(_map(X.SENSITIVE_PORTS)[port], F.lit(""))


def service_name(port: Column) -> Column:
    return F.coalesce(_map(X.SERVICE_PORTS)[port], F.lit(""))


def is_allowed(action: Column, exact_case: bool = False) -> Column:
    return (action if exact_case else F.lower(action)).isin(X.ALLOWED_ACTIONS)


def is_blocked(action: Column, exact_case: bool = False) -> Column:
    return (action if exact_case else F.lower(action)).isin(X.BLOCKED_ACTIONS)


def segment_label(dst: Column) -> Column:
    """Network segment of an internal destination; null for outside ones."""
    first = F.split_part(dst, F.lit("."), F.lit(1))
    second = F.split_part(dst, F.lit("."), F.lit(2))
    second = F.when(second.rlike(r"^[0-9]+$"), second).otherwise("0")
    number = second.try_cast("long").cast("string")
    return (F.when(~dst.contains("."), F.lit(None))
            .when(first == "10", F.coalesce(_map(X.SEGMENTS_10)[number],
                                            F.concat(F.lit("Internal Segment (10."), second,
                                                     F.lit(".x.x)"))))
            .when(first.isin("172", "192"), "Internal Network"))


# --- values kept in the original alert ---------------------------------------

def raw_text(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path), F.lit(""))


def destination_name(url: Column, raw: Column) -> Column:
    """Web address, host or looked-up name the event is about."""
    paths = ["$.data.url", "$.data.hostname", "$.data.dstname",
             "$.data.win.eventdata.queryName"]
    return F.coalesce(F.nullif(url, F.lit("")),
                      *[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths], F.lit(""))


def raw_process(raw: Column) -> dict[str, Column]:
    """Process and policy fields; the alert text is parsed once per row."""
    v = F.try_parse_json(raw)
    at = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    win = "$.data.win.eventdata."
    logged = F.regexp_extract(at("$.full_log"), X.POLICY_PATTERN, 1)
    return {
        "proc_image_r": at(win + "image"), "proc_cmdline_r": at(win + "commandLine"),
        "proc_parent_r": at(win + "parentImage"),
        "proc_parent_cmdline_r": at(win + "parentCommandLine"),
        "proc_user_r": at(win + "user"), "proc_parent_user_r": at(win + "parentUser"),
        "proc_integrity_r": at(win + "integrityLevel"), "proc_hashes_r": at(win + "hashes"),
        "policy_id_r": F.coalesce(F.nullif(at("$.data.policyid"), F.lit("")), logged),
        "policy_uuid_r": at("$.data.poluuid"),
        "policy_type_r": F.coalesce(F.nullif(at("$.data.policytype"), F.lit("")),
                                    at("$.data.subtype")),
    }


def policy_of(policy_id: Column, raw: Column, full_log: Column) -> Column:
    """Policy column, else the alert's own field, else the id in the log line."""
    return F.coalesce(F.nullif(policy_id, F.lit("")),
                      F.nullif(F.get_json_object(raw, "$.data.policyid"), F.lit("")),
                      F.regexp_extract(full_log, X.POLICY_PATTERN, 1))


def policy_before_cut(policy_id: Column, full_log: Column, longest: int) -> Column:
    """The id of a log line that is about to be cut, where the policy column has none."""
    return F.when((policy_id == "") & (F.length(full_log) > longest), F.regexp_extract(full_log, X.POLICY_PATTERN, 1)).otherwise(policy_id)


def is_firewall_row(decoder: Column, groups: Column, rule: Column, location: Column) -> Column:
    has = lambda c, w: F.lower(c).contains(w)
    return (has(decoder, "fortigate") | has(decoder, "firewall") | has(groups, "firewall")
            | has(rule, "fortigate") | has(location, "fortigate"))


# --- readable facts about an event -------------------------------------------

def log_source(groups: Column, rule: Column, agent: Column, mitre: Column, action: Column) -> Column:
    fallback = F.when(F.trim(action) != "", "firewall").otherwise("endpoint")
    return _first_group(_joined(groups, rule, agent, mitre), X.LOG_SOURCE_WORDS, fallback)


def threat_label(threat: Column, rule: Column, groups: Column) -> Column:
    named = (F.trim(threat) != "") & (F.lower(F.trim(threat)) != "unknown")
    bare = F.trim(rule)
    fallback = F.when(bare != "", F.concat(F.lit("Uncategorized: "), F.substring(bare, 1, 48))) \
        .otherwise("Other Activity")
    return F.when(named, F.initcap(F.replace(F.trim(threat), F.lit("_"), F.lit(" ")))) \
        .otherwise(_first_group(_joined(rule, groups), X.THREAT_LABEL_WORDS, fallback))


def is_machine_account(user: Column, agent: Column) -> Column:
    u = F.trim(user)
    host = F.lower(F.trim(agent))
    return (u != "") & (u.endswith("$") | ((agent != "") & (F.lower(u) == host)))


def person(username: Column, target_user: Column, agent: Column) -> Column:
    """The first of the two accounts that is a person; null when neither is."""
    real = lambda c: F.when((F.trim(c) != "") & ~is_machine_account(c, agent), F.trim(c))
    return F.coalesce(real(username), real(target_user))


def entity_of(username: Column, target_user: Column, agent: Column, ip: Column) -> Column:
    """Struct (id, type, label, stable, has_user): person, else host, else address."""
    user = person(username, target_user, agent)
    host = F.trim(agent)
    made = lambda prefix, kind, label, stable, known: F.struct(
        F.concat(F.lit(prefix), label).alias("id"), kind.alias("type"), label.alias("label"),
        F.lit(stable).alias("stable"), F.lit(known).alias("has_user"))
    host_kind = F.when(host.rlike(X.SENSOR_PATTERN), "sensor").otherwise("host")
    return (F.when(user.isNotNull(), made("user:", F.lit("user"), user, True, True))
            .when(host != "", made("host:", host_kind, host, True, False))
            .otherwise(made("ip:", F.lit("ip"), F.trim(ip), False, False)))


EVENT_KEY_FIELDS = ["src_ip", "dst_ip", "dst_port", "rule_id", "rule_level",
                    "threat_type", "agent", "username", "rule"]


def event_key(ts: Column, *fields: Column) -> Column:
    """Stable id that an analyst can quote for one event."""
    text = F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                       *[f.cast("string") for f in fields])
    return F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def enriched(df):
    """All readable facts of an event; callers select what they need."""
    c = F.col
    pick = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.trim(b))
    proc = raw_process(c("raw"))
    return df.select(
        "*",
        log_source(c("rule_groups"), c("rule"), c("agent"), c("mitre"), c("action")).alias("log_source"),
        threat_label(c("threat_type"), c("rule"), c("rule_groups")).alias("threat_label"),
        entity_of(c("username"), c("target_user"), c("agent"), c("src_ip")).alias("entity"),
        F.when(is_machine_account(c("username"), c("agent")), "").otherwise(c("username")).alias("user_display"),
        event_key(c("ts"), *[c(f) for f in EVENT_KEY_FIELDS]).alias("event_key"),
        destination_name(c("url"), c("raw")).alias("destination"),
        raw_text(c("raw"), "$.id").alias("alert_id"),
        raw_text(c("raw"), "$.timestamp").alias("ts_raw"),
        pick(proc["proc_image_r"], c("proc_image")).alias("process"),
        pick(proc["proc_cmdline_r"], c("proc_cmdline")).alias("command_line"),
        pick(proc["proc_parent_r"], c("proc_parent")).alias("parent_process"),
        proc["proc_parent_cmdline_r"].alias("parent_command_line"),
        proc["proc_user_r"].alias("process_user"),
        proc["proc_parent_user_r"].alias("parent_user"),
        proc["proc_integrity_r"].alias("integrity"),
        proc["proc_hashes_r"].alias("hashes"),
        proc["policy_id_r"].alias("policy"),
        proc["policy_uuid_r"].alias("policy_uuid"),
        proc["policy_type_r"].alias("policy_type"),
    )


# --- places --------------------------------------------------------------------

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def place_of(lat: Column, lon: Column, country: Column) -> Column:
    """Struct (lat, lon): exact coordinates, else the country's centre, else null."""
    at = lambda i: _map({k: v[i] for k, v in X.COUNTRY_CENTROIDS.items()})[F.trim(country)]
    exact = (F.abs(lat) > 0.01) | (F.abs(lon) > 0.01)
    made = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.when(exact, made(lat, lon)).when(at(0).isNotNull(), made(at(0), at(1)))


# --- attack knowledge -------------------------------------------------------------

def tactic_rank(tactic: Column) -> Column:
    return F.coalesce(_map({t: i for i, t in enumerate(X.TACTICS)})[F.trim(tactic)],
                      F.lit(len(X.TACTICS)))


def phase_of(tactic: Column) -> Column:
    return F.coalesce(_map(X.PHASE_OF_TACTIC)[F.trim(tactic)], F.lit(""))


def technique_base(tid: Column) -> Column:
    """Known technique id of an id or sub-technique id; null when unknown."""
    base = F.substring_index(F.upper(F.trim(tid)), ".", 1)
    return F.when(base.isin([t[0] for t in X.TECHNIQUES]), base)


def technique_name(tid: Column) -> Column:
    return _map({t[0]: t[1] for t in X.TECHNIQUES})[tid]


def technique_tactic(tid: Column) -> Column:
    return _map({t[0]: t[2] for t in X.TECHNIQUES})[tid]


def threat_technique(threat: Column) -> Column:
    return _map(X.TECHNIQUE_OF_THREAT)[F.lower(F.trim(threat))]


def _alias_words():
    return [(word.lower(), tid) for tid, name, _, aliases, _ in X.TECHNIQUES
            for word in [tid, name, *aliases]]


def techniques_of(threat: Column, mitre: Column, words: Column) -> Column:
    """Ordered technique ids: the alert's own, its threat type's, then by alias."""
    own = F.transform(F.split(mitre, "[,; ]"), technique_base)
    tt = F.lower(F.trim(threat))
    second = F.lit(None)
    for name, ids in X.SECOND_TECHNIQUES.items():
        second = F.when(tt == name, F.array(*map(F.lit, ids))).otherwise(second)
    hay = _joined(threat, words)
    by_alias = F.transform(
        F.filter(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("tid"))
                           for w, t in _alias_words()]), lambda a: hay.contains(a.word)),
        lambda a: a.tid)
    every = F.concat(own, F.array(threat_technique(threat)),
                     F.coalesce(second, F.array().cast("array<string>")), by_alias)
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull()))


def lead_technique(threat: Column, mitre: Column, words: Column) -> Column:
    """First of :func:`techniques_of`; null when nothing matches.  The alias search,
    the costly part, only runs when neither the alert nor its type names one."""
    known = "|".join(t[0] for t in X.TECHNIQUES)
    own = F.regexp_extract(F.upper(mitre), rf"(?:^|[,; ])({known})(?:\.[^,; ]*)?(?=$|[,; ])", 1)
    def by_alias(hay):
        chain = None
        for word, tid in _alias_words():
            chain = F.when(hay.contains(word), tid) if chain is None else chain.when(hay.contains(word), tid)
        return chain

    alias = F.transform(F.array(_joined(threat, words)), by_alias)[0]     # the text is joined once
    return F.coalesce(F.nullif(own, F.lit("")), threat_technique(threat), alias)


def tactic_of(tactic: Column, technique: Column) -> Column:
    """The alert's own tactic, else the technique's, else Unknown."""
    return F.coalesce(F.nullif(tactic, F.lit("")), technique_tactic(technique), F.lit("Unknown"))


def is_network_threat(threat: Column) -> Column:
    return _any_word(threat, X.NETWORK_THREAT_WORDS)


def is_identity_threat(threat: Column) -> Column:
    return _any_word(threat, X.IDENTITY_THREAT_WORDS)
