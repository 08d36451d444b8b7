"""Learning from analysts' verdicts: which recurring threats deserve a playbook."""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, moment, since
from .sequence import top_per


def label_examples(logs, labelled, window_days=30, as_of=None, max_types=None) -> DataFrame:
    """Busiest unlabelled address of every threat type."""
    recent = since(logs, ago(moment(as_of, logs), days=window_days)).where("threat_type != '' and src_ip != ''")
    fresh = recent.join(labelled.select(F.col("entity").alias("src_ip")).distinct(), "src_ip", "left_anti")
    per = fresh.groupBy("threat_type", F.col("src_ip").alias("entity")).agg(
        row_count("events"), F.max("rule_level").alias("max_lvl"),
        F.count_if(F.col("severity") == "critical").alias("crit"), F.countDistinct("dst_ip").alias("uniq_dst"))
    best = top_per(per, ["threat_type"], [F.desc("events"), "entity"], 1)
    return best.orderBy("threat_type").limit(max_types) if max_types else best


c = F.col


def featurised(rows, anomalies) -> DataFrame:
    """Nine inputs of the label model; ``anomalies`` are addresses now anomalous."""
    odd = anomalies.select(c("ip").alias("entity"), F.lit(1.0).alias("odd")).distinct()
    ev = F.greatest(F.lit(1), c("events"))
    values = [F.log1p(ev.cast("double")), c("max_lvl") / 15.0, c("avg_lvl") / 15.0, c("crit") / ev, c("high") / ev,
              F.log1p(c("uniq_dst").cast("double")), F.log1p(c("uniq_ports").cast("double")),
              F.log1p(c("uniq_users").cast("double")), F.coalesce("odd", F.lit(0.0))]
    extra = [x for x in ("top_threat", "disposition") if x in rows.columns]
    return rows.join(odd, "entity", "left").select("entity", *extra, *[
        v.cast("double").alias(n) for n, v in zip(X.LABEL_FEATURES, values)])


def label_of(disposition):
    return F.lower(F.trim(disposition)).isin(X.TRUE_POSITIVE_LABELS).cast("double")


def training_rows(features, verdicts, anomalies) -> DataFrame:
    """Labelled entities with their inputs."""
    joined = features.join(verdicts.where("entity <> ''").select("entity", "disposition"), "entity")
    return featurised(joined, anomalies).withColumn("label", label_of(c("disposition")))


def label_status(rows, least=24, per_class=6) -> DataFrame:
    """Labels so far and whether they suffice to train."""
    pos = F.count_if(c("label") == 1)
    n = F.count(F.lit(1))
    ready = (n >= least) & (pos >= per_class) & (n - pos >= per_class)
    return rows.agg(n.alias("labels"), pos.alias("pos"), (n - pos).alias("neg"),
                    F.when(ready, "ready").otherwise("collecting").alias("status"))


def _vectors(rows, names=X.LABEL_FEATURES):
    from pyspark.ml.functions import array_to_vector
    return rows.withColumn("features", array_to_vector(F.array(*names)))


def _scaling(rows, names=X.LABEL_FEATURES):
    """Mean and population deviation per input (18 numbers of one row)."""
    row = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    return {n: (row[f"m_{n}"], row[f"s_{n}"] or 1.0) for n in names}


def scaled(rows, scaling) -> DataFrame:
    return rows.withColumns({n: (c(n) - m) / s for n, (m, s) in scaling.items()})


def train_labels(rows, least=24, per_class=6):
    """Logistic regression on standardised inputs, or None while labels are few.
    Returns a dict with the model, its scaling, status, accuracy and weights."""
    from pyspark.ml.classification import LogisticRegression
    state = label_status(rows, least, per_class).first().asDict()
    if state["status"] != "ready":
        return {**state, "model": None}
    scaling = _scaling(rows)
    data = _vectors(scaled(rows, scaling))
    model = LogisticRegression(regParam=1e-3, elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    right = F.avg(((c("p") >= 0.5).cast("double") == c("label")).cast("double")).alias("accuracy")
    accuracy = _probabilities(model, data).agg(right).first()["accuracy"]
    weights = {n: round(float(w), 3) for n, w in zip(X.LABEL_FEATURES, model.coefficients)}
    return {**state, "model": model, "scaling": scaling, "train_accuracy": round(accuracy, 3), "weights": weights}


def _probabilities(model, data):
    from pyspark.ml.functions import vector_to_array
    return model.transform(data).withColumn("p", vector_to_array("probability")[1])


def probabilities(bundle, rows) -> DataFrame:
    """Chance that each entity is a true positive."""
    out = _probabilities(bundle["model"], _vectors(scaled(rows, bundle["scaling"])))
    keep = [x for x in ("entity", "top_threat") if x in rows.columns]
    return out.select(*keep, "p")


def threat_confidence(probability) -> DataFrame:
    return probability.groupBy(c("top_threat").alias("threat_type")).agg(F.avg("p").alias("confidence"))


def covered_threats(threats) -> DataFrame:
    """Threat types an existing playbook already answers, judged by the same matcher
    that incidents go through."""
    from .incidents import match_playbooks
    t = c("threat_type")
    tid = C.threat_technique(t)
    has = lambda *words: C._any_word(t, words)
    empty = F.array().cast("array<struct<id:string,name:string>>")
    made = threats.select("threat_type").distinct().select(
        t.alias("incident_id"), F.replace(t, F.lit("_"), F.lit(" ")).alias("narrative"),
        F.when(tid.isNotNull(), F.array(F.struct(tid.alias("id"), t.alias("name")))).otherwise(empty).alias("techniques"),
        F.array().cast("array<string>").alias("tactics"), has("lateral", "rdp", "smb").alias("reached_lateral"),
        (t == "account_takeover").cast("int").alias("takeovers"), (t == "impossible_travel").cast("int").alias("travels"))
    return match_playbooks(made).select(c("incident_id").alias("threat_type")).distinct()


def recommendations(recurrence, confidence, covered, least=30, threshold=0.5) -> DataFrame:
    """Uncovered, recurring threats the model believes in, best first."""
    rows = (recurrence.where(~c("threat_type").isin(X.SKIP_THREATS) & (c("events") >= least))
            .join(covered, "threat_type", "left_anti").join(confidence, "threat_type", "left")
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).where(c("confidence") >= threshold))
    weight = F.lit(1.0) + c("crit") / F.greatest(F.lit(1), c("events")) * 1.5
    rank = F.log1p(c("events").cast("double")) * c("confidence") * weight * (1 + F.log1p(c("ips").cast("double")))
    return (rows.withColumn("rank_score", F.bround(rank, 2)).withColumn("tp_confidence", F.bround("confidence", 3))
            .withColumn("title", F.initcap(F.replace("threat_type", F.lit("_"), F.lit(" ")))).drop("confidence")
            .orderBy(F.desc("rank_score"), "threat_type"))


def draft_responses(threats) -> DataFrame:
    """Suggested steps and the lead technique per threat type."""
    labels = {a: (text, changes) for a, text, changes in X.ACTIONS}
    t = c("threat_type")
    step = lambda action, approval=False: F.struct(
        F.lit(action).alias("action"), F.lit(labels[action][0]).alias("label"),
        F.lit(labels[action][1]).alias("mutates"), F.lit(approval).alias("requires_approval"))
    steps = F.filter(F.array(
        step("enrich_reputation"), step("enrich_abuseipdb"), step("tag_entity"),
        F.when(C.is_identity_threat(t), step("disable_user", True)),
        F.when(C.is_network_threat(t), step("block_ip", True)), step("open_case"), step("notify")),
        lambda s: s.isNotNull())
    lead = C.lead_technique(t, F.lit(""), t)
    advice = C._map({x[0]: ",".join(x[4]) for x in X.TECHNIQUES})[lead]
    return threats.select("threat_type").distinct().select(
        "threat_type", steps.alias("steps"), lead.alias("technique"), C.technique_tactic(lead).alias("tactic"),
        F.split(advice, ",").alias("mitigations"))


def label_queue(recurrence, covered, examples, limit=12) -> DataFrame:
    """Recurring threats, each with a fresh unlabelled example, busiest first."""
    mark = covered.withColumn("covered", F.lit(True))
    return (recurrence.where(~c("threat_type").isin(X.SKIP_THREATS))
            .select("threat_type", "events", "ips", "max_lvl", "crit")
            .join(examples.select("threat_type", c("entity").alias("example_entity"),
                                  c("events").alias("example_events"), c("crit").alias("example_crit")), "threat_type")
            .join(mark, "threat_type", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
            .orderBy(F.desc("events"), "threat_type").limit(limit))
