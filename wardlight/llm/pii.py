"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base spans are found by four patterns and their checks.  High-recall generators propose
further, overlapping spans: address-like texts (also with "at" and "dot" spelled out),
runs of grouped digits, dotted numbers, and long mixed tokens behind a name or an assignment (but
not behind that of a checksum or revision).  Each candidate has
format features (digits, length, separators, letters, leading sign) and context
features (words and signs just before it).  Boosted trees score candidates.  They are
fitted to counts of candidates by feature cell over all documents, where a candidate
counts as right if it covers a base span, or if it is a long token that looks random (many different signs that
often change between capitals, small letters and digits).  What makes it right (Luhn, byte range, digit count,
randomness) is no feature, so the trees carry over to spans in the same form and context that fail a check.

Thresholds: trees of each four folds of documents score the fifth's cells; per generator precision is
made monotone in the score by pooling neighbours, and a pool is accepted if it and all above it are right in
``PRECISION`` of cases and in ``SURE`` by the lower end of a one-sided 90 % interval; with none, that generator adds
nothing.  Accepted candidates are added where they overlap no
base span, or are long tokens around one; of overlapping ones the better score stays, then the earlier, then the longer.

Spans of one pattern don't overlap each other, so those of a kind that a span overlaps are found by halving, in time
near-linear in the spans of a text.

The cells are products of the few values that each feature has (at most
:data:`CELL_BOUND`), so what is fetched to the driver doesn't grow with the documents.

Patterns use possessive groups, which Java runs without recursion, so that very long
runs do not exhaust the stack; they match what the plain patterns match.

Defined results: null texts have no spans (they stay null when redacted); equal rows
give equal rows; an empty table fits no trees and gives no rows; offsets are code
points, the end exclusive; other columns are kept by ``redacted`` and unread otherwise.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

from wardlight.llm.tables import query, table, texts

KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "ip", "card", "phone", "secret")
PRECISION, SURE = 0.9, 0.8
FOLDS = 5
#: Characters of a text that are cut together when spans are replaced.
BLOCK = 1024
TREES, DEPTH, RATE = 24, 3, 0.3
#: 4 generators x 7 digit counts x 4 lengths x 3 separators x 2 signs x 4 contexts x 3 letters x 2 folds.
CELL_BOUND = 16_128

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[ -][0-9]++)*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: By generator.
_LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z])[+(]{0,2}[0-9][ ().0-9-]{5,}[0-9](?![0-9A-Za-z])",
    r"(?<![0-9.])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++(?![0-9.]*[0-9])",
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
)
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"
_SECRET = r"(?i)(?:token|secret|password|passwd|pwd|api.?key|bearer)\W{0,4}$"
_NAMED = r"(?i)(?:sha-?[0-9]*|md5|crc-?[0-9]*|commit|hash|checksum|digest|etag|uuid|guid|rev|revision)\W{0,4}$"
_CHANGES = "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"
_REACH = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|address|ip|host)\W{0,4}$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _running(numbers: Column) -> Column:
    """Running sums, by blocks of 64, so long lists don't cost their square."""
    blocks = _let(numbers, lambda ns: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / 64).cast("int")), lambda i: F.slice(ns, i * 64 + 1, 64)))
    return _let(blocks, lambda bs: _let(F.transform(bs, _sum), lambda sums: F.flatten(F.zip_with(
        bs, F.transform(sums, lambda s, i: _sum(F.slice(sums, 1, i))),
        lambda b, base: F.transform(b, lambda x, j: base + _sum(F.slice(b, 1, j + 1)))))))


def _before(places, value, leaps) -> Column:
    """How many of the sorted ``places`` are smaller than ``value``, by halving: ``leaps`` are falling powers of two."""
    return F.aggregate(leaps, F.lit(0), lambda n, leap: F.when(F.get(places, n + leap - 1) < value, n + leap).otherwise(n))


def _lane(spans: Column) -> Column:
    """Sorted spans that don't overlap each other, ready to be searched by place."""
    def leaps(n):
        bits = F.length(F.bin(n))
        return F.slice(F.lit([1 << i for i in range(30, -1, -1)]), 32 - bits, bits)
    return _let(spans, lambda xs: F.struct(
        xs.alias("xs"), F.transform(xs, lambda x: x["s"]).alias("starts"), F.transform(xs, lambda x: x["e"]).alias("ends"),
        leaps(F.size(xs)).alias("leaps")))


def _lanes(spans: Column, field: str, values) -> Column:
    """A lane for each value of the field that spans have."""
    def of(value):
        return F.filter(spans, lambda x: x[field] == value)
    return F.filter(F.array(*[_lane(of(v)) for v in values]), lambda lane: F.size(lane["xs"]) > 0)


def _ended(lane, place) -> Column:
    """How many spans end at ``place`` or before."""
    return _before(lane["ends"], place + 1, lane["leaps"])


def _started(lane, place) -> Column:
    """How many spans start before ``place``."""
    return _before(lane["starts"], place, lane["leaps"])


def _met(lane, s, e) -> Column:
    """Spans that overlap s to e; for all spans of another lane together no more than both lanes hold."""
    return _let(_ended(lane, s), lambda n: F.slice(lane["xs"], n + 1, F.greatest(_started(lane, e) - n, F.lit(0))))


_SPAN = "array<struct<s:int,e:int,m:string,before:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches with their places, and up to 24 characters before each."""
    def placed(found):
        return _let(F.split(text, pattern, -1), lambda parts: _let(
            _running(F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))),
            lambda ends: F.transform(found, lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"),
                F.right(F.get(parts, i), F.lit(24)).alias("before")))))
    return _let(F.regexp_extract_all(text, F.lit(pattern), 0),
                lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(_SPAN)))


def _digits(match):
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match):
    def total(r):
        return _sum(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: _let(
            F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d))))
    return _let(F.reverse(_digits(match)), lambda r: F.when(F.length(r).between(14, 19), total(r) % 10 == 0)
                .otherwise(F.lit(False)))


def _right_kind(kind, x):
    m = x["m"]
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(_BYTE))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    pattern, sign = {"email": (_EMAIL, "@"), "ip": (_IP, r"[0-9]\.[0-9]"), "card": (_CARD, "[0-9]"),
                     "phone": (_PHONE, r"\+[0-9]")}[kind]
    found = F.filter(located(text, pattern), lambda x: _right_kind(kind, x))
    return F.when(text.rlike(sign), found).otherwise(F.array().cast(_SPAN))


def _features(gen: int, x) -> Column:
    """Small integers; their ranges make up :data:`CELL_BOUND`."""
    m, before = x["m"], x["before"]
    digits, length = F.length(_digits(m)), F.length(m)
    separators = F.length(F.regexp_replace(m, "[^ ().-]", ""))
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(gen).alias("gen"),
        F.when(digits == 0, 0).when(digits < 7, 1).when(digits < 10, 2).when(digits < 13, 3).when(digits < 16, 4)
        .when(digits < 20, 5).otherwise(6).alias("digits"),
        F.when(length < 12, 0).when(length < 20, 1).when(length < 40, 2).otherwise(3).alias("length"),
        F.when(separators == 0, 0).when(separators < 3, 1).otherwise(2).alias("separators"),
        m.startswith("+").cast("int").alias("sign"),
        F.when(before.rlike(_NAMED), 0).when(before.rlike(_SECRET), 3).when(before.rlike(_REACH), 2).when(before.rlike(r"[=:]\W{0,2}$"), 1)
        .otherwise(0).alias("context"),
        F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("[a-z]") & m.rlike("[A-Z]"), 1).otherwise(2).alias("letters"),
        _random(m).cast("int").alias("random") if gen == 3 else F.lit(0).alias("random"))


def _random(m) -> Column:
    return (F.regexp_count(m, F.lit(_CHANGES)) >= 0.2 * F.length(m)) & (F.size(F.array_distinct(F.split(m, ""))) >= 10)


FEATURES = ("gen", "digits", "length", "separators", "sign", "context", "letters")
_CANDIDATE = "array<struct<s:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ",random:int>>"
_BASE = "array<struct<s:int,e:int,kind:int>>"
_SIGNS = ("@|at[)\\]]", "[0-9][ ().0-9-]{5}", r"[0-9]\.[0-9]+\.[0-9]", "[A-Za-z0-9+/_-]{16}")


def _candidates(text: Column) -> Column:
    """Candidates of all generators; long tokens count only with a digit and a context."""
    found = []
    for gen, (pattern, sign) in enumerate(zip(_LOOSE, _SIGNS)):
        spans = located(text, pattern)
        if gen == 3:
            spans = F.filter(spans, lambda x: x["m"].rlike("[0-9]"))
        spans = F.transform(spans, functools.partial(_features, gen))
        if gen == 3:
            spans = F.filter(spans, lambda c: c["context"] > 0)
        found.append(F.when(text.rlike(sign), spans)
                     .otherwise(F.array().cast(_CANDIDATE)))
    return F.concat(*[c.cast(_CANDIDATE) for c in found])


def _of_kind(spans: Column, place: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(place).alias("kind")))


def spans_and_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``base`` (s, e, kind as a place in KINDS) and ``candidates`` to rows with a ``text``.
    Texts without a digit or an address sign are not searched."""
    base = F.concat(*[_of_kind(_base(F.col("text"), kind), k) for k, kind in enumerate(KINDS)])
    any_sign = F.col("text").rlike("[0-9@]|at[)\\]]")
    return (rows.withColumn("base", F.when(any_sign, base).otherwise(F.array().cast(_BASE)))
            .withColumn("candidates", F.when(any_sign, _candidates(F.col("text"))).otherwise(F.array().cast(_CANDIDATE))))


def _base_lanes() -> Column:
    return _lanes(F.col("base"), "kind", range(len(KINDS)))


def cells(found: DataFrame) -> list:
    """Counts of candidates and of right ones by fold and feature cell, over all documents."""
    def covers(lanes, c):
        return F.exists(lanes, lambda lane: F.coalesce(F.get(lane["ends"], _started(lane, c["s"])) <= c["e"], F.lit(False)))
    labelled = F.when(F.size("candidates") > 0, _let(_base_lanes(), lambda lanes: F.transform("candidates", lambda c: F.struct(
        *[c[f].alias(f) for f in FEATURES], F.greatest(covers(lanes, c).cast("int"), c["random"]).alias("right")))))
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).alias("fold")
    # Not explode: its filter on the list would go below, and search each text anew for every candidate.
    rows = found.select(fold, F.explode_outer(labelled).alias("c")).filter("c is not null").select("fold", "c.*")
    return rows.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.sum("right").alias("k")).collect()


def _fit(data):
    """Trees of (feature, cut, left, right) or leaf values, by Newton steps on the log loss."""
    n = sum(c["n"] for c in data)
    bias = math.log((sum(c["k"] for c in data) + 0.5) / (n - sum(c["k"] for c in data) + 0.5))
    score = [bias] * len(data)

    def grown(rows, depth, slopes):
        g, h = sum(slopes[i][0] for i in rows), sum(slopes[i][1] for i in rows)
        best = (1e-6, None)
        if depth:
            for f in FEATURES:
                for cut in sorted({data[i][f] for i in rows})[:-1]:
                    left = [i for i in rows if data[i][f] <= cut]
                    gl, hl = sum(slopes[i][0] for i in left), sum(slopes[i][1] for i in left)
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left))
        if best[1] is None:
            return RATE * g / (h + 1)
        f, cut, left = best[1]
        chosen = set(left)
        return f, cut, grown(left, depth - 1, slopes), grown([i for i in rows if i not in chosen], depth - 1, slopes)
    trees = []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = grown(list(range(len(data))), DEPTH,
                     [(c["k"] - c["n"] * q, c["n"] * q * (1 - q)) for c, q in zip(data, p)])
        trees.append(tree)
        score = [s + _value(tree, c) for s, c in zip(score, data)]
    return bias, trees


def _value(tree, cell):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if cell[f] <= cut else high
    return tree


def _together(counted):
    """One cell for all folds, in a fixed order."""
    sums = {}
    for c in counted:
        n, k = sums.get(key := tuple(c[f] for f in FEATURES), (0, 0))
        sums[key] = n + c["n"], k + c["k"]
    return [dict(zip(FEATURES, key), n=n, k=k) for key, (n, k) in sorted(sums.items())]


def _sure(k, n, z=1.2816):
    """Lower end of Wilson's one-sided 90 % interval of k / n."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def threshold(scored) -> float | None:
    """Lowest accepted score of (score, n, k): see above."""
    pools = []
    for score, n, k in sorted(scored):
        if pools and pools[-1][3] == score:
            low, pn, pk, _ = pools.pop()
            score, n, k, top = low, n + pn, k + pk, score
        else:
            top = score
        while pools and pools[-1][2] * n >= k * pools[-1][1]:          # no more precise than the pool below
            low, pn, pk, _ = pools.pop()
            score, n, k = low, n + pn, k + pk
        pools.append((score, n, k, top))
    least = None
    for score, n, k, _ in reversed(pools):
        if k < PRECISION * n or _sure(k, n) < SURE:
            break
        least = score
    return least


def fit(counted: list) -> tuple[float, list, dict[int, float]]:
    """Bias, trees, and the threshold of each generator that has one."""
    if not counted:
        return 0.0, [], {}
    folds = sorted({c["fold"] for c in counted})
    scored = {gen: [] for gen in range(len(_LOOSE))}
    for fold in folds:
        others = _together(c for c in counted if c["fold"] != fold or len(folds) == 1)
        bias, trees = _fit(others)
        for c in _together(c for c in counted if c["fold"] == fold):
            scored[c["gen"]].append((bias + sum(_value(t, c) for t in trees), c["n"], c["k"]))
    bias, trees = _fit(_together(counted))
    thresholds = {gen: least - 1e-9 for gen, cs in scored.items() if (least := threshold(cs)) is not None}
    return bias, trees, thresholds


def _as_column(tree, c):
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(c[f] <= cut, _as_column(low, c)).otherwise(_as_column(high, c))


def _added(model) -> Column:
    """Accepted candidates (s, e, kind as a place in ADDED, score): none overlaps another, or a base span unless a
    long token holds it."""
    bias, trees, thresholds = model
    empty = F.array().cast("array<struct<s:int,e:int,kind:int,score:double>>")
    if not thresholds:
        return empty

    def scored(c):
        kind = (F.when(c["gen"] == 0, 0).when(c["gen"] == 2, 1).when(c["gen"] == 3, 4)
                .when((c["digits"] >= 4) & (c["sign"] == 0), 2).otherwise(3))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), kind.alias("kind"),
                        sum((_as_column(t, c) for t in trees), F.lit(bias)).alias("score"), c["gen"].alias("gen"))

    def enough(c):
        ok = F.lit(False)
        for gen, least in thresholds.items():
            ok = ok | ((c["gen"] == gen) & (c["score"] >= least))
        return ok

    def held(lane, c):
        def by(o):
            starts, ends, first = lane["starts"], lane["ends"], o["first"]
            within = ((F.get(starts, first) >= c["s"]) & (F.get(ends, o["last"]) <= c["e"])
                      & (F.get(ends, first) - F.get(starts, first) < c["e"] - c["s"]))
            return (first <= o["last"]) & ~((c["gen"] == 3) & within)
        return _let(F.struct(_ended(lane, c["s"]).alias("first"), (_started(lane, c["e"]) - 1).alias("last")), by)
    free = _let(_base_lanes(), lambda lanes: F.filter("candidates", lambda c: ~F.exists(lanes, lambda lane: held(lane, c))))
    kept = F.when(F.size("candidates") > 0, F.filter(F.transform(free, scored), enough))

    def better(a, b):
        return ((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (
            (a["s"] < b["s"]) | ((a["s"] == b["s"]) & ((a["e"] > b["e"]) | ((a["e"] == b["e"]) & (a["gen"] < b["gen"])))))))

    def uncontested(ks):
        return _let(_lanes(ks, "gen", thresholds), lambda lanes: F.filter(ks, lambda a: ~F.exists(
            lanes, lambda lane: F.exists(_met(lane, a["s"], a["e"]), lambda b: better(b, a)))))
    best = _let(F.coalesce(kept, F.array().cast("array<struct<s:int,e:int,kind:int,score:double,gen:int>>")),
                lambda ks: F.when(F.size(ks) > 1, uncontested(ks)).otherwise(ks))
    return F.transform(best, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"),
                                                c["score"].alias("score")))


def _joined(spans, names):
    """kind:start:end by start, then kind, comma-joined."""
    named = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["kind"], x["e"]))),
                                    lambda x: F.concat_ws(":", F.get(named, x["kind"]), x["s"], x["e"])), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans."""
    found = spans_and_candidates(texts(docs))
    model = fit(cells(found))
    spans = found.select("doc_id", "base", _added(model).alias("added"))

    def count(place):
        return F.size(F.filter("base", lambda b: b["kind"] == place)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    everything = F.concat("base", F.transform("added", lambda a: F.struct(a["s"], a["e"], a["kind"])))
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                        _joined(everything, ADDED).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _redaction(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans (s, kind, e) replaced by its kind in brackets; overlapping spans by the
    first's.  Spans of one kind don't overlap.  Each block of the text is cut by the spans that it meets."""
    named = F.array(*[F.lit(f"[{n.upper()}]") for n in ADDED])

    def leading(lanes, xs):
        """Spans beyond whose start no earlier one reaches."""
        return F.filter(xs, lambda x: ~F.exists(lanes, lambda lane: F.coalesce(
            F.get(lane["xs"], _ended(lane, x["s"])) < x, F.lit(False))))

    def cuts(lanes, firsts):
        """Leading spans up to the last end before the next of them."""
        def reached(place):
            return F.array_max(F.transform(lanes, lambda lane: F.get(lane["ends"], _started(lane, place) - 1)))
        return F.transform(firsts, lambda x, i: F.struct(
            x["s"].alias("s"), reached(F.coalesce(F.get(firsts, i + 1)["s"], F.lit(2**31 - 1))).alias("e"), x["kind"].alias("kind")))

    def cut(start, block, met):
        def piece(x, i):
            since = F.greatest(F.coalesce(F.get(met, i - 1)["e"], start), start)
            return F.concat(F.substring(block, since - start + 1, F.greatest(x["s"] - since, F.lit(0))),
                            F.when(x["s"] >= start, F.get(named, x["kind"])).otherwise(""))
        rest = F.element_at(met, -1)["e"] - start
        return F.concat(F.array_join(F.transform(met, piece), ""),
                        F.substring(block, rest + 1, F.greatest(F.length(block) - rest, F.lit(0))))

    def replaced(lane):
        return F.array_join(F.transform(
            F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda block, k: _let(
                _met(lane, k * BLOCK, (k + 1) * BLOCK),
                lambda met: F.when(F.size(met) == 0, block).otherwise(cut(k * BLOCK, block, met)))), "")
    return _let(spans, lambda xs: _let(_lanes(xs, "kind", range(len(ADDED))), lambda lanes: _let(
        _let(leading(lanes, xs), lambda firsts: _lane(cuts(lanes, firsts))), replaced)))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, with every span's text replaced (and n_chars, if there, counted anew)."""
    found = spans_and_candidates(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    model = fit(cells(found))
    added = F.transform(_added(model), lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e"), a["kind"].alias("kind")))
    spans = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(
        x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    held = found.select("row", "text", spans.alias("spans"))
    text = F.when(F.size("spans") > 0, _redaction(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        length = F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return held.select(row.alias("row")).select("row.*")


@query("op3_candidate_boosting")
def op3(spark, folder):
    return found_spans(table(spark, folder, "documents"))
