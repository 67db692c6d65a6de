"""Personal data by weak supervision, in DataFrame functions alone.

Labelers of three sorts vote on every candidate span, for (1), against (-1) or not at all (0):
regular expressions with their checks, a gazetteer (domain ends, words that name secrets, country
and area prefixes), and the context around the span. Votes are counted by pattern over all
documents; patterns are few by construction (three votes for each labeler and a few shapes), so
expectation-maximisation over that table runs on the driver. It estimates each labeler's accuracy
and each pattern's posterior, which then train a logistic span classifier on votes and shape. Its
weights become a column expression that decides spans the base patterns leave open.

Base spans always stay. Spans of the method that overlap a base span are left out. Null and empty
texts have none. Each row gives one row, repeated or not; other columns pass through ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.shared import keyed
from bazaarlens.session import durable

KINDS = ["email", "ip", "card", "phone", "secret"]

# The base patterns. Possessive forms match the same strings without backtracking; an
# address starts where its run of characters starts or the match before it ended.
NAME = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{NAME})){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Candidates beyond the base patterns.
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,64}+(?![A-Za-z0-9_-])",
    "number": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20-][0-9][0-9\x20-]{4,14}[0-9](?![0-9])",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DOMAIN_ENDS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at)$"
SECRET_WORDS = r"(?i)(?:token|secret|password|passwd|api[_-]?key|key|bearer)\W{0,6}$"
CONTACT_WORDS = r"(?i)(?:phone|tel|call|mobile|fax|contact|mail|write|address|card|visa|ip|host|server)\W{0,6}$"
SECRET_RUN = "[A-Za-z0-9_-]{20}"
LABELERS = ["pattern", "checksum", "gazetteer", "secret_context", "contact_context", "shape"]
ROUNDS, RATE, STEPS = 25, 0.5, 300


def _matches(text: Column, kind: str) -> Column:
    """Matches of a pattern with the code points before each one, and what stands around it."""
    both = F.struct(F.split(text, PATTERNS[kind]).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"))

    def listed(b: Column) -> Column:
        return F.transform(b["found"], lambda m, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("k"), F.length(F.get(b["gaps"], k)).cast("long").alias("gap"), m.alias("match"),
            F.right(F.get(b["gaps"], k), F.lit(24)).alias("before"), F.left(F.get(b["gaps"], k + 1), F.lit(8)).alias("after")))

    return F.transform(F.array(both), listed)[0]


def may_hold(text: Column) -> Column:
    """Every pattern needs a digit, the sign of an address or a long run of a secret's characters."""
    return F.coalesce(text, F.lit("")).rlike(f"[0-9@]|{SECRET_RUN}")


def candidates(docs: DataFrame) -> DataFrame:
    """(key, kind, match, before, after, start, end): every match of every pattern, base or not.

    ``docs`` has (key, text). Texts are read once; matches are a written table, and only they are
    shuffled for their positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,k:int,gap:bigint,match:string,before:string,after:string>>")
    digits, sign = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    parts = [F.when(sign, _matches(text, "email")).otherwise(none)] + [
        F.when(text.rlike(SECRET_RUN) if kind == "secret" else digits, _matches(text, kind)).otherwise(none) for kind in PATTERNS if kind != "email"]
    rows = durable(docs.select("key", F.explode(F.concat(*parts)).alias("m")).select("key", "m.*"), "matches")
    order = W.partitionBy("key", "kind").orderBy("k")
    size = F.length("match")
    start = F.sum(F.col("gap") + size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size
    return rows.withColumn("start", start).withColumn("end", F.col("start") + size).drop("gap", "k")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: every second one from the right doubled, nines cast out."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0


def is_base(kind: Column, match: Column) -> Column:
    n = F.length(digits_of(match))
    return F.coalesce(
        F.when(kind == "email", True).when(kind == "ip", match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", F.when((n >= 12) & (n <= 19), luhn(digits_of(match))).otherwise(False)).when(kind == "phone", (n >= 9) & (n <= 15)), F.lit(False))


def votes(rows: DataFrame) -> DataFrame:
    """``rows`` with base, one column v_<labeler> for each labeler, and the span's shape."""
    kind, match, n = F.col("kind"), F.col("match"), F.length(digits_of(F.col("match")))
    base = is_base(kind, match)
    pick = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    same = F.length(F.regexp_replace(match, r"^(.)\1*$", "")) == 0
    date = match.rlike(r"^(?:19|20)[0-9]{2}[-\x20][0-9]{2}[-\x20]")
    return rows.withColumn("base", base).withColumns({
        "v_pattern": pick(base | ((kind == "secret") & match.rlike("^(?:[0-9a-f]{24,64}|[0-9A-F]{24,64})$") & mixed) | ((kind == "number") & (n >= 9) & (n <= 15) & ~date), ~kind.isin("secret")),
        "v_checksum": pick((kind == "card") & base, (kind == "card") & ~base),
        "v_gazetteer": pick(((kind == "email") & match.rlike(DOMAIN_ENDS)) | ((kind == "phone") & match.rlike(r"^\+[1-9]")) | ((kind == "number") & match.rlike(r"^\(")), same),
        "v_secret_context": pick((kind == "secret") & F.col("before").rlike(SECRET_WORDS), (kind == "secret") & ~mixed),
        "v_contact_context": pick(kind.isin("email", "ip", "card", "phone", "number") & F.col("before").rlike(CONTACT_WORDS), F.col("after").rlike(r"^[A-Za-z]")),
        "v_shape": pick((kind == "secret") & mixed & (F.length(match) >= 32), (kind == "number") & date),
        "shape": F.concat_ws(":", kind, F.least(F.lit(4), F.floor(n / 5)).cast("string"))})


def fit_labelers(patterns: list[tuple[tuple[int, ...], str, int]]) -> tuple[dict[str, float], list[float]]:
    """Accuracies of the labelers and posteriors of the patterns (votes, shape, count), by EM.

    A labeler that votes is right with its own probability whatever the true class; votes are
    independent given the class. Starts from a majority of 0.8.
    """
    names = LABELERS
    right, prior = [0.8] * len(names), 0.5
    posterior = [0.5] * len(patterns)
    for _ in range(ROUNDS):
        for i, (v, _, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, _, n in patterns)
        prior = min(0.95, max(0.05, sum(p * n for p, (_, _, n) in zip(posterior, patterns)) / total)) if total else 0.5
        for j in range(len(names)):
            voted = sum(n for v, _, n in patterns if v[j])
            agreed = sum(n * (p if v[j] > 0 else 1 - p) for p, (v, _, n) in zip(posterior, patterns) if v[j])
            right[j] = min(0.99, max(0.55, (agreed + 8) / (voted + 10)))
    return dict(zip(names, right)), posterior


def fit_classifier(patterns: list[tuple[tuple[int, ...], str, int]], posterior: list[float]) -> dict[str, float]:
    """Logistic weights over votes and shapes, trained on the posteriors by gradient descent."""
    names = ["bias", *[f"{name}{s}" for name in LABELERS for s in "+-"], *sorted({s for _, s, _ in patterns})]
    place = {name: i for i, name in enumerate(names)}
    rows = []
    for (v, shape, n), p in zip(patterns, posterior):
        on = [0, place[shape], *[place[f"{name}{'+' if x > 0 else '-'}"] for name, x in zip(LABELERS, v) if x]]
        rows.append((on, p, math.sqrt(n)))  # rare patterns keep a say
    weights, total = [0.0] * len(names), sum(r[2] for r in rows) or 1.0
    for _ in range(STEPS):
        step = [0.0005 * w for w in weights]
        for on, p, n in rows:
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in on))))) - p
            for i in on:
                step[i] += n / total * miss
        weights = [w - RATE * 8 * s for w, s in zip(weights, step)]
    return dict(zip(names, weights))


def score(weights: dict[str, float]) -> Column:
    """The classifier as a column expression."""
    terms = F.lit(weights["bias"])
    for name in LABELERS:
        terms = terms + F.when(F.col(f"v_{name}") > 0, weights[f"{name}+"]).when(F.col(f"v_{name}") < 0, weights[f"{name}-"]).otherwise(0.0)
    shapes = [x for k, w in weights.items() if ":" in k for x in (F.lit(k), F.lit(w))]
    if shapes:
        terms = terms + F.coalesce(F.create_map(*shapes)[F.col("shape")], F.lit(0.0))
    return 1 / (1 + F.exp(-terms))


def spans(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, base, match): base spans, and those the trained classifier adds."""
    voted = durable(votes(candidates(docs)), "votes")
    columns = [f"v_{name}" for name in LABELERS]
    counted = voted.groupBy(*columns, "shape").agg(F.count("*").alias("n")).collect()  # 3 ** labelers times shapes at most
    patterns = sorted((tuple(r[c] for c in columns), r["shape"], r["n"]) for r in counted)
    _, posterior = fit_labelers(patterns)
    decided = voted.filter(F.col("base") | ((score(fit_classifier(patterns, posterior)) > 0.5) & F.col("kind").isin("secret", "number")))
    named = decided.select("key", F.when(F.col("kind") == "number", "phone").otherwise(F.col("kind")).alias("kind"), "start", "end", "base", "match")
    # A span of the method that overlaps one before it or a base span goes; base spans come first at equal starts.
    order = W.partitionBy("key").orderBy("start", F.col("base").desc())
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    return named.withColumn("free", free).filter(F.col("base") | F.col("free")).drop("free")


def pii_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are of base spans."""
    rows, _ = keyed(docs)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = spans(rows).withColumns({"at": F.struct("start", place.alias("place"), "end"), "line": F.concat_ws(":", "kind", "start", "end")})
    entry = F.struct("at", "line")
    joined = lambda a: F.array_join(F.transform(F.sort_array(a), lambda e: e["line"]), ",")
    by_doc = found.groupBy(F.col("key").alias("other")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]],
        joined(F.collect_list(F.when(F.col("base"), entry))).alias("base_line"), joined(F.collect_list(entry)).alias("spans"))
    none = F.lit("")
    return rows.select("doc_id", "key").join(by_doc, F.col("key") == F.col("other"), "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.coalesce("base_line", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one."""
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    filler = "_" * (1 + max([0, *map(len, own)]))  # no column's name; a struct needs a field
    plain = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias(filler)).alias("_own"))
    rows, _ = keyed(plain, "_own")
    found = spans(rows.select("key", "text"))
    order = W.partitionBy("key").orderBy("start", F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"))).alias("kind"))
    by_doc = merged.groupBy(F.col("key").alias("other")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    text, cuts = F.col("text"), F.col("cuts")
    cast = lambda c: c.cast("int")
    pieces = F.transform(cuts, lambda s, k: F.concat(
        text.substr(cast(F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0)) + 1), cast(s["start"] - F.coalesce(F.get(cuts, k - 1)["end"], F.lit(0)))), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.get(cuts, F.size(cuts) - 1)["end"]
    clean = F.concat(F.array_join(pieces, ""), text.substr(cast(last + 1), F.length(text)))
    back = {c: F.col(f"_own.`{c}`") for c in own} | {"doc_id": F.col("doc_id"), "text": text}
    untouched = rows.filter(~may_hold(text)).select(*[back[c].alias(c) for c in docs.columns])
    # Only texts that can hold a span travel to their spans, by the same kind of join at every size.
    joined = rows.filter(may_hold(text)).join(by_doc.hint("merge"), F.col("key") == F.col("other"), "left").withColumn("text", F.when(cuts.isNull(), text).otherwise(clean))
    if "n_chars" in own:
        back["n_chars"] = F.when(cuts.isNull(), back["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return untouched.unionByName(joined.select(*[back[c].alias(c) for c in docs.columns]))
