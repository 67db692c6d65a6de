"""Search-query and title text: normalization, geography, price, intent, n-grams, rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.columns import as_col, bucketize, flag, has_query, is_pageview, pct
from bazaarlens.operators.core import join_keys, quantiles, share_of_all, share_within, top_n
from bazaarlens.operators.joins import full_outer_zero
from bazaarlens.session import durable

# Labels, keyword lists and patterns of the query slots (texts without diacritics).
UNKNOWN_GEO = "khong_ro_tinh"
UNKNOWN_PRICE = "khong_ro_gia"
NOISE = ["none", "null", "nan", "n/a", ""]
PRICE_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(tr|trieu|ty|t)\b"
DISTRICT_PATTERN = r"\b(q|quan|huyen)\s*([0-9]+|[a-z0-9]+)"
PRICE_EDGES = [3e6, 5e6, 7e6, 10e6, 15e6]
PRICE_LABELS = ["<3tr", "3-5tr", "5-7tr", "7-10tr", "10-15tr", ">15tr"]
KEYWORDS = {
    "phong tro": ["phong tro", "ptro", "nha tro", "tro"],
    "nha nguyen can": ["nha nguyen can", "nguyen can"],
    "chung cu": ["chung cu", "cc", "can ho"],
    "mat bang": ["mat bang", "mb", "mat bang kinh doanh"],
    "dat": ["dat nen", "ban dat", "dat"],
    "homestay": ["homestay"],
}


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by Unicode decomposition."""
    pairs = {"đ": "d"}
    for code in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch == ch.lower() and base != ch and base.isascii():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _accent_table()


def strip_accents(c: Column | str) -> Column:
    return F.translate(F.lower(as_col(c)), _MARKED, _PLAIN)


def norm_query(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(strip_accents(F.coalesce(as_col(c), F.lit(""))), r"\s+", " "))


def aggregate_queries(events: DataFrame) -> DataFrame:
    """Counts per (query, category, city) of search pageviews; everything later works on these."""
    return events.filter(is_pageview() & has_query()).groupBy("query", "category", "city_name").agg(F.count("*").alias("n"))


def search_coverage(events: DataFrame, keys: Sequence[str], fraction: float = 1.0) -> DataFrame:
    search = is_pageview() & has_query()
    out = events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(search).alias("searches"),
        F.countDistinct(F.when(search, F.col("query"))).alias("distinct_queries"))
    return out.withColumns({
        "search_pct": pct("searches", "events"), "searches_estimate": F.bround(F.col("searches") / fraction, 0).cast("long")})


def build_geo_lexicon(
    mapping: DataFrame, dim: DataFrame, extra: Mapping[str, Sequence[str]] | None = None, min_listings: int = 1, top_districts: int | None = None
) -> DataFrame:
    """(kind, alias, canonical, city) rows: city names and aliases, and the districts of each city.

    Every district is kept unless a least number of listings or a number of districts is asked for.
    """
    cities = mapping.select(F.col("city_name").alias("canonical")).distinct()
    pairs = [F.struct(norm_query("canonical").alias("alias"))]
    named = cities.select("canonical", F.explode(F.array(*pairs)).alias("p")).select(F.col("p.alias").alias("alias"), "canonical")
    for city, aliases in (extra or {}).items():
        more = cities.filter(F.col("canonical") == city).select(
            F.explode(F.array(*[F.lit(a) for a in aliases])).alias("a"), "canonical").select(norm_query("a").alias("alias"), "canonical")
        named = named.unionByName(more)
    provinces = named.filter(F.length("alias") >= 2).distinct().select(
        F.lit("province").alias("kind"), "alias", "canonical", F.col("canonical").alias("city"))
    counts = dim.filter((F.trim("city_name") != "") & (F.trim("district_name") != "")).groupBy(
        "city_name", "district_name").agg(F.count("*").alias("n")).filter(F.col("n") >= min_listings)
    best = counts if top_districts is None else top_n(counts, ["city_name"], [F.desc("n"), F.asc("district_name")], top_districts, "r")
    districts = best.select(
        F.lit("district").alias("kind"), norm_query("district_name").alias("alias"),
        F.concat_ws("|", "district_name", "city_name").alias("canonical"), F.col("city_name").alias("city")).filter(F.length("alias") >= 3)
    return provinces.unionByName(districts)


def match_geo(queries: DataFrame, lexicon: DataFrame, text: str = "q_norm") -> DataFrame:
    """Longest province and district alias inside each distinct query text.

    A whole-word alias inside a query is one of the query's token n-grams, so the match is an
    equi-join of n-grams with the lexicon instead of a test of every query against every alias.
    """
    texts = queries.select(text).distinct()
    longest = lexicon.agg(F.max(F.size(F.split("alias", " ")))).scalar()
    tokens = texts.select(text, F.split(text, " ").alias("tok"), longest.alias("longest"))
    starts = F.sequence(F.lit(1), F.size("tok"))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.col("longest"), F.size("tok") - i + 1)), lambda n: F.array_join(F.slice("tok", i, n), " "))))
    exploded = tokens.select(text, F.explode(F.array_distinct(grams)).alias("alias"))
    hits = exploded.join(lexicon, "alias")
    order = F.struct(-F.length("alias"), F.col("alias"), F.col("canonical"))

    def best(kind: str) -> Column:
        return F.min_by("canonical", F.when(F.col("kind") == kind, order))

    found = hits.groupBy(text).agg(
        best("province").alias("province"), best("district").alias("district_lex"),
        F.min_by("alias", F.when(F.col("kind") == "province", order)).alias("match_span"))
    joined = queries.join(found, text, "left")
    pattern = F.when(F.col(text).rlike(DISTRICT_PATTERN), F.concat(
        F.upper(F.regexp_extract(text, DISTRICT_PATTERN, 1)), F.regexp_extract(text, DISTRICT_PATTERN, 2)))
    return joined.withColumn("district", F.coalesce("district_lex", pattern)).drop("district_lex")


def price_slot(text: str = "q_norm") -> Column:
    number = F.replace(F.regexp_extract(text, PRICE_PATTERN, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(text, PRICE_PATTERN, 2)
    value = number * F.when(unit.isin("ty", "t"), 1e9).otherwise(1e6)
    return bucketize(value, PRICE_EDGES, PRICE_LABELS, "left", UNKNOWN_PRICE)


def keyword_slot(text: str = "q_norm") -> Column:
    padded = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    out = None
    for label, words in KEYWORDS.items():
        hit = reduce(lambda a, b: a | b, [padded.contains(f" {w} ") for w in words])
        out = (F if out is None else out).when(hit, F.lit(label))
    return out.otherwise("khac")


def intent_slot(text: str = "q_norm") -> Column:
    t = F.col(text)
    return (
        F.when(t.contains("cho thue") | t.contains("thue "), "cho_thue").when(t.contains("ban ") | t.contains("mua "), "ban_mua")
        .when(t.contains("thue"), "thue").otherwise("khac"))


def query_slots(matched: DataFrame, text: str = "q_norm") -> DataFrame:
    """Price, keyword type, intent, size, noise and a multi-tag taxonomy of geo-matched queries."""
    t = F.col(text)
    n_tokens = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    slots = matched.withColumns({
        "price_slot": price_slot(text), "keyword": keyword_slot(text), "intent": intent_slot(text), "n_tokens": n_tokens,
        "is_noise": flag(t.isin(NOISE) | (F.length(t) <= 1))})
    tags = F.concat_ws(
        "|",
        F.when(F.col("province").isNotNull(), "geo_explicit_province").when(F.col("district").isNotNull(), "geo_district_only"),
        F.when(F.col("price_slot") != UNKNOWN_PRICE, "price_led"),
        F.when((F.col("n_tokens") >= 4) & (t.contains("cho thue") | t.contains(" o ") | t.contains(" tai ")), "full_phrase"),
        F.when((F.col("keyword") != "khac") & (F.col("n_tokens") <= 3), "generic"))
    taxonomy = F.when(F.col("is_noise") == 1, "noise").when(tags == "", "other").otherwise(tags)
    return slots.withColumn("taxonomy", taxonomy)


def enriched_queries(events: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Query counts with every slot and both geographic attributions (A text only, B text else city)."""
    counts = aggregate_queries(events).withColumn("q_norm", norm_query("query"))
    slots = query_slots(match_geo(counts, lexicon))
    return slots.withColumns({
        "geo_a": F.coalesce("province", F.lit(UNKNOWN_GEO)), "geo_b": F.coalesce("province", "city_name", F.lit(UNKNOWN_GEO))})


def geo_attribution(enriched: DataFrame) -> DataFrame:
    """Volume and share of each place by method, and the lift of B over A."""
    a = enriched.groupBy(F.col("geo_a").alias("place")).agg(F.sum("n").alias("n_a"))
    b = enriched.groupBy(F.col("geo_b").alias("place")).agg(F.sum("n").alias("n_b"))
    both = full_outer_zero(a, b, ["place"], ["n_a", "n_b"])
    both = share_of_all(share_of_all(both, "n_a", "share_a"), "n_b", "share_b")
    delta = F.col("n_b") - F.col("n_a")
    return both.withColumns({"delta": delta, "lift_pct": pct(delta, F.when(F.col("n_a") > 0, F.col("n_a")))})


def _comparable(enriched: DataFrame) -> DataFrame:
    kept = enriched.filter("province IS NOT NULL AND city_name IS NOT NULL AND is_noise = 0")
    return kept.withColumn("agree", flag(F.col("province") == F.col("city_name")))


def geo_agreement(enriched: DataFrame) -> DataFrame:
    return _comparable(enriched).agg(
        F.count("*").alias("rows"), F.sum("n").alias("searches"), (F.avg("agree") * 100).alias("agreement_pct"),
        pct(F.sum(F.col("agree") * F.col("n")), F.sum("n")).alias("weighted_agreement_pct"))


def top_disagreements(enriched: DataFrame, k: int = 25) -> DataFrame:
    bad = _comparable(enriched).filter("agree = 0").groupBy("province", "city_name").agg(F.sum("n").alias("n"))
    return bad.orderBy(F.desc("n"), "province", "city_name").limit(k)


def weighted_ngrams(
    df: DataFrame, text: str, weight: Column, sizes: Sequence[int], k: int, keys: Sequence[str] = (), frequent: int | None = None
) -> DataFrame:
    """Most frequent n-grams by weight (none negative), from whole texts; n-grams combine before the shuffle.

    Of long texts nearly every n-gram is rare, so that little combines and all of them travel. There
    ``frequent`` counts words first and then n-grams of the so many most frequent words of each key. An
    n-gram is never more frequent than its rarest word: where the k-th of these n-grams has more than any
    word left out, the list is exact, and where that does not hold for every key, all n-grams are counted.
    """
    tokens = df.select(*keys, weight.alias("w"), F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "").alias("tok"))
    found = None if frequent is None else _ngrams_of_frequent_words(tokens, sizes, k, keys, frequent)
    return _top_ngrams(tokens, sizes, k, keys) if found is None else found


def _top_ngrams(tokens: DataFrame, sizes: Sequence[int], k: int, keys: Sequence[str], gaps: bool = False) -> DataFrame:
    """The ``k`` n-grams of largest weight; with ``gaps`` some tokens are NULL and belong to none."""
    def grams(n: int) -> Column:
        joined = F.col("tok")
        for shift in range(1, n):  # glue every token to the text before it
            left = F.greatest(F.size("tok") - shift, F.lit(0))
            joined = F.zip_with(F.slice(joined, 1, left), F.slice("tok", shift + 1, left), lambda a, b: F.concat(a, F.lit(" "), b))
        if gaps:
            joined = F.filter(joined, lambda g: g.isNotNull())
        return F.transform(joined, lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram")))

    exploded = tokens.select(*keys, "w", F.explode(F.concat(*[grams(n) for n in sizes])).alias("g"))
    counts = exploded.groupBy(*keys, F.col("g.size").alias("size"), F.col("g.gram").alias("gram")).agg(F.sum("w").alias("n"))
    return top_n(counts, [*keys, "size"], [F.desc("n"), F.asc("gram")], k)


def _ngrams_of_frequent_words(tokens: DataFrame, sizes: Sequence[int], k: int, keys: Sequence[str], frequent: int, most: int = 16384) -> DataFrame | None:
    """``_top_ngrams`` by way of the ``frequent`` words of each key; None where that cannot be shown to be exact."""
    keys = list(keys)
    words = tokens.select(*keys, "w", F.explode("tok").alias("word")).groupBy(*keys, "word").agg(F.sum("w").alias("n"))
    best = durable(top_n(words, keys, [F.desc("n"), F.asc("word")], frequent + 1), "words")
    listed = [r.word for r in best.filter(F.col("rank") <= frequent).select("word").distinct().limit(most + 1).collect()]
    if not listed or len(listed) > most:  # many keys: the list would not be a small one
        return None
    kept = tokens.withColumn("tok", F.transform("tok", lambda t: F.when(t.isin(listed), t)))
    found = durable(_top_ngrams(kept, sizes, k, keys, gaps=True), "ngrams")
    outside = best.filter(F.col("rank") > frequent).select(*keys, F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size"), F.col("n").alias("__out"))
    least = found.filter(F.col("rank") == k).select(*keys, "size", F.col("n").alias("__least"))
    doubt = join_keys(outside, least, [*keys, "size"], "left").filter("__least IS NULL OR __least <= __out")
    return found if doubt.isEmpty() else None


def geo_coverage_metrics(enriched: DataFrame) -> DataFrame:
    """Unknown percent, concentration on the largest places, per category."""
    unknown = enriched.groupBy("category").agg(
        pct(F.sum(F.when(F.col("geo_a") == UNKNOWN_GEO, F.col("n")).otherwise(0)), F.sum("n")).alias("unknown_pct"),
        pct(F.sum(F.when(F.col("price_slot") != UNKNOWN_PRICE, F.col("n")).otherwise(0)), F.sum("n")).alias("price_led_pct"))
    places = enriched.groupBy("category", "geo_b").agg(F.sum("n").alias("n"))
    ranked = top_n(places, ["category"], [F.desc("n"), F.asc("geo_b")], 10, "r")
    totals = enriched.groupBy("category").agg(F.sum("n").alias("total"))
    tops = join_keys(ranked, totals, ["category"]).groupBy("category").agg(
        pct(F.sum(F.when(F.col("r") <= 5, F.col("n")).otherwise(0)), F.max("total")).alias("top5_pct"),
        pct(F.sum("n"), F.max("total")).alias("top10_pct"))
    return join_keys(unknown, tops, ["category"])


def taxonomy_share(enriched: DataFrame) -> DataFrame:
    return share_within(enriched.groupBy("category", "taxonomy").agg(F.sum("n").alias("n")), ["category"], "n", "pct")


def district_price_heatmap(enriched: DataFrame) -> DataFrame:
    """Share of all searches by district and price slot, one column per slot."""
    labels = [*PRICE_LABELS, UNKNOWN_PRICE]
    wide = enriched.groupBy(F.coalesce("district", F.lit("khac")).alias("district")).agg(
        *[F.sum(F.when(F.col("price_slot") == p, F.col("n")).otherwise(0)).alias(p) for p in labels])
    total = enriched.agg(F.sum("n")).scalar()  # districts come from free text, so they never meet in one task
    summed = wide.withColumn("__all", total)
    return summed.select("district", *[pct(F.col(f"`{p}`"), "__all").alias(p) for p in labels])


# ---- titles -------------------------------------------------------------------------------------

def title_category_rules(df: DataFrame, text: str, rules: Mapping[str, str], out: str = "rule") -> DataFrame:
    """Rule with most pattern hits in the whole text; the earlier rule wins ties."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = df.withColumns({f"__s{i}": F.regexp_count(t, F.lit(p)) for i, p in enumerate(rules.values())})
    cols = [F.col(f"__s{i}") for i in range(len(rules))]
    best = F.greatest(*cols)
    label = F.when(best == 0, "unknown")
    for name, c in zip(rules, cols):
        label = label.when(c == best, F.lit(name))
    return scored.withColumn(out, label).drop(*[f"__s{i}" for i in range(len(rules))])


def rule_agreement(df: DataFrame, expected: str, rule: str = "rule") -> DataFrame:
    return df.groupBy(expected).agg(F.count("*").alias("n"), (F.avg(flag(F.col(rule) == F.col(expected))) * 100).alias("agree_pct"))


def rule_confusion(df: DataFrame, expected: str, rule: str = "rule") -> DataFrame:
    return share_within(df.groupBy(expected, rule).agg(F.count("*").alias("n")), [expected], "n", "row_pct")


def title_segments(df: DataFrame, text: str, taxonomy: Mapping[str, str], out: str = "segment", other: str = "other") -> DataFrame:
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    label = None
    for name, pattern in taxonomy.items():
        label = (F if label is None else label).when(t.rlike(pattern), F.lit(name))
    return df.withColumn(out, label.otherwise(other))


def segment_stats(df: DataFrame, value: str, segment: str = "segment") -> DataFrame:
    base = df.groupBy(segment).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return join_keys(share_of_all(base, "n", "pct", bounded=True), quantiles(df, [segment], value, {"median": 0.5}), [segment], "left")


def top_words(df: DataFrame, text: str, stop: Sequence[str], k: int = 40, min_length: int = 3) -> DataFrame:
    """Most frequent words over the whole texts, without stop words and short words."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    kept = words.filter((F.length("word") >= min_length) & ~F.col("word").isin(list(stop)))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("word")).limit(k)


def keyword_cvr(df: DataFrame, text: str, groups: Mapping[str, str], success: Column) -> DataFrame:
    """Share of rows with each keyword group, and success rate with and without it; one pass."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    marked = df.select(flag(success).alias("ok"), *[flag(t.rlike(p)).alias(f"k_{g}") for g, p in groups.items()])
    aggs = [F.count("*").alias("total"), F.avg("ok").alias("base")]
    for g in groups:
        k = F.col(f"k_{g}")
        aggs += [F.sum(k).alias(f"n_{g}"), F.avg(F.when(k == 1, F.col("ok"))).alias(f"w_{g}"), F.avg(F.when(k == 0, F.col("ok"))).alias(f"o_{g}")]
    wide = marked.agg(*aggs)
    rows = [F.struct(F.lit(g).alias("keyword"), F.col(f"n_{g}").alias("n"), pct(f"n_{g}", "total").alias("with_pct"),
                     (F.col(f"w_{g}") * 100).alias("cvr_with"), (F.col(f"o_{g}") * 100).alias("cvr_without"),
                     (F.col("base") * 100).alias("cvr_all")) for g in groups]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


