"""Search-query and title queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import text as X
from bazaarlens.plans.primitives import PO
from bazaarlens.plans.registry import query

EXTRA = {"NATION_1": ["nation one", "phong tro gia re"], "NATION_2": ["brand#3"]}
SEARCH = "event_type='pageview' AND coalesce(trim(query)<>'',false)"


def nq(c: str) -> str:
    return rf"trim(regexp_replace(replace(strip_accents(lower({c})),'đ','d'),'\s+',' ','g'))"


AQ = f"aq AS (SELECT query, category, city_name, COUNT(*) AS n FROM ev WHERE {SEARCH} GROUP BY ALL)"


@query("aggregate_queries", "ev", f"WITH {AQ} SELECT * FROM aq")
def _(s):
    return X.aggregate_queries(s.ev)


for _name, _keys in {"search_coverage": "category", "search_coverage_device": "device", "search_coverage_login": "is_login"}.items():
    @query(_name, "ev", f"""SELECT {_keys}, COUNT(*) AS events, COUNT(*) FILTER ({SEARCH}) AS searches, COUNT(DISTINCT query) FILTER ({SEARCH}) AS distinct_queries, round(100.0*COUNT(*) FILTER ({SEARCH})/COUNT(*),6) AS search_pct,
 round_even(COUNT(*) FILTER ({SEARCH})/0.5,0)::BIGINT AS searches_estimate FROM ev GROUP BY 1""")
    def _(s, key=_keys):
        return X.search_coverage(s.ev, [key], 0.5)


LEX = f"""lx AS (SELECT 'province' AS kind, {nq('city_name')} AS alias, city_name AS canonical, city_name AS city FROM region_map
 UNION SELECT 'province', a, c, c FROM (VALUES ('nation one','NATION_1'),('phong tro gia re','NATION_1'),('brand#3','NATION_2')) v(a,c)
 UNION ALL SELECT 'district', {nq('district_name')}, district_name||'|'||city_name, city_name FROM (SELECT city_name, district_name, COUNT(*) AS n FROM dim WHERE trim(city_name)<>'' AND trim(district_name)<>'' GROUP BY 1,2 HAVING COUNT(*)>=2
  QUALIFY row_number() OVER (PARTITION BY city_name ORDER BY COUNT(*) DESC, district_name)<=80) WHERE length({nq('district_name')})>=3)"""


def lexicon(s):
    return X.build_geo_lexicon(s.region, s.dim, EXTRA, min_listings=2)


@query("build_geo_lexicon", "dim region_map", f"WITH {LEX} SELECT kind, alias, canonical, city FROM lx")
def _(s):
    return lexicon(s)


MATCH = rf"""{AQ}, {LEX}, qt AS (SELECT DISTINCT {nq('query')} AS q_norm FROM aq), ht AS (SELECT q_norm, kind, alias, canonical FROM qt, lx WHERE contains(' '||q_norm||' ', ' '||alias||' ')),
bs AS (SELECT q_norm, arg_min(canonical,(-length(alias),alias,canonical)) FILTER (kind='province') AS province, arg_min(canonical,(-length(alias),alias,canonical)) FILTER (kind='district') AS dl, arg_min(alias,(-length(alias),alias,canonical)) FILTER (kind='province') AS match_span FROM ht GROUP BY 1),
mq AS (SELECT aq.*, {nq('query')} AS q_norm FROM aq),
mt AS (SELECT mq.*, province, match_span, coalesce(dl, CASE WHEN regexp_matches(q_norm,'{X.DISTRICT_PATTERN}') THEN upper(regexp_extract(q_norm,'{X.DISTRICT_PATTERN}',1))||regexp_extract(q_norm,'{X.DISTRICT_PATTERN}',2) END) AS district FROM mq LEFT JOIN bs USING (q_norm))"""


@query("match_geo", "ev dim region_map", f"WITH {MATCH} SELECT query, category, city_name, n, province, district, match_span FROM mt")
def _(s):
    counts = X.aggregate_queries(s.ev).withColumn("q_norm", X.norm_query("query"))
    return X.match_geo(counts, lexicon(s)).select("query", "category", "city_name", "n", "province", "district", "match_span")


_KW = " ".join("WHEN " + " OR ".join(f"contains(' '||q_norm||' ',' {w} ')" for w in ws) + f" THEN '{k}'" for k, ws in X.KEYWORDS.items())
SLOT = rf"""{MATCH}, pv AS (SELECT *, try_cast(replace(regexp_extract(q_norm,'{X.PRICE_PATTERN}',1),',','.') AS DOUBLE)*CASE WHEN regexp_extract(q_norm,'{X.PRICE_PATTERN}',2) IN ('ty','t') THEN 1e9 ELSE 1e6 END AS v FROM mt),
sl AS (SELECT *, CASE WHEN v IS NULL THEN 'khong_ro_gia' WHEN v<3e6 THEN '<3tr' WHEN v<5e6 THEN '3-5tr' WHEN v<7e6 THEN '5-7tr' WHEN v<10e6 THEN '7-10tr' WHEN v<15e6 THEN '10-15tr' ELSE '>15tr' END AS price_slot, CASE {_KW} ELSE 'khac' END AS keyword,
 CASE WHEN contains(q_norm,'cho thue') OR contains(q_norm,'thue ') THEN 'cho_thue' WHEN contains(q_norm,'ban ') OR contains(q_norm,'mua ') THEN 'ban_mua' WHEN contains(q_norm,'thue') THEN 'thue' ELSE 'khac' END AS intent,
 CASE WHEN q_norm='' THEN 0 ELSE len(string_split(q_norm,' ')) END::INT AS n_tokens, (q_norm IN ('none','null','nan','n/a','') OR length(q_norm)<=1)::INT AS is_noise FROM pv),
tg AS (SELECT *, concat_ws('|', CASE WHEN province IS NOT NULL THEN 'geo_explicit_province' WHEN district IS NOT NULL THEN 'geo_district_only' END, CASE WHEN price_slot<>'khong_ro_gia' THEN 'price_led' END,
 CASE WHEN n_tokens>=4 AND (contains(q_norm,'cho thue') OR contains(q_norm,' o ') OR contains(q_norm,' tai ')) THEN 'full_phrase' END, CASE WHEN keyword<>'khac' AND n_tokens<=3 THEN 'generic' END) AS tags FROM sl),
en AS (SELECT *, CASE WHEN is_noise=1 THEN 'noise' WHEN tags='' THEN 'other' ELSE tags END AS taxonomy, coalesce(province,'khong_ro_tinh') AS geo_a, coalesce(province,city_name,'khong_ro_tinh') AS geo_b FROM tg)"""


def enriched(s):
    return X.enriched_queries(s.ev, lexicon(s))


@query("query_slots", "ev dim region_map", f"WITH {SLOT} SELECT query, category, city_name, n, price_slot, keyword, intent, n_tokens, is_noise, taxonomy FROM en")
def _(s):
    return enriched(s).select("query", "category", "city_name", "n", "price_slot", "keyword", "intent", "n_tokens", "is_noise", "taxonomy")


@query("geo_attribution", "ev dim region_map", f"""WITH {SLOT}, a AS (SELECT geo_a AS place, SUM(n)::BIGINT AS n_a FROM en GROUP BY 1), b AS (SELECT geo_b AS place, SUM(n)::BIGINT AS n_b FROM en GROUP BY 1), j AS (SELECT place, coalesce(n_a,0) AS n_a, coalesce(n_b,0) AS n_b FROM a FULL JOIN b USING (place))
SELECT *, round(100.0*n_a/SUM(n_a) OVER (),6) AS share_a, round(100.0*n_b/SUM(n_b) OVER (),6) AS share_b, n_b-n_a AS delta, round(100.0*(n_b-n_a)/NULLIF(n_a,0),6) AS lift_pct FROM j""")
def _(s):
    return X.geo_attribution(enriched(s))


@query("geo_agreement", "ev dim region_map", f"""WITH {SLOT} SELECT COUNT(*) AS rows, SUM(n)::BIGINT AS searches, round(100.0*AVG((province=city_name)::INT),6) AS agreement_pct, round(100.0*SUM(CASE WHEN province=city_name THEN n ELSE 0 END)/SUM(n),6) AS weighted_agreement_pct
FROM en WHERE province IS NOT NULL AND city_name IS NOT NULL AND is_noise=0""")
def _(s):
    return X.geo_agreement(enriched(s))


@query("top_disagreements", "ev dim region_map", f"WITH {SLOT} SELECT province, city_name, SUM(n)::BIGINT AS n FROM en WHERE province IS NOT NULL AND city_name IS NOT NULL AND is_noise=0 AND province<>city_name GROUP BY 1,2 ORDER BY n DESC, province, city_name LIMIT 25")
def _(s):
    return X.top_disagreements(enriched(s))


@query("weighted_ngrams", "ev", rf"""WITH t AS (SELECT category, list_filter(regexp_split_to_array({nq('query')},'\s+'), lambda x: x<>'') AS tok, COUNT(*) AS w FROM ev WHERE {SEARCH} GROUP BY 1,2),
g AS (SELECT category, w, 2 AS size, unnest(list_transform(range(1,len(tok)), lambda i: array_to_string(tok[i:i+1],' '))) AS gram FROM t UNION ALL SELECT category, w, 3, unnest(list_transform(range(1,len(tok)-1), lambda i: array_to_string(tok[i:i+2],' '))) FROM t),
c AS (SELECT category, size::INT AS size, gram, SUM(w)::BIGINT AS n FROM g GROUP BY 1,2,3) SELECT *, row_number() OVER (PARTITION BY category, size ORDER BY n DESC, gram)::INT AS rank FROM c QUALIFY rank<=20""")
def _(s):
    counts = X.aggregate_queries(s.ev).withColumn("q_norm", X.norm_query("query"))
    return X.weighted_ngrams(counts, "q_norm", F.col("n"), [2, 3], 20, ["category"])


@query("document_ngrams", "docs", r"""WITH t AS (SELECT lang, list_filter(regexp_split_to_array(lower(text),'[ \t\n\r\f\x0B]+'), lambda x: x<>'') AS tok FROM docs),
g AS (SELECT lang, unnest(list_transform(range(1,len(tok)), lambda i: array_to_string(tok[i:i+1],' '))) AS gram FROM t), c AS (SELECT lang, gram, COUNT(*) AS n FROM g GROUP BY 1,2)
SELECT lang, 2::INT AS size, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)::INT AS rank FROM c QUALIFY rank<=20""")
def _(s):
    return X.weighted_ngrams(s.docs.withColumn("t", F.lower("text")), "t", F.lit(1), [2], 20, ["lang"], frequent=512)


@query("geo_coverage_metrics", "ev dim region_map", f"""WITH {SLOT}, u AS (SELECT category, round(100.0*SUM(CASE WHEN geo_a='khong_ro_tinh' THEN n ELSE 0 END)/SUM(n),6) AS unknown_pct, round(100.0*SUM(CASE WHEN price_slot<>'khong_ro_gia' THEN n ELSE 0 END)/SUM(n),6) AS price_led_pct, SUM(n) AS t FROM en GROUP BY 1),
p AS (SELECT category, geo_b, SUM(n) AS n, row_number() OVER (PARTITION BY category ORDER BY SUM(n) DESC, geo_b) AS r FROM en GROUP BY 1,2)
SELECT category, unknown_pct, price_led_pct, round(100.0*SUM(n) FILTER (r<=5)/MAX(t),6) AS top5_pct, round(100.0*SUM(n) FILTER (r<=10)/MAX(t),6) AS top10_pct FROM u JOIN p USING (category) GROUP BY 1,2,3""")
def _(s):
    return X.geo_coverage_metrics(enriched(s))


@query("taxonomy_share", "ev dim region_map", f"WITH {SLOT} SELECT category, taxonomy, SUM(n)::BIGINT AS n, round(100.0*SUM(n)/SUM(SUM(n)) OVER (PARTITION BY category),6) AS pct FROM en GROUP BY 1,2")
def _(s):
    return X.taxonomy_share(enriched(s))


_HM = ", ".join(f"round(100.0*SUM(CASE WHEN price_slot='{p}' THEN n ELSE 0 END)/(SELECT SUM(n) FROM en),6) AS \"{p}\"" for p in [*X.PRICE_LABELS, X.UNKNOWN_PRICE])


@query("district_price_heatmap", "ev dim region_map", f"WITH {SLOT} SELECT coalesce(district,'khac') AS district, {_HM} FROM en GROUP BY 1")
def _(s):
    return X.district_price_heatmap(enriched(s))


# Word patterns per language for the documents, per kind for the titles.
LANGUAGE_RULES = {
    "en": "the|and|of|ing", "fr": "ou|le|eau|ment", "de": "ein|sch|ung|und", "es": "ión|os|ado|que",
}
TITLE_TAXONOMY = {"rent": "cho thuê|phòng trọ", "urgent": "gấp", "sell": "bán", "view": "ban công"}
KEYWORD_GROUPS = {"cheap": "giá rẻ", "rent": "thuê", "metal": "bolt|rod|plate", "small": "small|ring"}
STOP_WORDS = ["the", "and", "les", "der", "los"]


def _cnt(p: str) -> str:
    return f"len(regexp_extract_all(t,'{p}'))"


_RS = ", ".join(f"{_cnt(p)} AS s_{n}" for n, p in LANGUAGE_RULES.items())
_RB = "GREATEST(" + ", ".join(f"s_{n}" for n in LANGUAGE_RULES) + ")"
RULED = f"rd AS (SELECT doc_id, lang, lower(text) AS t FROM docs), rs AS (SELECT doc_id, lang, {_RS} FROM rd), ru AS (SELECT doc_id, lang, CASE WHEN {_RB}=0 THEN 'unknown' " + " ".join(
    f"WHEN s_{n}={_RB} THEN '{n}'" for n in LANGUAGE_RULES) + " END AS rule FROM rs)"


@query("title_category_rules", "docs", f"WITH {RULED} SELECT doc_id, lang, rule FROM ru")
def _(s):
    return X.title_category_rules(s.docs, "text", LANGUAGE_RULES).select("doc_id", "lang", "rule")


@query("rule_agreement", "docs", f"WITH {RULED} SELECT lang, COUNT(*) AS n, round(100.0*AVG((rule=lang)::INT),6) AS agree_pct FROM ru GROUP BY 1")
def _(s):
    return X.rule_agreement(X.title_category_rules(s.docs, "text", LANGUAGE_RULES), "lang")


@query("rule_confusion", "docs", f"WITH {RULED} SELECT lang, rule, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY lang),6) AS row_pct FROM ru GROUP BY 1,2")
def _(s):
    return X.rule_confusion(X.title_category_rules(s.docs, "text", LANGUAGE_RULES), "lang")


TSEG = "ts AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(lower(title),'{p}') THEN '{n}'" for n, p in TITLE_TAXONOMY.items()) + " ELSE 'other' END AS segment FROM dim)"


@query("title_segments", "dim", f"WITH {TSEG} SELECT segment, COUNT(*) AS n, round(AVG(area_sqm),6) AS mean, MIN(area_sqm) AS min, MAX(area_sqm) AS max, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct, round(median(area_sqm),6) AS median FROM ts GROUP BY 1")
def _(s):
    return X.segment_stats(X.title_segments(s.dim, "title", TITLE_TAXONOMY), "area_sqm")


@query("segment_top_prices", "dim", f"WITH {TSEG} SELECT segment, price_bucket, COUNT(*) AS n, row_number() OVER (PARTITION BY segment ORDER BY COUNT(*) DESC, price_bucket)::INT AS rank FROM ts WHERE price_bucket IS NOT NULL GROUP BY 1,2 QUALIFY rank<=3")
def _(s):
    from bazaarlens.operators.core import top_n
    counts = X.title_segments(s.dim, "title", TITLE_TAXONOMY).filter("price_bucket IS NOT NULL").groupBy("segment", "price_bucket").agg(F.count("*").alias("n"))
    return top_n(counts, ["segment"], [F.desc("n"), F.asc("price_bucket")], 3)


@query("top_words", "docs", rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text),'(\p{{L}}+)',1)) AS word FROM docs)
SELECT word, COUNT(*) AS n FROM w WHERE length(word)>=3 AND word NOT IN ('the','and','les','der','los') GROUP BY 1 ORDER BY n DESC, word LIMIT 40""")
def _(s):
    return X.top_words(s.docs, "text", STOP_WORDS)


_KA = " UNION ALL ".join(f"SELECT '{g}' AS keyword, COUNT(*) FILTER (regexp_matches(lower(title),'{p}')) AS n, round(100.0*COUNT(*) FILTER (regexp_matches(lower(title),'{p}'))/COUNT(*),6) AS with_pct, round(100.0*AVG(ok) FILTER (regexp_matches(lower(title),'{p}')),6) AS cvr_with, "
                         f"round(100.0*AVG(ok) FILTER (NOT regexp_matches(lower(title),'{p}')),6) AS cvr_without, round(100.0*AVG(ok),6) AS cvr_all FROM k" for g, p in KEYWORD_GROUPS.items())


@query("keyword_cvr", "ev dim", f"WITH k AS (SELECT title, (item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO}))::INT AS ok FROM dim) {_KA}")
def _(s):
    from bazaarlens.functions.columns import is_positive
    from bazaarlens.operators.joins import flag_left_join
    flagged = flag_left_join(s.dim, s.ev.filter(is_positive()), ["item_id"], "ok")
    return X.keyword_cvr(flagged, "title", KEYWORD_GROUPS, F.col("ok") == 1)
