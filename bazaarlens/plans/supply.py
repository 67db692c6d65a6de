"""Supply-demand, duplicate, coverage and regional portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.buckets import city_predicate
from bazaarlens.operators import lifecycle as L
from bazaarlens.operators import region as G
from bazaarlens.operators import supply as U
from bazaarlens.plans.funnel import SI
from bazaarlens.plans.primitives import ERFC, EX, PO
from bazaarlens.plans.registry import query
from bazaarlens.session import durable

METRO = ["nation_1"]
IE = f"ie AS (SELECT item_id, COUNT(*) FILTER (event_type IN {EX}) AS explicit, COUNT(*) FILTER (event_type IN {PO}) AS positive FROM ev GROUP BY 1)"


@query("supply_demand_by_category", "dim snap ev", f"""WITH b AS (SELECT MIN(date) AS lo, MAX(date) AS hi FROM snap), s AS (SELECT category, COUNT(DISTINCT item_id) AS listings, COUNT(*) AS listing_days FROM snap JOIN dim USING (item_id) GROUP BY 1),
d AS (SELECT dim.category, COUNT(*) FILTER (event_type IN {EX}) AS explicit, COUNT(*) FILTER (event_type IN {PO}) AS positive FROM ev JOIN dim USING (item_id), b WHERE date BETWEEN lo AND hi GROUP BY 1),
j AS (SELECT s.category, listings, listing_days, coalesce(explicit,0) AS explicit, coalesce(positive,0) AS positive FROM s LEFT JOIN d USING (category)), w AS (SELECT SUM(listings)::BIGINT AS l, SUM(listing_days)::BIGINT AS ld, SUM(explicit)::BIGINT AS e, SUM(positive)::BIGINT AS p FROM j),
a AS (SELECT * FROM j UNION ALL SELECT 0, l, ld, e, p FROM w)
SELECT category, listings, listing_days, explicit, positive, round(1000.0*explicit/listings,6) AS explicit_per_1k, round(1000.0*positive/listings,6) AS positive_per_1k, round(100.0*explicit/NULLIF(positive,0),6) AS explicit_of_positive_pct,
 round(100.0*listings/l,6) AS listings_pct, round(100.0*explicit/e,6) AS explicit_pct, round(100.0*positive/p,6) AS positive_pct FROM a, w""")
def _(s):
    return U.supply_demand_by_category(s.dim, s.snap, s.ev)


@query("metro_share", "dim ev", f"""WITH {IE}, j AS (SELECT category, (lower(city_name)='nation_1')::INT AS metro, coalesce(explicit,0) AS e, coalesce(positive,0) AS p FROM dim LEFT JOIN ie USING (item_id)),
c AS (SELECT category, metro, COUNT(*) AS listings, SUM(e)::BIGINT AS explicit, SUM(p)::BIGINT AS positive, COUNT(*) FILTER (p>0) AS listings_with_positive FROM j GROUP BY 1,2)
SELECT *, round(100.0*listings/SUM(listings) OVER w,6) AS supply_pct, round(100.0*positive/NULLIF(SUM(positive) OVER w,0),6) AS demand_pct, round(1000.0*explicit/listings,6) AS explicit_per_1k, round(1000.0*positive/listings,6) AS positive_per_1k FROM c WINDOW w AS (PARTITION BY category)""")
def _(s):
    return U.metro_share(s.dim, s.ev, city_predicate("city_name", METRO))


@query("top_cities_supply_demand", "dim ev", f"""WITH {IE}, c AS (SELECT city_name, COUNT(*) AS listings, coalesce(SUM(positive),0)::BIGINT AS positive FROM dim LEFT JOIN ie USING (item_id) GROUP BY 1), t AS (SELECT *, listings+positive/1000.0 AS rank_score FROM c ORDER BY rank_score DESC, city_name LIMIT 5)
SELECT city_name, listings, positive, round(rank_score,6) AS rank_score, round(100.0*listings/MAX(listings) OVER (),6) AS supply_index, round(100.0*positive/MAX(positive) OVER (),6) AS demand_index FROM t""")
def _(s):
    return U.top_cities_supply_demand(s.dim, s.ev)


AB = "CASE WHEN area_sqm<20 THEN '<20' WHEN area_sqm<30 THEN '20-30' WHEN area_sqm<45 THEN '30-45' WHEN area_sqm<60 THEN '45-60' WHEN area_sqm<80 THEN '60-80' WHEN area_sqm<100 THEN '80-100' WHEN area_sqm<150 THEN '100-150' WHEN area_sqm<200 THEN '150-200' WHEN area_sqm<300 THEN '200-300' WHEN area_sqm<500 THEN '300-500' ELSE '>500' END"


@query("area_gap", "dim ev", f"""WITH {IE}, sc AS (SELECT *, {AB} AS area FROM dim WHERE ad_type IS NOT NULL AND area_sqm BETWEEN 1 AND 5000), s AS (SELECT category, ad_type, area, COUNT(*) AS listings, 100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category, ad_type) AS sp FROM sc GROUP BY 1,2,3),
d AS (SELECT category, ad_type, area, SUM(positive)::BIGINT AS events, 100.0*SUM(positive)/SUM(SUM(positive)) OVER (PARTITION BY category, ad_type) AS dp FROM sc JOIN ie USING (item_id) WHERE positive>0 GROUP BY 1,2,3),
j AS (SELECT category, ad_type, area, coalesce(listings,0) AS listings, coalesce(sp,0) AS sp, coalesce(events,0) AS events, coalesce(dp,0) AS dp FROM s FULL JOIN d USING (category, ad_type, area))
SELECT category, ad_type, area, listings, round(sp,6) AS supply_pct, events, round(dp,6) AS demand_pct, round(dp-sp,6) AS gap_pp, CASE WHEN dp-sp>=1 THEN 'under_supplied' WHEN dp-sp<=-1 THEN 'over_supplied' ELSE 'balanced' END AS verdict FROM j""")
def _(s):
    return U.area_gap(s.dim, s.ev)


@query("district_gap", "dim ev", f"""WITH i AS (SELECT item_id, COUNT(*) AS n, COUNT(*) FILTER (event_type IN {EX}) AS c FROM ev GROUP BY 1), g AS (SELECT district_name, COUNT(*) AS supply, coalesce(SUM(n),0)::BIGINT AS demand, coalesce(SUM(c),0)::BIGINT AS contacts FROM dim LEFT JOIN i USING (item_id) GROUP BY 1 HAVING COUNT(*)>=30)
SELECT *, round(100.0*supply/SUM(supply) OVER (),6) AS supply_pct, round(100.0*demand/SUM(demand) OVER (),6) AS demand_pct, round(contacts::DOUBLE/supply,6) AS contacts_per_listing, round(ln(supply::DOUBLE/GREATEST(demand,1)),6) AS log_ratio FROM g""")
def _(s):
    return U.district_gap(s.dim, s.ev, ["district_name"], 30)


@query("geo_hotspots", "dim ev", f"WITH {IE} SELECT city_name, SUM(positive)::BIGINT AS leads, COUNT(*) AS items, round(SUM(positive)::DOUBLE/COUNT(*),6) AS leads_per_item FROM ie JOIN dim USING (item_id) WHERE positive>0 GROUP BY 1")
def _(s):
    return U.geo_hotspots(s.dim, s.ev, "city_name")


@query("price_leads", "dim ev", f"WITH {IE} SELECT price_bucket, SUM(positive)::BIGINT AS leads, COUNT(*) AS items, round(SUM(positive)::DOUBLE/COUNT(*),6) AS leads_per_item FROM ie JOIN dim USING (item_id) WHERE positive>0 GROUP BY 1")
def _(s):
    return U.geo_hotspots(s.dim, s.ev, "price_bucket")


@query("price_landscape", "dim", """SELECT city_name, ad_type, COUNT(*) AS n, round(quantile_cont(price,0.25),6) AS price_p25, round(quantile_cont(price,0.5),6) AS price_median, round(quantile_cont(price,0.75),6) AS price_p75,
 round(quantile_cont(price/area_sqm,0.25),6) AS sqm_p25, round(quantile_cont(price/area_sqm,0.5),6) AS sqm_median, round(quantile_cont(price/area_sqm,0.75),6) AS sqm_p75 FROM dim GROUP BY 1,2""")
def _(s):
    return U.price_landscape(s.dim, "city_name")


FP = """fp AS (SELECT *, lower(trim(title)) AS t, coalesce(lower(city_name),'') AS ci, coalesce(lower(district_name),'') AS di, coalesce(lower(ward_name),'') AS wa, coalesce(lower(price_bucket),'') AS pr, round(coalesce(area_sqm,-1),1) AS ar FROM dim WHERE trim(title)<>'')"""
LV = {"L1_title_category": "t, category", "L2_title_geo_price": "t, category, ad_type, ci, di, pr",
      "L3_full_fingerprint": "t, category, ad_type, seller_id, ci, di, wa, pr, ar", "L4_title_seller": "t, category, seller_id"}
DUPS = " UNION ALL ".join(f"""SELECT '{n}' AS level, COUNT(*) AS groups, coalesce(SUM(n),0)::BIGINT AS rows, coalesce(SUM(n-1),0)::BIGINT AS excess_rows, COUNT(*) FILTER (s=1) AS same_seller, COUNT(*) FILTER (s>1) AS multi_seller, coalesce(MAX(n),0) AS max_size,
 round(100.0*coalesce(SUM(n),0)/(SELECT COUNT(*) FROM fp),6) AS rows_pct FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT seller_id) AS s FROM fp GROUP BY {c} HAVING COUNT(*)>1)""" for n, c in LV.items())


@query("duplicate_levels", "dim", f"WITH {FP} {DUPS}")
def _(s):
    return U.duplicate_levels(s.dim)


@query("duplicates_by_category", "dim", f"WITH {FP}, g AS (SELECT category, COUNT(*) AS n FROM fp GROUP BY {LV['L4_title_seller']} HAVING COUNT(*)>1) SELECT category, COUNT(*) AS groups, SUM(n)::BIGINT AS rows, MAX(n) AS max_size FROM g GROUP BY 1")
def _(s):
    return U.duplicates_by_category(s.dim, "L4_title_seller")


@query("top_duplicate_groups", "dim", f"WITH {FP} SELECT t AS title_norm, category, COUNT(*) AS n_items FROM fp GROUP BY 1,2 HAVING COUNT(*)>1 ORDER BY n_items DESC, t, category LIMIT 20")
def _(s):
    return U.top_duplicate_groups(s.dim)


CV = """sn0 AS (SELECT item_id, 1 AS has_event, MAX((event_type='view_phone')::INT) AS ph, MAX((event_type='contact_chat')::INT) AS ch, MAX((event_type='contact_zalo')::INT) AS za, MAX((event_type='contact_sms')::INT) AS sm FROM ev GROUP BY 1),
cf AS (SELECT d.*, coalesce(ph,0) AS ph, coalesce(ch,0) AS ch, coalesce(za,0) AS za, coalesce(sm,0) AS sm, CASE WHEN ph+ch+za+sm=4 THEN 'full_four' WHEN ph+ch+za+sm>=1 THEN 'partial_1_3' WHEN has_event=1 THEN 'zero_explicit' ELSE 'no_events' END AS coverage FROM dim d LEFT JOIN sn0 USING (item_id))"""


@query("channel_coverage", "dim ev", f"WITH {CV} SELECT category, coverage, COUNT(*) AS items, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct_total, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS pct_within FROM cf GROUP BY 1,2")
def _(s):
    return U.channel_coverage(s.dim, s.ev)


@query("missing_channels", "dim ev", f"""WITH {CV}, w AS (SELECT category, COUNT(*) AS items, unnest([{{'c':'view_phone','n':SUM(1-ph)}},{{'c':'contact_chat','n':SUM(1-ch)}},{{'c':'contact_zalo','n':SUM(1-za)}},{{'c':'contact_sms','n':SUM(1-sm)}}]) AS p FROM cf WHERE coverage='partial_1_3' GROUP BY 1)
SELECT category, items, p.c AS channel, p.n::DOUBLE AS n_missing, round(100.0*p.n/items,6) AS missing_pct FROM w""")
def _(s):
    return U.missing_channels(s.dim, s.ev)


SIL = SI.replace("FROM ev WHERE", "FROM ev WHERE is_login='login' AND")
CSI = f"{CV}, {SIL}, cs AS (SELECT has_explicit, coverage, CASE WHEN coverage='full_four' THEN 'full_four' ELSE 'not_full_four' END AS bucket FROM si JOIN cf USING (item_id) WHERE has_pageview=1)"


@query("coverage_contact_rate", "dim ev", f"WITH {CSI} SELECT coverage, COUNT(*) AS session_items, SUM(has_explicit)::BIGINT AS with_explicit, round(100.0*AVG(has_explicit),6) AS contact_rate_pct FROM cs GROUP BY 1")
def _(s):
    return U.coverage_contact_rate(s.dim, s.ev)


@query("coverage_ztest", "dim ev", f"""WITH {CSI}, c AS (SELECT COUNT(*) FILTER (bucket='not_full_four') AS n_a, COUNT(*) FILTER (bucket='not_full_four' AND has_explicit=1) AS x_a, COUNT(*) FILTER (bucket='full_four') AS n_b, COUNT(*) FILTER (bucket='full_four' AND has_explicit=1) AS x_b FROM cs),
p AS (SELECT *, x_a::DOUBLE/NULLIF(n_a,0) AS p_a, x_b::DOUBLE/NULLIF(n_b,0) AS p_b, (x_a+x_b)::DOUBLE/NULLIF(n_a+n_b,0) AS pp FROM c), z AS (SELECT *, (p_a-p_b)/NULLIF(sqrt(pp*(1-pp)*(1.0/NULLIF(n_a,0)+1.0/NULLIF(n_b,0))),0) AS z FROM p), t AS (SELECT *, abs(z)/sqrt(2) AS x, 1/(1+0.3275911*abs(z)/sqrt(2)) AS t FROM z)
SELECT n_a, x_a, n_b, x_b, round(p_a,6) AS p_a, round(p_b,6) AS p_b, round(z,6) AS z, round({ERFC},6) AS p_value FROM t""")
def _(s):
    return U.coverage_ztest(s.dim, s.ev)


@query("coverage_snapshot_cvr", "dim ev snap", f"""WITH {CV}, t AS (SELECT item_id, 100.0*SUM(contacts_24h)/SUM(views_24h) AS cvr FROM snap GROUP BY 1 HAVING SUM(views_24h)>0) SELECT coverage, COUNT(*) AS listings, round(AVG(cvr),6) AS mean_cvr, round(median(cvr),6) AS median_cvr FROM t JOIN cf USING (item_id) GROUP BY 1""")
def _(s):
    return U.coverage_snapshot_cvr(s.dim, s.ev, s.snap)


@query("coverage_sensitivity_profile", "dim ev inter", f"""WITH {CV}, k AS (SELECT DISTINCT e.item_id FROM ev e JOIN inter i ON i.user_id=e.user_id AND i.item_id=e.item_id AND i.date=e.date AND chat_message_count>0 WHERE event_type='contact_chat')
SELECT coverage, COUNT(*) AS items, COUNT(*) FILTER (ph=1 AND za=1 AND sm=1 AND ch=1) AS full_four_raw, COUNT(*) FILTER (ph=1 AND za=1 AND sm=1 AND item_id IN (SELECT item_id FROM k)) AS full_four_verified, round(AVG(images_count),6) AS avg_images, round(AVG(area_sqm),6) AS avg_area,
 round(100.0*AVG((ad_type='sell')::INT),6) AS sell_pct, round(100.0*AVG((seller_type='agent')::INT),6) AS agent_pct FROM cf GROUP BY 1""")
def _(s):
    return U.coverage_sensitivity_profile(s.dim, s.ev, s.inter)


@query("project_cohort", "dim snap ev", f"""WITH {IE}, v AS (SELECT item_id, SUM(views_24h) AS v, SUM(contacts_24h) AS c FROM snap GROUP BY 1), j AS (SELECT category, (project_id IS NOT NULL)::INT AS has_project, coalesce(v,0) AS v, coalesce(c,0) AS c, coalesce(explicit,0) AS e, coalesce(positive,0) AS p FROM dim LEFT JOIN v USING (item_id) LEFT JOIN ie USING (item_id))
SELECT category, has_project, COUNT(*) AS listings, round(AVG(v),6) AS avg_views, round(AVG(c),6) AS avg_contacts, round(100.0*SUM(c)/NULLIF(SUM(v),0),6) AS contact_rate_pct, round(100.0*COUNT(*) FILTER (p>0)/COUNT(*),6) AS positive_cvr_pct, round(100.0*COUNT(*) FILTER (e>0)/COUNT(*),6) AS explicit_cvr_pct,
 round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS supply_pct FROM j GROUP BY 1,2""")
def _(s):
    return U.project_cohort(s.dim, s.snap, s.ev)


@query("cross_category_projects", "dim", """WITH p AS (SELECT project_id, category, COUNT(*) AS n FROM dim WHERE project_id IS NOT NULL GROUP BY 1,2) SELECT project_id, COUNT(*) AS categories, SUM(n)::BIGINT AS listings, string_agg(category::VARCHAR, ', ' ORDER BY category) AS category_list FROM p GROUP BY 1 HAVING COUNT(*)>1""")
def _(s):
    return U.cross_category_projects(s.dim)


@query("project_concentration", "dim", """WITH i AS (SELECT category, project_id, COUNT(*) AS x FROM dim WHERE project_id IS NOT NULL GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY x) AS k, COUNT(*) OVER (PARTITION BY category) AS n FROM i)
SELECT category, COUNT(*) AS projects, MAX(x) AS max_items, round(AVG(x),6) AS avg_items, round(median(x),6) AS median_items, round(SUM((2*k-n-1)*x)::DOUBLE/(MAX(n)*SUM(x)),6) AS gini FROM r GROUP BY 1""")
def _(s):
    return U.project_concentration(s.dim)


@query("project_profile", "dim", """WITH l AS (SELECT (project_id IS NOT NULL)::INT AS has_project, unnest([{'variable':'area_sqm','value':area_sqm},{'variable':'images_count','value':images_count}]) AS p FROM dim)
SELECT has_project, p.variable AS variable, COUNT(p.value) AS n, round(AVG(p.value),6) AS mean, round(quantile_cont(p.value,0.25),6) AS p25, round(quantile_cont(p.value,0.5),6) AS median, round(quantile_cont(p.value,0.75),6) AS p75 FROM l GROUP BY ALL""")
def _(s):
    return U.project_profile(s.dim, ["area_sqm", "images_count"])


@query("project_interest", "dim ev", f"""WITH u AS (SELECT (project_id IS NOT NULL)::INT AS has_project, user_id, MAX((event_type='pageview')::INT) AS v, MAX((event_type IN {EX})::INT) AS e FROM ev JOIN dim USING (item_id) GROUP BY 1,2)
SELECT has_project, COUNT(*) AS users, SUM(v)::BIGINT AS viewers, SUM(e)::BIGINT AS contacters, round(100.0*COUNT(*) FILTER (v=1 AND e=1)/NULLIF(SUM(v),0),6) AS viewer_contact_pct FROM u GROUP BY 1""")
def _(s):
    return U.project_interest(s.dim, s.ev)


# ---- regional portfolio -------------------------------------------------------------------------

RG = f"""md AS (SELECT MIN(date)+CAST(floor(DATE_DIFF('day',MIN(date),MAX(date))/2) AS INT) AS mid FROM ev), it AS (SELECT item_id, COUNT(*) FILTER (event_type IN {EX}) AS explicit, COUNT(*) FILTER (event_type IN {PO}) AS positive, COUNT(*) FILTER (event_type IN {EX} AND date<mid) AS explicit_h1, COUNT(*) FILTER (event_type IN {EX} AND date>=mid) AS explicit_h2,
 COUNT(*) FILTER (event_type IN {PO} AND date<mid) AS positive_h1, COUNT(*) FILTER (event_type IN {PO} AND date>=mid) AS positive_h2 FROM ev, md GROUP BY 1),
ce AS (SELECT coalesce(region,'Unknown') AS region, city_name, (coalesce(lower(city_name),'')='nation_1')::INT AS is_metro, category, ad_type, COUNT(*) AS listings, coalesce(SUM(explicit),0)::BIGINT AS explicit, coalesce(SUM(positive),0)::BIGINT AS positive, coalesce(SUM(explicit_h1),0)::BIGINT AS explicit_h1, coalesce(SUM(explicit_h2),0)::BIGINT AS explicit_h2,
 coalesce(SUM(positive_h1),0)::BIGINT AS positive_h1, coalesce(SUM(positive_h2),0)::BIGINT AS positive_h2 FROM dim LEFT JOIN region_map USING (city_name) LEFT JOIN it USING (item_id) GROUP BY 1,2,3,4,5),
ce1 AS (SELECT *, 1000.0*explicit/listings AS explicit_per_1k, 1000.0*positive/listings AS positive_per_1k FROM ce)"""
R6 = "* REPLACE (round(explicit_per_1k,6) AS explicit_per_1k, round(positive_per_1k,6) AS positive_per_1k)"


def cells(s):
    """The cell table, written once: every pool and quadrant below reads it instead of the events."""
    return durable(G.regional_totals(s.ev, s.dim, s.region, city_predicate("city_name", METRO)), "cells")


@query("regional_totals", "ev dim region_map", f"WITH {RG} SELECT {R6} FROM ce1")
def _(s):
    return cells(s)


@query("share_excluding_metro", "ev dim region_map", f"""WITH {RG} SELECT region, city_name, is_metro, category, ad_type, explicit, positive, CASE WHEN is_metro=0 THEN round(100.0*explicit/NULLIF(SUM(explicit) FILTER (is_metro=0) OVER w,0),6) END AS share_explicit_pct, CASE WHEN is_metro=1 THEN round(100.0*explicit/SUM(explicit) OVER (),6) END AS metro_explicit_nation_pct,
 CASE WHEN is_metro=0 THEN round(100.0*positive/NULLIF(SUM(positive) FILTER (is_metro=0) OVER w,0),6) END AS share_positive_pct, CASE WHEN is_metro=1 THEN round(100.0*positive/SUM(positive) OVER (),6) END AS metro_positive_nation_pct FROM ce1 WINDOW w AS (PARTITION BY region, category, ad_type)""")
def _(s):
    return G.share_excluding_metro(cells(s)).select(*G.CELL, "explicit", "positive", "share_explicit_pct", "metro_explicit_nation_pct", "share_positive_pct", "metro_positive_nation_pct")


def _gr(a: str, b: str) -> str:
    return f"CASE WHEN {a}<=0 AND {b}>0 THEN NULL WHEN {a}<=0 THEN 0.0 ELSE 100.0*({b}-{a})/{a} END"


HG = f"""{RG}, cv AS (SELECT *, explicit::DOUBLE/listings AS cvr_per_listing, explicit_h1::DOUBLE/listings AS cvr_h1, explicit_h2::DOUBLE/listings AS cvr_h2 FROM ce1),
hg AS (SELECT *, {_gr('explicit_h1','explicit_h2')} AS growth_explicit_pct, {_gr('positive_h1','positive_h2')} AS growth_positive_pct, {_gr('cvr_h1','cvr_h2')} AS growth_cvr_pct, (explicit_h1=0 AND explicit_h2>0)::INT AS is_new_market, (is_metro=0 AND listings>=2 AND explicit>=10)::INT AS eligible FROM cv)"""


@query("half_period_growth", "ev dim region_map", f"WITH {HG} SELECT region, city_name, category, ad_type, round(cvr_h1,6) AS cvr_h1, round(cvr_h2,6) AS cvr_h2, round(growth_explicit_pct,6) AS growth_explicit_pct, round(growth_positive_pct,6) AS growth_positive_pct, round(growth_cvr_pct,6) AS growth_cvr_pct, is_new_market FROM hg")
def _(s):
    return G.half_period_growth(cells(s)).select(
        "region", "city_name", "category", "ad_type", "cvr_h1", "cvr_h2", "growth_explicit_pct", "growth_positive_pct", "growth_cvr_pct", "is_new_market")


def _pool(name: str, keys: str) -> str:
    grp = f"GROUP BY {keys}" if keys else ""
    pre = f"{keys}, " if keys else ""
    return (f"pl_{name} AS (SELECT {pre}COUNT(*) AS n_{name}, quantile_cont(growth_cvr_pct,0.5) AS g_{name}, quantile_cont(explicit_per_1k,0.5)/MAX(explicit_per_1k) AS r_{name}, "
            f"MAX(explicit_per_1k) AS k_{name}, quantile_cont(cvr_per_listing,0.5) AS c_{name} FROM hg WHERE eligible=1 {grp})")


def _pick(p: str) -> str:
    return "CASE " + " ".join(f"WHEN n_{n}>=2 THEN {p}_{n}" for n, _k in G.SCOPES) + " END"


POOLS = ", ".join(_pool(n, ", ".join(k)) for n, k in G.SCOPES)
JOINS = " ".join(f"LEFT JOIN pl_{n} USING ({', '.join(k)})" for n, k in G.SCOPES if k) + " CROSS JOIN pl_national_all"
SCOPE = "CASE " + " ".join(f"WHEN n_{n}>=2 THEN '{n}'" for n, _k in G.SCOPES) + " ELSE 'none' END"
RP = f"""{HG}, {POOLS}, r0 AS (SELECT *, {SCOPE} AS median_scope, {_pick('g')} AS median_growth, {_pick('r')} AS median_relative, {_pick('k')} AS pool_peak FROM hg {JOINS}),
rp AS (SELECT *, CASE median_scope WHEN 'national_cat' THEN c_national_cat WHEN 'national_ad' THEN c_national_ad WHEN 'national_all' THEN c_national_all ELSE c_national_cat_ad END AS cvr_target,
 CASE WHEN eligible=1 AND pool_peak>0 THEN explicit_per_1k/pool_peak END AS relative_cvr FROM r0),
co AS (SELECT *, CASE WHEN is_metro=1 THEN 'metro_excluded' WHEN eligible=0 THEN 'low_volume' WHEN is_new_market=1 THEN 'question_marks' WHEN median_growth IS NULL OR median_relative IS NULL THEN 'low_volume' WHEN growth_cvr_pct IS NULL THEN 'question_marks'
 WHEN growth_cvr_pct>=median_growth AND coalesce(relative_cvr>=median_relative,false) THEN 'stars' WHEN coalesce(relative_cvr>=median_relative,false) THEN 'cash_cows' WHEN growth_cvr_pct>=median_growth THEN 'question_marks' ELSE 'dogs' END AS quadrant FROM rp)"""


@query("reference_median_pool", "ev dim region_map", f"WITH {RP} SELECT region, city_name, category, ad_type, eligible, median_scope, round(median_growth,6) AS median_growth, round(median_relative,6) AS median_relative, round(relative_cvr,6) AS relative_cvr, round(cvr_target,6) AS cvr_target FROM rp")
def _(s):
    return G.reference_median_pool(G.half_period_growth(cells(s)), 2, 10).select(
        "region", "city_name", "category", "ad_type", "eligible", "median_scope", "median_growth", "median_relative", "relative_cvr", "cvr_target")


def quads(s):
    return G.portfolio_quadrants(cells(s), 2, 10)


@query("portfolio_quadrants", "ev dim region_map", f"WITH {RP} SELECT region, city_name, category, ad_type, listings, explicit, median_scope, quadrant FROM co")
def _(s):
    return quads(s).select("region", "city_name", "category", "ad_type", "listings", "explicit", "median_scope", "quadrant")


ACT = f"""{RP}, sv0 AS (SELECT coalesce(region,'Unknown') AS region, city_name, category, ad_type, COUNT(*) FILTER (explicit_h1>0) AS h1, COUNT(*) FILTER (explicit_h1>0 AND explicit_h2>0) AS hb FROM it JOIN dim USING (item_id) LEFT JOIN region_map USING (city_name) GROUP BY 1,2,3,4),
sv AS (SELECT *, hb::DOUBLE/NULLIF(h1,0) AS survival_rate FROM sv0), ar AS (SELECT co.*, survival_rate, CASE WHEN survival_rate<0.3 THEN 'unstable_growth' ELSE 'stable' END AS growth_quality FROM co LEFT JOIN sv USING (region, city_name, category, ad_type) WHERE eligible=1 AND quadrant IN ('stars','cash_cows','question_marks','dogs')),
a1 AS (SELECT *, coalesce(growth_cvr_pct>median_growth*0.95 AND growth_cvr_pct<median_growth*1.05 AND relative_cvr IS NOT NULL,false) AS ng, coalesce(relative_cvr>median_relative*0.95 AND relative_cvr<median_relative*1.05 AND growth_cvr_pct IS NOT NULL,false) AS ns,
 coalesce(GREATEST(0,(cvr_target-cvr_per_listing)*listings),0) AS uplift_explicit, CASE WHEN quadrant IN ('stars','cash_cows') AND growth_cvr_pct<median_growth THEN explicit*(median_growth-growth_cvr_pct)/100.0 ELSE 0 END AS priority_defend FROM ar),
a2 AS (SELECT *, CASE WHEN ng AND ns THEN 'both' WHEN ng THEN 'growth' WHEN ns THEN 'cvr' ELSE '' END AS borderline_axis, uplift_explicit*CASE quadrant WHEN 'stars' THEN 1.0 WHEN 'cash_cows' THEN 0.95 WHEN 'question_marks' THEN 0.85 ELSE 0.5 END*CASE WHEN survival_rate<0.3 THEN 0.7 ELSE 1.0 END AS priority_impact,
 CASE WHEN growth_cvr_pct IS NULL OR median_growth IS NULL OR relative_cvr IS NULL OR median_relative IS NULL THEN 'unknown' WHEN growth_cvr_pct<median_growth AND relative_cvr<median_relative THEN 'both' WHEN growth_cvr_pct<median_growth THEN 'growth' WHEN relative_cvr<median_relative THEN 'cvr' ELSE 'none' END AS primary_weakness FROM a1),
ac AS (SELECT *, (rank() OVER (ORDER BY explicit)+(COUNT(*) OVER (PARTITION BY explicit)-1)/2.0)/COUNT(*) OVER ()*100 AS explicit_pct_rank, row_number() OVER (ORDER BY priority_defend DESC, region, city_name, category, ad_type) AS dr, (SELECT quantile_cont(explicit,0.75) FROM a2) AS p75, (SELECT quantile_cont(priority_impact,0.8) FROM a2) AS p80 FROM a2)"""


def action(s):
    q = durable(quads(s), "quadrants")
    placed = G.alias_lookup(s.dim.select("item_id", "city_name", "category", "ad_type"), s.region, "city_name", "region")
    survival = L.listing_survival_halves(s.ev, placed, ["region", "city_name", "category", "ad_type"], G.period_middle(s.ev))
    return G.action_matrix(q, survival)


@query("action_matrix", "ev dim region_map", f"""WITH {ACT} SELECT region, city_name, category, ad_type, quadrant, borderline_axis, round(growth_cvr_pct-median_growth,6) AS growth_gap_pp, round(relative_cvr-median_relative,6) AS cvr_gap, round(uplift_explicit,6) AS uplift_explicit, round(priority_impact,6) AS priority_impact, round(priority_defend,6) AS priority_defend,
 primary_weakness, growth_quality, round(explicit_pct_rank,6) AS explicit_pct_rank, (priority_impact>=p80 OR dr<=10 OR (quadrant IN ('question_marks','dogs') AND explicit>=p75))::INT AS deep_dive FROM ac""")
def _(s):
    return action(s).select("region", "city_name", "category", "ad_type", "quadrant", "borderline_axis", "growth_gap_pp", "cvr_gap", "uplift_explicit", "priority_impact",
                            "priority_defend", "primary_weakness", "growth_quality", "explicit_pct_rank", "deep_dive")


@query("peer_top3", "ev dim region_map", f"""WITH {ACT}, pr AS (SELECT a.region, a.city_name, a.category, a.ad_type, a.quadrant, b.city_name||'('||round(b.cvr_per_listing,1)::VARCHAR||')' AS l, row_number() OVER (PARTITION BY a.region, a.city_name, a.category, a.ad_type ORDER BY b.explicit DESC, b.city_name) AS r
 FROM ac a LEFT JOIN ac b ON a.category=b.category AND a.ad_type=b.ad_type AND a.quadrant=b.quadrant AND a.city_name<>b.city_name)
SELECT region, city_name, category, ad_type, quadrant, coalesce(string_agg(l,'; ' ORDER BY r) FILTER (r<=3),'') AS peers FROM pr GROUP BY 1,2,3,4,5""")
def _(s):
    return G.peer_top3(action(s))


@query("quadrant_profiles", "ev dim region_map", f"""WITH {ACT} SELECT quadrant, COUNT(*) AS cells, SUM(explicit)::BIGINT AS explicit, round(median(cvr_per_listing),6) AS median_cvr, round(median(growth_cvr_pct),6) AS median_growth, median(listings) AS median_listings, round(100.0*AVG((borderline_axis<>'')::INT),6) AS borderline_pct,
 round(100.0*AVG((growth_quality='unstable_growth')::INT),6) AS unstable_pct, round(median(priority_impact),6) AS median_impact FROM ac GROUP BY 1""")
def _(s):
    return G.quadrant_profiles(action(s))


def _px(rate: str, growth: str) -> str:
    return (f"CASE WHEN median_growth IS NULL OR median_relative IS NULL OR pool_peak IS NULL OR pool_peak<=0 THEN 'low_volume' WHEN {growth}>=median_growth AND 1000.0*{rate}/pool_peak>=median_relative THEN 'stars' "
            f"WHEN 1000.0*{rate}/pool_peak>=median_relative THEN 'cash_cows' WHEN {growth}>=median_growth THEN 'question_marks' ELSE 'dogs' END")


@query("migration_table", "ev dim region_map", f"""WITH {RP} SELECT region, city_name, category, ad_type, quadrant, median_scope, {_px('cvr_h1','0.0')} AS quadrant_h1, {_px('cvr_h2','coalesce(growth_cvr_pct,0.0)')} AS quadrant_h2,
 CASE WHEN explicit_h2=explicit_h1 THEN 'flat' WHEN explicit_h2>explicit_h1 THEN 'up' ELSE 'down' END AS migration FROM co WHERE eligible=1 AND median_scope<>'none'""")
def _(s):
    return G.migration_table(quads(s))


@query("city_quadrant_summary", "ev dim region_map", f"""WITH {RP}, p AS (SELECT region, city_name, is_metro, quadrant, SUM(explicit) AS e, COUNT(*) AS n FROM co GROUP BY 1,2,3,4)
SELECT region, city_name, is_metro, CASE WHEN is_metro=1 THEN 'metro_excluded' ELSE coalesce(arg_min(quadrant,(-e,quadrant)) FILTER (quadrant IN ('stars','cash_cows','question_marks','dogs')), arg_min(quadrant,(-n,quadrant))) END AS quadrant FROM p GROUP BY 1,2,3""")
def _(s):
    return G.city_quadrant_summary(quads(s))


@query("quadrant_wide", "ev dim region_map", f"""WITH {RP} SELECT region, city_name, """ + ", ".join(f"MAX(quadrant) FILTER (category={c} AND ad_type='{a}') AS q_{c}_{a}" for c in (1010, 1020) for a in ("sell", "let")) + " FROM co GROUP BY 1,2")
def _(s):
    return G.quadrant_wide(quads(s), [1010, 1020], ["sell", "let"])


@query("slice_totals", "ev dim region_map", f"""WITH {RG} SELECT region, city_name, is_metro, SUM(explicit)::BIGINT AS explicit, SUM(positive)::BIGINT AS positive, SUM(listings)::BIGINT AS listings, round(100.0*SUM(explicit)/SUM(SUM(explicit)) OVER (),6) AS explicit_pct, round(1000.0*SUM(explicit)/SUM(listings),6) AS explicit_per_1k FROM ce1 GROUP BY 1,2,3""")
def _(s):
    return G.slice_totals(cells(s))
