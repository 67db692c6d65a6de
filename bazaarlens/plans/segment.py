"""Segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive
from bazaarlens.operators import segment as E
from bazaarlens.plans.primitives import EX, PO
from bazaarlens.plans.registry import query
from bazaarlens.schemas import CATEGORIES
from bazaarlens.session import durable

PV = "event_type='pageview'"
USER_COLUMNS = ["n_sessions", "n_listings", "n_districts", "district_entropy", "contact_rate_pct", "weekend_pct", "night_pct", "avg_dwell",
                "avg_position", "avg_area", "avg_bedrooms", "let_pct"]
UF = f"""ue AS (SELECT e.*, d.district_name, area_sqm, bedrooms, ad_type, (event_type IN {EX})::INT AS contact, ({PV})::INT AS pv FROM ev e JOIN dim d USING (item_id)),
ub AS (SELECT user_id, category, COUNT(*) AS n_events, COUNT(DISTINCT session_id) AS n_sessions, COUNT(DISTINCT item_id) AS n_listings, COUNT(DISTINCT district_name) AS n_districts, SUM(pv)::BIGINT AS n_pageviews, SUM(contact)::BIGINT AS n_contacts, SUM((pv=1 AND coalesce(trim(query)<>'',false))::INT)::BIGINT AS n_searches,
 100.0*SUM(contact)/NULLIF(SUM(pv),0) AS contact_rate_pct, 100.0*AVG((isodow(event_ts)>=6)::INT) AS weekend_pct, 100.0*AVG((hour(event_ts)>=22 OR hour(event_ts)<6)::INT) AS night_pct, AVG(CASE WHEN pv=1 THEN dwell_time_sec END) AS avg_dwell, AVG(CASE WHEN pv=1 THEN position END) AS avg_position,
 AVG(area_sqm) AS avg_area, AVG(bedrooms) AS avg_bedrooms, 100.0*AVG((ad_type='let')::INT) AS let_pct FROM ue GROUP BY 1,2 HAVING COUNT(*)>=5),
dc AS (SELECT user_id, category, COUNT(*)::DOUBLE/SUM(COUNT(*)) OVER (PARTITION BY user_id, category) AS p FROM ue WHERE district_name IS NOT NULL GROUP BY user_id, category, district_name), en AS (SELECT user_id, category, -SUM(p*ln(p)) AS h FROM dc GROUP BY 1,2),
uf AS (SELECT ub.*, coalesce(h,0) AS district_entropy FROM ub LEFT JOIN en USING (user_id, category))"""
RND = ", ".join(f"round({c},6) AS {c}" for c in ("contact_rate_pct", "weekend_pct", "night_pct", "avg_dwell", "avg_position", "avg_area", "avg_bedrooms", "let_pct"))


@query("user_intent_features", "ev dim", f"WITH {UF} SELECT user_id, category, n_events, n_sessions, n_listings, n_districts, n_pageviews, n_contacts, n_searches, {RND}, round(GREATEST(district_entropy,0),6)+0.0 AS district_entropy FROM uf")
def _(s):
    return E.user_intent_features(s.ev, s.dim)


LF = f"""lb AS (SELECT item_id, category, COUNT(*) FILTER ({PV}) AS n_pageviews, COUNT(*) FILTER (event_type IN {EX}) AS n_contacts, COUNT(DISTINCT user_id) AS n_users, AVG(CASE WHEN {PV} THEN dwell_time_sec END) AS avg_dwell, AVG(CASE WHEN {PV} THEN position END) AS avg_position,
 100.0*COUNT(*) FILTER (event_type IN {EX})/NULLIF(COUNT(*) FILTER ({PV}),0) AS contact_rate_pct FROM ev GROUP BY 1,2 HAVING COUNT(*) FILTER ({PV})>=5),
rp AS (SELECT item_id, 100.0*COUNT(*) FILTER (pv>1)/COUNT(*) AS repeat_viewer_pct FROM (SELECT item_id, user_id, COUNT(*) FILTER ({PV}) AS pv FROM ev GROUP BY 1,2) GROUP BY 1),
sm AS (SELECT item_id, median(views_24h) AS median_views, median(contacts_24h) AS median_contacts, median(listing_age_days) AS median_age FROM snap GROUP BY 1),
lf AS (SELECT lb.*, ad_type, area_sqm, district_name, seller_type, repeat_viewer_pct, median_views, median_contacts, median_age FROM lb JOIN dim USING (item_id) LEFT JOIN rp USING (item_id) LEFT JOIN sm USING (item_id))"""
LR = "item_id, category, n_pageviews, n_contacts, n_users, round(avg_dwell,6) AS avg_dwell, round(avg_position,6) AS avg_position, round(contact_rate_pct,6) AS contact_rate_pct, ad_type, area_sqm, district_name, seller_type, round(repeat_viewer_pct,6) AS repeat_viewer_pct, median_views, median_contacts, median_age"


def listings(s):
    return E.listing_behavior_features(s.ev, s.dim, s.snap)


@query("listing_behavior_features", "ev dim snap", f"WITH {LF.replace('lb.*, ad_type', 'lb.*, dim.ad_type')} SELECT {LR} FROM (SELECT item_id, lf.* EXCLUDE (item_id) FROM lf)")
def _(s):
    return listings(s)


@query("seller_features", "ev dim", f"""WITH i AS (SELECT item_id, COUNT(*) FILTER ({PV}) AS pv, COUNT(*) FILTER (event_type IN {EX}) AS ct, 100.0*COUNT(*) FILTER (event_type IN {EX})/NULLIF(COUNT(*) FILTER ({PV}),0) AS r FROM ev GROUP BY 1),
b AS (SELECT seller_id, d.category, seller_type, COUNT(*) AS n_listings, coalesce(SUM(pv),0)::BIGINT AS pageviews, coalesce(SUM(ct),0)::BIGINT AS contacts, round(AVG(coalesce(r,0)),6) AS avg_listing_rate FROM dim d LEFT JOIN i USING (item_id) WHERE seller_id IS NOT NULL GROUP BY 1,2,3 HAVING COUNT(*)>=3)
SELECT *, round(contacts::DOUBLE/n_listings,6) AS contacts_per_listing, round(pageviews::DOUBLE/n_listings,6) AS pageviews_per_listing FROM b""")
def _(s):
    return E.seller_features(s.ev, s.dim)


SF = f"""sf0 AS (SELECT session_id, category, MAX(device) AS device, COUNT(*) AS n_events, COUNT(DISTINCT item_id) AS n_items, MAX(({PV} AND coalesce(trim(query)<>'',false))::INT) AS has_search, MAX((event_type IN {EX})::INT) AS has_contact, COUNT(*) FILTER ({PV}) AS n_pageviews,
 MAX(dwell_time_sec) AS max_dwell, AVG(CASE WHEN {PV} THEN dwell_time_sec END) AS avg_dwell, (epoch_us(MAX(event_ts))-epoch_us(MIN(event_ts)))/6e7 AS duration_min FROM ev GROUP BY 1,2 HAVING COUNT(*)>=2),
sf AS (SELECT *, (n_items>=3 AND coalesce(max_dwell,0)>=60)::INT AS deep_compare, (n_pageviews>=2 AND has_contact=0 AND coalesce(avg_dwell,0)<15)::INT AS bounce_like FROM sf0)"""


@query("session_journey_features", "ev", f"WITH {SF} SELECT * REPLACE (round(avg_dwell,6) AS avg_dwell, round(duration_min,6) AS duration_min) FROM sf")
def _(s):
    return E.session_journey_features(s.ev, 2)


@query("behavioral_clusters")
def _(s):
    users = E.user_intent_features(s.ev, s.dim, 3)
    return E.cluster_profiles(E.behavioral_clusters(users, "user_id", USER_COLUMNS, CATEGORIES, k=4), USER_COLUMNS)


@query("rule_labels", "ev dim snap", f"""WITH {UF}, {LF}, u AS (SELECT 'user' AS entity, category, CASE WHEN contact_rate_pct>=8 AND n_contacts>=2 THEN 'High-intent / urgent' WHEN coalesce(contact_rate_pct,0)<1 AND n_pageviews>=15 THEN 'Window shopper' WHEN district_entropy>=1.8 THEN 'Geo explorer' WHEN night_pct>=40 THEN 'Night-active searcher'
 WHEN avg_area>=120 THEN 'Large-space seeker' ELSE 'Typical browser' END AS label FROM uf),
l AS (SELECT 'listing' AS entity, category, CASE WHEN coalesce(contact_rate_pct,0)>=25 AND n_pageviews>=20 THEN 'High-conversion gem' WHEN n_pageviews>=50 AND coalesce(contact_rate_pct,0)<3 THEN 'Clickbait / high view low contact' WHEN CASE WHEN coalesce(median_age,0)=0 THEN 999 ELSE median_age END<=7 AND coalesce(contact_rate_pct,0)>=10 THEN 'Fresh fast-moving'
 WHEN CASE WHEN coalesce(median_age,0)=0 THEN 999 ELSE median_age END>=60 AND n_pageviews<15 THEN 'Cold inventory' ELSE 'Evergreen average' END AS label FROM lf)
SELECT entity, category, label, COUNT(*) AS n FROM (SELECT * FROM u UNION ALL SELECT * FROM l) GROUP BY 1,2,3""")
def _(s):
    users = E.user_intent_features(s.ev, s.dim).select(F.lit("user").alias("entity"), "category", E.user_rule_label().alias("label"))
    items = listings(s).select(F.lit("listing").alias("entity"), "category", E.listing_rule_label().alias("label"))
    return users.unionByName(items).groupBy("entity", "category", "label").agg(F.count("*").alias("n"))


def _prank(c: str, out: str) -> str:
    return f"(rank() OVER (PARTITION BY category ORDER BY {c})+(COUNT(*) OVER (PARTITION BY category, {c})-1)/2.0)/COUNT(*) OVER (PARTITION BY category) AS {out}"


HS = f"""{LF}, h0 AS (SELECT *, coalesce(median_views,n_pageviews::DOUBLE) AS exposure FROM lf), h1 AS (SELECT *, {_prank('contact_rate_pct','contact_rank')}, {_prank('exposure','exposure_rank')} FROM h0),
hs AS (SELECT *, CASE WHEN contact_rank<=0.25 AND exposure_rank>=0.75 THEN 'oversaturated_low_conversion' WHEN contact_rank>=0.6 AND exposure_rank<=0.35 THEN 'x' ELSE 'normal' END AS health_segment, (item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO}))::INT AS has_positive, (n_pageviews%3)::INT AS cluster FROM h1)""".replace(
    "contact_rank>=0.6 AND exposure_rank<=0.35 THEN 'x'", "contact_rank>=0.75 AND exposure_rank<=0.35 THEN 'high_quality_underexposed'")


def health(s):
    """The listing health table, written once: its ranks and medians are read by several branches."""
    return durable(E.with_positive(E.health_segments(listings(s)), s.ev).withColumn("cluster", (F.col("n_pageviews") % 3).cast("int")), "health")


@query("health_segments", "ev dim snap", f"WITH {HS} SELECT item_id, category, round(contact_rank,6) AS contact_rank, round(exposure_rank,6) AS exposure_rank, health_segment FROM hs")
def _(s):
    return E.health_segments(listings(s)).select("item_id", "category", "contact_rank", "exposure_rank", "health_segment")


@query("segment_bridge", "ev dim snap", f"WITH {HS} SELECT category, health_segment, cluster, ad_type, COUNT(*) AS n, SUM(has_positive)::BIGINT AS n_positive, round(100.0*AVG(has_positive),6) AS cvr_pct FROM hs GROUP BY 1,2,3,4 HAVING COUNT(*)>=2")
def _(s):
    return E.segment_bridge(health(s), ["category", "health_segment", "cluster", "ad_type"], 2)


EF = "ef AS (SELECT category, health_segment, COUNT(*) AS n, AVG(contact_rate_pct) AS avg_rate, AVG(exposure) AS avg_exposure, AVG(n_pageviews) AS avg_pageviews, AVG(n_users) AS avg_users, AVG(repeat_viewer_pct) AS avg_repeat, AVG(median_age) AS avg_age, median(contact_rate_pct) AS med_rate, median(exposure) AS med_exposure FROM hs GROUP BY 1,2)"


@query("segment_efficiency", "ev dim snap", f"WITH {HS}, {EF} SELECT category, health_segment, n, " + ", ".join(f"round({c},6) AS {c}" for c in ("avg_rate", "avg_exposure", "avg_pageviews", "avg_users", "avg_repeat", "avg_age", "med_rate", "med_exposure")) + " FROM ef")
def _(s):
    return E.segment_efficiency(health(s))


@query("ranked_underexposed", "ev dim snap", f"""WITH {HS} SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY contact_rank-exposure_rank DESC, item_id)::INT AS rank, round(contact_rank-exposure_rank,6) AS lift_score, round(contact_rate_pct,6) AS contact_rate_pct, exposure, has_positive
FROM hs WHERE health_segment='high_quality_underexposed' QUALIFY rank<=500""")
def _(s):
    return E.ranked_underexposed(health(s))


@query("user_positive_rate", "ev dim", f"""WITH {UF}, p AS (SELECT DISTINCT user_id, category FROM ev WHERE event_type IN {PO}) SELECT category, (n_events%3)::INT AS cluster, COUNT(*) AS users, round(100.0*AVG(((user_id, category) IN (SELECT (user_id, category) FROM p))::INT),6) AS positive_pct FROM uf GROUP BY 1,2""")
def _(s):
    users = E.user_intent_features(s.ev, s.dim).withColumn("cluster", (F.col("n_events") % 3).cast("int"))
    return E.user_positive_rate(users, s.ev, "cluster")


@query("session_funnel_by_cluster", "ev dim", f"""WITH {SF}, {UF}, o AS (SELECT session_id, category, MAX(user_id) AS user_id FROM ev GROUP BY 1,2), j AS (SELECT sf.*, coalesce((uf.n_events%3)::INT,-1) AS cluster FROM sf JOIN o USING (session_id, category) LEFT JOIN uf USING (user_id, category))
SELECT category, cluster, COUNT(*) AS sessions, round(100.0*AVG(has_contact),6) AS has_contact_pct, round(100.0*AVG(has_search),6) AS has_search_pct, round(100.0*AVG(deep_compare),6) AS deep_compare_pct, round(100.0*AVG(bounce_like),6) AS bounce_like_pct FROM j GROUP BY 1,2""")
def _(s):
    users = E.user_intent_features(s.ev, s.dim).withColumn("cluster", (F.col("n_events") % 3).cast("int"))
    return E.session_funnel_by_cluster(s.ev, E.session_journey_features(s.ev, 2, owner=True), users)


@query("what_if_impacts", "ev dim snap", f"""WITH {HS}, {EF}, w AS (SELECT category, MAX(CASE WHEN health_segment='high_quality_underexposed' THEN n*avg_pageviews*GREATEST(40-med_exposure,0)*avg_rate/100.0*0.35 END) AS boost, MAX(CASE WHEN health_segment='oversaturated_low_conversion' THEN n*med_exposure*avg_pageviews*0.25 END) AS demote FROM ef GROUP BY 1),
l AS (SELECT category, COUNT(DISTINCT session_id)*0.01 AS sess FROM ev GROUP BY 1), k AS (SELECT category, COUNT(*)*0.02 AS weak FROM dim WHERE ad_type='let' AND bedrooms=1 GROUP BY 1), j AS (SELECT * FROM w LEFT JOIN l USING (category) LEFT JOIN k USING (category))
SELECT category, 'boost_underexposed' AS scenario, round(coalesce(boost,0),6) AS value, 'contact events' AS unit FROM j UNION ALL SELECT category, 'session_plus_1pp', round(coalesce(sess,0)::DOUBLE,6), 'sessions with contact' FROM j
UNION ALL SELECT category, 'demote_oversaturated', round(coalesce(demote,0),6), 'impressions saved' FROM j UNION ALL SELECT category, 'weak_slice_lift', round(coalesce(weak,0)::DOUBLE,6), 'listings with contact' FROM j""")
def _(s):
    slices = s.dim.filter("ad_type = 'let' AND bedrooms = 1").groupBy("category").agg(F.count("*").alias("listings"))
    return E.what_if_impacts(E.segment_efficiency(health(s)), s.ev, slices, target_exposure=40.0)


ACO = f"uc AS (SELECT user_id, COUNT(*) AS x FROM ev WHERE event_type IN {PO} GROUP BY 1), q AS (SELECT quantile_cont(x,0.33) AS lo, quantile_cont(x,0.67) AS hi FROM uc), co AS (SELECT user_id, x, CASE WHEN x<=lo THEN 'cold' WHEN x<=hi THEN 'warm' ELSE 'hot' END AS cohort FROM uc, q)"


def cohorts(s):
    return E.activity_cohorts(s.ev.filter(is_positive()).groupBy("user_id").agg(F.count("*").alias("x")), "x")


@query("activity_cohorts", "ev", f"WITH {ACO} SELECT cohort, COUNT(*) AS users, MIN(x) AS lo, MAX(x) AS hi FROM co GROUP BY 1")
def _(s):
    return cohorts(s).groupBy("cohort").agg(F.count("*").alias("users"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("cohort_scores", "ev", f"WITH {ACO} SELECT cohort, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, round(median(dwell_time_sec),6) AS median, round(quantile_cont(dwell_time_sec,0.25),6) AS q25, round(quantile_cont(dwell_time_sec,0.75),6) AS q75 FROM ev JOIN co USING (user_id) GROUP BY 1")
def _(s):
    return E.cohort_scores(s.ev.select("user_id", F.col("dwell_time_sec").alias("score")), cohorts(s))


@query("item_tiers", "dim ev snap", f"""WITH e AS (SELECT item_id, COUNT(*) AS n_pos, MAX(date) AS le FROM ev WHERE event_type IN {PO} GROUP BY 1), s AS (SELECT item_id, SUM(contacts_24h) AS c FROM snap GROUP BY 1),
j AS (SELECT dim.*, coalesce(n_pos,0) AS n_pos, le, coalesce(c,0) AS contacts_total FROM dim LEFT JOIN e USING (item_id) LEFT JOIN s USING (item_id)), d AS (SELECT *, (n_pos=0 AND contacts_total=0) OR ad_status='deleted' AS dead FROM j)
SELECT item_id, n_pos, contacts_total, DATE_DIFF('day',posted_date,DATE'2024-01-30')::INT AS age_days, (posted_date<DATE'2023-12-01')::INT AS is_pre_window, CASE WHEN dead THEN 'D' WHEN n_pos>0 AND DATE_DIFF('day',le,DATE'2024-01-30')<=5 THEN 'A' WHEN n_pos>0 THEN 'B' ELSE 'C' END AS tier FROM d""")
def _(s):
    return E.item_tiers(s.dim, s.ev, s.snap, "2024-01-30", "2023-12-01", 5).select("item_id", "n_pos", "contacts_total", "age_days", "is_pre_window", "tier")


# ---- clusters by density -------------------------------------------------------------------------

LISTING_COLUMNS = ["n_pageviews", "n_contacts", "n_users", "avg_dwell", "avg_position", "contact_rate_pct", "repeat_viewer_pct"]


def user_clusters(s):
    """Users of each category clustered by the density of their behavior, written once."""
    users = E.user_intent_features(s.ev, s.dim)
    return durable(E.density_clusters(durable(E.projected(users, "user_id", USER_COLUMNS, CATEGORIES), "points")), "userclusters")


@query("density_clusters")
def _(s):
    return E.cluster_profiles(user_clusters(s), USER_COLUMNS)


@query("segment_bridge_clusters")
def _(s):
    """CVR of listings by health segment and the cluster of their behavior."""
    rows = durable(E.with_positive(E.health_segments(listings(s)), s.ev), "health")
    clusters = E.density_clusters(E.projected(rows, "item_id", LISTING_COLUMNS, CATEGORIES)).select("item_id", "cluster")
    return E.segment_bridge(rows.join(clusters, "item_id"), ["category", "health_segment", "cluster", "ad_type"], 2)


@query("user_positive_rate_clusters")
def _(s):
    return E.user_positive_rate(user_clusters(s), s.ev, "cluster")


@query("session_funnel_clusters")
def _(s):
    return E.session_funnel_by_cluster(s.ev, E.session_journey_features(s.ev, 2, owner=True), user_clusters(s))
