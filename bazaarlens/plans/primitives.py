"""Projection, join, aggregation, window, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions import buckets as B
from bazaarlens.functions.columns import (
    flag, is_explicit, is_other, is_pageview, is_positive, width_bin,
)
from bazaarlens.operators import joins as J
from bazaarlens.operators import sets as S
from bazaarlens.operators import stats as A
from bazaarlens.operators import windows as N
from bazaarlens.operators.core import join_keys, quantiles
from bazaarlens.plans.registry import query
from bazaarlens.schemas import CATEGORIES, POSITIVE

EX = "('view_phone','contact_chat','contact_zalo','contact_sms')"
PO = "('view_phone','contact_chat','other_interaction','contact_zalo','contact_sms')"
CNT = "COUNT(*) AS n"


# ---- projections and buckets -------------------------------------------------------------------

@query("event_filters", "ev", f"""
SELECT category, event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM ev
WHERE category IN (1010,1020,1030,1040,1050) AND event_type IN {PO} AND is_login = 'login'
  AND date BETWEEN DATE'2024-01-05' AND DATE'2024-01-25' AND item_id IS NOT NULL GROUP BY ALL""")
def _(s):
    rows = B.event_filters(s.ev, CATEGORIES, POSITIVE, True, "2024-01-05", "2024-01-25", ["item_id"])
    return rows.groupBy("category", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("exclude_window", "ev", """
SELECT date::VARCHAR AS date, COUNT(*) AS n FROM ev
WHERE NOT (event_ts >= TIMESTAMP'2024-01-14' AND event_ts < TIMESTAMP'2024-01-18 12:00:00') GROUP BY ALL""")
def _(s):
    return B.exclude_window(s.ev, "event_ts", "2024-01-14", "2024-01-18 12:00:00").groupBy("date").agg(F.count("*").alias("n"))


@query("event_layer", "ev", f"""
WITH c AS (SELECT category, CASE WHEN event_type='pageview' THEN 'pageview' WHEN event_type='other_interaction' THEN 'other_interaction'
  WHEN event_type IN {EX} THEN 'explicit_contact' ELSE 'other_event_type' END AS layer,
  COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT session_id) AS sessions FROM ev GROUP BY 1,2)
SELECT *, round(100.0*n/SUM(n) OVER (PARTITION BY category),6) AS volume_pct FROM c""")
def _(s):
    rows = s.ev.withColumn("layer", B.event_layer()).groupBy("category", "layer").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions"))
    return A.share_within(rows, ["category"], "n", "volume_pct")


@query("event_flags", "ev dim", f"""
SELECT d.ad_type, hour(event_ts)::INT AS hour, SUM((event_type IN {PO})::INT)::BIGINT AS positives,
 SUM((event_type='pageview')::INT)::BIGINT AS pageviews,
 SUM((event_type='pageview' AND query IS NOT NULL AND trim(query)<>'')::INT)::BIGINT AS searches,
 SUM((isodow(event_ts)>=6)::INT)::BIGINT AS weekend, SUM((hour(event_ts)>=22 OR hour(event_ts)<6)::INT)::BIGINT AS night
FROM ev JOIN dim d USING (item_id) GROUP BY ALL""")
def _(s):
    rows = J.enrich_events(B.event_flags(s.ev), s.dim, ["ad_type"])
    return rows.groupBy("ad_type", "hour").agg(
        F.sum("is_positive").alias("positives"), F.sum("is_pageview").alias("pageviews"), F.sum("is_search").alias("searches"),
        F.sum("is_weekend").alias("weekend"), F.sum("is_night").alias("night"))


@query("age_bucket", "snap", """
SELECT CASE WHEN listing_age_days IS NULL THEN 'unk' WHEN listing_age_days<=2 THEN '0-2d' WHEN listing_age_days<=7 THEN '3-7d'
 WHEN listing_age_days<=14 THEN '8-14d' WHEN listing_age_days<=30 THEN '15-30d' WHEN listing_age_days<=60 THEN '31-60d' ELSE '60+d' END AS age_bucket,
 COUNT(*) AS n FROM snap GROUP BY 1""")
def _(s):
    return s.snap.groupBy(B.age_bucket("listing_age_days").alias("age_bucket")).agg(F.count("*").alias("n"))


@query("area_bucket", "dim", """
SELECT category, CASE WHEN area_sqm IS NULL THEN NULL WHEN area_sqm<20 THEN '<20' WHEN area_sqm<30 THEN '20-30' WHEN area_sqm<45 THEN '30-45'
 WHEN area_sqm<60 THEN '45-60' WHEN area_sqm<80 THEN '60-80' WHEN area_sqm<100 THEN '80-100' WHEN area_sqm<150 THEN '100-150'
 WHEN area_sqm<200 THEN '150-200' WHEN area_sqm<300 THEN '200-300' WHEN area_sqm<500 THEN '300-500' ELSE '>500' END AS area_bucket,
 COUNT(*) AS n FROM dim GROUP BY 1,2""")
def _(s):
    return s.dim.groupBy("category", B.area_bucket("area_sqm").alias("area_bucket")).agg(F.count("*").alias("n"))


@query("structure_buckets", "dim", """
SELECT CASE WHEN bedrooms IS NULL OR bedrooms<=0 THEN 'unknown_or_0' WHEN bedrooms<=1 THEN '1' WHEN bedrooms<=2 THEN '2' WHEN bedrooms<=3 THEN '3' ELSE '4+' END AS bed_bucket,
 CASE WHEN floors IS NULL OR floors<=0 THEN 'unknown_or_0' WHEN floors<=2 THEN '1-2' WHEN floors<=4 THEN '3-4' ELSE '5+' END AS floors_bucket,
 CASE WHEN area_sqm IS NULL OR area_sqm<=0 THEN 'unknown_or_0' WHEN area_sqm<30 THEN '<30' WHEN area_sqm<50 THEN '30-50' WHEN area_sqm<80 THEN '50-80' WHEN area_sqm<120 THEN '80-120' ELSE '120+' END AS area_bucket,
 COUNT(*) AS n, SUM((project_id IS NOT NULL)::INT)::BIGINT AS has_project, SUM((legal_status IS NOT NULL)::INT)::BIGINT AS has_legal,
 SUM((furnishing IS NOT NULL)::INT)::BIGINT AS has_furnishing, SUM((coalesce(width_m,0)>0)::INT)::BIGINT AS has_width FROM dim GROUP BY 1,2,3""")
def _(s):
    flags = ["has_project", "has_legal", "has_furnishing", "has_width"]
    return B.structure_buckets(s.dim).groupBy("bed_bucket", "floors_bucket", "area_bucket").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f) for f in flags])


@query("position_bucket", "ev", """
SELECT CASE WHEN position IS NULL THEN NULL WHEN position<=5 THEN '1-5' WHEN position<=10 THEN '6-10' WHEN position<=20 THEN '11-20' ELSE '21+' END AS position_bucket,
 COUNT(*) AS n FROM ev GROUP BY 1""")
def _(s):
    return s.ev.groupBy(B.position_bucket().alias("position_bucket")).agg(F.count("*").alias("n"))


@query("dwell_band", "ev", """
SELECT category, CASE WHEN dwell_time_sec IS NULL THEN 'unknown' WHEN dwell_time_sec<5 THEN 'bounce_<5s' WHEN dwell_time_sec<15 THEN 'skim_5-15s' ELSE 'engaged_15s+' END AS dwell_band,
 COUNT(*) AS n FROM ev WHERE event_type='pageview' GROUP BY 1,2""")
def _(s):
    return s.ev.filter(is_pageview()).groupBy("category", B.dwell_band().alias("dwell_band")).agg(F.count("*").alias("n"))


@query("width_bin", "snap", """
SELECT (floor(listing_age_days/5)*5)::BIGINT AS age_bin, COUNT(*) AS n, round(AVG(views_24h),6) AS avg_views FROM snap
WHERE listing_age_days<=40 GROUP BY 1""")
def _(s):
    rows = s.snap.withColumn("age_bin", width_bin("listing_age_days", 5, 40)).filter(F.col("age_bin").isNotNull())
    return rows.groupBy("age_bin").agg(F.count("*").alias("n"), F.avg("views_24h").alias("avg_views"))


@query("quantile_buckets", "ev", f"""
WITH u AS (SELECT user_id, LEAST(COUNT(*),200)::DOUBLE AS v FROM ev WHERE event_type='other_interaction' GROUP BY 1),
e AS (SELECT list_sort(list_distinct([quantile_cont(v,0.0),quantile_cont(v,0.2),quantile_cont(v,0.4),quantile_cont(v,0.6),quantile_cont(v,0.8),quantile_cont(v,1.0)])) AS ed FROM u)
SELECT GREATEST(len(list_filter(ed, lambda x: x < v)),1)::INT AS bucket, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi FROM u, e GROUP BY 1""")
def _(s):
    users = s.ev.filter(is_other()).groupBy("user_id").agg(F.count("*").alias("v"))
    return B.quantile_buckets(users, "v", 5, "bucket", 200).groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))


@query("city_predicate", "dim", """
SELECT category, COUNT(*) AS n, SUM((coalesce(lower(trim(city_name)) IN ('nation_1','nation_2'),false))::INT)::BIGINT AS metro FROM dim GROUP BY 1""")
def _(s):
    metro = B.city_predicate("city_name", ["nation_1", "nation_2"])
    return s.dim.groupBy("category").agg(F.count("*").alias("n"), F.sum(flag(metro)).alias("metro"))


@query("label_encode", "dim", """
WITH w AS (SELECT d, (row_number() OVER (ORDER BY d)-1)::INT AS code FROM (SELECT DISTINCT coalesce(district_name,'unknown') AS d FROM dim))
SELECT code, COUNT(*) AS n, MIN(district_name) AS district_name FROM dim JOIN w ON coalesce(district_name,'unknown')=d GROUP BY 1""")
def _(s):
    return B.label_encode(s.dim, "district_name", "code").groupBy("code").agg(
        F.count("*").alias("n"), F.min("district_name").alias("district_name"))


# ---- joins --------------------------------------------------------------------------------------

@query("enrich_events", "ev dim", """
SELECT d.district_name, ev.event_type, COUNT(*) AS n FROM ev JOIN dim d USING (item_id) GROUP BY ALL""")
def _(s):
    return J.enrich_events(s.ev, s.dim, ["district_name"]).groupBy("district_name", "event_type").agg(F.count("*").alias("n"))


@query("flag_left_join", "ev dim", f"""
SELECT category, house_type, COUNT(*) AS n, SUM((item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO}))::INT)::BIGINT AS with_positive
FROM dim GROUP BY ALL""")
def _(s):
    flagged = J.flag_left_join(s.dim, s.ev.filter(is_positive()), ["item_id"], "has_positive")
    return flagged.groupBy("category", "house_type").agg(F.count("*").alias("n"), F.sum("has_positive").alias("with_positive"))


@query("supply_demand_full_outer", "ev dim", """
WITH a AS (SELECT city_name, category, COUNT(*) AS listings FROM dim GROUP BY ALL), b AS (SELECT city_name, category, COUNT(*) AS events FROM ev GROUP BY ALL)
SELECT coalesce(a.city_name,b.city_name) AS city_name, coalesce(a.category,b.category) AS category, coalesce(listings,0) AS listings, coalesce(events,0) AS events,
 round(1000.0*coalesce(events,0)/NULLIF(coalesce(listings,0),0),6) AS events_per_1k
FROM a FULL JOIN b ON a.city_name IS NOT DISTINCT FROM b.city_name AND a.category IS NOT DISTINCT FROM b.category""")
def _(s):
    return J.supply_demand_full_outer(s.dim, s.ev, ["city_name", "category"])


@query("scope_semi", "ev dim", """
SELECT device, COUNT(*) AS n FROM ev WHERE item_id IN (SELECT item_id FROM dim WHERE ad_status='accepted') GROUP BY 1""")
def _(s):
    return J.scope_semi(s.ev, s.dim.filter("ad_status = 'accepted'"), ["item_id"]).groupBy("device").agg(F.count("*").alias("n"))


@query("anti_exists", "ev dim", """
SELECT category, COUNT(*) AS n FROM dim d WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.item_id=d.item_id) GROUP BY 1""")
def _(s):
    return J.anti_exists(s.dim, s.ev, ["item_id"]).groupBy("category").agg(F.count("*").alias("n"))


@query("one_row_cross", "ev dim", """
WITH b AS (SELECT MIN(date) AS lo, MAX(date) AS hi FROM ev) SELECT category, COUNT(*) AS n FROM dim, b WHERE posted_date BETWEEN lo AND hi GROUP BY 1""")
def _(s):
    bounds = s.ev.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return J.within_bounds(s.dim, bounds, "posted_date", "lo", "hi").groupBy("category").agg(F.count("*").alias("n"))


@query("users_x_pool", "ev test_users", f"""
WITH p AS (SELECT item_id, COUNT(*) AS pos FROM ev WHERE event_type IN {PO} GROUP BY 1),
t AS (SELECT item_id, row_number() OVER (ORDER BY pos DESC, item_id)::INT AS rank FROM p QUALIFY rank<=10)
SELECT user_id, item_id, rank FROM test_users u, t WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id=u.user_id AND event_type IN {PO})""")
def _(s):
    positive = s.ev.filter(is_positive())
    pool = positive.groupBy("item_id").agg(F.count("*").alias("pos"))
    cold = J.anti_exists(s.test_users, positive, ["user_id"])
    return J.with_pool(cold, pool, 10, [F.desc("pos"), F.asc("item_id")])


@query("event_snapshot_join", "ev snap", """
SELECT event_type, COUNT(*) AS n, COUNT(listing_age_days) AS with_age, round(AVG(listing_age_days),6) AS avg_age FROM ev JOIN snap USING (item_id, date) GROUP BY 1""")
def _(s):
    return J.event_snapshot_join(s.ev, s.snap).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("listing_age_days").alias("with_age"), F.avg("listing_age_days").alias("avg_age"))


@query("verified_chat_join", "ev inter", """
SELECT category, COUNT(*) AS n, COUNT(DISTINCT session_id) AS sessions FROM (SELECT DISTINCT e.category, session_id, e.user_id, e.item_id, e.date FROM ev e
 JOIN inter i ON i.user_id=e.user_id AND i.item_id=e.item_id AND i.date=e.date AND chat_message_count>0 WHERE event_type='contact_chat') GROUP BY 1""")
def _(s):
    return J.verified_chat_join(s.ev, s.inter).groupBy("category").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("before_first_contact", "ev", f"""
WITH f AS (SELECT user_id, MIN(event_ts) AS t0 FROM ev WHERE event_type IN {EX} GROUP BY 1)
SELECT user_id, COUNT(*) AS n FROM ev JOIN f USING (user_id) WHERE event_ts<t0 GROUP BY 1""")
def _(s):
    return J.before_first_contact(s.ev).groupBy("user_id").agg(F.count("*").alias("n"))


@query("ordinal_band_join", "ev dim", """
WITH p AS (SELECT e.user_id, d.category, d.district_name, CASE WHEN d.price_bucket IS NULL THEN -1 ELSE length(d.price_bucket) END::INT AS u_ord, COUNT(*) AS w
 FROM ev e JOIN dim d USING (item_id) GROUP BY ALL),
i AS (SELECT item_id, category, district_name, CASE WHEN price_bucket IS NULL THEN -1 ELSE length(price_bucket) END::INT AS i_ord FROM dim)
SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT item_id) AS items FROM p JOIN i USING (category, district_name) WHERE u_ord<0 OR i_ord<0 OR abs(u_ord-i_ord)<=1 GROUP BY 1""")
def _(s):
    ordinal = F.when(F.col("price_bucket").isNull(), -1).otherwise(F.length("price_bucket"))
    dim = s.dim.withColumn("i_ord", ordinal).select("item_id", "category", "district_name", "i_ord")
    wishes = s.ev.select("user_id", "item_id").join(dim.withColumnRenamed("i_ord", "u_ord"), "item_id").select(
        "user_id", "category", "district_name", "u_ord").distinct()
    return J.ordinal_band_counts(wishes, dim, "user_id", ["category", "district_name"], "u_ord", "i_ord")


@query("first_last_self_join", "ev", """
SELECT first_event_type, last_event_type, COUNT(*) AS n FROM (SELECT user_id, item_id, arg_min(event_type, (event_ts, event_id)) AS first_event_type,
 arg_max(event_type, (event_ts, event_id)) AS last_event_type FROM ev GROUP BY 1,2) GROUP BY 1,2""")
def _(s):
    rows = s.ev.withColumn("at", F.struct("event_ts", "event_id"))
    return J.first_last(rows, ["user_id", "item_id"], "at", "event_type").groupBy(
        "first_event_type", "last_event_type").agg(F.count("*").alias("n"))


@query("alias_lookup", "dim region_map", """
SELECT coalesce(region,'Unknown') AS region, COUNT(*) AS n FROM dim LEFT JOIN region_map USING (city_name) GROUP BY 1""")
def _(s):
    return J.alias_lookup(s.dim, s.region, "city_name", "region").groupBy("region").agg(F.count("*").alias("n"))


@query("role_overlap", "ev dim", """
WITH d AS (SELECT DISTINCT user_id AS id FROM ev), p AS (SELECT DISTINCT seller_id AS id FROM dim WHERE seller_id IS NOT NULL),
c AS (SELECT COUNT(*) FILTER (p.id IS NULL) AS only_demand, COUNT(*) FILTER (d.id IS NULL) AS only_supply, COUNT(*) FILTER (d.id IS NOT NULL AND p.id IS NOT NULL) AS "both" FROM d FULL JOIN p ON d.id=p.id)
SELECT *, round("both"::DOUBLE/(only_demand+only_supply+"both"),6) AS jaccard, round(100.0*"both"/(only_demand+"both"),6) AS pct_demand_also_supply,
 round(100.0*"both"/(only_supply+"both"),6) AS pct_supply_also_demand FROM c""")
def _(s):
    return J.role_overlap(s.ev.select(F.col("user_id").alias("id")), s.dim.select(F.col("seller_id").alias("id")), "id")


# ---- aggregations -------------------------------------------------------------------------------

@query("conditional_counts", "ev", """
SELECT category, COUNT(*) FILTER (event_type='view_phone') AS phone, COUNT(*) FILTER (event_type='contact_chat') AS chat, COUNT(*) FILTER (event_type='contact_zalo') AS zalo,
 COUNT(*) FILTER (event_type='contact_sms') AS sms FROM ev GROUP BY 1""")
def _(s):
    t = F.col("event_type")
    return A.conditional_counts(s.ev, ["category"], {
        "phone": t == "view_phone", "chat": t == "contact_chat", "zalo": t == "contact_zalo", "sms": t == "contact_sms"})


@query("distinct_counts", "ev", """
SELECT category, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT session_id) AS sessions, COUNT(DISTINCT item_id) AS items FROM ev GROUP BY 1""")
def _(s):
    return A.distinct_counts(s.ev, ["category"], {"users": "user_id", "sessions": "session_id", "items": "item_id"})


def near(estimate: str, exact: str):
    """Whether an estimate lies within five times its relative error of 1 % (one at least)."""
    return flag(F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * 0.05))


@query("approx_distinct", "ev", """
SELECT category, COUNT(DISTINCT user_id) AS exact_users, COUNT(DISTINCT session_id) AS exact_sessions, COUNT(DISTINCT item_id) AS exact_items, 1::INT AS near_users, 1::INT AS near_sessions, 1::INT AS near_items FROM ev GROUP BY 1""")
def _(s):
    columns = {"users": "user_id", "sessions": "session_id", "items": "item_id"}
    both = join_keys(A.approx_distinct(s.ev, ["category"], columns), A.distinct_counts(s.ev, ["category"], {f"exact_{n}": c for n, c in columns.items()}), ["category"])
    return both.select("category", *[f"exact_{n}" for n in columns], *[near(n, f"exact_{n}").alias(f"near_{n}") for n in columns])


@query("exact_quantiles", "", """
SELECT l_shipmode_like AS grp, round(quantile_cont(l_extendedprice,0.1),6) AS p10, round(quantile_cont(l_extendedprice,0.5),6) AS median, round(quantile_cont(l_extendedprice,0.9),6) AS p90,
 round(quantile_cont(l_extendedprice,0.99),6) AS p99 FROM (SELECT l_returnflag AS l_shipmode_like, l_extendedprice FROM lineitem) GROUP BY 1""")
def _(s):
    rows = s.raw("lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return quantiles(rows, ["grp"], "l_extendedprice", {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99})


@query("filtered_agg", "", """
SELECT l_suppkey, COUNT(*) FILTER (l_returnflag='R') AS n_returned, round(SUM(l_quantity) FILTER (l_returnflag='R'),6) AS sum_returned,
 COUNT(*) FILTER (l_discount>0.05) AS n_discounted, round(SUM(l_quantity) FILTER (l_discount>0.05),6) AS sum_discounted FROM lineitem GROUP BY 1""")
def _(s):
    return A.filtered_agg(s.raw("lineitem"), ["l_suppkey"], "l_quantity",
                          {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05})


@query("mode_value", "ev dim", """
WITH c AS (SELECT user_id, d.district_name AS v, COUNT(*) AS n FROM ev JOIN dim d USING (item_id) WHERE d.district_name IS NOT NULL GROUP BY ALL)
SELECT user_id, v AS mode, n AS n_mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v)=1""")
def _(s):
    return A.mode_value(J.enrich_events(s.ev.select("user_id", "item_id"), s.dim, ["district_name"]), ["user_id"], "district_name")


@query("string_list_agg", "ev", """
SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM ev) GROUP BY 1""")
def _(s):
    return A.string_list_agg(s.ev, ["user_id"], "event_type", "types")


@query("ordered_list_agg", "ev", """
WITH c AS (SELECT user_id, item_id, COUNT(*) AS n FROM ev GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM c QUALIFY rank<=10)
SELECT user_id, string_agg(item_id::VARCHAR, '|' ORDER BY rank) AS items FROM r GROUP BY 1""")
def _(s):
    counts = s.ev.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    lists = N.top_n_per_group(counts, ["user_id"], [F.desc("n"), F.asc("item_id")], 10)
    return A.ordered_list_agg(lists, ["user_id"], "rank", "item_id", "items")


@query("having_min_n", "dim", """
SELECT district_name, ad_type, COUNT(*) AS n, round(AVG(area_sqm),6) AS avg_area FROM dim GROUP BY 1,2 HAVING COUNT(*)>=30""")
def _(s):
    return A.having_min_n(s.dim, ["district_name", "ad_type"], [F.avg("area_sqm").alias("avg_area")], 30)


@query("share_of_total", "dim", """
SELECT category, ad_status, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct_total, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS pct_within FROM dim GROUP BY 1,2""")
def _(s):
    return A.share_of_total(s.dim, ["category", "ad_status"], ["category"])


@query("crosstab_pct", "dim", """
SELECT category, round(100.0*COUNT(*) FILTER (ad_status='accepted')/COUNT(*),6) AS pct_accepted, round(100.0*COUNT(*) FILTER (ad_status='hidden')/COUNT(*),6) AS pct_hidden,
 round(100.0*COUNT(*) FILTER (ad_status='refused')/COUNT(*),6) AS pct_refused FROM dim WHERE ad_status IN ('accepted','hidden','refused') GROUP BY 1""")
def _(s):
    return A.crosstab_pct(s.dim, "category", "ad_status", ["accepted", "hidden", "refused"])


CONTACTS = f"cc AS (SELECT category, item_id, COUNT(*) AS x FROM ev WHERE event_type IN {EX} GROUP BY ALL)"


def contact_counts(s, entity="item_id"):
    return s.ev.filter(is_explicit()).groupBy("category", entity).agg(F.count("*").alias("x"))


@query("gini", "ev", f"""
WITH {CONTACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY x) AS i, COUNT(*) OVER (PARTITION BY category) AS n FROM cc)
SELECT category, round(SUM((2*i-n-1)*x)::DOUBLE/(MAX(n)*SUM(x)),6) AS gini FROM r GROUP BY 1""")
def _(s):
    return A.gini(contact_counts(s), ["category"], "x", bounded=True)


@query("top_pct_share", "", """
WITH c AS (SELECT l_suppkey%4 AS grp, l_partkey, SUM(l_quantity) AS x FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x DESC) AS i, COUNT(*) OVER (PARTITION BY grp) AS n FROM c)
SELECT grp, round(100.0*SUM(CASE WHEN i<=GREATEST(1,ceil(n*0.01)) THEN x ELSE 0 END)/SUM(x),6) AS top_1pct_share,
 round(100.0*SUM(CASE WHEN i<=GREATEST(1,ceil(n*0.1)) THEN x ELSE 0 END)/SUM(x),6) AS top_10pct_share FROM r GROUP BY 1""")
def _(s):
    rows = s.raw("lineitem").groupBy((F.col("l_suppkey") % 4).alias("grp"), "l_partkey").agg(F.sum("l_quantity").alias("x"))
    return A.top_pct_share(rows, ["grp"], "x", [1, 10], bounded=False)


@query("hhi", "ev", f"""
WITH {CONTACTS} SELECT category, round(10000.0*SUM(x*x)/(SUM(x)*SUM(x)),6) AS hhi, round(SUM(x*x)::DOUBLE/(SUM(x)*SUM(x)),6) AS hhi_01, round(MAX(x)::DOUBLE/SUM(x),6) AS top1_share FROM cc GROUP BY 1""")
def _(s):
    return A.hhi(contact_counts(s), ["category"], "x")


@query("entropy", "ev", f"""
WITH {CONTACTS}, p AS (SELECT category, x::DOUBLE/SUM(x) OVER (PARTITION BY category) AS p FROM cc)
SELECT category, round(-SUM(p*ln(p)),6) AS entropy, round(CASE WHEN COUNT(*)>1 THEN -SUM(p*log2(p))/log2(COUNT(*)) ELSE 0 END,6) AS normalized_entropy FROM p GROUP BY 1""")
def _(s):
    return A.entropy(contact_counts(s), ["category"], "x")


@query("lorenz_curve", "ev", f"""
WITH {CONTACTS}, h AS (SELECT category, x, COUNT(*) AS n FROM cc GROUP BY ALL)
SELECT category, x, round(100.0*SUM(n) OVER w/SUM(n) OVER (PARTITION BY category),6) AS cum_population_pct, round(100.0*SUM(n*x) OVER w/SUM(n*x) OVER (PARTITION BY category),6) AS cum_value_pct
FROM h WINDOW w AS (PARTITION BY category ORDER BY x)""")
def _(s):
    return A.lorenz_curve(contact_counts(s), ["category"], "x", bounded=True)


@query("concentration_table", "ev dim", f"""
WITH c AS (SELECT 'listing' AS entity, category, item_id AS id, COUNT(*) AS x FROM ev WHERE event_type IN {EX} GROUP BY ALL
 UNION ALL SELECT 'user', category, user_id, COUNT(*) FROM ev WHERE event_type IN {EX} GROUP BY ALL
 UNION ALL SELECT 'seller', e.category, seller_id, COUNT(*) FROM ev e JOIN dim USING (item_id) WHERE event_type IN {EX} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, category ORDER BY x) AS i, COUNT(*) OVER (PARTITION BY entity, category) AS n FROM c)
SELECT entity, category, COUNT(*) AS n_entities, SUM(x)::BIGINT AS total, round(AVG(x),6) AS mean, round(median(x),6) AS median, round(SUM((2*i-n-1)*x)::DOUBLE/(MAX(n)*SUM(x)),6) AS gini,
 round(100.0*SUM(CASE WHEN n-i+1<=GREATEST(1,ceil(n*0.01)) THEN x ELSE 0 END)/SUM(x),6) AS top_1pct_share,
 round(100.0*SUM(CASE WHEN n-i+1<=GREATEST(1,ceil(n*0.05)) THEN x ELSE 0 END)/SUM(x),6) AS top_5pct_share,
 round(100.0*SUM(CASE WHEN n-i+1<=GREATEST(1,ceil(n*0.10)) THEN x ELSE 0 END)/SUM(x),6) AS top_10pct_share,
 round(100.0*SUM(CASE WHEN n-i+1<=GREATEST(1,ceil(n*0.20)) THEN x ELSE 0 END)/SUM(x),6) AS top_20pct_share,
 round(100.0*COUNT(*) FILTER (x=1)/COUNT(*),6) AS singleton_pct FROM r GROUP BY 1,2""")
def _(s):
    explicit = s.ev.filter(is_explicit()).select("category", "item_id", "user_id")
    sold = explicit.join(s.dim.select("item_id", "seller_id"), "item_id")
    parts = [
        df.groupBy(F.lit(name).alias("entity"), "category", F.col(key).alias("id")).agg(F.count("*").alias("x"))
        for name, df, key in (("listing", explicit, "item_id"), ("user", explicit, "user_id"), ("seller", sold, "seller_id"))
    ]
    return A.concentration_table(parts[0].union(parts[1]).union(parts[2]), ["entity", "category"], "x")


@query("capped_histogram", "ev", f"""
WITH u AS (SELECT user_id, COUNT(*) AS x FROM ev WHERE event_type IN {PO} GROUP BY 1)
SELECT LEAST(x::DOUBLE, (SELECT quantile_cont(x,0.99) FROM u)) AS bin, COUNT(*) AS n FROM u GROUP BY 1""")
def _(s):
    return A.capped_histogram(s.ev.filter(is_positive()).groupBy("user_id").agg(F.count("*").alias("x")), "x")


@query("pearson_vs_label", "", """
WITH w AS (SELECT corr(l_quantity, y) AS a, corr(l_extendedprice, y) AS b, corr(l_discount, y) AS c FROM (SELECT *, (l_returnflag='R')::INT AS y FROM lineitem))
SELECT 'l_quantity' AS feature, round(a,6) AS corr FROM w UNION ALL SELECT 'l_extendedprice', round(b,6) FROM w UNION ALL SELECT 'l_discount', round(c,6) FROM w""")
def _(s):
    rows = s.raw("lineitem").withColumn("y", flag(F.col("l_returnflag") == "R"))
    return A.pearson_vs_label(rows, ["l_quantity", "l_extendedprice", "l_discount"], "y")


@query("spearman", "", """
WITH b AS (SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x)+(COUNT(*) OVER (PARTITION BY grp, x)-1)/2.0 AS rx, rank() OVER (PARTITION BY grp ORDER BY y)+(COUNT(*) OVER (PARTITION BY grp, y)-1)/2.0 AS ry FROM b)
SELECT grp, round(corr(rx,ry),6) AS spearman, COUNT(*) AS n_pairs FROM r GROUP BY 1""")
def _(s):
    rows = s.raw("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return A.spearman(rows, ["grp"], "x", "y")


ERFC = "(((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t)*exp(-x*x)"


@query("two_proportion_ztest", "ev", f"""
WITH c AS (SELECT COUNT(*) FILTER (device='iOS') AS n_a, COUNT(*) FILTER (device='iOS' AND event_type IN {EX}) AS x_a,
 COUNT(*) FILTER (device='Desktop') AS n_b, COUNT(*) FILTER (device='Desktop' AND event_type IN {EX}) AS x_b FROM ev),
p AS (SELECT *, x_a::DOUBLE/n_a AS p_a, x_b::DOUBLE/n_b AS p_b, (x_a+x_b)::DOUBLE/(n_a+n_b) AS pp FROM c),
z AS (SELECT *, (p_a-p_b)/sqrt(pp*(1-pp)*(1.0/n_a+1.0/n_b)) AS z FROM p), t AS (SELECT *, abs(z)/sqrt(2) AS x, 1/(1+0.3275911*abs(z)/sqrt(2)) AS t FROM z)
SELECT n_a, x_a, n_b, x_b, round(p_a,6) AS p_a, round(p_b,6) AS p_b, round(z,6) AS z, round({ERFC},6) AS p_value FROM t""")
def _(s):
    return A.two_proportion_ztest(s.ev, "device", is_explicit(), "iOS", "Desktop")


@query("categorical_compare", "dim", """
WITH l AS (SELECT (project_id IS NOT NULL)::INT AS has_project, unnest([{'variable':'ad_type','bucket':coalesce(ad_type,'null')},{'variable':'furnishing','bucket':coalesce(furnishing,'null')},
 {'variable':'seller_type','bucket':coalesce(seller_type,'null')}]) AS p FROM dim)
, c AS (SELECT has_project, p.variable AS variable, p.bucket AS bucket, COUNT(*) AS n FROM l GROUP BY ALL) SELECT *, round(100.0*n/SUM(n) OVER (PARTITION BY has_project, variable),6) AS pct FROM c""")
def _(s):
    rows = s.dim.withColumn("has_project", flag(F.col("project_id").isNotNull()))
    return A.categorical_compare(rows, "has_project", ["ad_type", "furnishing", "seller_type"])


@query("numeric_compare", "dim", """
WITH l AS (SELECT (project_id IS NOT NULL)::INT AS has_project, unnest([{'variable':'area_sqm','value':area_sqm},{'variable':'price','value':price},{'variable':'images_count','value':images_count}]) AS p FROM dim)
SELECT has_project, p.variable AS variable, COUNT(p.value) AS n, round(AVG(p.value),6) AS mean, round(quantile_cont(p.value,0.25),6) AS p25, round(quantile_cont(p.value,0.5),6) AS median,
 round(quantile_cont(p.value,0.75),6) AS p75 FROM l GROUP BY ALL""")
def _(s):
    rows = s.dim.withColumn("has_project", flag(F.col("project_id").isNotNull()))
    return A.numeric_compare(rows, "has_project", ["area_sqm", "price", "images_count"])


@query("correlation_matrix", "", """
WITH w AS (SELECT corr(l_quantity,l_extendedprice) AS ab, corr(l_quantity,l_discount) AS ac, corr(l_extendedprice,l_discount) AS bc FROM lineitem),
v AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, ab AS c FROM w UNION ALL SELECT 'l_quantity','l_discount',ac FROM w UNION ALL SELECT 'l_extendedprice','l_discount',bc FROM w)
SELECT a, b, round(c,6) AS corr FROM v UNION ALL SELECT b, a, round(c,6) FROM v UNION ALL SELECT 'l_quantity','l_quantity',1.0 UNION ALL SELECT 'l_extendedprice','l_extendedprice',1.0 UNION ALL SELECT 'l_discount','l_discount',1.0""")
def _(s):
    return A.correlation_matrix(s.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("area_percentiles", "dim", """
SELECT category, COUNT(*) AS n, round(AVG(area_sqm),6) AS mean, round(100.0*COUNT(*) FILTER (area_sqm<30)/COUNT(*),6) AS pct_small, round(100.0*COUNT(*) FILTER (area_sqm>=100)/COUNT(*),6) AS pct_large,
 round(quantile_cont(area_sqm,0.25),6) AS p25, round(quantile_cont(area_sqm,0.5),6) AS p50, round(quantile_cont(area_sqm,0.75),6) AS p75 FROM dim WHERE area_sqm IS NOT NULL GROUP BY 1""")
def _(s):
    return A.area_percentiles(s.dim, ["category"], "area_sqm", {"pct_small": F.col("area_sqm") < 30, "pct_large": F.col("area_sqm") >= 100})


# ---- windows ------------------------------------------------------------------------------------

@query("top_n_per_group", "ev", """
WITH c AS (SELECT category, city_name, COUNT(*) AS n FROM ev GROUP BY 1,2)
SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, city_name)::INT AS rank FROM c QUALIFY rank<=3""")
def _(s):
    counts = s.ev.groupBy("category", "city_name").agg(F.count("*").alias("n"))
    return N.top_n_per_group(counts, ["category"], [F.desc("n"), F.asc("city_name")], 3)


@query("lag_transition", "snap", """
WITH m AS (SELECT item_id, strftime(date,'%Y-%m') AS month, CASE WHEN SUM(contacts_24h)>60 THEN 'busy' ELSE 'quiet' END AS state FROM snap GROUP BY 1,2),
l AS (SELECT *, lag(state) OVER (PARTITION BY item_id ORDER BY month) AS prev_state, lag(month) OVER (PARTITION BY item_id ORDER BY month) AS prev_month FROM m)
SELECT prev_month, month, prev_state, state, COUNT(*) AS n FROM l GROUP BY 1,2,3,4""")
def _(s):
    monthly = s.snap.groupBy("item_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.when(F.sum("contacts_24h") > 60, "busy").otherwise("quiet").alias("state"))
    return N.lag_transition(monthly, ["item_id"], "month", "state").groupBy("prev_month", "month", "prev_state", "state").agg(F.count("*").alias("n"))


@query("query_refinement_lag", "ev", r"""
WITH q AS (SELECT *, lower(trim(regexp_replace(query,'\s+',' ','g'))) AS q FROM ev WHERE event_type='pageview' AND trim(query)<>''),
l AS (SELECT *, lag(q) OVER (PARTITION BY category, session_id ORDER BY event_ts, event_id) AS p FROM q)
SELECT category, session_id, COUNT(*) AS searches, SUM((p IS NOT NULL AND p<>q)::INT)::BIGINT AS refinements FROM l GROUP BY 1,2""")
def _(s):
    return N.query_refinement_lag(s.ev).groupBy("category", "session_id").agg(
        F.count("*").alias("searches"), F.sum("is_refinement").alias("refinements"))


@query("gap_sessionize", "ev", """
WITH l AS (SELECT *, lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS p FROM ev),
n AS (SELECT *, SUM((p IS NULL OR epoch_us(event_ts)-epoch_us(p)>43200000000)::INT) OVER (PARTITION BY user_id ORDER BY event_ts, event_id)::BIGINT AS session_no FROM l)
SELECT user_id, session_no, COUNT(*) AS events, MIN(event_id) AS first_event, MAX(event_id) AS last_event FROM n GROUP BY 1,2""")
def _(s):
    return N.gap_sessionize(s.ev, gap_seconds=43200).groupBy("user_id", "session_no").agg(
        F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("min_max_norm_per_user", "ev", """
WITH c AS (SELECT user_id, item_id, COUNT(*)::DOUBLE AS score FROM ev GROUP BY 1,2)
SELECT user_id, item_id, score, round((score-MIN(score) OVER w)/(MAX(score) OVER w-MIN(score) OVER w+1e-10),6) AS score_norm FROM c WINDOW w AS (PARTITION BY user_id)""")
def _(s):
    scores = s.ev.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("score"))
    return N.min_max_norm(scores, ["user_id"], ["score"])


@query("pct_rank_in_category", "dim snap", """
WITH v AS (SELECT item_id, category, coalesce(t,0) AS t FROM dim LEFT JOIN (SELECT item_id, SUM(views_24h) AS t FROM snap GROUP BY 1) USING (item_id))
SELECT item_id, category, t, round((rank() OVER (PARTITION BY category ORDER BY t)+(COUNT(*) OVER (PARTITION BY category, t)-1)/2.0)/COUNT(*) OVER (PARTITION BY category),6) AS exposure_rank FROM v""")
def _(s):
    total = s.snap.groupBy("item_id").agg(F.sum("views_24h").alias("t"))
    rows = s.dim.select("item_id", "category").join(total, "item_id", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    return N.pct_rank(rows, ["category"], "t", "exposure_rank")


@query("segment_zscore", "dim", """
WITH g AS (SELECT category, city_name, median(price) AS m, stddev_samp(price) AS sd FROM dim GROUP BY 1,2)
SELECT item_id, round((price-m)/GREATEST(coalesce(sd,0),0.1),6) AS z FROM dim d JOIN g ON d.category=g.category AND d.city_name IS NOT DISTINCT FROM g.city_name""")
def _(s):
    return N.segment_zscore(s.dim, ["category", "city_name"], "price", "z").select("item_id", "z")


@query("rolling_mean_7d", "snap dim", """
WITH d AS (SELECT category, date, SUM(views_24h) AS v FROM snap JOIN dim USING (item_id) GROUP BY 1,2)
SELECT category, date::VARCHAR AS date, v, round(AVG(v) OVER (PARTITION BY category ORDER BY date ROWS 6 PRECEDING),6) AS v_7d FROM d""")
def _(s):
    daily = s.snap.join(s.dim.select("item_id", "category"), "item_id").groupBy("category", "date").agg(F.sum("views_24h").alias("v"))
    return N.rolling_mean(daily, ["category"], "date", "v", "v_7d")


@query("first_contact_rank", "ev", f"""
WITH r AS (SELECT session_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY event_ts, event_id) AS rn FROM ev)
SELECT session_id, MIN(rn) AS first_contact_rank FROM r WHERE event_type IN {EX} GROUP BY 1""")
def _(s):
    return N.first_contact_rank(s.ev)


@query("last_n_per_user", "ev", """
WITH l AS (SELECT user_id, item_id, MAX(event_ts) AS last_ts FROM ev GROUP BY 1,2)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, item_id)::INT AS rank FROM l QUALIFY rank<=50""")
def _(s):
    return N.last_n_per_user(s.ev).select("user_id", "item_id", "rank")


@query("latest_row", "snap", """
SELECT item_id, arg_max(views_24h,date) AS views_24h, arg_max(contacts_24h,date) AS contacts_24h, arg_max(listing_age_days,date) FILTER (listing_age_days IS NOT NULL) AS listing_age_days,
 MAX(date)::VARCHAR AS last_date FROM snap WHERE date<=DATE'2024-01-15' GROUP BY 1""")
def _(s):
    cutoff = F.lit("2024-01-15").cast("date")
    return N.latest_row(s.snap, ["item_id"], "date", ["views_24h", "contacts_24h", "listing_age_days"], cutoff)


@query("relative_to_group_max", "ev", """
WITH c AS (SELECT category, city_name, COUNT(*) AS n FROM ev GROUP BY 1,2) SELECT *, round(n::DOUBLE/MAX(n) OVER (PARTITION BY category),6) AS rel FROM c""")
def _(s):
    counts = s.ev.groupBy("category", "city_name").agg(F.count("*").alias("n"))
    return N.relative_to_group_max(counts, ["category"], "n", "rel")


@query("index_to_first_bucket", "snap dim", """
WITH b AS (SELECT category, (floor(listing_age_days/10)*10)::BIGINT AS age_bin, AVG(views_24h) AS v FROM snap JOIN dim USING (item_id) WHERE listing_age_days IS NOT NULL GROUP BY 1,2)
SELECT category, age_bin, round(v,6) AS v, round(100.0*v/first_value(v) OVER (PARTITION BY category ORDER BY age_bin),6) AS idx FROM b""")
def _(s):
    rows = s.snap.filter("listing_age_days IS NOT NULL").join(s.dim.select("item_id", "category"), "item_id")
    bins = rows.groupBy("category", width_bin("listing_age_days", 10).alias("age_bin")).agg(F.avg("views_24h").alias("v"))
    return N.index_to_first_bucket(bins, ["category"], "age_bin", "v", "idx")


# ---- top-k and sets -----------------------------------------------------------------------------

@query("global_top_k", "ev", """
SELECT query, COUNT(*) AS n FROM ev WHERE query IS NOT NULL GROUP BY 1 ORDER BY n DESC, query LIMIT 20""")
def _(s):
    counts = s.ev.filter("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("n"))
    return S.global_top_k(counts, [F.desc("n"), F.asc("query")], 20)


@query("multi_key_rank", "", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank<=10""")
def _(s):
    order = [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return S.multi_key_rank(s.raw("orders"), ["o_custkey"], order, "rank", 10).select("o_custkey", "o_orderkey", "rank")


SLOTS = f"""vol AS (SELECT category, COUNT(*) AS w FROM ev WHERE event_type IN {PO} GROUP BY 1),
st AS (SELECT list(category ORDER BY w DESC, category) AS g, list(GREATEST(round_even(w::DOUBLE/t*50,0),3)::INT ORDER BY w DESC, category) AS s FROM vol, (SELECT SUM(w) AS t FROM vol)),
rec AS (SELECT g, s FROM st UNION ALL SELECT g, list_transform(s, lambda x, i: CASE WHEN i=list_position(s,list_max(s)) THEN x+sign(50-list_sum(s))::INT ELSE x END) FROM rec WHERE list_sum(s)<>50),
slots AS (SELECT unnest(g) AS category, unnest(s)::INT AS slots, unnest(range(1,len(g)+1))::INT AS volume_order FROM rec WHERE list_sum(s)=50)"""


@query("slot_allocation", "ev", f"WITH RECURSIVE_ {SLOTS} SELECT category, slots, volume_order FROM slots")
def _(s):
    volume = s.ev.filter(is_positive()).groupBy("category").agg(F.count("*").alias("w"))
    return S.slot_allocation(volume, "category", "w", 50)


@query("interleave_by_category", "ev", f"""WITH RECURSIVE_ {SLOTS},
p AS (SELECT category, item_id, COUNT(*) AS pos FROM ev WHERE event_type IN {PO} GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos DESC, item_id) AS gr FROM p QUALIFY gr<=40)
SELECT item_id, category, pos, row_number() OVER (ORDER BY gr, volume_order)::INT AS pool_rank FROM r JOIN slots USING (category) WHERE gr<=slots""")
def _(s):
    positive = s.ev.filter(is_positive())
    slots = S.slot_allocation(positive.groupBy("category").agg(F.count("*").alias("w")), "category", "w", 50)
    items = positive.groupBy("category", "item_id").agg(F.count("*").alias("pos"))
    return S.interleave_by_category(items, slots, "category", "pos", 50)


@query("union_all", "ev ordered", """
SELECT source, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM (SELECT 'events' AS source, user_id, item_id FROM ev UNION ALL SELECT 'orders', user_id, item_id FROM ordered) GROUP BY 1""")
def _(s):
    both = S.union_all({"events": s.ev.select("user_id", "item_id"), "orders": s.orders.select("user_id", "item_id")})
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("union_distinct", "ev inter", f"""
SELECT user_id FROM ev WHERE event_type IN {PO} UNION SELECT user_id FROM inter WHERE lead_count>0""")
def _(s):
    return S.union_distinct(s.ev.filter(is_positive()), s.inter.filter("lead_count > 0"), "user_id")


TWO_LISTS = f"""a AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, item_id)::INT AS rank FROM ev GROUP BY 1,2 QUALIFY rank<=10),
b AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, item_id)::INT AS rank FROM ev WHERE event_type IN {PO} GROUP BY 1,2 QUALIFY rank<=10)"""


def two_lists(s):
    """Two top-10 lists per user: by all events and by positive events."""
    def top(df):
        counts = df.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
        return N.top_n_per_group(counts, ["user_id"], [F.desc("n"), F.asc("item_id")], 10).select("user_id", "item_id", "rank")
    return top(s.ev), top(s.ev.filter(is_positive()))


@query("list_intersect", "ev", f"""WITH {TWO_LISTS}
SELECT user_id, COUNT(*) FILTER (a.item_id IS NOT NULL AND b.item_id IS NOT NULL) AS n_common, COUNT(a.item_id) AS n_a, COUNT(b.item_id) AS n_b,
 COUNT(*)=COUNT(a.item_id) AND COUNT(*)=COUNT(b.item_id) AS same_set FROM a FULL JOIN b USING (user_id, item_id) GROUP BY 1""")
def _(s):
    a, b = two_lists(s)
    return S.list_intersect(a, b, "user_id")


@query("set_difference", "ev dim", "SELECT item_id FROM dim EXCEPT SELECT item_id FROM ev")
def _(s):
    return S.set_difference(s.dim, s.ev, ["item_id"])
