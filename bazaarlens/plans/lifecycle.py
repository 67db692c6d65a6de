"""Lifecycle, seller and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import bucketize, is_positive
from bazaarlens.operators import lifecycle as L
from bazaarlens.plans.primitives import EX, PO
from bazaarlens.plans.registry import query

AGE = """CASE WHEN listing_age_days IS NULL THEN 'unk' WHEN listing_age_days<=2 THEN '0-2d' WHEN listing_age_days<=7 THEN '3-7d' WHEN listing_age_days<=14 THEN '8-14d'
 WHEN listing_age_days<=30 THEN '15-30d' WHEN listing_age_days<=60 THEN '31-60d' ELSE '60+d' END"""
EN = f"""en AS (SELECT s.*, category, ad_type, ad_status, (isodow(date)-1)::INT AS dow, strftime(date,'%Y-%m') AS month, {AGE} AS age_bucket, contacts_24h/NULLIF(views_24h,0) AS contact_rate, (contacts_24h>views_24h)::INT AS violation FROM snap s JOIN dim USING (item_id))"""
RATE = "COUNT(*) AS listing_days, round(AVG(views_24h),6) AS avg_views, round(AVG(contacts_24h),6) AS avg_contacts, round(100.0*SUM(contacts_24h)/NULLIF(SUM(views_24h),0),6) AS contact_rate_pct"
STATE = "CASE WHEN SUM((contacts_24h>0)::INT)>0 THEN 'contacted' WHEN SUM((views_24h>0)::INT)>0 THEN 'viewed' ELSE 'inactive' END"
MS = f"ms AS (SELECT m.*, ad_status, category FROM (SELECT item_id, strftime(date,'%Y-%m') AS month, {STATE} AS state FROM snap GROUP BY 1,2) m JOIN dim USING (item_id))"


def enriched(s):
    return L.snapshot_enriched(s.snap, s.dim)


@query("snapshot_enriched", "snap dim", f"WITH {EN} SELECT category, age_bucket, dow, month, COUNT(*) AS n, SUM(violation)::BIGINT AS violations, round(AVG(contact_rate),6) AS avg_rate FROM en GROUP BY 1,2,3,4")
def _(s):
    return enriched(s).groupBy("category", "age_bucket", "dow", "month").agg(
        F.count("*").alias("n"), F.sum("violation").alias("violations"), F.avg("contact_rate").alias("avg_rate"))


for _name, _keys in {
    "contact_rate_by": ["category"], "contact_rate_by_date": ["category", "date"], "contact_rate_by_dow": ["category", "dow"], "contact_rate_by_month": ["category", "month"],
    "contact_rate_by_age": ["category", "age_bucket"], "contact_rate_by_age_dow": ["category", "age_bucket", "dow"],
    "contact_rate_by_adtype_dow": ["ad_type", "dow"], "contact_rate_by_adtype_age": ["ad_type", "age_bucket"],
    "contact_rate_by_age_day": ["category", "listing_age_days"],
}.items():
    _sel = ", ".join("date::VARCHAR AS date" if k == "date" else k for k in _keys)

    @query(_name, "snap dim", f"WITH {EN} SELECT {_sel}, {RATE} FROM en GROUP BY ALL")
    def _(s, keys=tuple(_keys)):
        return L.contact_rate_by(enriched(s), keys)


@query("category_ranking", "snap dim", f"""WITH {EN} SELECT category, {RATE}, COUNT(DISTINCT item_id) AS listings, round(100.0*AVG((contacts_24h>0)::INT),6) AS days_with_contact_pct, round(median(listing_age_days),6) AS median_age FROM en GROUP BY 1""")
def _(s):
    return L.category_ranking(enriched(s))


@query("interaction_dow", "ev inter", "SELECT category, (isodow(date)-1)::INT AS dow, SUM(lead_count) AS leads, SUM(chat_message_count) AS messages FROM inter WHERE user_id IN (SELECT user_id FROM ev WHERE is_login='login') GROUP BY 1,2")
def _(s):
    return L.interaction_dow(s.inter, s.ev)


@query("temporal_scorecard", "snap dim ev", f"""WITH {EN}, d AS (SELECT category, dow, {RATE} FROM en GROUP BY 1,2), m AS (SELECT category, month, {RATE} FROM en GROUP BY 1,2), a AS (SELECT category, age_bucket, {RATE} FROM en GROUP BY 1,2 HAVING COUNT(*)>=100),
b AS (SELECT category, (hour(event_ts)//3*3)::BIGINT AS block, COUNT(*) AS n FROM ev WHERE event_type IN {EX} GROUP BY 1,2)
SELECT * FROM (SELECT category, 'top_weekday' AS metric, row_number() OVER (PARTITION BY category ORDER BY contact_rate_pct DESC, dow)::INT AS place, dow::VARCHAR AS value, contact_rate_pct AS score FROM d) WHERE place<=3
UNION ALL SELECT * FROM (SELECT category, 'peak_month', row_number() OVER (PARTITION BY category ORDER BY contact_rate_pct DESC, month)::INT AS p, month, contact_rate_pct FROM m) WHERE p=1
UNION ALL SELECT * FROM (SELECT category, 'low_month', row_number() OVER (PARTITION BY category ORDER BY contact_rate_pct, month)::INT AS p, month, contact_rate_pct FROM m) WHERE p=1
UNION ALL SELECT * FROM (SELECT category, 'best_age', row_number() OVER (PARTITION BY category ORDER BY contact_rate_pct DESC, age_bucket)::INT AS p, age_bucket, contact_rate_pct FROM a) WHERE p=1
UNION ALL SELECT * FROM (SELECT category, 'peak_hour_block', row_number() OVER (PARTITION BY category ORDER BY n DESC, block)::INT AS p, block::VARCHAR, n::DOUBLE FROM b) WHERE p=1""")
def _(s):
    return L.temporal_scorecard(enriched(s), s.ev)


@query("decay_curve", "snap dim", f"""WITH {EN}, i AS (SELECT category, item_id, (floor(listing_age_days/5)*5)::BIGINT AS age_bin, AVG(views_24h) AS v, AVG(contacts_24h) AS c FROM en WHERE listing_age_days BETWEEN 0 AND 180 GROUP BY 1,2,3)
SELECT category, age_bin, COUNT(*) AS items, round(AVG(v),6) AS avg_views, round(AVG(c),6) AS avg_contacts FROM i GROUP BY 1,2""")
def _(s):
    return L.decay_curve(enriched(s))


@query("monthly_state", "snap dim", f"WITH {MS} SELECT month, state, ad_status, category, COUNT(*) AS n FROM ms GROUP BY 1,2,3,4")
def _(s):
    return L.monthly_state(s.snap, s.dim).groupBy("month", "state", "ad_status", "category").agg(F.count("*").alias("n"))


TR = "tr AS (SELECT *, lag(month) OVER (PARTITION BY item_id ORDER BY month) AS prev_month, lag(state) OVER (PARTITION BY item_id ORDER BY month) AS prev_state FROM ms)"


@query("state_transitions", "snap dim", f"WITH {MS}, {TR} SELECT prev_month, month, prev_state, state, COUNT(*) AS n FROM tr WHERE prev_state IS NOT NULL GROUP BY 1,2,3,4")
def _(s):
    return L.state_transitions(L.monthly_state(s.snap, s.dim))


@query("largest_month_pair", "snap dim", f"WITH {MS}, {TR} SELECT prev_month, month, COUNT(*) AS n FROM tr WHERE prev_state IS NOT NULL GROUP BY 1,2 ORDER BY n DESC, prev_month, month LIMIT 1")
def _(s):
    return L.largest_month_pair(L.monthly_state(s.snap, s.dim))


@query("first_last_status", "snap dim", f"WITH {MS}, i AS (SELECT item_id, ad_status, arg_min(state,month) AS first_state, arg_max(state,month) AS last_state FROM ms GROUP BY 1,2) SELECT first_state, last_state, ad_status, COUNT(*) AS n FROM i GROUP BY 1,2,3")
def _(s):
    return L.first_last_status(L.monthly_state(s.snap, s.dim))


@query("age_band_paths", "snap dim", f"""WITH st AS (SELECT item_id, CASE WHEN listing_age_days<=7 THEN 'a' WHEN listing_age_days<=30 THEN 'b' ELSE 'c' END AS band, {STATE} AS state FROM snap GROUP BY 1,2),
w AS (SELECT item_id, MAX('0-7d:'||state) FILTER (band='a') AS a, MAX('8-30d:'||state) FILTER (band='b') AS b, MAX('31d+:'||state) FILTER (band='c') AS c FROM st GROUP BY 1), p AS (SELECT w.*, ad_status FROM w JOIN dim USING (item_id) WHERE a IS NOT NULL),
e AS (SELECT a AS source, b AS target FROM p WHERE b IS NOT NULL UNION ALL SELECT b, c FROM p WHERE b IS NOT NULL AND c IS NOT NULL UNION ALL SELECT coalesce(c,b,a), ad_status FROM p)
SELECT source, target, COUNT(*) AS n FROM e GROUP BY 1,2""")
def _(s):
    return L.age_band_paths(s.snap, s.dim)


@query("item_snapshot_kpi", "snap", "SELECT item_id, COUNT(*) AS days, COUNT(*) FILTER (views_24h>0) AS days_viewed, COUNT(*) FILTER (contacts_24h>0) AS days_contacted, MAX(views_24h) AS max_views, MAX(contacts_24h) AS max_contacts FROM snap GROUP BY 1")
def _(s):
    return L.item_snapshot_kpi(s.snap)


@query("kpi_by_status", "snap dim", """WITH k AS (SELECT item_id, COUNT(*) AS d, COUNT(*) FILTER (views_24h>0) AS v, COUNT(*) FILTER (contacts_24h>0) AS c, MAX(views_24h) AS mv FROM snap GROUP BY 1)
SELECT ad_status, category, COUNT(*) AS items, round(AVG(d),6) AS avg_days, round(100.0*SUM(v)/SUM(d),6) AS viewed_pct, round(100.0*SUM(c)/SUM(d),6) AS contacted_pct, MAX(mv) AS max_views FROM k JOIN dim USING (item_id) GROUP BY 1,2""")
def _(s):
    return L.kpi_by_status(s.snap, s.dim)


@query("status_positive_coverage", "ev dim", f"""WITH s AS (SELECT item_id, MAX((event_type IN {PO})::INT) AS pos, MAX((event_type='view_phone')::INT) AS phone, MAX((event_type='contact_chat')::INT) AS chat, MAX((event_type='contact_zalo')::INT) AS zalo, MAX((event_type='contact_sms')::INT) AS sms FROM ev GROUP BY 1)
SELECT ad_status, category, COUNT(*) AS items, round(100.0*AVG(coalesce(pos,0)),6) AS pos_pct, round(100.0*AVG(coalesce(phone,0)),6) AS phone_pct, round(100.0*AVG(coalesce(chat,0)),6) AS chat_pct, round(100.0*AVG(coalesce(zalo,0)),6) AS zalo_pct, round(100.0*AVG(coalesce(sms,0)),6) AS sms_pct
FROM dim LEFT JOIN s USING (item_id) GROUP BY 1,2""")
def _(s):
    return L.status_positive_coverage(s.dim, s.ev)


@query("seller_status_groups", "dim", """WITH f AS (SELECT seller_id, COUNT(*) FILTER (ad_status='shop_accepted') AS sh, COUNT(*) FILTER (ad_status='accepted') AS ac, COUNT(*) FILTER (ad_status='hidden') AS hi FROM dim WHERE seller_id IS NOT NULL GROUP BY 1),
g AS (SELECT CASE WHEN ac>0 THEN 'shop_and_accepted' WHEN hi>0 THEN 'shop_and_hidden' ELSE 'shop_only' END AS seller_group, sh FROM f WHERE sh>0)
SELECT seller_group, COUNT(*) AS sellers, SUM(sh)::BIGINT AS shop_listings, round(100.0*SUM(sh)/SUM(SUM(sh)) OVER (),6) AS pct_listings FROM g GROUP BY 1""")
def _(s):
    return L.seller_status_groups(s.dim)


@query("city_status_share", "dim", """SELECT city_name, COUNT(*) FILTER (ad_status='shop_accepted') AS shop, COUNT(*) FILTER (ad_status='accepted') AS accepted, round(100.0*COUNT(*) FILTER (ad_status='shop_accepted')/COUNT(*),6) AS shop_pct FROM dim WHERE ad_status IN ('shop_accepted','accepted') GROUP BY 1 HAVING COUNT(*)>=10""")
def _(s):
    return L.city_status_share(s.dim, 10)


@query("first_week_match_rate", "snap dim", """WITH f AS (SELECT item_id, (MAX(LEAST(contacts_24h,views_24h))>0)::INT AS c FROM snap WHERE listing_age_days<=7 GROUP BY 1) SELECT district_name, COUNT(*) AS items, round(100.0*AVG(c),6) AS match_pct FROM f JOIN dim USING (item_id) GROUP BY 1""")
def _(s):
    return L.first_week_match_rate(s.snap, s.dim)


@query("dead_listing_profile", "snap dim", """WITH f AS (SELECT item_id FROM snap WHERE listing_age_days<=14 GROUP BY 1 HAVING MAX(LEAST(contacts_24h,views_24h))<=0), j AS (SELECT d.*, (f.item_id IS NOT NULL)::INT AS dead FROM dim d LEFT JOIN f USING (item_id)),
l AS (SELECT dead, unnest([{'variable':'district_name','value':district_name},{'variable':'price_bucket','value':price_bucket},{'variable':'furnishing','value':furnishing}]) AS p FROM j)
SELECT p.variable AS variable, p.value AS value, COUNT(*) AS items, round(100.0*AVG(dead),6) AS dead_pct FROM l GROUP BY 1,2""")
def _(s):
    return L.dead_listing_profile(s.snap, s.dim, ["district_name", "price_bucket", "furnishing"])


@query("survival_by_age", "snap dim", f"""WITH {EN}, b AS (SELECT category, (floor(listing_age_days/7)*7)::BIGINT AS age_bin, COUNT(*) AS listing_days, 100.0*AVG((contacts_24h>0)::INT) AS alive, AVG(views_24h) AS v, AVG(contacts_24h) AS c FROM en WHERE listing_age_days IS NOT NULL GROUP BY 1,2)
SELECT category, age_bin, listing_days, round(alive,6) AS alive_pct, round(v,6) AS avg_views, round(c,6) AS avg_contacts, round(100.0*v/first_value(v) OVER w,6) AS views_index, round(100.0*c/NULLIF(first_value(c) OVER w,0),6) AS contacts_index FROM b WINDOW w AS (PARTITION BY category ORDER BY age_bin)""")
def _(s):
    return L.survival_by_age(enriched(s))


@query("posting_cohort", "dim inter ev", """WITH l AS (SELECT item_id, SUM(lead_count) AS x FROM inter GROUP BY 1)
SELECT strftime(posted_date,'%Y-%m') AS posted_month, COUNT(*) AS listings, round(AVG(coalesce(x,0)),6) AS avg_leads, round(100.0*AVG((coalesce(x,0)>0)::INT),6) AS with_lead_pct FROM dim LEFT JOIN l USING (item_id) GROUP BY 1""")
def _(s):
    return L.posting_cohort(s.dim, s.inter)


@query("monthly_supply_demand", "dim inter", """WITH a AS (SELECT strftime(posted_date,'%Y-%m') AS month, COUNT(*) AS supply FROM dim GROUP BY 1), b AS (SELECT strftime(date,'%Y-%m') AS month, SUM(lead_count) AS demand FROM inter GROUP BY 1),
j AS (SELECT coalesce(a.month,b.month) AS month, coalesce(supply,0) AS supply, coalesce(demand,0) AS demand FROM a FULL JOIN b ON a.month=b.month) SELECT *, round(100.0*supply/SUM(supply) OVER (),6) AS supply_pct, round(100.0*demand/SUM(demand) OVER (),6) AS demand_pct FROM j""")
def _(s):
    return L.monthly_supply_demand(s.dim, s.inter)


@query("listing_survival_halves", "ev dim", f"""WITH m AS (SELECT MIN(date)+CAST(floor(DATE_DIFF('day',MIN(date),MAX(date))/2) AS INT) AS mid FROM ev), i AS (SELECT item_id, COUNT(*) FILTER (event_type IN {EX} AND date<mid) AS e1, COUNT(*) FILTER (event_type IN {EX} AND date>=mid) AS e2 FROM ev, m GROUP BY 1),
c AS (SELECT city_name, category, ad_type, COUNT(*) FILTER (e1>0) AS items_h1, COUNT(*) FILTER (e1>0 AND e2>0) AS items_both, COUNT(*) FILTER (e1>0 AND e2=0) AS items_h1_only, COUNT(*) FILTER (e1=0 AND e2>0) AS items_h2_only FROM i JOIN dim USING (item_id) GROUP BY 1,2,3)
SELECT *, round(items_both::DOUBLE/NULLIF(items_h1,0),6) AS survival_rate, round(100.0*items_h1_only/NULLIF(items_h1,0),6) AS churn_pct, CASE WHEN items_both::DOUBLE/NULLIF(items_h1,0)<0.3 THEN 'unstable_growth' ELSE 'stable' END AS growth_quality FROM c""")
def _(s):
    from bazaarlens.operators.region import period_middle
    return L.listing_survival_halves(s.ev, s.dim, ["city_name", "category", "ad_type"], period_middle(s.ev))


@query("market_share", "snap dim", f"""WITH {EN} SELECT category, COUNT(*) AS listing_days, SUM(contacts_24h) AS contacts, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS listing_days_pct, round(100.0*SUM(contacts_24h)/SUM(SUM(contacts_24h)) OVER (),6) AS contacts_pct FROM en GROUP BY 1""")
def _(s):
    return L.market_share(enriched(s))


PF = """v AS (SELECT item_id, SUM(views_24h) AS total_views, SUM(contacts_24h) AS total_contacts FROM snap GROUP BY 1), l AS (SELECT item_id, SUM(lead_count) AS n_leads, COUNT(*) AS n_contacts, COUNT(DISTINCT user_id) AS n_users, MIN(date) AS first_contact FROM inter GROUP BY 1),
pf AS (SELECT d.*, coalesce(total_views,0) AS total_views, coalesce(total_contacts,0) AS total_contacts, coalesce(n_leads,0) AS n_leads, coalesce(n_contacts,0) AS n_contacts, coalesce(n_users,0) AS n_users, (coalesce(n_leads,0)>0)::INT AS has_lead,
 DATE_DIFF('day',posted_date,first_contact)::INT AS days_to_first FROM dim d LEFT JOIN v USING (item_id) LEFT JOIN l USING (item_id))"""


def perf(s):
    return L.item_performance(s.dim, s.snap, s.inter)


@query("item_performance", "dim snap inter", f"WITH {PF} SELECT item_id, total_views, total_contacts, n_leads, n_contacts, n_users, has_lead, days_to_first::DOUBLE AS days_to_first, round(n_leads/NULLIF(total_views,0),6) AS lead_per_view FROM pf")
def _(s):
    return perf(s).select("item_id", "total_views", "total_contacts", "n_leads", "n_contacts", "n_users", "has_lead", F.col("days_to_first").cast("double").alias("days_to_first"), "lead_per_view")


@query("performance_by_images_furnishing", "dim snap inter", f"""WITH {PF} SELECT CASE WHEN images_count<3 THEN '0-2' WHEN images_count<6 THEN '3-5' ELSE '6+' END AS images, furnishing, COUNT(*) AS items, round(AVG(total_views),6) AS avg_views, round(AVG(n_leads),6) AS avg_leads, round(100.0*AVG(has_lead),6) AS with_lead_pct FROM pf GROUP BY 1,2""")
def _(s):
    return L.performance_by(perf(s), {"images": bucketize("images_count", [3, 6], ["0-2", "3-5", "6+"]), "furnishing": F.col("furnishing")})


@query("performance_by_title_length", "dim snap inter", f"""WITH {PF} SELECT CASE WHEN length(title)<15 THEN '<15' WHEN length(title)<22 THEN '15-21' ELSE '22+' END AS title_len, COUNT(*) AS items, round(AVG(total_views),6) AS avg_views, round(AVG(n_leads),6) AS avg_leads, round(100.0*AVG(has_lead),6) AS with_lead_pct FROM pf GROUP BY 1""")
def _(s):
    return L.performance_by(perf(s), {"title_len": bucketize(F.length("title"), [15, 22], ["<15", "15-21", "22+"])})


@query("performance_by_seller_district", "dim snap inter", f"""WITH {PF} SELECT seller_type, district_name, COUNT(*) AS items, round(AVG(total_views),6) AS avg_views, round(AVG(n_leads),6) AS avg_leads, round(100.0*AVG(has_lead),6) AS with_lead_pct FROM pf GROUP BY 1,2""")
def _(s):
    return L.performance_by(perf(s), {"seller_type": F.col("seller_type"), "district_name": F.col("district_name")})


@query("contact_velocity", "dim snap inter", f"""WITH {PF}, d(k) AS (VALUES (1),(3),(7),(14),(30)) SELECT k::VARCHAR AS within_days, round(100.0*AVG(coalesce((days_to_first<=k)::INT,0)),6) AS pct_items FROM pf, d GROUP BY 1""")
def _(s):
    return L.contact_velocity(perf(s))


RL = "rl AS (SELECT seller_id, ward_name, price_bucket, COUNT(*) AS n_list, DATE_DIFF('day',MIN(posted_date),MAX(posted_date)) AS r FROM dim WHERE seller_id IS NOT NULL AND ward_name IS NOT NULL AND price_bucket IS NOT NULL GROUP BY 1,2,3 HAVING COUNT(*)>1 AND DATE_DIFF('day',MIN(posted_date),MAX(posted_date))<=60)"


@query("relisting_groups", "dim", f"WITH {RL} SELECT seller_id, ward_name, price_bucket, n_list, r::INT AS date_range FROM rl")
def _(s):
    return L.relisting_groups(s.dim, 60)


@query("relisting_detection", "dim", f"WITH {RL}, s AS (SELECT seller_id, LEAST(SUM(n_list),20)::BIGINT AS relisted FROM rl GROUP BY 1) SELECT relisted, COUNT(*) AS sellers FROM s GROUP BY 1")
def _(s):
    return L.relisting_detection(s.dim, 60)


SCR = f"""{PF}, se AS (SELECT seller_id, AVG(images_count) AS avg_images, COUNT(*) AS listings, SUM(n_leads) AS leads, AVG(coalesce((furnishing='full')::INT,0)) AS full_rate FROM pf GROUP BY 1),
sc AS (SELECT *, (avg_images/(SELECT GREATEST(MAX(avg_images),1) FROM se)+full_rate)/2 AS quality_score FROM se)"""


@query("seller_scorecard", "dim snap inter", f"WITH {SCR} SELECT seller_id, round(avg_images,6) AS avg_images, listings, leads, round(full_rate,6) AS full_rate, round(quality_score,6) AS quality_score FROM sc")
def _(s):
    return L.seller_scorecard(perf(s))


@query("top_sellers", "dim snap inter", f"WITH {SCR} SELECT seller_id, listings, leads FROM sc ORDER BY leads DESC, seller_id LIMIT 20")
def _(s):
    return L.top_sellers(L.seller_scorecard(perf(s))).select("seller_id", "listings", "leads")


@query("monthly_posting_of_top_sellers", "dim snap inter", f"WITH {SCR}, t AS (SELECT seller_id FROM sc ORDER BY leads DESC, seller_id LIMIT 20) SELECT seller_id, strftime(posted_date,'%Y-%m') AS month, COUNT(*) AS listings FROM dim JOIN t USING (seller_id) GROUP BY 1,2")
def _(s):
    return L.monthly_posting_of_top_sellers(s.dim, L.seller_scorecard(perf(s)))


@query("posting_frequency_bins", "dim", """WITH n AS (SELECT seller_id, COUNT(*) AS n FROM dim WHERE seller_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN n<=1 THEN '1' WHEN n<=5 THEN '2-5' WHEN n<=20 THEN '6-20' WHEN n<=50 THEN '21-50' ELSE '>50' END AS bin, COUNT(*) AS sellers, SUM(n)::BIGINT AS listings, round(100.0*SUM(n)/SUM(SUM(n)) OVER (),6) AS listings_pct FROM n GROUP BY 1""")
def _(s):
    return L.posting_frequency_bins(s.dim)


@query("issue_scorecard", "dim snap inter", f"""WITH {PF}, w AS (SELECT COUNT(*) AS t, unnest([{{'issue':'no_image','n':COUNT(*) FILTER (images_count=0)}},{{'issue':'no_furnishing','n':COUNT(*) FILTER (furnishing IS NULL)}},{{'issue':'no_area','n':COUNT(*) FILTER (area_sqm IS NULL)}},
 {{'issue':'no_price','n':COUNT(*) FILTER (price_bucket IS NULL)}},{{'issue':'zero_views','n':COUNT(*) FILTER (total_views=0)}},{{'issue':'zero_leads','n':COUNT(*) FILTER (n_leads=0)}},{{'issue':'deleted','n':COUNT(*) FILTER (ad_status='deleted')}},
 {{'issue':'area_outlier','n':COUNT(*) FILTER (area_sqm>180)}},{{'issue':'no_image_with_leads','n':COUNT(*) FILTER (images_count=0 AND n_leads>0)}}]) AS p FROM pf)
SELECT p.issue AS issue, p.n AS n, round(100.0*p.n/t,6) AS pct FROM w""")
def _(s):
    return L.issue_scorecard(perf(s), 180)


@query("top_vs_bottom_decile", "dim snap inter", f"""WITH {PF}, q AS (SELECT quantile_cont(n_leads,0.98) AS c FROM pf), t AS (SELECT *, CASE WHEN n_leads=0 THEN 'bottom' WHEN n_leads>=c THEN 'top' END AS grp FROM pf, q)
SELECT grp, COUNT(*) AS items, round(AVG(images_count),6) AS avg_images, round(AVG(area_sqm),6) AS avg_area, round(100.0*AVG(coalesce((furnishing='full')::INT,0)),6) AS full_pct, round(100.0*AVG(coalesce((seller_type='agent')::INT,0)),6) AS agent_pct,
 median(DATE_DIFF('day',posted_date,expected_expired_date)) AS median_duration FROM t WHERE grp IS NOT NULL GROUP BY 1""")
def _(s):
    return L.top_vs_bottom_decile(perf(s), 0.98)


# ---- series -------------------------------------------------------------------------------------

DS = f"""dc AS (SELECT city_name, date, COUNT(*)::DOUBLE AS y FROM ev WHERE event_type IN {PO} AND is_login='login' GROUP BY 1,2), sp AS (SELECT city_name, MIN(date) AS lo, MAX(date) AS hi FROM dc GROUP BY 1),
cal AS (SELECT city_name, unnest(generate_series(lo,hi,INTERVAL 1 DAY))::DATE AS date FROM sp), j AS (SELECT cal.*, y, CASE WHEN y IS NOT NULL THEN date END AS kd FROM cal LEFT JOIN dc USING (city_name,date)),
k AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS pv, last_value(kd IGNORE NULLS) OVER b AS pd, first_value(y IGNORE NULLS) OVER a AS nv, first_value(kd IGNORE NULLS) OVER a AS nd FROM j
 WINDOW b AS (PARTITION BY city_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY city_name ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ds AS (SELECT city_name, date, coalesce(y, pv+(nv-pv)*DATE_DIFF('day',pd,date)::DOUBLE/DATE_DIFF('day',pd,nd)) AS y, (y IS NULL)::INT AS interpolated FROM k)"""


def daily(s):
    counts = s.ev.filter(is_positive() & (F.col("is_login") == "login")).groupBy("city_name", "date").agg(F.count("*").cast("double").alias("y"))
    return L.daily_series_fill(counts, ["city_name"])


@query("daily_series_fill", "ev", f"WITH {DS} SELECT city_name, date::VARCHAR AS date, round(y,6) AS y, interpolated FROM ds")
def _(s):
    return daily(s)


WD = f"""{DS}, t AS (SELECT *, (isodow(date)-1)::INT AS dow, CASE WHEN COUNT(y) OVER w=7 THEN AVG(y) OVER w END AS trend FROM ds WINDOW w AS (PARTITION BY city_name ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT city_name, dow, AVG(y-trend) AS raw FROM t WHERE NOT (date BETWEEN DATE'2024-01-14' AND DATE'2024-01-16') GROUP BY 1,2), sn AS (SELECT city_name, dow, raw-AVG(raw) OVER (PARTITION BY city_name) AS seasonal FROM p)"""


@query("weekly_decomposition", "ev", f"WITH {WD} SELECT city_name, date::VARCHAR AS date, dow, round(y,6) AS y, interpolated, round(trend,6) AS trend, round(seasonal,6) AS seasonal, round(y-trend-seasonal,6) AS residual FROM t LEFT JOIN sn USING (city_name,dow)")
def _(s):
    return L.weekly_decomposition(daily(s), ["city_name"], holiday=("2024-01-14", "2024-01-16"))


@query("weekday_spread", "ev", f"""WITH {WD} SELECT city_name, (SELECT dow FROM sn x WHERE x.city_name=sn.city_name ORDER BY seasonal DESC, dow LIMIT 1) AS peak_dow, round(MAX(seasonal)-MIN(seasonal),6) AS spread,
 round(AVG(seasonal) FILTER (dow>=5)-AVG(seasonal) FILTER (dow BETWEEN 1 AND 4),6) AS weekend_minus_midweek FROM sn GROUP BY 1""")
def _(s):
    return L.weekday_spread(L.weekly_decomposition(daily(s), ["city_name"], holiday=("2024-01-14", "2024-01-16")), ["city_name"])


@query("robust_decomposition")
def _(s):
    """LOESS trend and weekly part with bisquare weights (no SQL form; equal to plain Python in the tests)."""
    return L.robust_decomposition(daily(s), ["city_name"])
