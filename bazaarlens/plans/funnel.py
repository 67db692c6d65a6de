"""Funnel, contact-rate and journey queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions import buckets as B
from bazaarlens.functions.columns import bucketize, flag, is_positive
from bazaarlens.operators import funnel as C
from bazaarlens.operators import journey as D
from bazaarlens.operators.core import join_keys
from bazaarlens.operators.quality import posted_cohort
from bazaarlens.plans.primitives import EX, PO, near
from bazaarlens.plans.registry import query

DEVICES = ["Desktop", "MSite", "iOS", "Android"]
PV = "event_type='pageview'"
OI = "event_type='other_interaction'"
SEARCH = "event_type='pageview' AND coalesce(trim(query)<>'',false)"


@query("event_cvr_by_category", "ev", f"""
SELECT category, COUNT(*) AS events, COUNT(*) FILTER ({PV}) AS pageviews, COUNT(*) FILTER ({OI}) AS other, COUNT(*) FILTER (event_type='view_phone') AS view_phone,
 COUNT(*) FILTER (event_type='contact_chat') AS contact_chat, COUNT(*) FILTER (event_type='contact_zalo') AS contact_zalo, COUNT(*) FILTER (event_type='contact_sms') AS contact_sms,
 COUNT(*) FILTER (event_type IN {PO}) AS positives, round(100.0*COUNT(*) FILTER (event_type IN {PO})/COUNT(*),6) AS cvr_pct FROM ev GROUP BY 1""")
def _(s):
    return C.event_cvr_by_category(s.ev)


@query("stage_funnel", "ev", f"""
WITH c AS (SELECT category, COUNT(*) FILTER ({PV}) AS pageview, COUNT(*) FILTER ({OI}) AS other, COUNT(*) FILTER (event_type='view_phone') AS phone, COUNT(*) FILTER (event_type IN ('contact_chat','contact_zalo','contact_sms')) AS direct FROM ev GROUP BY 1)
SELECT *, round(100-100.0*other/NULLIF(pageview,0),6) AS drop_pageview_other_pct, round(100-100.0*phone/NULLIF(other,0),6) AS drop_other_phone_pct, round(100-100.0*direct/NULLIF(phone,0),6) AS drop_phone_direct_pct FROM c""")
def _(s):
    return C.stage_funnel(s.ev)


@query("listing_cvr_by_dims", "ev dim", f"""
SELECT category, ad_type, CASE WHEN bedrooms IS NULL OR bedrooms<=0 THEN 'unknown_or_0' WHEN bedrooms<=1 THEN '1' WHEN bedrooms<=2 THEN '2' WHEN bedrooms<=3 THEN '3' ELSE '4+' END AS bed_bucket,
 COUNT(*) AS listings, SUM((item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO}))::INT)::BIGINT AS with_positive,
 round(100.0*SUM((item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO}))::INT)/COUNT(*),6) AS cvr_pct FROM dim GROUP BY 1,2,3 HAVING COUNT(*)>=20""")
def _(s):
    return C.listing_cvr_by_dims(B.structure_buckets(s.dim), s.ev, ["category", "ad_type", "bed_bucket"], 20)


SI = f"""si AS (SELECT category, session_id, item_id, MAX(user_id) AS user_id, MAX(({PV})::INT) AS has_pageview, MAX(({OI})::INT) AS has_other, MAX(({OI} AND coalesce(surface,'')='ad_view')::INT) AS has_ad_view,
 MAX(({OI} AND coalesce(surface,'')='adview')::INT) AS has_adview, MAX(({OI} AND coalesce(surface,'') NOT IN ('ad_view','adview'))::INT) AS has_other_surface,
 MAX(({PV} AND dwell_time_sec>30)::INT) AS has_consider, MAX((event_type IN {EX})::INT) AS has_explicit FROM ev WHERE item_id IS NOT NULL GROUP BY 1,2,3)"""


@query("session_item_flags", "ev", f"WITH {SI} SELECT * FROM si")
def _(s):
    return C.session_item_flags(s.ev)


@query("contact_rate_three_grains", "ev", f"""WITH {SI},
se AS (SELECT category, session_id, MAX(has_pageview) AS v, MAX(has_explicit) AS e FROM si GROUP BY 1,2),
us AS (SELECT category, user_id, MAX(({PV})::INT) AS v, MAX((event_type IN {EX})::INT) AS e FROM ev WHERE item_id IS NOT NULL GROUP BY 1,2)
SELECT category, 'session_item' AS grain, COUNT(*) AS n, COUNT(*) FILTER (has_pageview=1) AS n_with_pageview, COUNT(*) FILTER (has_pageview=1 AND has_explicit=1) AS n_contact,
 round(100.0*COUNT(*) FILTER (has_pageview=1 AND has_explicit=1)/NULLIF(COUNT(*) FILTER (has_pageview=1),0),6) AS contact_rate_pct FROM si GROUP BY 1
UNION ALL SELECT category,'session',COUNT(*),COUNT(*) FILTER (v=1),COUNT(*) FILTER (e=1),round(100.0*COUNT(*) FILTER (e=1)/COUNT(*),6) FROM se GROUP BY 1
UNION ALL SELECT category,'user',COUNT(*),COUNT(*),COUNT(*) FILTER (e=1),round(100.0*COUNT(*) FILTER (e=1)/COUNT(*),6) FROM us WHERE v=1 GROUP BY 1""")
def _(s):
    return C.contact_rate_three_grains(s.ev)


PATHS = f"""{SI}, b AS (SELECT * FROM si WHERE has_pageview=1), p AS (SELECT category, 'A_pageview_only' AS path, has_explicit AS x FROM b WHERE has_ad_view=0 AND has_adview=0 AND has_other_surface=0
 UNION ALL SELECT category,'B_plus_ad_view',has_explicit FROM b WHERE has_ad_view=1 UNION ALL SELECT category,'C_plus_adview',has_explicit FROM b WHERE has_adview=1
 UNION ALL SELECT category,'D_plus_other_surface',has_explicit FROM b WHERE has_other_surface=1 UNION ALL SELECT category,'Z_all_pageview',has_explicit FROM b),
r AS (SELECT category, path, COUNT(*) AS n_items, SUM(x)::BIGINT AS n_explicit, 100.0*SUM(x)/COUNT(*) AS rate FROM p GROUP BY 1,2)"""


@query("path_conditional_rates", "ev", f"WITH {PATHS} SELECT category, path, n_items, n_explicit, round(rate,6) AS explicit_rate_pct FROM r")
def _(s):
    return C.path_conditional_rates(s.ev)


@query("path_incremental_weights", "ev", f"""WITH {PATHS}, l AS (SELECT *, rate-MAX(CASE WHEN path='A_pageview_only' THEN rate END) OVER (PARTITION BY category) AS lift FROM r WHERE path<>'Z_all_pageview'),
t AS (SELECT *, SUM(GREATEST(lift,0)) OVER (PARTITION BY category) AS tot FROM l)
SELECT category, path, round(rate,6) AS explicit_rate_pct, round(lift,6) AS lift_pp, CASE WHEN path<>'A_pageview_only' THEN round(CASE WHEN tot>0 THEN GREATEST(lift,0)/tot ELSE 0 END,6) END AS path_weight FROM t""")
def _(s):
    return C.path_incremental_weights(s.ev)


@query("logistic_contributions")
def _(s):
    return C.logistic_contributions(s.ev)


SESS = f"""vs AS (SELECT DISTINCT e.category, session_id FROM ev e JOIN inter i ON i.user_id=e.user_id AND i.item_id=e.item_id AND i.date=e.date AND chat_message_count>0 WHERE event_type='contact_chat' AND is_login='login'),
s0 AS (SELECT category, session_id, MAX(({SEARCH})::INT) AS search, MAX(({PV})::INT) AS pageview, MAX(({OI})::INT) AS other, MAX((event_type='view_phone')::INT) AS phone, MAX((event_type='contact_zalo')::INT) AS zalo,
 MAX((event_type='contact_sms')::INT) AS sms, MAX((event_type='contact_chat')::INT) AS chat_raw FROM ev GROUP BY 1,2),
s1 AS (SELECT s0.*, (vs.session_id IS NOT NULL)::INT AS chat_verified FROM s0 LEFT JOIN vs USING (category, session_id)),
ss AS (SELECT *, GREATEST(phone,zalo,sms,chat_verified) AS explicit_any FROM s1)"""
AB = ", ".join(f"round(100.0*AVG({m}) FILTER (other={v}),6) AS {m}_{n}_pct" for m in ("phone", "chat_raw", "chat_verified", "zalo", "sms", "explicit_any") for n, v in (("with", 1), ("without", 0)))


@query("session_ab_lift", "ev inter", f"""WITH {SESS} SELECT category, COUNT(*) FILTER (other=1) AS sessions_with, COUNT(*) FILTER (other=0) AS sessions_without, {AB},
 round(100.0*AVG(explicit_any) FILTER (other=1)-100.0*AVG(explicit_any) FILTER (other=0),6) AS lift_pp FROM ss WHERE pageview=1 GROUP BY 1""")
def _(s):
    return C.session_ab_lift(s.ev, s.inter)


@query("session_funnel_steps", "ev inter", f"""WITH {SESS}, w AS (SELECT category, COUNT(*) AS sessions, unnest([{{'step':'search','v':SUM(search)}},{{'step':'pageview','v':SUM(pageview)}},{{'step':'other','v':SUM(other)}},{{'step':'phone','v':SUM(phone)}},
 {{'step':'zalo','v':SUM(zalo)}},{{'step':'sms','v':SUM(sms)}},{{'step':'chat_verified','v':SUM(chat_verified)}},{{'step':'explicit_any','v':SUM(explicit_any)}}]) AS p FROM ss GROUP BY 1)
SELECT category, sessions, p.step AS step, p.v::DOUBLE AS n_sessions, round(100.0*p.v/sessions,6) AS pct_of_sessions FROM w""")
def _(s):
    return C.session_funnel_steps(s.ev, s.inter)


@query("session_path_transitions", "ev inter", f"""WITH {SESS}, l AS (SELECT category, CASE WHEN other=1 AND explicit_any=1 THEN 'pv_other_explicit' WHEN other=1 THEN 'pv_other_no_explicit' WHEN explicit_any=1 THEN 'pv_explicit_skip_other' ELSE 'pv_only_no_explicit' END AS path FROM ss WHERE pageview=1)
SELECT category, path, COUNT(*) AS n_sessions, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS pct_of_pv_sessions FROM l GROUP BY 1,2""")
def _(s):
    return C.session_path_transitions(s.ev, s.inter)


@query("session_funnel_by_device", "ev", f"""WITH f AS (SELECT device, session_id, MAX(({SEARCH})::INT) AS search, MAX(({PV})::INT) AS v, MAX(({PV} AND dwell_time_sec>30)::INT) AS c, MAX((event_type IN {EX})::INT) AS e FROM ev GROUP BY 1,2)
SELECT device, COUNT(*) AS sessions, SUM(search)::BIGINT AS search, SUM(v)::BIGINT AS "view", SUM(c)::BIGINT AS consider, SUM(e)::BIGINT AS contact, round(100.0*COUNT(*) FILTER (v=1 AND e=1)/NULLIF(SUM(v),0),6) AS view_to_contact_pct FROM f GROUP BY 1""")
def _(s):
    return C.session_funnel_by_device(s.ev)


@query("item_funnel", "ev", f"""WITH f AS (SELECT category, item_id, MAX(({PV})::INT) AS v, MAX(({OI})::INT) AS o, MAX((event_type IN {EX})::INT) AS e FROM ev GROUP BY 1,2)
SELECT category, COUNT(*) AS items, round(100.0*AVG(v),6) AS viewed_pct, round(100.0*AVG(o),6) AS other_pct, round(100.0*AVG(e),6) AS contacted_pct FROM f GROUP BY 1""")
def _(s):
    return C.item_funnel(s.ev)


@query("unmet_search_sessions", "ev", f"""WITH f AS (SELECT category, session_id, MAX(({SEARCH})::INT) AS q, MAX(({PV} AND NOT coalesce(trim(query)<>'',false))::INT) AS v FROM ev GROUP BY 1,2)
SELECT category, COUNT(*) AS search_sessions, COUNT(*) FILTER (v=0) AS unmet, round(100.0*COUNT(*) FILTER (v=0)/COUNT(*),6) AS unmet_pct FROM f WHERE q=1 GROUP BY 1""")
def _(s):
    return C.unmet_search_sessions(s.ev)


@query("demand_users_by_login", "ev", f"""SELECT category, is_login, COUNT(DISTINCT user_id) AS users, round(100.0*COUNT(DISTINCT user_id)/SUM(COUNT(DISTINCT user_id)) OVER (PARTITION BY category),6) AS pct FROM ev WHERE event_type IN {PO} GROUP BY 1,2""")
def _(s):
    return C.demand_users_by_login(s.ev)


@query("demand_by_category_device", "ev", f"SELECT category, {', '.join(f"COUNT(DISTINCT user_id) FILTER (device='{d}') AS exact_{d}, 1::INT AS near_{d}" for d in DEVICES)} FROM ev WHERE event_type IN {PO} GROUP BY 1")
def _(s):
    exact = s.ev.filter(is_positive()).groupBy("category").agg(*[F.countDistinct(F.when(F.col("device") == d, F.col("user_id"))).alias(f"exact_{d}") for d in DEVICES])
    both = join_keys(C.demand_by_category_device(s.ev, DEVICES), exact, ["category"])
    return both.select("category", *[f"exact_{d}" for d in DEVICES], *[near(f"u_{d}", f"exact_{d}").alias(f"near_{d}") for d in DEVICES])


@query("event_mix", "ev", "SELECT device, event_type, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY device),6) AS pct FROM ev GROUP BY 1,2")
def _(s):
    return C.event_mix(s.ev, "device")


@query("other_interaction_composition", "ev", f"""SELECT surface, device, COUNT(*) AS n, round(100.0*AVG((position IS NULL)::INT),6) AS null_position_pct, round(100.0*AVG((query IS NULL)::INT),6) AS null_query_pct, round(quantile_cont(dwell_time_sec,0.5),6) AS dwell_p50,
 round(quantile_cont(dwell_time_sec,0.9),6) AS dwell_p90, round(quantile_cont(position,0.5),6) AS position_p50, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct FROM ev WHERE {OI} GROUP BY 1,2""")
def _(s):
    return C.other_interaction_composition(s.ev)


@query("high_intent_cooccurrence", "ev", f"""WITH f AS (SELECT session_id, MAX(({OI})::INT) AS o, MAX((event_type='view_phone')::INT) AS phone, MAX((event_type='contact_chat')::INT) AS chat, MAX((event_type='contact_zalo')::INT) AS zalo FROM ev GROUP BY 1)
SELECT phone, chat, zalo, COUNT(*) AS sessions, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct FROM f WHERE o=1 GROUP BY 1,2,3""")
def _(s):
    return C.high_intent_cooccurrence(s.ev)


@query("dwell_by_event", "ev", f"""SELECT category, event_type, round(AVG(dwell_time_sec),6) AS avg_dwell, COUNT(*) AS n, round(quantile_cont(dwell_time_sec,0.5),6) AS p50, round(quantile_cont(dwell_time_sec,0.9),6) AS p90
FROM ev WHERE ({PV} OR {OI}) AND dwell_time_sec>0 AND dwell_time_sec<=600 GROUP BY 1,2""")
def _(s):
    return C.dwell_by_event(s.ev)


@query("dwell_by_event_and_group", "ev", f"""WITH f AS (SELECT category, session_id, item_id, MAX(({OI})::INT) AS has_other, MAX(CASE WHEN {PV} THEN dwell_time_sec END) AS d FROM ev WHERE item_id IS NOT NULL GROUP BY 1,2,3)
SELECT category, has_other, round(AVG(d),6) AS avg_dwell, COUNT(*) AS n, round(quantile_cont(d,0.5),6) AS p50 FROM f WHERE d>0 AND d<=600 GROUP BY 1,2""")
def _(s):
    return C.dwell_by_group(s.ev)


@query("repeated_other_dwell", "ev", f"""WITH f AS (SELECT category, session_id, item_id, COUNT(*) AS n_other, MAX(dwell_time_sec) AS d FROM ev WHERE {OI} AND item_id IS NOT NULL GROUP BY 1,2,3 HAVING COUNT(*)>=2)
SELECT CASE WHEN d<5 THEN 'fast_swipe_lt5s' WHEN d<15 THEN 'short_5-15s' ELSE 'long_15s+' END AS band, COUNT(*) AS n, round(AVG(n_other),6) AS avg_other FROM f GROUP BY 1""")
def _(s):
    return C.repeated_other_dwell(s.ev)


@query("hour_dow_matrix", "ev", "SELECT (isodow(event_ts)-1)::INT AS dow, hour(event_ts)::INT AS hour, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct FROM ev GROUP BY 1,2")
def _(s):
    return C.hour_dow_matrix(s.ev)


@query("peak_hours_share", "ev", """WITH d AS (SELECT category, date, COUNT(*) AS n, COUNT(*) FILTER (hour(event_ts) IN (19,20,21)) AS p FROM ev GROUP BY 1,2)
SELECT category, round(100.0*SUM(p)/SUM(n),6) AS peak_pct, round(AVG(100.0*p/n),6) AS mean_daily_peak_pct FROM d GROUP BY 1""")
def _(s):
    return C.peak_hours_share(s.ev, [19, 20, 21])


@query("position_ctr_proxy", "ev", f"""SELECT category, CASE WHEN position<=5 THEN '1-5' WHEN position<=10 THEN '6-10' WHEN position<=20 THEN '11-20' ELSE '21+' END AS position_bucket, COUNT(*) AS clicks,
 round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS pct_of_clicks FROM ev WHERE {PV} AND position IS NOT NULL GROUP BY 1,2""")
def _(s):
    return C.position_ctr_proxy(s.ev)


@query("stars_and_blackholes", "ev snap", f"""WITH pv AS (SELECT category, item_id, COUNT(*) AS pageviews, median(position) AS med FROM ev WHERE {PV} AND position IS NOT NULL AND item_id IS NOT NULL GROUP BY 1,2 HAVING COUNT(*)>=5),
ex AS (SELECT item_id, SUM(views_24h) AS x FROM snap GROUP BY 1), i AS (SELECT pv.*, coalesce(x,0) AS exposure, 100.0*pageviews/NULLIF(coalesce(x,0),0) AS ctr FROM pv LEFT JOIN ex USING (item_id)),
q AS (SELECT category, quantile_cont(pageviews,0.9) AS pv90, quantile_cont(exposure,0.75) AS ex75, quantile_cont(ctr,0.25) AS ctr25 FROM i GROUP BY 1), j AS (SELECT * FROM i JOIN q USING (category)),
o AS (SELECT *, 'star' AS kind, row_number() OVER (PARTITION BY category ORDER BY pageviews DESC, item_id)::INT AS rank FROM j WHERE med>=15 AND pageviews>=pv90
 UNION ALL SELECT *, 'black_hole', row_number() OVER (PARTITION BY category ORDER BY ctr, item_id)::INT FROM j WHERE med<=3 AND exposure>=ex75 AND coalesce(ctr,100)<=ctr25)
SELECT category, item_id, kind, pageviews, round(med,6) AS med_position, exposure, round(ctr,6) AS ctr_proxy_pct, rank FROM o WHERE rank<=50""")
def _(s):
    return C.stars_and_blackholes(s.ev, s.snap)


@query("content_blackholes", "ev dim snap", f"""WITH st AS (SELECT category, item_id, COUNT(*) FILTER ({PV}) AS pageviews, COUNT(*) FILTER ({OI}) AS other_ix, COUNT(*) FILTER (event_type IN {EX}) AS explicit FROM ev GROUP BY 1,2),
h AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pageviews DESC, other_ix DESC, item_id)::INT AS rank FROM st WHERE pageviews>=20 AND other_ix>=5 AND explicit<=40 QUALIFY rank<=100),
sn AS (SELECT item_id, median(listing_age_days) AS median_age, AVG(contacts_24h) AS avg_contacts FROM snap GROUP BY 1)
SELECT h.*, title, ad_type, round(median_age,6) AS median_age, round(avg_contacts,6) AS avg_contacts FROM h LEFT JOIN dim USING (item_id) LEFT JOIN sn USING (item_id)""".replace("SELECT h.*, title, ad_type,", "SELECT h.category, h.item_id, pageviews, other_ix, explicit, rank, title, ad_type,"))
def _(s):
    return C.content_blackholes(s.ev, s.dim, s.snap, max_explicit=40)


@query("dwell_traps", "ev", f"""WITH v AS (SELECT category, item_id, AVG(dwell_time_sec) AS avg_dwell, COUNT(*) AS pageviews FROM ev WHERE {PV} GROUP BY 1,2), c AS (SELECT category, item_id, COUNT(*) AS contacts FROM ev WHERE is_contact=1 OR event_type IN {PO} GROUP BY 1,2),
q AS (SELECT category, quantile_cont(avg_dwell,0.95) AS p95 FROM v GROUP BY 1)
SELECT category, item_id, round(avg_dwell,6) AS avg_dwell, pageviews, coalesce(contacts,0) AS contacts, row_number() OVER (PARTITION BY category ORDER BY avg_dwell DESC, item_id)::INT AS rank
FROM v LEFT JOIN c USING (category,item_id) JOIN q USING (category) WHERE avg_dwell>=p95 AND coalesce(contacts,0)<=1 QUALIFY rank<=30""")
def _(s):
    return C.dwell_traps(s.ev)


@query("contact_burst_sessions", "ev", f"""WITH f AS (SELECT category, user_id, session_id FROM ev WHERE event_type IN {PO} GROUP BY ALL HAVING COUNT(DISTINCT item_id)>=2)
SELECT category, COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS users FROM f GROUP BY 1""")
def _(s):
    return C.contact_burst_sessions(s.ev, 2)


ST = """m AS (SELECT session_id, device FROM (SELECT session_id, device, COUNT(*) AS n FROM ev GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, device)=1),
g AS (SELECT session_id, COUNT(*) AS n_events, COUNT(DISTINCT item_id) AS n_items, MAX(is_contact)::INT AS converted, (epoch_us(MAX(event_ts))-epoch_us(MIN(event_ts)))/1e6 AS duration_s FROM ev GROUP BY 1),
st AS (SELECT g.*, device, (n_events=1)::INT AS is_bounce, CASE WHEN n_events<=1 THEN '1' WHEN n_events<=3 THEN '2-3' WHEN n_events<=5 THEN '4-5' WHEN n_events<=10 THEN '6-10' WHEN n_events<=20 THEN '11-20' ELSE '>20' END AS event_bin,
 CASE WHEN duration_s<30 THEN '<30s' WHEN duration_s<120 THEN '30s-2min' WHEN duration_s<300 THEN '2-5min' WHEN duration_s<900 THEN '5-15min' ELSE '>15min' END AS duration_bin FROM g JOIN m USING (session_id))"""


@query("session_stats", "ev", f"WITH {ST} SELECT * REPLACE (round(duration_s,6) AS duration_s) FROM st")
def _(s):
    return C.session_stats(s.ev)


@query("session_stats_by_bin", "ev", f"WITH {ST} SELECT event_bin, duration_bin, converted, COUNT(*) AS sessions, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY converted),6) AS pct FROM st GROUP BY 1,2,3")
def _(s):
    return C.session_stats_by_bin(s.ev)


@query("bounce_by_device", "ev", f"WITH {ST} SELECT device, COUNT(*) AS sessions, round(100.0*AVG(is_bounce),6) AS bounce_pct, round(AVG(n_events),6) AS avg_events FROM st GROUP BY 1")
def _(s):
    return C.bounce_by_device(s.ev)


@query("login_vs_nonlogin", "ev", f"""WITH e AS (SELECT category, is_login, COUNT(*) AS events, round(100.0*AVG((event_type IN {EX})::INT),6) AS explicit_event_pct, round(100.0*AVG((event_type IN {PO})::INT),6) AS positive_event_pct FROM ev GROUP BY 1,2),
f AS (SELECT category, is_login, session_id, MAX((event_type IN {EX})::INT) AS e, MAX((event_type IN {PO})::INT) AS p FROM ev GROUP BY 1,2,3),
g AS (SELECT category, is_login, COUNT(*) AS sessions, round(100.0*AVG(e),6) AS explicit_session_pct, round(100.0*AVG(p),6) AS positive_session_pct FROM f GROUP BY 1,2) SELECT * FROM e JOIN g USING (category, is_login)""")
def _(s):
    return C.login_vs_nonlogin(s.ev)


@query("chat_verification_buckets", "ev inter", """WITH b AS (SELECT is_login, CASE WHEN chat_message_count IS NULL THEN 'no_match' WHEN chat_message_count>0 THEN 'msg_gt0' ELSE 'msg_zero' END AS bucket FROM ev LEFT JOIN inter USING (user_id, item_id, date) WHERE event_type='contact_chat')
SELECT is_login, bucket, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY is_login),6) AS pct FROM b GROUP BY 1,2""")
def _(s):
    return C.chat_verification_buckets(s.ev, s.inter)


@query("daily_cvr_rolling", "ev", f"""WITH d AS (SELECT category, date, COUNT(*) AS events, 100.0*COUNT(*) FILTER (event_type IN {PO})/COUNT(*) AS c FROM ev GROUP BY 1,2)
SELECT category, date::VARCHAR AS date, events, round(c,6) AS cvr_pct, round(AVG(c) OVER (PARTITION BY category ORDER BY date ROWS 6 PRECEDING),6) AS cvr_7d FROM d""")
def _(s):
    return C.daily_cvr_rolling(s.ev)


UIM = f"uim AS (SELECT user_id, item_id, category, COUNT(*) FILTER (event_type IN {EX}) AS explicit, COUNT(*) FILTER ({OI}) AS n_other FROM ev WHERE event_type IN {PO} GROUP BY ALL)"


@query("interaction_buckets", "ev", f"""WITH {UIM}, t AS (SELECT user_id, SUM(explicit) AS x, SUM(n_other) AS o, LEAST(SUM(n_other),200)::DOUBLE AS v FROM uim GROUP BY 1),
e AS (SELECT list_sort(list_distinct([quantile_cont(v,0.0),quantile_cont(v,0.2),quantile_cont(v,0.4),quantile_cont(v,0.6),quantile_cont(v,0.8),quantile_cont(v,1.0)])) AS ed FROM t)
SELECT GREATEST(len(list_filter(ed, lambda z: z < v)),1)::INT AS bucket, COUNT(*) AS n, round(100.0*AVG((x>0)::INT),6) AS has_explicit_pct, round(AVG(x),6) AS avg_explicit, round(AVG(o),6) AS avg_other, round(AVG(x::DOUBLE/GREATEST(x+o,1)),6) AS explicit_ratio FROM t, e GROUP BY 1""")
def _(s):
    return C.interaction_buckets(s.ev, "user_id", 200)


def _rho(key: str) -> str:
    return f"""(SELECT corr(rx,ry) FROM (SELECT rank() OVER (ORDER BY x)+(COUNT(*) OVER (PARTITION BY x)-1)/2.0 AS rx, rank() OVER (ORDER BY y)+(COUNT(*) OVER (PARTITION BY y)-1)/2.0 AS ry FROM (SELECT SUM(explicit) AS x, SUM(n_other) AS y FROM uim GROUP BY {key})))"""


@query("interaction_weight_study", "ev", f"""WITH {UIM}, a AS (SELECT COUNT(*) AS pairs, COUNT(*) FILTER (n_other>0) AS pairs_with_other, COUNT(*) FILTER (n_other>0 AND explicit>0)::DOUBLE/COUNT(*) FILTER (n_other>0) AS g, COUNT(*) FILTER (explicit>0)::DOUBLE/COUNT(*) AS h FROM uim),
b AS (SELECT *, g/h AS lift, {_rho('user_id')} AS su, {_rho('item_id')} AS si FROM a)
SELECT pairs, pairs_with_other, round(g,6) AS explicit_given_other, round(h,6) AS explicit_all, round(lift,6) AS lift, round(su,6) AS spearman_user, round(si,6) AS spearman_item, GREATEST(0.5, round(10.0*si*LEAST(lift,2.0)*0.5,1)) AS proposed_weight FROM b""")
def _(s):
    return C.interaction_weight_study(s.ev)


@query("interaction_mix", "ev", f"WITH {UIM} SELECT category, SUM(explicit)::BIGINT AS explicit, SUM(n_other)::BIGINT AS other, round(100.0*SUM(n_other)/GREATEST(SUM(explicit)+SUM(n_other),1),6) AS other_pct FROM uim GROUP BY 1")
def _(s):
    return C.interaction_mix(s.ev)


@query("sliced_cvr", "ev dim", f"""WITH c AS (SELECT item_id, COUNT(*) AS e, COUNT(*) FILTER (event_type IN {PO}) AS p, COUNT(*) FILTER (event_type IN {EX}) AS x FROM ev GROUP BY 1),
l AS (SELECT item_id, e, p, x, unnest([{{'slice':'district','value':district_name}},{{'slice':'seller_type','value':seller_type}},{{'slice':'furnishing','value':furnishing}},{{'slice':'bathrooms','value':CAST(bathrooms AS INT)::VARCHAR}},
 {{'slice':'images','value':CASE WHEN images_count<1 THEN '0' WHEN images_count<5 THEN '1-4' ELSE '5+' END}},{{'slice':'title_rent','value':(contains(title,'thuê'))::INT::VARCHAR}}]) AS q FROM dim JOIN c USING (item_id))
SELECT q.slice AS slice, q.value AS value, COUNT(*) AS items, SUM(e)::BIGINT AS events, round(100.0*SUM(p)/SUM(e),6) AS positive_pct, round(100.0*SUM(x)/SUM(e),6) AS explicit_pct FROM l GROUP BY 1,2 HAVING SUM(e)>=10""")
def _(s):
    return C.sliced_cvr(s.ev, s.dim, {
        "district": F.col("district_name"), "seller_type": F.col("seller_type"), "furnishing": F.col("furnishing"),
        "bathrooms": F.col("bathrooms").cast("int"), "images": bucketize("images_count", [1, 5], ["0", "1-4", "5+"]),
        "title_rent": flag(F.col("title").contains("thuê"))}, 10)


@query("seller_channel_style", "ev inter dim", """WITH a AS (SELECT seller_id, SUM(chat_message_count) AS messages, SUM(chat_turn_count) AS turns FROM inter JOIN dim USING (item_id) GROUP BY 1 HAVING SUM(chat_turn_count)>=5),
b AS (SELECT seller_id, COUNT(*) FILTER (event_type='view_phone') AS phone, COUNT(*) FILTER (event_type IN ('view_phone','contact_chat')) AS phone_chat FROM ev JOIN dim USING (item_id) GROUP BY 1 HAVING COUNT(*) FILTER (event_type IN ('view_phone','contact_chat'))>=10)
SELECT seller_id, messages, turns, phone, phone_chat, round(messages/NULLIF(turns,0),6) AS msg_per_turn, round(phone::DOUBLE/NULLIF(phone_chat,0),6) AS phone_share FROM a FULL JOIN b USING (seller_id)""")
def _(s):
    return C.seller_channel_style(s.ev, s.inter, s.dim)


@query("listing_rate_by_cohort", "ev dim", f"""WITH i AS (SELECT item_id, MAX((event_type IN {EX})::INT) AS e FROM ev GROUP BY 1 HAVING MAX(({PV})::INT)=1)
SELECT CASE WHEN posted_date IS NULL THEN 'unknown' WHEN posted_date<DATE'2023-11-20' THEN 'pre_window' WHEN posted_date>DATE'2023-12-31' THEN 'post_window' ELSE 'in_window' END AS cohort, ad_type, COUNT(*) AS viewed, round(100.0*AVG(e),6) AS contact_pct
FROM i LEFT JOIN dim USING (item_id) GROUP BY 1,2 HAVING COUNT(*)>=5""")
def _(s):
    return C.listing_rate_by_cohort(s.ev, s.dim, posted_cohort("2023-11-20", "2023-12-31"), 5)


@query("volume_vs_outcome", "ev", f"""WITH {SI}, v AS (SELECT category, CASE WHEN {PV} THEN 'pageview' WHEN {OI} THEN 'other_interaction' ELSE 'explicit_contact' END AS layer, COUNT(*) AS events FROM ev GROUP BY 1,2),
m AS (SELECT category, 'pageview' AS layer, has_explicit AS x FROM si WHERE has_pageview=1 UNION ALL SELECT category,'other_interaction',has_explicit FROM si WHERE has_other=1 UNION ALL SELECT category,'explicit_contact',has_explicit FROM si WHERE has_explicit=1),
r AS (SELECT category, layer, COUNT(*) AS session_items, round(100.0*AVG(x),6) AS contact_rate_pct FROM m GROUP BY 1,2)
SELECT v.*, round(100.0*events/SUM(events) OVER (PARTITION BY v.category),6) AS volume_pct, session_items, contact_rate_pct FROM v LEFT JOIN r USING (category, layer)""".replace("SELECT v.*, round", "SELECT v.category, v.layer, v.events, round"))
def _(s):
    return C.volume_vs_outcome(s.ev)


@query("position_curve", "ev", f"SELECT position, COUNT(*) AS events, COUNT(*) FILTER (event_type IN {EX}) AS contacts, round(100.0*AVG((event_type IN {EX})::INT),6) AS contact_pct FROM ev WHERE position<=30 GROUP BY 1")
def _(s):
    return C.event_cvr_by(s.ev.filter("position <= 30"), {"position": F.col("position")})


@query("query_vs_none", "ev", f"SELECT (coalesce(trim(query)<>'',false))::INT AS has_query, COUNT(*) AS events, COUNT(*) FILTER (event_type IN {EX}) AS contacts, round(100.0*AVG((event_type IN {EX})::INT),6) AS contact_pct FROM ev GROUP BY 1")
def _(s):
    from bazaarlens.functions.columns import has_query
    return C.event_cvr_by(s.ev, {"has_query": flag(has_query())})


@query("device_login_cvr", "ev", f"SELECT device, is_login, COUNT(*) AS events, COUNT(*) FILTER (event_type IN {EX}) AS contacts, round(100.0*AVG((event_type IN {EX})::INT),6) AS contact_pct FROM ev GROUP BY 1,2")
def _(s):
    return C.event_cvr_by(s.ev, {"device": F.col("device"), "is_login": F.col("is_login")})


@query("user_activity_stats", "ev", f"""SELECT user_id, device, COUNT(*) AS events, COUNT(DISTINCT item_id) AS items, COUNT(DISTINCT session_id) AS sessions, COUNT(*) FILTER (event_type IN {EX}) AS contacts, COUNT(DISTINCT surface) AS surfaces,
 MIN(date)::VARCHAR AS first_seen, MAX(date)::VARCHAR AS last_seen FROM ev GROUP BY 1,2""")
def _(s):
    return C.user_activity_stats(s.ev)


# ---- demand journey -----------------------------------------------------------------------------

@query("time_to_first_contact", "ev", f"""WITH u AS (SELECT category, user_id, MIN(CASE WHEN {PV} THEN event_ts END) AS v, MIN(CASE WHEN event_type IN {EX} THEN event_ts END) AS c FROM ev GROUP BY 1,2), l AS (SELECT category, DATE_DIFF('day', v::DATE, c::DATE) AS d FROM u WHERE c>=v)
SELECT category, COUNT(*) AS users, round(AVG(d),6) AS mean_days, round(100.0*AVG((d=0)::INT),6) AS same_day_pct, round(100.0*AVG((d>=2)::INT),6) AS ge2_pct, round(100.0*AVG((d>=3)::INT),6) AS ge3_pct, round(quantile_cont(d,0.5),6) AS p50, round(quantile_cont(d,0.75),6) AS p75, round(quantile_cont(d,0.9),6) AS p90 FROM l GROUP BY 1""")
def _(s):
    return D.time_to_first_contact(s.ev)


@query("listing_age_at_first_contact", "ev snap", f"""WITH f AS (SELECT user_id, item_id, MIN(date) AS date FROM ev WHERE event_type IN {EX} GROUP BY 1,2),
b AS (SELECT CASE WHEN listing_age_days IS NULL THEN 'unknown' WHEN listing_age_days<=3 THEN '0-3d fresh' WHEN listing_age_days<=14 THEN '4-14d' WHEN listing_age_days<=30 THEN '15-30d' ELSE '31d+' END AS age_bucket FROM f LEFT JOIN snap USING (item_id, date))
SELECT age_bucket, COUNT(*) AS contacts, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct FROM b GROUP BY 1""")
def _(s):
    return D.listing_age_at_first_contact(s.ev, s.snap)


@query("repeat_views_before_contact", "ev", f"""WITH f AS (SELECT user_id, item_id, MIN(event_ts) AS t0 FROM ev WHERE event_type IN {EX} GROUP BY 1,2), c AS (SELECT user_id, item_id, COUNT(*) AS n FROM ev JOIN f USING (user_id,item_id) WHERE {PV} AND event_ts<t0 GROUP BY 1,2)
SELECT COUNT(*) AS pairs, median(n) AS median_pv, quantile_cont(n,0.75) AS p75_pv, round(100.0*AVG((n>=2)::INT),6) AS ge2_pct, round(100.0*AVG((n>=3)::INT),6) AS ge3_pct FROM c""")
def _(s):
    return D.repeat_views_before_contact(s.ev)


@query("pre_contact_effort", "ev", rf"""WITH f AS (SELECT category, user_id, MIN(event_ts) AS t0, COUNT(DISTINCT item_id) AS contacted FROM ev WHERE event_type IN {EX} GROUP BY 1,2),
ss AS (SELECT category, user_id, session_id, MIN(event_ts) AS st FROM ev GROUP BY 1,2,3), us AS (SELECT category, user_id, SUM((st<t0)::INT) AS sb FROM ss JOIN f USING (category,user_id) GROUP BY 1,2),
pd AS (SELECT category, user_id, COUNT(DISTINCT date) AS d FROM ev JOIN f USING (category,user_id) WHERE {PV} AND event_ts<t0 GROUP BY 1,2),
q AS (SELECT category, user_id, event_ts, lower(trim(regexp_replace(query,'\s+',' ','g'))) AS q, lag(lower(trim(regexp_replace(query,'\s+',' ','g')))) OVER (PARTITION BY category, user_id, session_id ORDER BY event_ts, event_id) AS p FROM ev WHERE {SEARCH}),
r AS (SELECT category, user_id, SUM((p IS NOT NULL AND p<>q)::INT) AS n FROM q JOIN f USING (category,user_id) WHERE event_ts<t0 GROUP BY 1,2)
SELECT category, COUNT(*) AS users, median(contacted) AS median_contacted, round(AVG(contacted),6) AS mean_contacted, median(sb) AS median_sessions_before, round(100.0*AVG(coalesce((d>=2)::INT,0)),6) AS ge2_pv_days_pct, median(n) AS median_refinements
FROM f LEFT JOIN us USING (category,user_id) LEFT JOIN pd USING (category,user_id) LEFT JOIN r USING (category,user_id) GROUP BY 1""")
def _(s):
    return D.pre_contact_effort(s.ev)


@query("lead_segments", "inter", """WITH p AS (SELECT category, user_id, SUM(adview_count) AS v, SUM(lead_count) AS l, SUM(chat_message_count) AS m, AVG(chat_turn_count) AS t, COUNT(DISTINCT item_id) AS i FROM inter GROUP BY 1,2 HAVING SUM(adview_count)>0),
g AS (SELECT category, CASE WHEN i>=15 AND m>0 AND t<=1.5 THEN 'C_spam_broker' WHEN v>50 AND l=0 AND m=0 THEN 'B_window_shopper' WHEN v<=10 AND (l>=2 OR t>5) THEN 'A_high_intent' ELSE 'D_other' END AS segment FROM p)
SELECT category, segment, COUNT(*) AS users, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY category),6) AS pct FROM g GROUP BY 1,2""")
def _(s):
    return D.lead_segments(s.inter)


@query("listing_age_distribution", "ev snap", f"""WITH j AS (SELECT listing_age_days AS a FROM ev JOIN snap USING (item_id, date) WHERE event_type IN {EX} AND listing_age_days IS NOT NULL), q AS (SELECT quantile_cont(a,0.99) AS p FROM j)
SELECT LEAST(a,60,p) AS age, COUNT(*) AS n, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct, (SELECT round(100.0*AVG((a<=2)::INT),6) FROM j) AS fresh_pct FROM j, q GROUP BY 1""")
def _(s):
    return D.listing_age_distribution(s.ev, s.snap)


@query("quality_time_to_contact", "ev dim", f"""WITH f AS (SELECT item_id, MIN(event_ts) AS t0 FROM ev WHERE event_type IN {EX} GROUP BY 1),
r AS (SELECT images_count::INT AS quality_score, (epoch_us(t0)-epoch_us(posted_date::TIMESTAMP))/3.6e9 AS h FROM dim LEFT JOIN f USING (item_id)), k AS (SELECT * FROM r),
b AS (SELECT quality_score, CASE WHEN h IS NULL THEN 'NoContact' WHEN h<0 THEN 'BeforePosting' WHEN h<24 THEN 'Fast' WHEN h<=168 THEN 'Mid' ELSE 'Slow' END AS speed, COUNT(*) AS n FROM k GROUP BY 1,2)
SELECT quality_score, speed, n, round(100.0*n/SUM(n) OVER (PARTITION BY quality_score),6) AS pct, round((SELECT median(h) FROM k WHERE k.quality_score=b.quality_score),6) AS median_hours FROM b""")
def _(s):
    return D.quality_time_to_contact(s.ev, s.dim.withColumn("quality_score", F.col("images_count").cast("int")))


@query("origin_destination_migration", "ev dim", f"""WITH r AS (SELECT ev.*, district_name AS d FROM ev JOIN dim USING (item_id) WHERE is_login='login' AND district_name IS NOT NULL),
u AS (SELECT user_id, arg_min(d,(event_ts,event_id)) FILTER ({PV}) AS origin, arg_min(d,(event_ts,event_id)) FILTER (event_type IN {EX}) AS destination FROM r GROUP BY 1)
SELECT origin, destination, COUNT(*) AS users, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (PARTITION BY origin),6) AS pct_of_origin FROM u WHERE origin IS NOT NULL AND destination IS NOT NULL AND origin<>destination GROUP BY 1,2""")
def _(s):
    return D.origin_destination_migration(s.ev, s.dim)


@query("positives_per_user", "ev", f"""WITH u AS (SELECT category, user_id, COUNT(*) AS n FROM ev WHERE event_type IN {PO} GROUP BY 1,2)
SELECT category, COUNT(*) AS users, round(AVG(n),6) AS mean, MAX(n) AS max, quantile_cont(n,0.5) AS p50, quantile_cont(n,0.9) AS p90, quantile_cont(n,0.99) AS p99 FROM u GROUP BY 1""")
def _(s):
    return D.positives_per_user(s.ev)


@query("interaction_summary", "ev inter", """SELECT category, SUM(adview_count) AS adviews, SUM(lead_count) AS leads, SUM(chat_message_count) AS messages, round(AVG(chat_turn_count),6) AS avg_turns, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items
FROM inter WHERE user_id IN (SELECT user_id FROM ev WHERE is_login='login') GROUP BY 1""")
def _(s):
    return D.interaction_summary(s.inter, s.ev)


@query("lead_distribution", "inter", """WITH i AS (SELECT item_id, SUM(lead_count) AS l FROM inter GROUP BY 1)
SELECT CASE WHEN l<=0 THEN '0' WHEN l<=1 THEN '1' WHEN l<=5 THEN '2-5' WHEN l<=10 THEN '6-10' WHEN l<=20 THEN '11-20' ELSE '>20' END AS lead_bin, COUNT(*) AS items, SUM(l) AS leads, round(100.0*SUM(l)/SUM(SUM(l)) OVER (),6) AS lead_share_pct FROM i GROUP BY 1""")
def _(s):
    return D.lead_distribution(s.inter)


@query("top_items_by_lead_share", "inter", """SELECT item_id, SUM(lead_count) AS leads, SUM(adview_count) AS adviews, round(100.0*SUM(lead_count)/(SELECT SUM(lead_count) FROM inter),6) AS lead_share_pct, round(SUM(lead_count)/NULLIF(SUM(adview_count),0),6) AS leads_per_view
FROM inter GROUP BY 1 ORDER BY leads DESC, item_id LIMIT 20""")
def _(s):
    return D.top_items_by_lead_share(s.inter)
