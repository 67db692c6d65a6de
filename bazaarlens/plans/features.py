"""Recommender feature queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive
from bazaarlens.operators import features as T
from bazaarlens.operators import quality as Q
from bazaarlens.operators import sketches as K
from bazaarlens.plans.primitives import EX, PO, near
from bazaarlens.plans.registry import query
from bazaarlens.session import bucketed, durable

CUT = "2024-01-20"
END = "2024-01-30"
HOL = ("2024-01-14", "2024-01-16")
LIGHT = {"view_phone": 10, "contact_chat": 10, "contact_zalo": 10, "contact_sms": 10, "pageview": 2, "other_interaction": 1}
PV = "event_type='pageview'"


SCOPE = "is_login='login' AND category IN (1010,1020,1030,1040,1050)"


def pairs_sql(name: str = "pr", where: str = "") -> str:
    return f"""{name} AS (SELECT user_id, item_id, COUNT(*) AS pos_count, COUNT(*) FILTER (event_type='view_phone') AS n_view_phone, COUNT(*) FILTER (event_type='contact_chat') AS n_chat, COUNT(*) FILTER (event_type='contact_zalo') AS n_zalo, COUNT(*) FILTER (event_type='contact_sms') AS n_sms,
 COUNT(*) FILTER (event_type='other_interaction') AS n_other, MIN(event_ts) AS first_ts, MAX(event_ts) AS last_ts, MAX(category) AS category, MAX(city_name) AS city_name FROM ev WHERE {SCOPE} AND event_type IN {PO} {where} GROUP BY 1,2)"""


PR = pairs_sql()
COUNTS = ["user_id", "item_id", "pos_count", "n_view_phone", "n_chat", "n_zalo", "n_sms", "n_other", "category", "city_name"]


@query("user_item_positive", "ev", f"WITH {PR} SELECT {', '.join(COUNTS)} FROM pr")
def _(s):
    return T.user_item_positive(s.ev).select(*COUNTS)


TRAIN = f"AND event_ts<TIMESTAMP'{CUT}' AND NOT (event_ts>=TIMESTAMP'{HOL[0]}' AND event_ts<TIMESTAMP'{HOL[1]}')"


@query("user_item_positive_train", "ev", f"WITH {pairs_sql('pr', TRAIN)} SELECT {', '.join(COUNTS)} FROM pr")
def _(s):
    return T.user_item_positive(s.ev, CUT, HOL).select(*COUNTS)


@query("user_item_weighted", "ev", f"SELECT user_id, item_id, SUM(CASE WHEN event_type IN {EX} THEN 10.0E0 WHEN {PV} THEN 2 ELSE 1 END) AS weight, COUNT(*) AS events FROM ev WHERE is_login='login' GROUP BY 1,2")
def _(s):
    return T.user_item_weighted(s.ev, LIGHT).select("user_id", "item_id", "weight", "events")


@query("user_sequences", "ev", f"""WITH l AS (SELECT user_id, item_id, MAX(event_ts) AS t FROM ev WHERE {SCOPE} GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item_id) AS k FROM l QUALIFY k<=50)
SELECT user_id, string_agg(item_id::VARCHAR,'|' ORDER BY k DESC) AS items, COUNT(*) AS length FROM r GROUP BY 1""")
def _(s):
    return T.user_sequences(s.ev)


@query("user_item_interactions", "inter", "SELECT user_id, item_id, SUM(adview_count) AS adviews, SUM(lead_count) AS leads, SUM(chat_message_count) AS messages, SUM(chat_turn_count) AS turns, MAX(purchased::INT) AS ever_purchased, COUNT(DISTINCT date) AS active_days FROM inter GROUP BY 1,2")
def _(s):
    return T.user_item_interactions(s.inter)


@query("user_item_interactions_train", "inter", f"SELECT user_id, item_id, SUM(lead_count) AS leads, COUNT(DISTINCT date) AS active_days FROM inter WHERE date<DATE'{CUT}' GROUP BY 1,2")
def _(s):
    return T.user_item_interactions(s.inter, CUT).select("user_id", "item_id", "leads", "active_days")


QS = f"qs AS (SELECT item_id, COUNT(*) AS total_events, COUNT(*) FILTER (event_type IN {PO}) AS pos_events, COUNT(*) FILTER ({PV}) AS pageviews, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT session_id) AS unique_sessions, AVG(dwell_time_sec) AS avg_dwell, COUNT(*) FILTER (event_type IN {PO})::DOUBLE/COUNT(*) AS item_cvr FROM ev GROUP BY 1)"


@query("item_quality_stats", "ev", f"WITH {QS} SELECT * REPLACE (round(avg_dwell,6) AS avg_dwell, round(item_cvr,6) AS item_cvr) FROM qs")
def _(s):
    return T.item_quality_stats(s.ev, None)


@query("item_quality_stats_approx", "ev", f"WITH {QS} SELECT item_id, total_events, unique_users, unique_sessions, 1::INT AS near_users, 1::INT AS near_sessions FROM qs")
def _(s):
    exact = T.item_quality_stats(s.ev, None).select("item_id", "unique_users", "unique_sessions")
    both = T.item_quality_stats(s.ev).select("item_id", "total_events", F.col("unique_users").alias("u"), F.col("unique_sessions").alias("v")).join(exact, "item_id")
    return both.select("item_id", "total_events", "unique_users", "unique_sessions", near("u", "unique_users").alias("near_users"), near("v", "unique_sessions").alias("near_sessions"))


_W = ", ".join(f"COUNT(*) FILTER (date>=DATE'{END}'-{d}) AS events_{d}d, COUNT(*) FILTER (date>=DATE'{END}'-{d} AND event_type IN {PO}) AS pos_{d}d" for d in (1, 7, 14, 28))
PW = f"pw AS (SELECT item_id, category, {_W} FROM ev WHERE date<=DATE'{END}' AND date>=DATE'{END}'-28 GROUP BY 1,2)"


@query("popularity_windows", "ev", f"WITH {PW} SELECT * FROM pw")
def _(s):
    return T.popularity_windows(s.ev, END)


UP = f"""up AS (SELECT user_id, SUM(pos_count)::BIGINT AS total_pos, COUNT(*) AS unique_items, GREATEST(DATE_DIFF('day',MAX(last_ts)::DATE,DATE'{END}'),0)::INT AS days_since_last, (DATE_DIFF('day',MIN(first_ts)::DATE,MAX(last_ts)::DATE)+1)::INT AS active_span_days,
 (SELECT category FROM pr b WHERE b.user_id=pr.user_id GROUP BY category ORDER BY SUM(pos_count) DESC, category LIMIT 1) AS pref_category, (SELECT city_name FROM pr b WHERE b.user_id=pr.user_id GROUP BY city_name ORDER BY SUM(pos_count) DESC, city_name LIMIT 1) AS pref_city FROM pr GROUP BY 1)"""


@query("user_profile", "ev", f"WITH {PR}, {UP} SELECT * FROM up")
def _(s):
    return T.user_profile(T.user_item_positive(s.ev), END)


def _mode(c: str) -> str:
    return f"m_{c} AS (SELECT user_id, {c} AS pref_{c} FROM (SELECT user_id, {c}, COUNT(*) AS n FROM pj WHERE {c} IS NOT NULL GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {c})=1)"


CATS = ("price_bucket", "ad_type", "district_name", "seller_type")
UX = f"""pj AS (SELECT user_id, d.price_bucket, d.ad_type, d.district_name, d.seller_type, d.bedrooms, d.area_sqm FROM pr LEFT JOIN dim d USING (item_id)), ch AS (SELECT user_id, SUM(n_view_phone) AS p, SUM(n_chat) AS c, SUM(n_zalo) AS z, SUM(n_sms) AS m FROM pr GROUP BY 1), {', '.join(_mode(c) for c in CATS)},
md AS (SELECT user_id, median(bedrooms) AS pref_bedrooms, median(area_sqm) AS pref_area_sqm FROM pj GROUP BY 1),
ux AS (SELECT user_id, CASE WHEN GREATEST(p,c,z,m)<=0 THEN 'view_phone' WHEN p=GREATEST(p,c,z,m) THEN 'view_phone' WHEN c=GREATEST(p,c,z,m) THEN 'chat' WHEN z=GREATEST(p,c,z,m) THEN 'zalo' ELSE 'sms' END AS pref_channel, round(p::DOUBLE/GREATEST(p+c+z+m,1),6) AS view_phone_ratio, round(c::DOUBLE/GREATEST(p+c+z+m,1),6) AS chat_ratio,
 round(z::DOUBLE/GREATEST(p+c+z+m,1),6) AS zalo_ratio, round(m::DOUBLE/GREATEST(p+c+z+m,1),6) AS sms_ratio, {', '.join('pref_'+c for c in CATS)}, pref_bedrooms, pref_area_sqm FROM ch {' '.join(f'LEFT JOIN m_{c} USING (user_id)' for c in CATS)} LEFT JOIN md USING (user_id))"""


@query("user_preferences_ext", "ev dim", f"WITH {PR}, {UX} SELECT * FROM ux")
def _(s):
    return T.user_preferences_ext(T.user_item_positive(s.ev), s.dim)


@query("first_click", "ev", "SELECT user_id, item_id, category, city_name, event_ts::VARCHAR AS event_ts FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_ts, event_id)=1")
def _(s):
    return T.first_click(s.ev)


UB = f"""uj AS (SELECT ev.*, d.district_name FROM ev JOIN dim d USING (item_id) WHERE is_login='login'), ub0 AS (SELECT user_id, COUNT(DISTINCT session_id) AS n_sessions, COUNT(DISTINCT district_name) AS n_districts, AVG((hour(event_ts)>=22 OR hour(event_ts)<6)::INT) AS pct_night, AVG(CASE WHEN {PV} AND dwell_time_sec BETWEEN 1 AND 3600 THEN dwell_time_sec END) AS avg_dwell FROM uj GROUP BY 1),
ud AS (SELECT user_id, COUNT(*)::DOUBLE/SUM(COUNT(*)) OVER (PARTITION BY user_id) AS p FROM uj WHERE district_name IS NOT NULL GROUP BY user_id, district_name), ue AS (SELECT user_id, GREATEST(-SUM(p*ln(p)),0) AS h FROM ud GROUP BY 1),
ub AS (SELECT ub0.*, coalesce(h,0) AS district_entropy FROM ub0 LEFT JOIN ue USING (user_id))"""


@query("user_behavior", "ev dim", f"WITH {UB} SELECT user_id, n_sessions, n_districts, round(pct_night,6) AS pct_night, round(avg_dwell,6) AS avg_dwell, round(district_entropy,6) AS district_entropy FROM ub")
def _(s):
    return T.user_behavior(s.ev, s.dim)


@query("dwell_pairs", "ev", f"SELECT user_id, item_id, COUNT(*) AS pageviews, MAX(dwell_time_sec) AS max_dwell, round(AVG(dwell_time_sec),6) AS avg_dwell, MAX((dwell_time_sec>30)::INT) AS considered FROM ev WHERE {SCOPE} AND {PV} GROUP BY 1,2")
def _(s):
    return T.dwell_pairs(s.ev)


@query("dwell_pairs_train", "ev", f"SELECT user_id, item_id, COUNT(*) AS pageviews, MAX(dwell_time_sec) AS max_dwell, round(AVG(dwell_time_sec),6) AS avg_dwell, MAX((dwell_time_sec>30)::INT) AS considered FROM ev WHERE {SCOPE} AND {PV} AND event_ts<TIMESTAMP'{CUT}' GROUP BY 1,2")
def _(s):
    return T.dwell_pairs(s.ev, CUT)


SN = f"""sn AS (SELECT item_id, coalesce(arg_max(views_24h,date),0) AS views_24h, coalesce(arg_max(contacts_24h,date),0) AS contacts_24h, arg_max(listing_age_days,date) FILTER (listing_age_days IS NOT NULL) AS listing_age, AVG((contacts_24h>0)::INT) AS pct_days_contact FROM snap WHERE date<=DATE'{END}' GROUP BY 1)"""


@query("snapshot_features", "snap", f"WITH {SN} SELECT item_id, views_24h, contacts_24h, listing_age, round(pct_days_contact,6) AS pct_days_contact, round(ln(1+views_24h),6) AS views_log, round(ln(1+contacts_24h),6) AS contacts_log, round(contacts_24h/(views_24h+1),6) AS contact_rate FROM sn")
def _(s):
    return T.snapshot_features(s.snap, END)


def _enc(c: str, out: str) -> str:
    return f"(dense_rank() OVER (ORDER BY coalesce({c}::VARCHAR,'unknown'))-1)::INT AS {out}"


ENCODED = {"category": "cat_enc", "ad_type": "adtype_enc", "seller_type": "seller_enc", "price_bucket": "price_enc", "city_name": "city_enc", "district_name": "district_enc"}
IFN = ["area_log", "images_log", "total_events_log", "unique_users_log", "item_contact_rate", "item_repeat_share", "trend_pos_log", "trend_cvr", "item_velocity_log", "velocity_7d", "velocity_14d",
       "velocity_accel", "avg_dwell", "item_cvr", "contact_rate"]
IFI = ["days_since_posted", "has_project", "area_bucket", "is_renewal_week", "age_boost", "bedrooms_filled", *ENCODED.values()]
IF = f"""{QS}, {PW}, {SN}, pg AS (SELECT item_id, SUM(events_28d) AS e28, SUM(pos_28d) AS p28, SUM(pos_7d) AS p7, SUM(pos_14d) AS p14 FROM pw GROUP BY 1),
i0 AS (SELECT d.*, GREATEST(DATE_DIFF('day',posted_date,DATE'{END}'),0)::INT AS days_since_posted, (project_id IS NOT NULL)::INT AS has_project, coalesce(CASE WHEN area_sqm IS NULL THEN NULL WHEN area_sqm<20 THEN 0 WHEN area_sqm<30 THEN 1 WHEN area_sqm<45 THEN 2 WHEN area_sqm<60 THEN 3 WHEN area_sqm<80 THEN 4 WHEN area_sqm<100 THEN 5 WHEN area_sqm<150 THEN 6
 WHEN area_sqm<200 THEN 7 WHEN area_sqm<300 THEN 8 WHEN area_sqm<500 THEN 9 ELSE 10 END,0)::INT AS area_bucket, ln(1+coalesce(area_sqm,0)) AS area_log, ln(1+coalesce(images_count,0)) AS images_log, coalesce(bedrooms,-1) AS bedrooms_filled, {', '.join(_enc(c,o) for c,o in ENCODED.items())} FROM dim d),
i1 AS (SELECT i0.*, (days_since_posted IN (15,16,30,31))::INT AS is_renewal_week, CASE WHEN category=1050 THEN CASE WHEN days_since_posted<15 THEN 1.0 WHEN days_since_posted<30 THEN 1.05 WHEN days_since_posted<60 THEN 1.08 ELSE 1.1 END
 ELSE CASE WHEN days_since_posted<=2 THEN 1.2 WHEN days_since_posted<=7 THEN 1.1 WHEN days_since_posted<=14 THEN 1.03 WHEN days_since_posted<=29 THEN 1.0 ELSE 0.92 END END::DOUBLE AS age_boost,
 coalesce(total_events,0) AS te, coalesce(pos_events,0) AS pe, coalesce(pageviews,0) AS pv, coalesce(unique_users,0) AS uu, coalesce(avg_dwell,0) AS avg_dwell, coalesce(item_cvr,0) AS item_cvr, coalesce(e28,0) AS e28, coalesce(p28,0) AS p28, coalesce(p7,0) AS p7, coalesce(p14,0) AS p14, coalesce(contacts_24h/(views_24h+1),0) AS contact_rate
 FROM i0 LEFT JOIN qs USING (item_id) LEFT JOIN pg USING (item_id) LEFT JOIN sn USING (item_id)),
itf AS (SELECT *, ln(1+te) AS total_events_log, ln(1+uu) AS unique_users_log, pe::DOUBLE/GREATEST(pv,1) AS item_contact_rate, GREATEST(0,1.0-uu::DOUBLE/GREATEST(te,1)) AS item_repeat_share, ln(1+p28) AS trend_pos_log, p28::DOUBLE/GREATEST(e28,1) AS trend_cvr, ln(1+p28::DOUBLE/(te+1)) AS item_velocity_log,
 p7::DOUBLE/(p28+1) AS velocity_7d, p14::DOUBLE/(p28+1) AS velocity_14d, p7::DOUBLE/(p28+1)-p14::DOUBLE/(p28+1) AS velocity_accel FROM i1)"""


def items(s):
    return T.item_features(s.dim, T.item_quality_stats(s.ev, None), T.popularity_windows(s.ev, END), T.snapshot_features(s.snap, END), END)


@query("item_features", "ev dim snap", f"WITH {IF} SELECT item_id, {', '.join(IFI)}, {', '.join(f'round({c},6) AS {c}' for c in IFN)} FROM itf")
def _(s):
    return items(s).select("item_id", *IFI, *IFN)


UFT = f"""{PR}, {UP}, {UB}, ec AS (SELECT user_id, SUM(n_view_phone+n_chat+n_zalo+n_sms)::DOUBLE/GREATEST(SUM(pos_count),1) AS ec FROM pr GROUP BY 1),
ut AS (SELECT up.*, coalesce(ec,0) AS explicit_cvr, coalesce(n_sessions,0) AS n_sessions, coalesce(n_districts,0) AS n_districts, coalesce(pct_night,0) AS pct_night, coalesce(avg_dwell,0) AS avg_dwell, coalesce(district_entropy,0) AS district_entropy FROM up LEFT JOIN ec USING (user_id) LEFT JOIN ub USING (user_id))"""


def users(s):
    pairs = T.user_item_positive(s.ev)
    return T.user_features(T.user_profile(pairs, END), pairs, T.user_behavior(s.ev, s.dim))


@query("user_features", "ev dim", f"""WITH {UFT} SELECT user_id, total_pos, unique_items, days_since_last, active_span_days, pref_category, pref_city, round(explicit_cvr,6) AS explicit_cvr, n_sessions, n_districts, round(pct_night,6) AS pct_night, round(avg_dwell,6) AS avg_dwell, round(district_entropy,6) AS district_entropy,
 round(ln(1+total_pos),6) AS total_pos_log, round(ln(1+unique_items),6) AS unique_items_log, round(total_pos::DOUBLE/GREATEST(unique_items,1),6) AS avg_pos_per_item, round(ln(1+n_sessions),6) AS n_sessions_log FROM ut""")
def _(s):
    return users(s)


@query("pair_positive_features", "ev", f"""WITH {PR}, x AS (SELECT *, 3*(n_chat+n_zalo+n_sms)+2*n_view_phone+n_other AS i, n_chat+n_zalo+n_sms+n_view_phone AS e FROM pr)
SELECT user_id, item_id, GREATEST(floor((epoch_us(TIMESTAMP'{END}')-epoch_us(last_ts))/8.64e10),0)::BIGINT AS days_since_ui, round(ln(1+pos_count),6) AS pos_count_log, n_view_phone, n_chat, n_zalo, n_sms, n_other, round(ln(1+i),6) AS intent_score_log, round(ln(1+e),6) AS explicit_contact_log,
 round(i::DOUBLE/GREATEST(pos_count,1),6) AS intent_ratio, (isodow(last_ts)>=6)::INT AS is_weekend FROM x""")
def _(s):
    return T.pair_positive_features(T.user_item_positive(s.ev), END)


def hd_sql(name: str, where: str) -> str:
    w = "CASE event_type WHEN 'view_phone' THEN 10.0E0 WHEN 'contact_chat' THEN 9 WHEN 'contact_zalo' THEN 9 WHEN 'contact_sms' THEN 8 WHEN 'other_interaction' THEN 2.5 ELSE 1 END"
    return f"{name} AS (SELECT user_id, item_id, SUM({w}*exp(-GREATEST(DATE_DIFF('day',event_ts::DATE,DATE'{CUT}'),0)/21.0)) AS decay_score, SUM({w}) AS decay_total FROM ev {where} GROUP BY 1,2)"


@query("history_decay", "ev", f"WITH {hd_sql('hd', f'WHERE event_ts<TIMESTAMP{chr(39)}{CUT}{chr(39)}')} SELECT user_id, item_id, round(decay_score,6) AS decay_score, round(decay_total,6) AS decay_total FROM hd")
def _(s):
    return T.history_decay(s.ev, CUT)


DT = """dl AS (SELECT user_id, item_id, MAX(event_ts) AS t FROM ev GROUP BY 1,2), dj AS (SELECT dl.*, district_name AS d FROM dl JOIN dim USING (item_id) WHERE district_name IS NOT NULL), dg AS (SELECT *, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM dj WINDOW w AS (PARTITION BY user_id ORDER BY t, item_id)),
dt AS (SELECT pd AS source, d AS target, COUNT(*) AS n, COUNT(*)::DOUBLE/SUM(COUNT(*)) OVER (PARTITION BY pd) AS prob FROM dg WHERE pd IS NOT NULL AND pd<>d AND epoch_us(t)-epoch_us(pt)<=86400000000 GROUP BY 1,2)"""


@query("district_transitions", "ev dim", f"WITH {DT} SELECT source, target, n, round(prob,6) AS prob FROM dt")
def _(s):
    return T.district_transitions(s.ev, s.dim)


@query("match_features", "ev dim", f"""WITH {PR}, {UP}, {UX}, {DT}, c AS (SELECT DISTINCT user_id, item_id FROM ev), j AS (SELECT c.user_id, c.item_id, up.pref_category, up.pref_city, ux.pref_price_bucket, ux.pref_ad_type, ux.pref_district_name, ux.pref_seller_type, d.category, d.city_name, d.price_bucket, d.ad_type, d.district_name, d.seller_type
 FROM c LEFT JOIN up USING (user_id) LEFT JOIN ux USING (user_id) LEFT JOIN dim d USING (item_id))
SELECT user_id, item_id, (coalesce(pref_category::VARCHAR,'')=coalesce(category::VARCHAR,''))::INT AS category_match, (coalesce(pref_city,'')=coalesce(city_name,''))::INT AS city_match, (coalesce(pref_price_bucket,'')=coalesce(price_bucket,''))::INT AS price_match, (coalesce(pref_ad_type,'')=coalesce(ad_type,''))::INT AS adtype_match,
 (coalesce(pref_district_name,'')=coalesce(district_name,''))::INT AS district_match, (coalesce(pref_seller_type,'')=coalesce(seller_type,''))::INT AS seller_match, round(CASE WHEN coalesce(pref_district_name,'')=coalesce(district_name,'') THEN 1.0 ELSE coalesce(prob,0) END,6)::DOUBLE AS district_transition_score
FROM j LEFT JOIN dt ON pref_district_name=source AND district_name=target""")
def _(s):
    pairs = T.user_item_positive(s.ev)
    prefs = T.user_profile(pairs, END).join(T.user_preferences_ext(pairs, s.dim), "user_id", "left")
    return T.match_features(s.ev.select("user_id", "item_id").distinct(), prefs, s.dim, T.district_transitions(s.ev, s.dim))


def candidate_pairs(s):
    """Every pair seen before the cutoff: the candidates of the offline feature table."""
    return T.before(s.ev, CUT).select("user_id", "item_id").distinct()


def feature_stages(s):
    pairs = T.user_item_positive(s.ev, CUT)
    return T.FeatureStages(
        items(s).select("item_id", "days_since_posted", "cat_enc", "trend_pos_log", "velocity_7d", "item_cvr", "age_boost", "contact_rate"),
        T.user_profile(pairs, CUT).select("user_id", "total_pos", "unique_items", "days_since_last", "active_span_days"),
        T.pair_positive_features(pairs, CUT), T.history_decay(s.ev, CUT), T.user_item_interactions(s.inter, CUT).select("user_id", "item_id", "leads", "active_days"))


def assembled(s, candidates=None, stages=None):
    truth = s.ev.filter(is_positive() & (F.col("event_ts") >= F.lit(CUT).cast("timestamp_ntz")))
    return T.assemble_features(candidate_pairs(s) if candidates is None else candidates, feature_stages(s) if stages is None else stages, truth)


AF = f"""{IF}, {pairs_sql('pr', f"AND event_ts<TIMESTAMP'{CUT}'")}, ca AS (SELECT DISTINCT user_id, item_id FROM ev WHERE event_ts<TIMESTAMP'{CUT}'), us AS (SELECT user_id, SUM(pos_count)::BIGINT AS total_pos, GREATEST(DATE_DIFF('day',MAX(last_ts)::DATE,DATE'{CUT}'),0)::INT AS days_since_last FROM pr GROUP BY 1),
{hd_sql('hd', f"WHERE event_ts<TIMESTAMP'{CUT}'")}, ia AS (SELECT user_id, item_id, SUM(lead_count) AS leads FROM inter WHERE date<DATE'{CUT}' GROUP BY 1,2), tr AS (SELECT DISTINCT user_id, item_id, 1 AS label FROM ev WHERE event_type IN {PO} AND event_ts>=TIMESTAMP'{CUT}')"""


AFS = f"""WITH {AF} SELECT ca.user_id, ca.item_id, coalesce(i.days_since_posted,0) AS days_since_posted, round(coalesce(trend_pos_log,0),6) AS trend_pos_log, coalesce(total_pos,0) AS total_pos, coalesce(days_since_last,999)::INT AS days_since_last,
 (CASE WHEN last_ts IS NULL THEN 999 ELSE GREATEST(floor((epoch_us(TIMESTAMP'{CUT}')-epoch_us(last_ts))/8.64e10),0) END)::BIGINT AS days_since_ui, coalesce(n_chat,0) AS n_chat, round(coalesce(decay_score,0),6) AS decay_score, coalesce(leads,0) AS leads, coalesce(label,0)::INT AS label
FROM ca LEFT JOIN itf i USING (item_id) LEFT JOIN us USING (user_id) LEFT JOIN pr USING (user_id, item_id) LEFT JOIN hd USING (user_id, item_id) LEFT JOIN ia USING (user_id, item_id) LEFT JOIN tr USING (user_id, item_id)"""
AFC = ["user_id", "item_id", "days_since_posted", "trend_pos_log", "total_pos", "days_since_last", "days_since_ui", "n_chat", "decay_score", "leads", "label"]


@query("assemble_features", "ev dim snap inter", AFS)
def _(s):
    return assembled(s).select(*AFC)


@query("assemble_from_stages", "ev dim snap inter", AFS)
def _(s):
    """The same rows from stages that are written in buckets and could serve other candidates too."""
    return assembled(s, bucketed(candidate_pairs(s), "candidates", "user_id", "item_id"), T.stage_features(feature_stages(s))).select(*AFC)


def price_log_sql(c: str) -> str:
    v = rf"(coalesce(try_cast(replace(regexp_extract(lower({c}),'{Q.BILLIONS}',1),',','.') AS DOUBLE)*1e9,0)+coalesce(try_cast(replace(regexp_extract(lower({c}),'{Q.MILLIONS}',1),',','.') AS DOUBLE)*1e6,0))"
    f = rf"try_cast(regexp_extract(replace(lower({c}),',',''),'(\d+)',1) AS DOUBLE)"
    return f"CASE WHEN {v}>0 THEN ln(1+{v}) WHEN {f}>0 THEN ln(1+{f}) END"


U2 = f"""pp AS (SELECT *, (epoch_us(TIMESTAMP'{CUT}')-epoch_us(event_ts))/8.64e10 AS age FROM ev WHERE event_ts<TIMESTAMP'{CUT}'), po AS (SELECT * FROM pp WHERE event_type IN {PO}),
b2 AS (SELECT user_id, COUNT(*) AS n_pos, COUNT(*) FILTER (age<=7) AS n_pos_7d, COUNT(*) FILTER (age<=30) AS n_pos_30d, COUNT(*) FILTER (age<=30 AND event_type IN {EX}) AS n_high_30d, MIN(age) AS recency_days, COUNT(DISTINCT item_id) AS n_items, COUNT(DISTINCT session_id) AS n_sessions, (AVG((is_login='login')::INT)>0.5)::INT AS login_majority FROM po GROUP BY 1),
""" + ", ".join(f"k_{c} AS (SELECT user_id, {c} AS {o} FROM (SELECT user_id, {c}, COUNT(*) AS n FROM po WHERE {c} IS NOT NULL GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {c})=1)"
                for c, o in (("category", "top_category"), ("city_name", "top_city"), ("surface", "main_surface"), ("device", "main_device"))) + f""",
v2 AS (SELECT user_id, COUNT(*) AS n_pageviews_30d, AVG(dwell_time_sec) AS avg_dwell FROM pp WHERE {PV} AND age<=30 GROUP BY 1), pl AS (SELECT item_id, {price_log_sql('price_bucket')} AS price_log FROM dim), pm AS (SELECT user_id, median(price_log) AS price_pref_log FROM po JOIN pl USING (item_id) GROUP BY 1),
u2 AS (SELECT b2.*, n_high_30d::DOUBLE/GREATEST(n_pos_30d,1) AS high_intent_ratio, top_category, top_city, main_surface, main_device, n_pageviews_30d, avg_dwell, price_pref_log FROM b2 LEFT JOIN k_category USING (user_id) LEFT JOIN k_city_name USING (user_id) LEFT JOIN k_surface USING (user_id) LEFT JOIN k_device USING (user_id) LEFT JOIN v2 USING (user_id) LEFT JOIN pm USING (user_id))"""
R2 = "* REPLACE (round(recency_days,6) AS recency_days, round(high_intent_ratio,6) AS high_intent_ratio, round(avg_dwell,6) AS avg_dwell, round(price_pref_log,6) AS price_pref_log, n_pageviews_30d::DOUBLE AS n_pageviews_30d)"


def users_v2(s):
    return T.user_features_v2(s.ev, s.dim, CUT)


@query("user_features_v2", "ev dim", f"WITH {U2} SELECT {R2} FROM u2")
def _(s):
    return users_v2(s).withColumn("n_pageviews_30d", F.col("n_pageviews_30d").cast("double"))


I2 = f"""ip AS (SELECT item_id, COUNT(*) FILTER (epoch_us(TIMESTAMP'{CUT}')-epoch_us(event_ts)<=7*86400000000) AS n_pos_7d, COUNT(*) FILTER (epoch_us(TIMESTAMP'{CUT}')-epoch_us(event_ts)<=30*86400000000) AS n_pos_30d, COUNT(DISTINCT user_id) AS n_users, COUNT(*) AS n_pos FROM ev WHERE event_type IN {PO} AND event_ts<TIMESTAMP'{CUT}' GROUP BY 1),
ms AS (SELECT item_id, AVG(views_24h) FILTER (DATE'{CUT}'-date<=7) AS v7, AVG(contacts_24h) FILTER (DATE'{CUT}'-date<=7) AS c7, AVG(views_24h) FILTER (DATE'{CUT}'-date<=30) AS v30, AVG(contacts_24h) FILTER (DATE'{CUT}'-date<=30) AS c30, COUNT(*) AS n_days FROM snap WHERE date<DATE'{CUT}' GROUP BY 1),
i2a AS (SELECT d.item_id, d.category, d.city_name, {price_log_sql('d.price_bucket')} AS price_log, coalesce(n_pos_7d,0) AS n_pos_7d, coalesce(n_pos_30d,0) AS n_pos_30d, coalesce(n_users,0) AS n_users, coalesce(n_pos,0) AS n_pos, v7, c7, v30, c30, coalesce(n_days,0) AS n_days FROM dim d LEFT JOIN ip USING (item_id) LEFT JOIN ms USING (item_id)),
sg AS (SELECT category, city_name, median(price_log) AS m, stddev_samp(price_log) AS sd FROM i2a GROUP BY 1,2)"""


def items_v2(s):
    return T.item_features_v2(s.ev, s.snap, s.dim, CUT)


@query("item_features_v2", "ev snap dim", f"""WITH {I2} SELECT item_id, round(price_log,6) AS price_log, n_pos_7d, n_pos_30d, n_users, n_pos, round(c30/GREATEST(v30,0.01),6) AS cr_30d, round((c7-c30)/GREATEST(c30,0.01),6) AS velocity_contacts, round((v7-v30)/GREATEST(v30,0.01),6) AS velocity_views, round(n_pos::DOUBLE/GREATEST(n_days,1),6) AS event_density,
 round((price_log-m)/GREATEST(coalesce(sd,0),0.1),6) AS price_deviation FROM i2a LEFT JOIN sg ON i2a.category=sg.category AND i2a.city_name IS NOT DISTINCT FROM sg.city_name""")
def _(s):
    return items_v2(s).select("item_id", "price_log", "n_pos_7d", "n_pos_30d", "n_users", "n_pos", "cr_30d", "velocity_contacts", "velocity_views", "event_density", "price_deviation")


@query("cross_features", "ev snap dim", f"""WITH {U2}, c AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT c.user_id, c.item_id, coalesce((top_category=d.category)::INT,0) AS same_category, coalesce((top_city=d.city_name)::INT,0) AS same_city, round(-abs(pl.price_log-price_pref_log),6) AS price_affinity
FROM c LEFT JOIN u2 USING (user_id) LEFT JOIN dim d ON d.item_id=c.item_id LEFT JOIN pl ON pl.item_id=c.item_id""")
def _(s):
    """Users and items carry only the columns that are compared; no other feature is computed."""
    listed = durable(T.priced(s.dim).select("item_id", "category", "city_name", "price_log"), "listed")
    return T.cross_features(s.ev.select("user_id", "item_id").distinct(), T.user_tastes(s.ev, listed, CUT), listed).select("user_id", "item_id", "same_category", "same_city", "price_affinity")


IQ = "(0.2*(coalesce(images_count,0)>3)::INT+0.2*coalesce((seller_type='private')::INT,0)+0.3*coalesce((legal_status='so_hong')::INT,0)+0.15*(house_type IS NOT NULL)::INT+0.15*(direction IS NOT NULL)::INT)::DOUBLE"


@query("item_quality_score", "dim", f"SELECT item_id, round({IQ},6) AS quality FROM dim")
def _(s):
    return s.dim.select("item_id", T.item_quality_score(["private"], ["so_hong"]).alias("quality"))


VEC = f"""un AS (SELECT vec_id AS item_id, list_transform(embedding::DOUBLE[], lambda x: x/sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y*y)))) AS u, embedding::DOUBLE[] AS e FROM embeddings),
pt AS (SELECT user_id, item_id FROM ev WHERE {SCOPE} AND event_type IN ('view_phone','contact_chat','other_interaction','contact_zalo','contact_sms') GROUP BY 1,2),
px AS (SELECT user_id, unnest(range(1,65)) AS pos, unnest(u) AS x FROM pt JOIN un USING (item_id)), pf AS (SELECT user_id, list(m ORDER BY pos) AS p FROM (SELECT user_id, pos, AVG(x) AS m FROM px GROUP BY 1,2) GROUP BY 1)"""


@query("user_embedding_profile", "ev", f"WITH {VEC} SELECT user_id, round(list_sum(p),6) AS total, round(p[1],6) AS first, len(p)::INT AS dims FROM pf")
def _(s):
    pairs = T.user_item_positive(s.ev).select("user_id", "item_id")
    prof = T.user_embedding_profile(pairs, s.vectors)
    return prof.select("user_id", F.aggregate("profile", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("profile")[0].alias("first"), F.size("profile").alias("dims"))


@query("title_similarity", "ev", f"""WITH {VEC}, c AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT c.user_id, c.item_id, round(list_dot_product(p,e)/(sqrt(list_dot_product(p,p))*sqrt(list_dot_product(e,e))),6) AS similarity FROM c JOIN pf USING (user_id) JOIN un USING (item_id)""")
def _(s):
    pairs = T.user_item_positive(s.ev).select("user_id", "item_id")
    return T.title_similarity(s.ev.select("user_id", "item_id").distinct(), T.user_embedding_profile(pairs, s.vectors), s.vectors)


WINDOWS = (1, 7, 14, 28)


@query("sketched_uniques", "ev", f"""SELECT item_id, {', '.join(f"COUNT(DISTINCT user_id) FILTER (date>DATE'{END}'-{d}) AS users_{d}d" for d in WINDOWS)}, 1::INT AS near
FROM ev WHERE date<=DATE'{END}' AND date>DATE'{END}'-28 AND user_id IS NOT NULL GROUP BY 1""")
def _(s):
    """Users per item over four windows; ``near`` says that the daily sketches are within 3 percent of them all."""
    sketches = durable(K.daily_sketches(s.ev, ["item_id"]), "sketches")
    names = [f"users_{d}d" for d in WINDOWS]
    exact = K.exact_window_uniques(s.ev, ["item_id"], END, WINDOWS)
    both = exact.join(K.window_uniques(sketches, ["item_id"], END, WINDOWS, prefix="about"), "item_id")
    near = [F.abs(F.col(n) - F.col(n.replace("users", "about"))) <= F.col(n) * 0.03 for n in names]
    return both.select("item_id", *names, F.when(reduce(lambda a, b: a & b, near), 1).otherwise(0).alias("near"))
