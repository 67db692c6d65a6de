"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_explicit
from bazaarlens.operators import quality as Q
from bazaarlens.plans.primitives import EX
from bazaarlens.plans.registry import query
from bazaarlens.schemas import CATEGORIES

WINDOW = ("2023-11-15", "2023-12-31")


@query("dedupe_items", "dim", """
SELECT item_id, title, ward_name FROM dim QUALIFY row_number() OVER (PARTITION BY title, district_name ORDER BY images_count DESC NULLS LAST, posted_date DESC, item_id)=1""")
def _(s):
    order = [F.desc_nulls_last("images_count"), F.desc("posted_date"), F.asc("item_id")]
    return Q.dedupe_items(s.dim, ["title", "district_name"], order).select("item_id", "title", "ward_name")


@query("dropped_duplicates", "dim", """
SELECT item_id, title FROM dim QUALIFY row_number() OVER (PARTITION BY title, district_name ORDER BY images_count DESC NULLS LAST, posted_date DESC, item_id)>1""")
def _(s):
    order = [F.desc_nulls_last("images_count"), F.desc("posted_date"), F.asc("item_id")]
    kept = Q.dedupe_items(s.dim, ["title", "district_name"], order)
    return Q.dropped_duplicates(s.dim, kept, "item_id").select("item_id", "title")


@query("cap_contacts", "snap", """
SELECT date::VARCHAR AS date, SUM((contacts_24h>views_24h)::INT)::BIGINT AS violations, SUM(LEAST(contacts_24h,views_24h)) AS contacts FROM snap GROUP BY 1""")
def _(s):
    return Q.cap_contacts(s.snap).groupBy("date").agg(
        F.sum("contact_violation").alias("violations"), F.sum("contacts_24h").alias("contacts"))


@query("recompute_contact_flag", "ev", f"""
SELECT category, COUNT(*) FILTER (is_contact=1 AND event_type IN {EX}) AS "both", COUNT(*) FILTER (is_contact=1 AND event_type NOT IN {EX}) AS flag_only,
 COUNT(*) FILTER (is_contact=0 AND event_type IN {EX}) AS type_only FROM ev GROUP BY 1""")
def _(s):
    return Q.contact_flag_consistency(s.ev)


@query("category_mismatch", "ev dim", """
SELECT e.category, COUNT(*) AS n, COUNT(*) FILTER (d.category<>e.category) AS mismatched, COUNT(*) FILTER (d.category IS NULL) AS no_dim
FROM ev e LEFT JOIN dim d USING (item_id) GROUP BY 1""")
def _(s):
    return Q.category_mismatch(s.ev, s.dim)


@query("drop_orphans", "snap dim", """
SELECT date::VARCHAR AS date, COUNT(*) AS n FROM snap WHERE item_id IN (SELECT item_id FROM dim WHERE category<>3030) GROUP BY 1""")
def _(s):
    return Q.drop_orphans(s.snap, s.dim.filter("category <> 3030")).groupBy("date").agg(F.count("*").alias("n"))


@query("orphans", "snap dim", """
SELECT item_id, COUNT(*) AS n FROM snap WHERE item_id NOT IN (SELECT item_id FROM dim WHERE category<>3030) GROUP BY 1""")
def _(s):
    return Q.orphans(s.snap, s.dim.filter("category <> 3030")).groupBy("item_id").agg(F.count("*").alias("n"))


@query("drop_future", "dim", "SELECT category, COUNT(*) AS n FROM dim WHERE posted_date IS NULL OR posted_date<=DATE'2023-12-31' GROUP BY 1")
def _(s):
    return Q.drop_future(s.dim, "posted_date", "2023-12-31").groupBy("category").agg(F.count("*").alias("n"))


@query("fix_expiry", "dim", """
SELECT category, COUNT(expected_expired_date) FILTER (expected_expired_date>=posted_date) AS kept, COUNT(*) AS n FROM dim GROUP BY 1""")
def _(s):
    return Q.fix_expiry(s.dim).groupBy("category").agg(F.count("expected_expired_date").alias("kept"), F.count("*").alias("n"))


@query("normalize_event_time", "ev", """
SELECT CAST(event_ts + INTERVAL 7 HOUR AS DATE)::VARCHAR AS date, COUNT(*) AS n, SUM((date<>CAST(event_ts + INTERVAL 7 HOUR AS DATE))::INT)::BIGINT AS mismatches FROM ev GROUP BY 1""")
def _(s):
    return Q.normalize_event_time(s.ev, "7 HOURS").groupBy("date").agg(F.count("*").alias("n"), F.sum("date_mismatch").alias("mismatches"))


@query("normalize_dwell", "ev", """
WITH m AS (SELECT *, dwell_time_sec*1000 AS ms FROM ev), s AS (SELECT median(ms) AS med, quantile_cont(ms,0.99) AS cap FROM m)
SELECT event_type, COUNT(*) AS n, round(AVG(LEAST(ms,cap)/CASE WHEN med>1000 THEN 1000 ELSE 1 END),6) AS avg_dwell, round(MAX(LEAST(ms,cap)/CASE WHEN med>1000 THEN 1000 ELSE 1 END),6) AS max_dwell FROM m, s GROUP BY 1""")
def _(s):
    millis = s.ev.withColumn("dwell_time_sec", F.col("dwell_time_sec") * 1000)
    return Q.normalize_dwell(millis).groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg("dwell_time_sec").alias("avg_dwell"), F.max("dwell_time_sec").alias("max_dwell"))


@query("flag_zero_views", "snap", "SELECT date::VARCHAR AS date, COUNT(*) AS n, SUM((coalesce(views_24h,0)=0)::INT)::BIGINT AS zero FROM snap GROUP BY 1")
def _(s):
    return Q.flag_zero_views(s.snap).groupBy("date").agg(F.count("*").alias("n"), F.sum("zero_views").alias("zero"))


@query("null_outliers", "dim", "SELECT category, COUNT(area_sqm) FILTER (area_sqm BETWEEN 10 AND 180) AS kept, round(AVG(area_sqm) FILTER (area_sqm BETWEEN 10 AND 180),6) AS mean FROM dim GROUP BY 1")
def _(s):
    return Q.null_outliers(s.dim, "area_sqm", 10, 180).groupBy("category").agg(F.count("area_sqm").alias("kept"), F.avg("area_sqm").alias("mean"))


@query("drop_sparse_columns", "dim", "SELECT item_id, title, bedrooms, project_id FROM dim")
def _(s):
    wide = s.dim.select("item_id", "title", "bedrooms", "project_id", F.when(F.col("item_id") < 0, "x").alias("empty"))
    return Q.drop_sparse_columns(wide)


@query("normalize_text", "dim", r"""
SELECT nullif(nullif(nullif(lower(trim(regexp_replace('  '||coalesce(furnishing,'NaN')||'   x ','\s+',' ','g'))),''),'nan'),'none') AS t,
 nullif(nullif(nullif(lower(trim(regexp_replace(furnishing,'\s+',' ','g'))),''),'nan'),'none') AS furnishing, COUNT(*) AS n FROM dim GROUP BY 1,2""")
def _(s):
    padded = F.concat(F.lit("  "), F.coalesce("furnishing", F.lit("NaN")), F.lit("   x "))
    return s.dim.groupBy(Q.normalize_text(padded).alias("t"), Q.normalize_text("furnishing").alias("furnishing")).agg(F.count("*").alias("n"))


def _amt(pattern: str, g: int, u: int) -> str:
    return (f"(try_cast(replace(regexp_extract(t,'{pattern}',{g}),',','.') AS DOUBLE)*CASE lower(regexp_extract(t,'{pattern}',{u})) "
            "WHEN 'k' THEN 1e3 WHEN 'nghìn' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'triệu' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'tỷ' THEN 1e9 END)")


PRICED = f"""pz AS (SELECT *, lower(trim(price_bucket)) AS t FROM dim),
priced AS (SELECT *, CASE WHEN t LIKE '%thỏa thuận%' THEN NULL WHEN regexp_matches(t,'{Q.RANGE_CODES}') THEN {_amt(Q.RANGE_CODES,1,2)} WHEN regexp_matches(t,'{Q.BELOW}') THEN 0
  WHEN regexp_matches(t,'{Q.ABOVE}') THEN {_amt(Q.ABOVE,1,2)} WHEN regexp_matches(t,'{Q.RANGE_WORDS}') THEN {_amt(Q.RANGE_WORDS,1,2)} END AS price_low,
 CASE WHEN t LIKE '%thỏa thuận%' THEN NULL WHEN regexp_matches(t,'{Q.RANGE_CODES}') THEN {_amt(Q.RANGE_CODES,3,4)} WHEN regexp_matches(t,'{Q.BELOW}') THEN {_amt(Q.BELOW,1,2)}
  WHEN regexp_matches(t,'{Q.ABOVE}') THEN 1.5*{_amt(Q.ABOVE,1,2)} WHEN regexp_matches(t,'{Q.RANGE_WORDS}') THEN {_amt(Q.RANGE_WORDS,3,4)} END AS price_high,
 CASE WHEN t LIKE '%thỏa thuận%' THEN true WHEN t IS NOT NULL THEN false END AS is_negotiable FROM pz),
mid AS (SELECT *, CASE WHEN price_low IS NOT NULL OR price_high IS NOT NULL THEN (coalesce(price_low,0)+coalesce(price_high,0))/2 END AS price_mid FROM priced)"""


@query("price_bucket_to_numeric", "dim", f"WITH {PRICED} SELECT item_id, price_low, price_high, price_mid, is_negotiable FROM mid")
def _(s):
    return Q.price_bucket_to_numeric(s.dim).select("item_id", "price_low", "price_high", "price_mid", "is_negotiable")


@query("price_log", "dim", rf"""
WITH p AS (SELECT item_id, lower(price_bucket) AS t FROM dim),
v AS (SELECT item_id, t, coalesce(try_cast(replace(regexp_extract(t,'{Q.BILLIONS}',1),',','.') AS DOUBLE)*1e9,0)+coalesce(try_cast(replace(regexp_extract(t,'{Q.MILLIONS}',1),',','.') AS DOUBLE)*1e6,0) AS v,
 try_cast(regexp_extract(replace(t,',',''),'(\d+)',1) AS DOUBLE) AS f FROM p)
SELECT item_id, CASE WHEN v>0 THEN round(ln(1+v),6) WHEN f>0 THEN round(ln(1+f),6) END AS price_log FROM v""")
def _(s):
    return s.dim.select("item_id", Q.price_log("price_bucket").alias("price_log"))


@query("price_ordinal", "dim", """
SELECT price_bucket, CASE price_bucket WHEN '<500M' THEN 0 WHEN '3B–5B' THEN 6 WHEN '<2M/tháng' THEN 0 WHEN '3M–5M/tháng' THEN 2 WHEN '>30M/tháng' THEN 8 ELSE -1 END::INT AS ordinal, COUNT(*) AS n FROM dim GROUP BY 1""")
def _(s):
    return s.dim.groupBy("price_bucket", Q.price_ordinal("price_bucket").alias("ordinal")).agg(F.count("*").alias("n"))


@query("price_per_sqm_winsor", "dim", f"""WITH {PRICED}, r AS (SELECT item_id, CASE WHEN area_sqm>0 THEN price_mid/area_sqm END AS v FROM mid),
l AS (SELECT quantile_cont(v,0.01) AS lo, quantile_cont(v,0.99) AS hi FROM r) SELECT item_id, round(GREATEST(LEAST(v,hi),lo),6)*(v-v+1) AS price_per_sqm FROM r, l""")
def _(s):
    return Q.price_per_sqm_winsor(Q.price_bucket_to_numeric(s.dim)).select("item_id", "price_per_sqm")


@query("user_scope_id", "ev", "SELECT CASE WHEN is_login='login' THEN user_id::VARCHAR ELSE session_id END AS scope_id, COUNT(*) AS n FROM ev GROUP BY 1")
def _(s):
    return Q.user_scope_id(s.ev).groupBy("scope_id").agg(F.count("*").alias("n"))


@query("session_login_state", "ev", """
SELECT session_id, (COUNT(DISTINCT is_login)>1)::INT AS is_mixed, CASE WHEN SUM((is_login='login')::INT)>0 THEN 'login' ELSE 'non-login' END AS session_login FROM ev GROUP BY 1""")
def _(s):
    return Q.session_login_state(s.ev)


def issues(s):
    return [
        ("snapshot", "contacts above views", s.snap, F.col("contacts_24h") > F.col("views_24h"), "cap"),
        ("snapshot", "zero views", s.snap, F.col("views_24h") == 0, "flag"),
        ("dim", "expiry before posting", s.dim, F.col("expected_expired_date") < F.col("posted_date"), "null"),
        ("dim", "no bedrooms", s.dim, F.col("bedrooms").isNull(), "keep"),
        ("events", "flag differs from type", s.ev, (F.col("is_contact") == 1) != is_explicit(), "recompute"),
    ]


QLOG = f"""lg AS (SELECT 'snapshot' AS "group", 'contacts above views' AS issue, COUNT(*) FILTER (contacts_24h>views_24h) AS n_issue, COUNT(*) AS total, 'cap' AS action FROM snap
 UNION ALL SELECT 'snapshot','zero views', COUNT(*) FILTER (views_24h=0), COUNT(*), 'flag' FROM snap
 UNION ALL SELECT 'dim','expiry before posting', COUNT(*) FILTER (expected_expired_date<posted_date), COUNT(*), 'null' FROM dim
 UNION ALL SELECT 'dim','no bedrooms', COUNT(*) FILTER (bedrooms IS NULL), COUNT(*), 'keep' FROM dim
 UNION ALL SELECT 'events','flag differs from type', COUNT(*) FILTER ((is_contact=1)<>(event_type IN {EX})), COUNT(*), 'recompute' FROM ev)"""


@query("quality_log", "snap dim ev", f"""WITH {QLOG} SELECT "group", issue, n_issue, total, round(100.0*n_issue/total,6) AS pct, action FROM lg""")
def _(s):
    return Q.quality_log(issues(s))


@query("quality_log_rollup", "snap dim ev", f"""WITH {QLOG} SELECT "group", COUNT(*) AS issues, SUM(n_issue)::BIGINT AS n_issue FROM lg GROUP BY 1""")
def _(s):
    return Q.quality_log_rollup(Q.quality_log(issues(s)))


@query("null_rate_matrix", "dim", """
WITH l AS (SELECT category, unnest([{'column':'bedrooms','v':(bedrooms IS NULL)::INT},{'column':'width_m','v':(width_m IS NULL)::INT},{'column':'project_id','v':(project_id IS NULL)::INT},{'column':'direction','v':(direction IS NULL)::INT}]) AS p FROM dim)
SELECT category, p."column" AS "column", round(100.0*AVG(p.v),6) AS null_pct, (p."column"='bedrooms' AND category IN (1040,1050))::INT AS valid_null FROM l GROUP BY ALL""")
def _(s):
    return Q.null_rate_matrix(s.dim, "category", ["bedrooms", "width_m", "project_id", "direction"], {"bedrooms": [1040, 1050]})


@query("fill_rate", "dim", """
WITH l AS (SELECT category, unnest([{'field':'bedrooms','v':coalesce((bedrooms>0)::INT,0)},{'field':'floors','v':coalesce((floors>0)::INT,0)},{'field':'furnishing','v':coalesce((trim(furnishing)<>'')::INT,0)},{'field':'posted_date','v':(posted_date IS NOT NULL)::INT}]) AS p FROM dim)
SELECT category, p.field AS field, round(100.0*AVG(p.v),6) AS fill_pct FROM l GROUP BY ALL""")
def _(s):
    return Q.fill_rate(s.dim, "category", ["bedrooms", "floors", "furnishing", "posted_date"])


@query("snapshot_sanity", "snap dim ev", f"""
WITH j AS (SELECT s.*, d.category FROM snap s JOIN dim d USING (item_id)), a AS (SELECT category, COUNT(*) AS listing_days, round(100.0*COUNT(*) FILTER (contacts_24h>views_24h)/COUNT(*),6) AS pct_contact_gt_view,
 round(100.0*COUNT(*) FILTER (views_24h=0)/COUNT(*),6) AS pct_views_zero FROM j GROUP BY 1),
sd AS (SELECT category, date, SUM(contacts_24h) AS c FROM j GROUP BY 1,2), ed AS (SELECT category, date, COUNT(*)::DOUBLE AS x FROM ev WHERE is_login='login' AND event_type IN {EX} GROUP BY 1,2),
b AS (SELECT sd.category, round(AVG(c),6) AS avg_daily_snap, round(AVG(x),6) AS avg_daily_explicit, round(AVG(x/NULLIF(c,0)),6) AS avg_event_snap_ratio FROM sd LEFT JOIN ed USING (category,date) GROUP BY 1)
SELECT * FROM a JOIN b USING (category)""")
def _(s):
    return Q.snapshot_sanity(s.snap, s.dim, s.ev)


@query("time_coverage", "ev dim snap", """
SELECT 'events' AS source, MIN(date)::VARCHAR AS t_min, MAX(date)::VARCHAR AS t_max, COUNT(*) AS n_rows FROM ev UNION ALL SELECT 'dim', MIN(posted_date)::VARCHAR, MAX(posted_date)::VARCHAR, COUNT(*) FROM dim
UNION ALL SELECT 'snapshot', MIN(date)::VARCHAR, MAX(date)::VARCHAR, COUNT(*) FROM snap""")
def _(s):
    return Q.time_coverage({"events": (s.ev, "date"), "dim": (s.dim, "posted_date"), "snapshot": (s.snap, "date")})


@query("posted_cohort", "ev dim", """
WITH s AS (SELECT item_id, MAX((event_type IN ('view_phone','contact_chat','other_interaction','contact_zalo','contact_sms'))::INT) AS p FROM ev GROUP BY 1),
d AS (SELECT *, CASE WHEN posted_date IS NULL THEN 'unknown' WHEN posted_date<DATE'2023-11-15' THEN 'pre_window' WHEN posted_date>DATE'2023-12-31' THEN 'post_window' ELSE 'in_window' END AS cohort FROM dim)
SELECT category, cohort, COUNT(*) AS listings, COUNT(p) AS with_events, round(100.0*COUNT(p)/COUNT(*),6) AS pct_with_events, round(100.0*coalesce(SUM(p),0)/COUNT(*),6) AS cvr_pct FROM d LEFT JOIN s USING (item_id) GROUP BY 1,2""")
def _(s):
    return Q.cohort_event_overlap(s.dim, s.ev, *WINDOW)


@query("alive_in_window", "dim", """
SELECT category, COUNT(*) AS n, round(100.0*AVG(coalesce((expected_expired_date>=DATE'2023-11-15' AND posted_date<=DATE'2023-12-31')::INT,0)),6) AS alive_pct FROM dim GROUP BY 1""")
def _(s):
    return Q.alive_in_window(s.dim, *WINDOW)


@query("table_scale", "ev", "SELECT category, is_login, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items FROM ev GROUP BY 1,2")
def _(s):
    return Q.table_scale(s.ev)


@query("unexpected_categories", "dim", "SELECT category, COUNT(*) AS n FROM dim WHERE category NOT IN (1010,1020,1030,1040,1050) GROUP BY 1")
def _(s):
    return Q.unexpected_categories(s.dim, CATEGORIES)


@query("location_completeness", "dim", """
SELECT category, COUNT(*) AS n, COUNT(*) FILTER (city_name IS NULL) AS null_city_name, COUNT(*) FILTER (district_name IS NULL) AS null_district_name, COUNT(*) FILTER (direction IS NULL) AS null_direction,
 round(100.0*AVG((city_name IS NOT NULL AND district_name IS NOT NULL AND direction IS NOT NULL)::INT),6) AS complete_pct FROM dim GROUP BY 1""")
def _(s):
    return Q.location_completeness(s.dim, ["city_name", "district_name", "direction"])


@query("metrics_long", "dim", """
WITH w AS (SELECT category, COUNT(*)::DOUBLE AS n, AVG(area_sqm) AS avg_area FROM dim GROUP BY 1)
SELECT 'supply' AS section, 'n' AS metric, category, n AS value, 'listings' AS unit FROM w UNION ALL SELECT 'supply','avg_area',category,round(avg_area,6),'sqm' FROM w""")
def _(s):
    table = s.dim.groupBy("category").agg(F.count("*").alias("n"), F.avg("area_sqm").alias("avg_area"))
    return Q.metrics_long("supply", table, "category", {"n": "listings", "avg_area": "sqm"})


@query("adtype_title_mismatch", "dim", rf"""
WITH f AS (SELECT category, ad_type='sell' AND regexp_matches(lower(title),'{Q.RENT_WORDS}') AS a, ad_type='let' AND regexp_matches(lower(title),'{Q.SELL_WORDS}') AND NOT regexp_matches(lower(title),'{Q.BALCONY_WORDS}') AS b FROM dim)
SELECT category, COUNT(*) AS n, COUNT(*) FILTER (a) AS sell_rent_title, COUNT(*) FILTER (b) AS let_sell_title, round(100.0*COUNT(*) FILTER (a)/COUNT(*),6) AS pct_sell_rent, round(100.0*COUNT(*) FILTER (b)/COUNT(*),6) AS pct_let_sell FROM f GROUP BY 1""")
def _(s):
    return Q.adtype_title_mismatch(s.dim)


PREP = """sc AS (SELECT * FROM dim WHERE category IN (1010,1020,1030,1040,1050) AND ad_type IN ('let','sell')),
lv AS (SELECT * FROM sc WHERE ad_status IN ('accepted','shop_accepted') AND posted_date BETWEEN DATE'2023-11-15' AND DATE'2023-12-31' AND trim(city_name)<>''),
dd AS (SELECT DISTINCT title, district_name FROM lv)"""


@query("dim_prep_summary", "dim", f"""WITH {PREP} SELECT 'in_scope' AS stage, COUNT(*) AS rows FROM sc UNION ALL SELECT 'active_in_window', COUNT(*) FROM lv UNION ALL SELECT 'deduplicated', COUNT(*) FROM dd
 UNION ALL SELECT 'dropped', (SELECT COUNT(*) FROM lv)-(SELECT COUNT(*) FROM dd)""")
def _(s):
    order = [F.desc("posted_date"), F.asc("item_id")]
    return Q.dim_prep_summary(s.dim, CATEGORIES, ["accepted", "shop_accepted"], *WINDOW, ["title", "district_name"], order)


