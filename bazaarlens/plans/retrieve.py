"""Retrieval and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive
from bazaarlens.operators import features as T
from bazaarlens.operators import retrieve as R
from bazaarlens.operators.quality import price_ordinal
from bazaarlens.operators.segment import item_tiers
from bazaarlens.plans.features import END, IQ, PR, U2, UX, UP, users_v2
from bazaarlens.plans.primitives import PO
from bazaarlens.plans.registry import query
from bazaarlens.session import durable

GAP = 43200
CINT = "CASE event_type WHEN 'view_phone' THEN 2.0E0 WHEN 'contact_chat' THEN 3 WHEN 'contact_zalo' THEN 3 WHEN 'contact_sms' THEN 3 WHEN 'other_interaction' THEN 1 ELSE 0 END"
INT = "CASE event_type WHEN 'view_phone' THEN 3.0E0 WHEN 'contact_chat' THEN 2 WHEN 'contact_zalo' THEN 2 WHEN 'contact_sms' THEN 2 WHEN 'other_interaction' THEN 1 ELSE {d} END"


def written(s):
    """The star over one written copy of what the retrievers read of its events: their texts are parsed once, not in every scan."""
    read = ["event_id", "event_ts", "date", "user_id", "item_id", "category", "event_type", "is_login", "city_name"]
    return s.over(durable(s.ev.select(*read), "events"))


def als_scores(s, n=20):
    pairs = T.user_item_positive(s.ev)
    factors = R.fit_als(R.confidence(pairs, END), rank=16, iterations=5)
    return R.als_candidates(factors, s.test_users, n)


@query("als_candidates")
def _(s):
    return als_scores(s)


@query("confidence", "ev", f"WITH {PR} SELECT user_id, item_id, round(GREATEST(1.0,pos_count*exp(-0.005*GREATEST(DATE_DIFF('day',last_ts::DATE,DATE'{END}'),0))),6) AS weight FROM pr")
def _(s):
    return R.confidence(T.user_item_positive(s.ev), END)


@query("item_embedding_cf", "ev", f"""WITH {PR}, un AS (SELECT vec_id AS item_id, list_transform(embedding::DOUBLE[], lambda x: x/sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))) AS u FROM embeddings),
px AS (SELECT user_id, pos_count AS w, unnest(range(1,65)) AS pos, unnest(u) AS x FROM pr JOIN un USING (item_id)), p0 AS (SELECT user_id, list(m ORDER BY pos) AS p FROM (SELECT user_id, pos, SUM(w*x)/SUM(w) AS m FROM px GROUP BY 1,2) GROUP BY 1),
sc AS (SELECT user_id, item_id, list_dot_product(p,u)/sqrt(list_dot_product(p,p)) AS score FROM p0, un WHERE (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM pr))
SELECT user_id, item_id, round(score,6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INT AS rank FROM sc QUALIFY rank<=20""")
def _(s):
    pairs = T.user_item_positive(s.ev).select("user_id", "item_id", "pos_count")
    return R.item_embedding_cf(R.user_vectors(pairs, s.vectors), s.vectors, pairs, k=20)


CVP = f"""lt AS (SELECT user_id, item_id, MAX(event_ts) AS event_ts, arg_max(event_id,(event_ts,event_id)) AS event_id FROM ev WHERE event_type IN {PO} GROUP BY 1,2), g0 AS (SELECT *, lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS p FROM lt), g1 AS (SELECT user_id, item_id, event_ts, event_id, SUM((p IS NULL OR epoch_us(event_ts)-epoch_us(p)>{GAP}000000)::INT) OVER w AS sn, row_number() OVER w AS pos FROM g0 WINDOW w AS (PARTITION BY user_id ORDER BY event_ts, event_id)),
fp AS (SELECT LEAST(x.item_id,y.item_id) AS a, GREATEST(x.item_id,y.item_id) AS b, 1.0/log2(GREATEST((epoch_us(y.event_ts)-epoch_us(x.event_ts))/6e7,0)+2) AS w FROM g1 x JOIN g1 y ON x.user_id=y.user_id AND x.sn=y.sn AND y.pos BETWEEN x.pos+1 AND x.pos+5 WHERE x.item_id<>y.item_id),
cs AS (SELECT a, b, SUM(w) AS score FROM fp GROUP BY 1,2), sd AS (SELECT a AS item_id, b AS neighbor, score FROM cs UNION ALL SELECT b, a, score FROM cs), cp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score,9) DESC, neighbor)::INT AS rank FROM sd QUALIFY rank<=20)"""


def neighbors(s):
    # Written first: cutting them into slices reads them twice.
    return R.covisit_pairs(durable(R.last_touches(s.ev.filter(is_positive())), "touches"), gap_seconds=GAP)


@query("covisit_pairs", "ev", f"WITH {CVP} SELECT item_id, neighbor, round(score,6) AS score, rank FROM cp")
def _(s):
    return neighbors(s)


CVC = f"""{CVP}, hi AS (SELECT user_id, item_id, SUM({CINT}) AS intent FROM ev GROUP BY 1,2 HAVING SUM({CINT})>0), c0 AS (SELECT user_id, neighbor AS item_id, SUM(intent*score) AS score FROM hi JOIN cp USING (item_id) GROUP BY 1,2),
cc AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score,9) DESC, item_id)::INT AS rank FROM c0 WHERE (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM hi) QUALIFY rank<=100)"""


def covisited(s):
    return R.covisit_candidates(R.user_intent(s.ev), neighbors(s))


@query("covisit_candidates", "ev", f"WITH {CVC} SELECT user_id, item_id, round(score,6) AS score, rank FROM cc")
def _(s):
    return covisited(s)


HC = f"""hc AS (SELECT user_id, item_id, SUM({INT.format(d=1)}*exp(-((SELECT epoch_us(MAX(event_ts)) FROM ev WHERE item_id IN (SELECT item_id FROM dim WHERE ad_status<>'refused'))-epoch_us(event_ts))/8.64e10/14.0)) AS score FROM ev WHERE item_id IN (SELECT item_id FROM dim WHERE ad_status<>'refused') GROUP BY 1,2),
hr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score,9) DESC, item_id)::INT AS rank FROM hc QUALIFY rank<=30)"""


def history(s):
    return R.history_candidates(s.ev, s.dim.filter("ad_status <> 'refused'"))


@query("history_candidates", "ev dim", f"WITH {HC} SELECT user_id, item_id, round(score,6) AS score, rank FROM hr")
def _(s):
    return history(s)


SPC = f"""{U2}, pp2 AS (SELECT item_id, category, city_name, c FROM (SELECT item_id, SUM(contacts_24h) AS c FROM snap WHERE date>=DATE'2024-01-16' GROUP BY 1) JOIN dim USING (item_id) WHERE lower(coalesce(ad_status,''))<>'deleted' AND item_id IN (SELECT item_id FROM ev WHERE event_type IN {PO})), sl AS (SELECT *, row_number() OVER (PARTITION BY category, city_name ORDER BY c DESC, item_id)::INT AS rank FROM pp2 QUALIFY rank<=50),
gl AS (SELECT item_id, c, row_number() OVER (ORDER BY c DESC, item_id)::INT AS rank FROM pp2 QUALIFY rank<=50), sp AS (SELECT user_id, sl.item_id, sl.c AS score, sl.rank FROM u2 JOIN sl ON u2.top_category=sl.category AND u2.top_city=sl.city_name
 UNION ALL SELECT user_id, gl.item_id, gl.c, gl.rank FROM u2, gl WHERE NOT EXISTS (SELECT 1 FROM sl WHERE u2.top_category=sl.category AND u2.top_city=sl.city_name))"""


@query("segment_popularity_candidates", "ev dim snap", f"WITH {SPC} SELECT user_id, item_id, score, rank FROM sp")
def _(s):
    live = item_tiers(s.dim, s.ev, s.snap, END, "2023-12-01").filter("tier IN ('A', 'B')").select("item_id")
    return R.segment_popularity_candidates(users_v2(s), s.dim.join(live, "item_id", "left_semi"), s.snap.filter("date >= DATE'2024-01-16'"))


@query("cold_item_candidates", "ev dim snap", f"""WITH {PR}, {UP}, {UX}, e AS (SELECT item_id, COUNT(*) AS n_pos FROM ev WHERE event_type IN {PO} GROUP BY 1), s AS (SELECT item_id, SUM(contacts_24h) AS c FROM snap GROUP BY 1),
ti AS (SELECT dim.* FROM dim LEFT JOIN e USING (item_id) LEFT JOIN s USING (item_id) WHERE coalesce(n_pos,0)=0 AND coalesce(c,0)>0 AND ad_status<>'deleted'),
li AS (SELECT item_id, category, district_name, ad_type, row_number() OVER w AS rank, COUNT(*) OVER (PARTITION BY category, district_name, ad_type) AS n FROM ti WINDOW w AS (PARTITION BY category, district_name, ad_type ORDER BY posted_date DESC, item_id)),
us AS (SELECT up.user_id, pref_category, pref_district_name, pref_ad_type FROM up JOIN ux USING (user_id))
SELECT user_id, item_id, round(1.0-(rank-1)::DOUBLE/LEAST(n,50),6) AS score, rank::INT AS rank FROM us JOIN li ON pref_category=category AND pref_district_name=district_name AND pref_ad_type=ad_type WHERE rank<=50""")
def _(s):
    pairs = T.user_item_positive(s.ev)
    users = T.user_profile(pairs, END).join(T.user_preferences_ext(pairs, s.dim), "user_id").select(
        "user_id", F.col("pref_category").alias("top_category"), F.col("pref_district_name").alias("top_district"), F.col("pref_ad_type").alias("top_ad_type"))
    return R.cold_item_candidates(users, item_tiers(s.dim, s.ev, s.snap, END, "2023-12-01"))


PORD = "CASE price_bucket WHEN '<500M' THEN 0 WHEN '3B–5B' THEN 6 WHEN '<2M/tháng' THEN 0 WHEN '3M–5M/tháng' THEN 2 WHEN '>30M/tháng' THEN 8 ELSE -1 END"
FRESH = f"""w1 AS (SELECT item_id, COUNT(*) FILTER (date>=DATE'{END}'-1 AND date<=DATE'{END}' AND event_type IN {PO}) AS p1, COUNT(*) FILTER (date>=DATE'{END}'-7 AND date<=DATE'{END}' AND event_type IN {PO}) AS p7 FROM ev GROUP BY 1),
fr AS (SELECT item_id, category, district_name, {PORD} AS po, {IQ}*ln(1+10.0*coalesce(p1,0)/(coalesce(p7,0)+1)+0.1*coalesce(p1,0)) AS score FROM dim LEFT JOIN w1 USING (item_id) WHERE GREATEST(DATE_DIFF('day',posted_date,DATE'{END}'),0)<=45 AND {IQ}>0.3 AND district_name IS NOT NULL)"""


def fresh_items(s):
    """Young items of fair quality with a score of quality times recent activity."""
    pop = T.popularity_windows(s.ev, END, (1, 7)).groupBy("item_id").agg(F.sum("pos_1d").alias("p1"), F.sum("pos_7d").alias("p7"))
    age = F.greatest(F.datediff(F.lit(END).cast("date"), "posted_date"), F.lit(0))
    rows = s.dim.withColumns({"quality": T.item_quality_score(["private"], ["so_hong"]), "age": age, "price_ordinal": price_ordinal("price_bucket")})
    joined = rows.filter("age <= 45 AND quality > 0.3 AND district_name IS NOT NULL").join(pop, "item_id", "left").fillna(0, ["p1", "p7"])
    velocity = F.col("p1") / (F.col("p7") + 1)
    return joined.withColumn("score", F.col("quality") * F.log1p(velocity * 10 + F.col("p1") * 0.1))


def preferences(s, pairs=None):
    pairs = T.user_item_positive(s.ev) if pairs is None else pairs
    return T.user_profile(pairs, END).join(T.user_preferences_ext(pairs, s.dim), "user_id").select(
        "user_id", "pref_category", F.col("pref_district_name").alias("pref_district"), price_ordinal("pref_price_bucket").alias("pref_ordinal"))


FC = f"""{FRESH}, us AS (SELECT up.user_id, pref_category, pref_district_name, {PORD.replace('price_bucket','pref_price_bucket')} AS uo FROM up JOIN ux USING (user_id)),
fm AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score,9) DESC, item_id)::INT AS rank FROM us JOIN fr ON pref_category=category AND pref_district_name=district_name WHERE uo<0 OR po<0 OR abs(uo-po)<=1 QUALIFY rank<=50)"""


@query("fresh_content_candidates", "ev dim", f"WITH {PR}, {UP}, {UX}, {FC} SELECT user_id, item_id, round(score,6) AS score, rank FROM fm")
def _(s):
    return R.fresh_content_candidates(preferences(s), fresh_items(s))


POP10 = f"p10 AS (SELECT item_id, pos, row_number() OVER (ORDER BY pos DESC, item_id)::INT AS r FROM (SELECT item_id, COUNT(*) AS pos FROM ev WHERE event_type IN {PO} GROUP BY 1) QUALIFY r<=10)"


def popular(s, k=10):
    counts = s.ev.filter(is_positive()).groupBy("item_id").agg(F.count("*").alias("pos"))
    return R.top_array(counts, [F.desc("pos"), F.asc("item_id")], k)


SI2I = f"""fc AS (SELECT user_id, item_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_ts, event_id)=1), sn AS (SELECT item_id, coalesce(arg_max(contacts_24h,date),0) AS c FROM snap WHERE date<=DATE'{END}' GROUP BY 1),
dm AS (SELECT item_id, category, city_name, district_name, coalesce(c,0) AS c FROM dim LEFT JOIN sn USING (item_id)), l1 AS (SELECT *, row_number() OVER (PARTITION BY category, district_name ORDER BY c DESC, item_id) AS r FROM dm QUALIFY r<=15), l2 AS (SELECT *, row_number() OVER (PARTITION BY category, city_name ORDER BY c DESC, item_id) AS r FROM dm QUALIFY r<=15),
l3 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY c DESC, item_id) AS r FROM dm QUALIFY r<=15), {POP10}, u AS (SELECT fc.user_id, fc.item_id AS clicked, category, city_name, district_name FROM fc JOIN dim USING (item_id)),
a AS (SELECT user_id, clicked, l1.item_id AS rec, 1 AS t, r FROM u JOIN l1 USING (category, district_name) UNION ALL SELECT user_id, clicked, l2.item_id, 2, r FROM u JOIN l2 ON u.category=l2.category AND u.city_name=l2.city_name UNION ALL SELECT user_id, clicked, l3.item_id, 3, r FROM u JOIN l3 USING (category) UNION ALL SELECT user_id, clicked, p10.item_id, 4, r FROM u, p10),
b AS (SELECT user_id, rec, MIN(t*100+r) AS o FROM a WHERE rec<>clicked GROUP BY 1,2),
si AS (SELECT user_id, rec AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY o)::INT AS rank FROM b QUALIFY rank<=10)"""


def session_lists(s):
    return R.session_item_to_item(T.first_click(s.ev), s.dim, T.snapshot_features(s.snap, END), popular(s))


@query("session_item_to_item", "ev dim snap", f"WITH {SI2I} SELECT user_id, item_id, rank FROM si")
def _(s):
    return session_lists(s)


@query("session_cold_fallback", "ev dim snap test_users", f"""WITH {SI2I}, cu AS (SELECT user_id FROM test_users WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type IN {PO})), fl AS (SELECT user_id FROM si JOIN cu USING (user_id) GROUP BY 1 HAVING COUNT(*)=10)
SELECT user_id, item_id, rank, 'session' AS origin FROM si JOIN fl USING (user_id) UNION ALL SELECT user_id, item_id, r, 'cold' FROM cu, p10 WHERE user_id NOT IN (SELECT user_id FROM fl)""")
def _(s):
    cold = s.test_users.join(s.ev.filter(is_positive()).select("user_id"), "user_id", "left_anti")
    return R.cold_session_lists(session_lists(s), cold, popular(s))


MG = f"""{CVC}, {HC}, {PR}, {UP}, {UX}, {FC}, st AS (SELECT user_id, item_id, 'covis' AS source, score FROM cc UNION ALL SELECT user_id, item_id, 'als', score FROM hr UNION ALL SELECT user_id, item_id, 'fresh', score FROM fm),
nm AS (SELECT *, (score-MIN(score) OVER w)/(MAX(score) OVER w-MIN(score) OVER w+1e-10) AS norm FROM st WINDOW w AS (PARTITION BY user_id, source)), rp AS (SELECT user_id, item_id, pos_count::DOUBLE AS repeat_count FROM pr WHERE pos_count>1),
al AS (SELECT user_id, item_id, source, score, norm, 0.0E0 AS rc FROM nm UNION ALL SELECT user_id, item_id, 'repeat', NULL, NULL, repeat_count FROM rp),
wd AS (SELECT user_id, item_id, coalesce(MAX(norm) FILTER (source='covis'),0) AS covis_norm, coalesce(MAX(norm) FILTER (source='als'),0) AS als_norm, coalesce(MAX(norm) FILTER (source='fresh'),0) AS fresh_norm, MAX(rc) AS repeat_count, MAX((source='repeat')::INT) AS is_repeat, COUNT(*) AS source_count FROM al GROUP BY 1,2),
bl AS (SELECT *, 0.25*covis_norm+0.35*als_norm+0.15*fresh_norm+0.10*is_repeat AS blend_score FROM wd), mc AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(blend_score,9) DESC, item_id)::INT AS cand_rank FROM bl QUALIFY cand_rank<=500)"""
MGC = ["user_id", "item_id", "covis_norm", "als_norm", "fresh_norm", "repeat_count", "is_repeat", "source_count", "blend_score", "cand_rank"]


def merged(s):
    """History stands in the matrix-factorization slot, so that the whole merge has an exact SQL form."""
    s = written(s)
    pairs = durable(T.user_item_positive(s.ev), "pairs")
    repeats = pairs.filter("pos_count > 1").select("user_id", "item_id", F.col("pos_count").alias("repeat_count"))
    fresh = R.fresh_content_candidates(durable(preferences(s, pairs), "preferences"), fresh_items(s))
    # Every retriever is a stage of its own: its list is written once and read by the merge.
    sources = {name: durable(df.select("user_id", "item_id", "score"), name) for name, df in
               (("covis", covisited(s)), ("als", history(s)), ("fresh", fresh))}
    return R.merge_candidates(sources, repeats)


@query("merge_candidates", "ev dim", f"WITH {MG} SELECT {', '.join(f'round({c},6) AS {c}' if c.endswith(('norm', 'score')) else c for c in MGC)} FROM mc")
def _(s):
    return merged(s).select(*MGC)


@query("merge_sources_long", "ev dim", f"""WITH {CVC}, {HC}, w AS (SELECT coalesce(cc.user_id,hr.user_id) AS user_id, coalesce(cc.item_id,hr.item_id) AS item_id, cc.score AS src_covis, hr.score AS src_history FROM cc FULL JOIN hr ON cc.user_id=hr.user_id AND cc.item_id=hr.item_id)
SELECT user_id, item_id, round(src_covis,6) AS src_covis, round(src_history,6) AS src_history, round(coalesce(src_covis,0)+coalesce(src_history,0),6) AS total, row_number() OVER (PARTITION BY user_id ORDER BY round(coalesce(src_covis,0)+coalesce(src_history,0),9) DESC, item_id)::INT AS rank FROM w QUALIFY rank<=40""")
def _(s):
    return R.merge_sources_long({"covis": covisited(s), "history": history(s)}, 40)


@query("drop_purchased", "ev dim inter", f"WITH {HC} SELECT user_id, item_id, rank FROM hr WHERE NOT EXISTS (SELECT 1 FROM inter WHERE purchased AND inter.user_id=hr.user_id AND inter.item_id=hr.item_id)")
def _(s):
    return R.drop_purchased(history(s), s.inter).select("user_id", "item_id", "rank")


@query("cold_fill", "ev dim test_users", f"""WITH {HC}, {POP10} SELECT user_id, item_id, rank, 'retrieved' AS origin FROM hr UNION ALL SELECT user_id, item_id, r, 'pool' FROM test_users, p10 WHERE user_id NOT IN (SELECT user_id FROM hr)""")
def _(s):
    return R.cold_fill(history(s), s.test_users, popular(s))


@query("modal_profile_fill", "ev test_users", f"""WITH {PR}, {UP} SELECT user_id, coalesce(pref_category,(SELECT pref_category FROM up GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS pref_category, coalesce(pref_city,(SELECT pref_city FROM up GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS pref_city FROM test_users LEFT JOIN up USING (user_id)""")
def _(s):
    return R.modal_profile_fill(T.user_profile(T.user_item_positive(s.ev), END), s.test_users, ["pref_category", "pref_city"])




def item_cf(s, k=100):
    """Unseen items nearest to the test users' vectors."""
    pairs = T.user_item_positive(s.ev).select("user_id", "item_id", "pos_count")
    return R.item_embedding_cf(R.user_vectors(pairs, s.vectors), s.vectors, pairs, k=k, targets=s.test_users)


def retrieved(s, k=100):
    """The lists of every retriever for the test users, each written once: factors, co-visits, vectors, fresh content."""
    users = s.test_users
    fresh = R.fresh_content_candidates(durable(preferences(s).join(users, "user_id", "left_semi"), "preferences"), fresh_items(s))
    lists = {"als": als_scores(s, k), "covis": covisited(s).join(users, "user_id", "left_semi"), "itemcf": item_cf(s, k), "fresh": fresh}
    return {name: durable(df.select("user_id", "item_id", "score"), name) for name, df in lists.items()}


def merged_for_test_users(s, sources, cap=500):
    repeats = T.user_item_positive(s.ev).join(s.test_users, "user_id", "left_semi").filter("pos_count > 1").select("user_id", "item_id", F.col("pos_count").alias("repeat_count"))
    return R.merge_candidates(sources, repeats, cap=cap)


@query("merge_retrievers")
def _(s):
    """The merge over what the retrievers themselves find (factors have no SQL form; tested against brute force)."""
    s = written(s)
    norms = [f"{n}_norm" for n in ("als", "covis", "itemcf", "fresh")]
    return merged_for_test_users(s, retrieved(s)).select("user_id", "item_id", *norms, "repeat_count", "is_repeat", "source_count", "blend_score", "cand_rank")


@query("item_embedding_cf_indexed")
def _(s):
    """Item CF through the codes of the index instead of every reachable cell (tested by its recall)."""
    pairs = T.user_item_positive(s.ev).select("user_id", "item_id", "pos_count")
    return R.item_embedding_cf(R.user_vectors(pairs, s.vectors), s.vectors, pairs, k=20, exact=False, probes=18, keep=200)
