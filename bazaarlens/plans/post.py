"""Post-processing, evaluation and marketplace-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_login, is_positive
from bazaarlens.operators import evaluate as V
from bazaarlens.operators import features as T
from bazaarlens.operators import post as P
from bazaarlens.operators import retrieve as R
from bazaarlens.plans.features import CUT, END, IQ, PR, UP
from bazaarlens.plans.ingest import FOLDS
from bazaarlens.plans.primitives import PO, TWO_LISTS, two_lists
from bazaarlens.plans.registry import query
from bazaarlens.plans.retrieve import CVC, HC, POP10, covisited, history, popular
from bazaarlens.sources.star import temporal_split, walk_forward_folds

ITEM_AGE = f"ia AS (SELECT item_id, seller_id, district_name, category, seller_type, GREATEST(DATE_DIFF('day',posted_date,DATE'{END}'),0)::INT AS age, {IQ} AS quality FROM dim)"


def aged(s):
    age = F.greatest(F.datediff(F.lit(END).cast("date"), "posted_date"), F.lit(0))
    return s.dim.withColumns({"age": age, "quality": T.item_quality_score(["private"], ["so_hong"])})


def lists(s):
    """Primary list: history; alternative list: co-visitation. Both top-10."""
    return history(s).filter("rank <= 10"), covisited(s).filter("rank <= 10")


TWO = f"{CVC}, {HC}, pl AS (SELECT user_id, item_id, rank, score FROM hr WHERE rank<=10), sl AS (SELECT user_id, item_id, rank, score FROM cc WHERE rank<=10)"


@query("blend_scores", "ev dim", f"""WITH {TWO}, n1 AS (SELECT user_id, item_id, (score-MIN(score) OVER w)/(MAX(score) OVER w-MIN(score) OVER w+1e-10) AS n FROM hr WINDOW w AS (PARTITION BY user_id)), h2 AS (SELECT hr.user_id, hr.item_id, x.c::DOUBLE AS s FROM hr LEFT JOIN (SELECT user_id, item_id, COUNT(*) AS c FROM ev GROUP BY 1,2) x USING (user_id, item_id)),
n2 AS (SELECT user_id, item_id, (s-MIN(s) OVER w)/(MAX(s) OVER w-MIN(s) OVER w+1e-10) AS n FROM h2 WINDOW w AS (PARTITION BY user_id)) SELECT user_id, item_id, round(0.6*n1.n+0.4*coalesce(n2.n,0),6) AS score FROM n1 JOIN n2 USING (user_id, item_id)""")
def _(s):
    counts = s.ev.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("score"))
    return P.blend_scores(history(s).select("user_id", "item_id", "score"), {"count": counts}, {"base": 0.6, "count": 0.4})


@query("freshness_boost", "ev dim", f"""WITH {HC}, {ITEM_AGE}, g AS (SELECT (MAX(score)-MIN(score))*0.015 AS b FROM hr) SELECT user_id, item_id, round(score+CASE WHEN age<=20 THEN b ELSE 0 END,6) AS score FROM hr LEFT JOIN ia USING (item_id), g""")
def _(s):
    return P.freshness_boost(history(s).select("user_id", "item_id", "score"), aged(s), max_age=20).select("user_id", "item_id", "score")


@query("fresh_multiplier_guarded", "ev dim", f"""WITH {HC}, {ITEM_AGE}, m AS (SELECT hr.user_id, hr.item_id, score, score*CASE WHEN coalesce(age,999)<1 AND coalesce(quality,0)>0.7 THEN 1.5 WHEN coalesce(age,999)<3 AND coalesce(quality,0)>0.6 THEN 1.25 WHEN coalesce(age,999)<7 THEN 1.0+0.1*(7-age)/7 ELSE 1.0 END AS ms FROM hr LEFT JOIN ia USING (item_id)),
a AS (SELECT user_id, item_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score,9) DESC, item_id)<=10), b AS (SELECT user_id, item_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(ms,9) DESC, item_id)<=10), o AS (SELECT AVG(n) AS o FROM (SELECT COUNT(*) AS n FROM a JOIN b USING (user_id,item_id) GROUP BY user_id))
SELECT user_id, item_id, round(CASE WHEN o>=7 THEN ms ELSE score END,6) AS score, round(o,6) AS mean_overlap FROM m, o""")
def _(s):
    return P.fresh_multiplier_guarded(history(s).select("user_id", "item_id", "score"), aged(s)).select("user_id", "item_id", "score", "mean_overlap")


@query("category_boost", "ev dim", f"""WITH {HC}, {PR}, {UP}, g AS (SELECT (MAX(score)-MIN(score))*0.006 AS b FROM hr) SELECT hr.user_id, hr.item_id, round(score+CASE WHEN d.category=pref_category THEN b ELSE 0 END,6) AS score FROM hr LEFT JOIN dim d USING (item_id) LEFT JOIN up ON up.user_id=hr.user_id, g""")
def _(s):
    return P.category_boost(history(s).select("user_id", "item_id", "score"), T.user_profile(T.user_item_positive(s.ev), END), s.dim)


FILL = "fl AS (SELECT user_id, item_id, MIN(o) AS o FROM (SELECT user_id, item_id, rank AS o FROM {src} UNION ALL SELECT user_id, item_id, 1000+r FROM test_users, p10) GROUP BY 1,2), fk AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY o, item_id)::INT AS rank FROM fl QUALIFY rank<=10)"


def filled(s):
    primary, _ = lists(s)
    return P.fill_to_k(primary.join(s.test_users, "user_id", "left_semi"), s.test_users, popular(s))


FK = f"{TWO}, {POP10}, {FILL.format(src='(SELECT * FROM pl WHERE user_id IN (SELECT user_id FROM test_users))')}"


@query("fill_to_k", "ev dim test_users", f"WITH {FK} SELECT user_id, item_id, rank FROM fk")
def _(s):
    return filled(s)


def cold_users(s):
    return s.test_users.join(s.ev.filter(is_positive()).select("user_id"), "user_id", "left_anti")


COLD = f"cold AS (SELECT user_id FROM test_users WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type IN {PO}))"


@query("cold_override", "ev dim test_users", f"""WITH {FK}, {COLD} SELECT user_id, item_id, rank FROM fk WHERE user_id NOT IN (SELECT user_id FROM cold) UNION ALL SELECT user_id, item_id, r FROM cold, p10""")
def _(s):
    return P.cold_override(filled(s), cold_users(s), popular(s))


@query("cold_override_cvr", "ev test_users", f"""WITH {COLD}, w AS (SELECT item_id, COUNT(*) FILTER (event_type IN {PO}) AS p, COUNT(*) AS e FROM ev GROUP BY 1), t AS (SELECT item_id, row_number() OVER (ORDER BY round(p*(p::DOUBLE/GREATEST(e,1)),9) DESC, item_id)::INT AS rank FROM w QUALIFY rank<=10) SELECT user_id, item_id, rank FROM cold, t""")
def _(s):
    pop = T.item_quality_stats(s.ev, None).select("item_id", "pos_events", "total_events")
    scores = P.cvr_popularity(pop, "pos_events", "total_events")
    best = R.top_array(scores, [F.desc(F.round("cold_score", 9)), F.asc("item_id")], 10)
    empty = s.ev.limit(0).select("user_id", "item_id", F.lit(1).alias("rank"))
    return P.cold_override(empty, cold_users(s), best)


AGEP = f"""ab AS (SELECT item_id, (COUNT(*)*CASE WHEN category=1050 THEN CASE WHEN a<15 THEN 1.0 WHEN a<30 THEN 1.05 WHEN a<60 THEN 1.08 ELSE 1.1 END ELSE CASE WHEN a<=2 THEN 1.2 WHEN a<=7 THEN 1.1 WHEN a<=14 THEN 1.03 WHEN a<=29 THEN 1.0 ELSE 0.92 END END)::DOUBLE AS s
 FROM (SELECT ev.item_id, d.category, GREATEST(DATE_DIFF('day',posted_date,DATE'{END}'),0) AS a FROM ev JOIN dim d USING (item_id) WHERE event_type IN {PO}) GROUP BY item_id, category, a), agt AS (SELECT item_id, row_number() OVER (ORDER BY round(s,9) DESC, item_id)::INT AS r FROM ab QUALIFY r<=10)"""


def age_track(s):
    pop = s.ev.filter(is_positive()).groupBy("item_id").agg(F.count("*").alias("pos"))
    age = F.greatest(F.datediff(F.lit(END).cast("date"), "posted_date"), F.lit(0))
    boosts = s.dim.withColumn("days_since_posted", age).withColumn("age_boost", T.age_boost())
    return R.top_array(P.age_boost_popularity(pop, boosts, "pos"), [F.desc(F.round("cold_score", 9)), F.asc("item_id")], 10)


@query("cold_override_age_boost", "ev dim test_users", f"WITH {COLD}, {AGEP} SELECT user_id, item_id, r AS rank FROM cold, agt")
def _(s):
    empty = s.ev.limit(0).select("user_id", "item_id", F.lit(1).alias("rank"))
    return P.cold_override(empty, cold_users(s), age_track(s))


@query("cold_override_guarded", "ev dim test_users", f"""WITH {COLD}, {AGEP}, {POP10}, o AS (SELECT COUNT(*) AS o FROM agt JOIN p10 USING (item_id)), mx AS (SELECT item_id, MIN(o) AS k FROM (SELECT item_id, r*2 AS o FROM agt UNION ALL SELECT item_id, r*2+1 FROM p10) GROUP BY 1), mr AS (SELECT item_id, row_number() OVER (ORDER BY k)::INT AS r FROM mx QUALIFY r<=10),
ch AS (SELECT item_id, r FROM agt, o WHERE o>=7 UNION ALL SELECT item_id, r FROM mr, o WHERE o BETWEEN 4 AND 6 UNION ALL SELECT item_id, r FROM p10, o WHERE o<4) SELECT user_id, item_id, r AS rank FROM cold, ch""")
def _(s):
    empty = s.ev.limit(0).select("user_id", "item_id", F.lit(1).alias("rank"))
    return P.cold_override(empty, cold_users(s), P.guarded_cold_list(age_track(s), popular(s)))


@query("diversity_cap", "ev dim", f"""WITH RECURSIVE_ {HC}, {ITEM_AGE}, ds AS (SELECT hr.user_id, hr.item_id, ia.seller_id AS s, ia.district_name AS d, hr.score+CASE WHEN age<=7 THEN 0.05 ELSE 0 END AS sc FROM hr LEFT JOIN ia USING (item_id)),
dl AS (SELECT user_id, list({{'i':item_id,'s':s,'d':d,'sc':sc}} ORDER BY round(sc,9) DESC, item_id) AS a FROM ds GROUP BY 1),
rc AS (SELECT user_id, a, 1 AS p, a[1:0] AS picked FROM dl UNION ALL SELECT user_id, a, p+1, CASE WHEN len(picked)>=10 OR len(list_filter(picked, lambda x: x.s=a[p].s))>=2 OR len(list_filter(picked, lambda x: x.d=a[p].d))>=2 THEN picked ELSE list_append(picked, a[p]) END FROM rc WHERE p<=len(a)),
fn AS (SELECT user_id, list_concat(picked, list_filter(a, lambda x: NOT list_contains(list_transform(picked, lambda y: y.i), x.i)))[1:10] AS f FROM rc WHERE p=len(a)+1), ex AS (SELECT user_id, unnest(f) AS x, unnest(range(1,len(f)+1)) AS rank FROM fn)
SELECT user_id, x.i AS item_id, rank::INT AS rank, round(x.sc,6) AS score FROM ex""")
def _(s):
    return P.diversity_cap(history(s), aged(s), max_seller=2, max_district=2)


@query("seller_cap_defer", "ev dim", f"""WITH {HC}, j AS (SELECT hr.user_id, hr.item_id, hr.rank AS o, seller_id, row_number() OVER (PARTITION BY hr.user_id, seller_id ORDER BY hr.rank) AS n FROM hr LEFT JOIN dim USING (item_id) WHERE hr.rank<=20)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY (seller_id IS NOT NULL AND n>1)::INT, o)::INT AS rank FROM j QUALIFY rank<=10""")
def _(s):
    return P.seller_cap_defer(history(s).filter("rank <= 20"), s.dim, 1)


TL = f"{TWO_LISTS}, po AS (SELECT user_id, item_id, MIN(rp) AS rank_p, MIN(ra) AS rank_a FROM (SELECT user_id, item_id, rank AS rp, NULL AS ra FROM a UNION ALL SELECT user_id, item_id, NULL, rank FROM b) GROUP BY 1,2)"


@query("rrf_ensemble", "ev", f"""WITH {TL}, sc AS (SELECT *, coalesce(1.0E0/(60+rank_p),0)+coalesce(0.95E0/(60+rank_a),0)+0.12*(rank_p IS NOT NULL AND rank_a IS NOT NULL)::INT AS s FROM po)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s,9) DESC, coalesce(rank_p,99), coalesce(rank_a,99), item_id)::INT AS rank, round(s::DOUBLE,6) AS score FROM sc QUALIFY rank<=10""")
def _(s):
    return P.rrf_ensemble(*two_lists(s))


HSC = f"""hx AS (SELECT user_id, item_id, SUM(x) AS hist_raw, MAX(date) AS last_touch FROM (SELECT user_id, item_id, (8.0*lead_count+3.0*chat_message_count+0.15*adview_count)*exp(-ln(2)*DATE_DIFF('day',date,DATE'{END}')/21.0) AS x, date FROM inter
 UNION ALL SELECT user_id, item_id, CASE event_type WHEN 'view_phone' THEN 10.0E0 WHEN 'contact_chat' THEN 9 WHEN 'contact_zalo' THEN 9 WHEN 'contact_sms' THEN 8 ELSE 2.5 END*exp(-ln(2)*DATE_DIFF('day',date,DATE'{END}')/21.0), date FROM ev WHERE is_login='login' AND event_type IN {PO}) GROUP BY 1,2 HAVING SUM(x)>0),
hs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(hist_raw,9) DESC, last_touch DESC, item_id)::INT AS hist_rank FROM hx)"""


def past(s):
    return P.history_score(s.inter, s.ev, END)


@query("history_score", "ev inter", f"WITH {HSC} SELECT user_id, item_id, round(hist_raw,6) AS hist_raw, last_touch::VARCHAR AS last_touch, hist_rank FROM hs")
def _(s):
    return past(s)


@query("rerank_within_list", "ev inter", f"""WITH {TWO_LISTS}, {HSC}, pk AS (SELECT user_id, MAX(hist_raw) AS peak FROM hs GROUP BY 1), j AS (SELECT a.*, 1.0/rank+0.08*CASE WHEN peak>0 THEN coalesce(hist_raw,0)/peak ELSE 0 END AS s FROM a LEFT JOIN hs USING (user_id,item_id) LEFT JOIN pk USING (user_id))
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s,9) DESC, j.rank, item_id)::INT AS rank FROM j""")
def _(s):
    return P.rerank_within_list(two_lists(s)[0], past(s))


@query("rrf_with_history", "ev inter", f"""WITH {TWO_LISTS}, {HSC}, pk AS (SELECT user_id, MAX(hist_raw) AS peak FROM hs GROUP BY 1), h AS (SELECT user_id, item_id, hist_raw, 1.35E0/(60+hist_rank)+1.15*hist_raw/(peak+1e-9) AS h FROM hs JOIN pk USING (user_id)),
j AS (SELECT coalesce(a.user_id,h.user_id) AS user_id, coalesce(a.item_id,h.item_id) AS item_id, coalesce(1.0/(60+rank),0)+coalesce(h,0) AS s, coalesce(hist_raw,0) AS hr FROM a FULL JOIN h ON a.user_id=h.user_id AND a.item_id=h.item_id)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s,9) DESC, round(hr,9) DESC, item_id)::INT AS rank FROM j QUALIFY rank<=10""")
def _(s):
    return P.rrf_with_history(two_lists(s)[0], past(s))


PRUNE = f"""pg AS (SELECT item_id FROM dim WHERE ad_status='refused' OR coalesce(expected_expired_date<DATE'2024-01-01',false)), pu AS (SELECT DISTINCT user_id, item_id FROM inter WHERE purchased), wu AS (SELECT DISTINCT user_id FROM ev WHERE event_type IN {PO})"""


def pruning(s):
    """Pruned listings, purchased pairs, and users with any positive event."""
    warm = s.ev.filter(is_positive()).select("user_id").distinct()
    return P.prune_list(s.dim, "2024-01-01"), s.inter.filter("purchased").select("user_id", "item_id").distinct(), warm


@query("tiered_cold_list", "ev dim inter", f"""WITH {TL}, {PRUNE}, cu AS (SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT user_id FROM wu)), uc AS (SELECT user_id, city_name FROM (SELECT user_id, city_name, COUNT(*) AS n FROM ev WHERE is_login='login' AND city_name IS NOT NULL GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, city_name)=1),
cp AS (SELECT city_name, item_id, row_number() OVER (PARTITION BY city_name ORDER BY COUNT(*) DESC, item_id) AS cr FROM ev WHERE event_type IN {PO} AND item_id NOT IN (SELECT item_id FROM pg) GROUP BY 1,2 QUALIFY cr<=15),
al AS (SELECT user_id, item_id, CASE WHEN rank_a IS NOT NULL THEN 1 ELSE 2 END AS t, 1.0E0/(60+rank_p) AS f, rank_p AS r FROM po WHERE rank_p IS NOT NULL AND user_id IN (SELECT user_id FROM cu) UNION ALL SELECT user_id, item_id, 3, 1.0E0/(3+cr), cr FROM cu JOIN uc USING (user_id) JOIN cp USING (city_name)),
de AS (SELECT user_id, item_id, MIN(t) AS t, MAX(f) AS f, MIN(r) AS r FROM al WHERE item_id NOT IN (SELECT item_id FROM pg) AND (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM pu) GROUP BY 1,2)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY t, f DESC, r, item_id)::INT AS rank FROM de QUALIFY rank<=10""")
def _(s):
    prune, purchased, warm = pruning(s)
    users = s.ev.select("user_id").distinct().join(warm, "user_id", "left_anti")
    return P.tiered_cold_list(users, *two_lists(s), P.user_main_city(s.ev), P.city_popularity(s.ev, prune), prune, purchased)


@query("warm_prune", "ev dim inter", f"""WITH {TL}, {PRUNE}, ow AS (SELECT * FROM a WHERE user_id IN (SELECT user_id FROM wu)), ok AS (SELECT user_id, item_id, rank FROM ow WHERE item_id NOT IN (SELECT item_id FROM pg) AND (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM pu)),
u AS (SELECT user_id, item_id, rank AS o FROM ok UNION ALL SELECT user_id, item_id, 2000+rank FROM ow), d AS (SELECT user_id, item_id, MIN(o) AS o FROM u GROUP BY 1,2) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY o, item_id)::INT AS rank FROM d QUALIFY rank<=10""")
def _(s):
    prune, purchased, warm = pruning(s)
    return P.warm_prune(warm, *two_lists(s), prune, purchased)


@query("capped_blend", "ev", f"""WITH {TL}, t AS (SELECT *, CASE WHEN rank_p IS NOT NULL AND rank_a IS NOT NULL THEN 1 WHEN rank_p IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(1.0E0/(60+rank_p),0) AS p, coalesce(1.0E0/(60+rank_a),0) AS q FROM po),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY round(CASE WHEN tier=1 THEN p+q ELSE 0 END,9) DESC, p DESC, q DESC, rank_p NULLS FIRST, rank_a NULLS FIRST, item_id) AS rn FROM t) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY tier, rn)::INT AS rank FROM n WHERE tier<3 OR rn<=2 QUALIFY rank<=10""")
def _(s):
    return P.capped_blend(*two_lists(s))


@query("validate_ranked_list", "ev dim test_users", f"""WITH {TWO_LISTS}, u AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT rank) AS r, MIN(rank) AS lo, MAX(rank) AS hi, COUNT(DISTINCT item_id) AS i FROM b GROUP BY 1), w AS (SELECT unnest([{{'c':'row_count','v':COUNT(*) FILTER (n<>10)}},{{'c':'rank_range','v':COUNT(*) FILTER (lo<1 OR hi>10)}},{{'c':'rank_unique','v':COUNT(*) FILTER (r<>n)}},{{'c':'item_unique','v':COUNT(*) FILTER (i<>n)}},
 {{'c':'invalid_items','v':(SELECT COUNT(*) FROM b WHERE item_id NOT IN (SELECT item_id FROM dim WHERE category<>3030))}},{{'c':'missing_users','v':(SELECT COUNT(*) FROM test_users WHERE user_id NOT IN (SELECT user_id FROM b))}},{{'c':'unknown_users','v':(SELECT COUNT(DISTINCT user_id) FROM b WHERE user_id NOT IN (SELECT user_id FROM test_users))}}]) AS p FROM u)
SELECT p.c AS "check", p.v AS violations, p.v=0 AS ok FROM w""")
def _(s):
    return P.validate_ranked_list(two_lists(s)[1], s.test_users, s.dim.filter("category <> 3030"))


# ---- evaluation ---------------------------------------------------------------------------------

SPLIT = f"""vt AS (SELECT DISTINCT user_id, item_id FROM ev WHERE event_type IN {PO} AND date BETWEEN DATE'{CUT}' AND DATE'{END}' AND user_id IN (SELECT user_id FROM ev WHERE event_type IN {PO} AND date<DATE'{CUT}')),
tl AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, item_id)::INT AS rank, COUNT(*)::DOUBLE AS score FROM ev WHERE event_type IN {PO} AND date<DATE'{CUT}' GROUP BY 1,2 QUALIFY rank<=20),
hh AS (SELECT user_id, COUNT(*) AS h, SUM(1.0/log2(rank+1)) AS dcg FROM tl JOIN vt USING (user_id,item_id) WHERE rank<=10 GROUP BY 1), nn AS (SELECT user_id, COUNT(*) AS n FROM vt GROUP BY 1),
um AS (SELECT user_id, n, coalesce(h,0) AS h, coalesce(h,0)::DOUBLE/n AS recall, coalesce(dcg,0)/list_sum(list_transform(range(1,LEAST(n,10)+1), lambda i: 1.0/log2(i+1))) AS ndcg FROM nn LEFT JOIN hh USING (user_id))"""


def split(s):
    """Lists from before the split (most repeated items) and the truth after it."""
    parts = temporal_split(s.ev.filter(is_positive()), CUT, END)
    counts = parts["train"].groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("score"))
    return V.top_ranked(counts, 20), parts["truth"]


@query("user_metrics", "ev", f"WITH {SPLIT} SELECT user_id, n AS n_truth, h AS hits, round(recall,6) AS recall_at_10, round(ndcg,6) AS ndcg_at_10 FROM um")
def _(s):
    return V.user_metrics(*split(s))


@query("recall_at_k", "ev", f"WITH {SPLIT} SELECT COUNT(*) AS users, round(AVG(recall),6) AS recall FROM um")
def _(s):
    return V.recall_at_k(*split(s))


@query("ndcg_at_k", "ev", f"WITH {SPLIT} SELECT COUNT(*) AS users, round(AVG(ndcg),6) AS ndcg FROM um")
def _(s):
    return V.ndcg_at_k(*split(s))


@query("offline_validation", "ev", f"WITH {SPLIT} SELECT COUNT(*) AS users, round(AVG(recall),6) AS recall, round(AVG(ndcg),6) AS ndcg, round(100.0*AVG((recall>0)::INT),6) AS hit_users_pct, round(quantile_cont(recall,0.5),6) AS recall_p50, round(quantile_cont(recall,0.75),6) AS recall_p75, round(quantile_cont(recall,0.9),6) AS recall_p90 FROM um")
def _(s):
    return V.offline_validation(*split(s))


@query("candidate_recall_ceiling", "ev", f"WITH {SPLIT}, c AS (SELECT user_id, COUNT(*) AS h FROM tl JOIN vt USING (user_id,item_id) GROUP BY 1) SELECT COUNT(*) AS users, round(AVG(coalesce(h,0)::DOUBLE/n),6) AS recall_ceiling FROM nn LEFT JOIN c USING (user_id)")
def _(s):
    return V.candidate_recall_ceiling(*split(s), k=500)


FOLD = f"""fd(fold,te,vs,ve) AS (VALUES (1,DATE'2024-01-09',DATE'2024-01-10',DATE'2024-01-15'),(2,DATE'2024-01-15',DATE'2024-01-16',DATE'2024-01-22'),(3,DATE'2024-01-22',DATE'2024-01-23',DATE'2024-01-30')), fe AS (SELECT fold, CASE WHEN date<=te THEN 't' ELSE 'v' END AS part, user_id, item_id FROM ev, fd WHERE event_type IN {PO} AND (date<=te OR date BETWEEN vs AND ve)),
ft AS (SELECT DISTINCT fold, user_id, item_id FROM fe WHERE part='v' AND (fold,user_id) IN (SELECT (fold,user_id) FROM fe WHERE part='t')), fr AS (SELECT fold, user_id, item_id, row_number() OVER (PARTITION BY fold, user_id ORDER BY COUNT(*) DESC, item_id) AS rank FROM fe WHERE part='t' GROUP BY 1,2,3 QUALIFY rank<=10),
fh AS (SELECT fold, user_id, COUNT(*) AS h, SUM(1.0/log2(rank+1)) AS dcg FROM fr JOIN ft USING (fold,user_id,item_id) GROUP BY 1,2), fn AS (SELECT fold, user_id, COUNT(*) AS n FROM ft GROUP BY 1,2),
fm AS (SELECT fold::INT AS fold, COUNT(*) AS users, AVG(coalesce(h,0)::DOUBLE/n) AS recall, AVG(coalesce(dcg,0)/list_sum(list_transform(range(1,LEAST(n,10)+1), lambda i: 1.0/log2(i+1)))) AS ndcg FROM fn LEFT JOIN fh USING (fold,user_id) GROUP BY 1)"""


def folds(s):
    tagged = walk_forward_folds(s.ev.filter(is_positive()).select("user_id", "item_id", "date"), FOLDS)
    train, valid = tagged.filter("part = 'train'"), tagged.filter("part = 'valid'")
    truth = valid.join(train.select("fold", "user_id"), ["fold", "user_id"], "left_semi")
    counts = train.groupBy("fold", "user_id", "item_id").agg(F.count("*").alias("n"))
    from bazaarlens.operators.core import top_n
    return V.fold_metrics(top_n(counts, ["fold", "user_id"], [F.desc("n"), F.asc("item_id")], 10), truth)


@query("fold_metrics", "ev", f"WITH {FOLD} SELECT fold, users, round(recall,6) AS recall, round(ndcg,6) AS ndcg FROM fm")
def _(s):
    return folds(s)


@query("walk_forward_report", "ev", f"WITH {FOLD} SELECT fold::VARCHAR AS fold, round(recall,6) AS recall, round(ndcg,6) AS ndcg FROM fm UNION ALL SELECT 'mean', round(AVG(recall),6), round(AVG(ndcg),6) FROM fm UNION ALL SELECT 'std', round(stddev_pop(recall),6), round(stddev_pop(ndcg),6) FROM fm")
def _(s):
    return V.walk_forward_report(folds(s))


@query("popularity_baseline", "ev", f"""WITH {SPLIT}, pp AS (SELECT item_id, row_number() OVER (ORDER BY COUNT(*) DESC, item_id) AS rank FROM ev WHERE event_type IN {PO} AND date<DATE'{CUT}' GROUP BY 1 QUALIFY rank<=10)
SELECT user_id, nn.n AS n_truth, (SELECT COUNT(*) FROM vt JOIN pp USING (item_id) WHERE vt.user_id=nn.user_id) AS hits, round((SELECT COUNT(*) FROM vt JOIN pp USING (item_id) WHERE vt.user_id=nn.user_id)::DOUBLE/nn.n,6) AS recall_at_10,
 round(coalesce((SELECT SUM(1.0/log2(rank+1)) FROM vt JOIN pp USING (item_id) WHERE vt.user_id=nn.user_id),0)/list_sum(list_transform(range(1,LEAST(nn.n,10)+1), lambda i: 1.0/log2(i+1))),6) AS ndcg_at_10 FROM nn""")
def _(s):
    parts = temporal_split(s.ev.filter(is_positive()), CUT, END)
    pop = parts["train"].groupBy("item_id").agg(F.count("*").alias("pos"))
    ranked = V.popular_list(pop, parts["users"], [F.desc("pos"), F.asc("item_id")])
    return V.user_metrics(ranked, parts["truth"])


CMP = f"""{TWO_LISTS}, pa AS (SELECT user_id, item_id, MIN(ra) AS ra, MIN(rb) AS rb FROM (SELECT user_id, item_id, rank AS ra, NULL AS rb FROM a UNION ALL SELECT user_id, item_id, NULL, rank FROM b) GROUP BY 1,2),
sh AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ra) AS xa, row_number() OVER (PARTITION BY user_id ORDER BY rb) AS xb FROM pa WHERE ra IS NOT NULL AND rb IS NOT NULL), cr AS (SELECT user_id, CASE WHEN COUNT(*)>=2 THEN corr(xa,xb) END AS rho FROM sh GROUP BY 1),
us AS (SELECT user_id, COUNT(ra) AS na, COUNT(rb) AS nb, COUNT(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS overlap, COUNT(*) FILTER (ra<=5 AND rb<=5) AS overlap_5, COUNT(*) FILTER (ra=1 AND rb=1) AS top1_same, COUNT(*) FILTER (ra=rb) AS ss, COUNT(*) AS un FROM pa GROUP BY 1 HAVING COUNT(ra)>0 AND COUNT(rb)>0),
ps AS (SELECT us.user_id, overlap, overlap_5, top1_same, overlap::DOUBLE/un AS jaccard, (ss=na AND na=nb)::INT AS identical, rho AS spearman FROM us LEFT JOIN cr USING (user_id))"""


@query("shared_stats", "ev", f"WITH {CMP} SELECT user_id, overlap, overlap_5, top1_same, round(jaccard,6) AS jaccard, identical, round(spearman,6) AS spearman FROM ps")
def _(s):
    return V.shared_stats(*two_lists(s)).withColumn("overlap", F.col("overlap").cast("long"))


@query("compare_lists", "ev", f"""WITH {CMP}, w AS (SELECT DISTINCT user_id FROM ev WHERE is_login='login' AND event_type IN {PO}), g AS (SELECT ps.*, 'all' AS grp FROM ps UNION ALL SELECT ps.*, CASE WHEN user_id IN (SELECT user_id FROM w) THEN 'warm' ELSE 'cold' END FROM ps)
SELECT grp, COUNT(*) AS users, round(AVG(jaccard),6) AS jaccard, round(AVG(overlap),6) AS overlap, round(AVG(overlap_5),6) AS overlap_5, round(100.0*AVG(top1_same),6) AS top1_same_pct, round(100.0*AVG(identical),6) AS identical_pct, round(AVG(spearman),6) AS spearman FROM g GROUP BY 1""")
def _(s):
    warm = s.ev.filter(is_login() & is_positive())
    return V.compare_lists(*two_lists(s), warm)


@query("overlap_histogram", "ev", f"WITH {CMP} SELECT overlap, COUNT(*) AS users, round(100.0*COUNT(*)/SUM(COUNT(*)) OVER (),6) AS pct FROM ps GROUP BY 1")
def _(s):
    return V.overlap_histogram(*two_lists(s))


@query("list_diff_report", "ev", f"""WITH {TWO_LISTS}, sl AS (SELECT user_id, a.rank, a.item_id AS ia, b.item_id AS ib FROM a JOIN b USING (user_id, rank)), m AS (SELECT *, ((user_id,ib) IN (SELECT (user_id,item_id) FROM a))::INT AS ba, ((user_id,ia) IN (SELECT (user_id,item_id) FROM b))::INT AS ab FROM sl)
SELECT 'positional_match' AS section, rank::INT AS rank, round(AVG((ia=ib)::INT),6) AS value FROM m GROUP BY rank UNION ALL SELECT 'new_at_rank', rank::INT, round(AVG(1-ba),6) FROM m GROUP BY rank
UNION ALL SELECT 'removed', rank::INT, COUNT(*)::DOUBLE FROM a WHERE (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM b) GROUP BY rank UNION ALL SELECT 'added', rank::INT, COUNT(*)::DOUBLE FROM b WHERE (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM a) GROUP BY rank
UNION ALL SELECT 'reorder', 0, (COUNT(*) FILTER (ia<>ib AND ba=1 AND ab=1))::DOUBLE FROM m UNION ALL SELECT 'injection', 0, (COUNT(*) FILTER (ia<>ib AND ba=0))::DOUBLE FROM m UNION ALL SELECT 'removal', 0, (COUNT(*) FILTER (ia<>ib AND ab=0))::DOUBLE FROM m""")
def _(s):
    return V.list_diff_report(*two_lists(s))


@query("slots_changed", "ev", f"""WITH {TWO_LISTS}, u AS (SELECT user_id, (SELECT COUNT(*) FROM a x WHERE x.user_id=q.user_id AND (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM b)) AS r, (SELECT COUNT(*) FROM b x WHERE x.user_id=q.user_id AND (user_id,item_id) NOT IN (SELECT (user_id,item_id) FROM a)) AS ad FROM (SELECT DISTINCT user_id FROM a) q)
SELECT COUNT(*) AS users, round(AVG(r),6) AS avg_removed, round(AVG(ad),6) AS avg_added FROM u""")
def _(s):
    return V.slots_changed(*two_lists(s))


@query("score_cohorts", "ev dim", f"""WITH {HC}, w AS (SELECT DISTINCT user_id FROM ev WHERE event_type IN {PO}), c AS (SELECT hr.*, CASE WHEN user_id IN (SELECT user_id FROM w) THEN 'warm' ELSE 'cold' END AS cohort FROM hr)
SELECT cohort, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users, round(AVG(score),6) AS mean, round(quantile_cont(score,0.25),6) AS p25, round(quantile_cont(score,0.5),6) AS p50, round(quantile_cont(score,0.75),6) AS p75, round(COUNT(*)::DOUBLE/COUNT(DISTINCT user_id),6) AS per_user FROM c GROUP BY 1""")
def _(s):
    return V.score_cohorts(history(s), s.ev.filter(is_positive()))


@query("score_by_rank", "ev dim", f"WITH {HC} SELECT rank, COUNT(*) AS n, round(AVG(score),6) AS mean, round(MIN(score),6) AS min, round(MAX(score),6) AS max FROM hr GROUP BY 1")
def _(s):
    return V.score_by_rank(history(s))


# ---- marketplace health -------------------------------------------------------------------------

COV = "cov AS (SELECT round(100.0*(SELECT COUNT(*) FROM dim WHERE item_id IN (SELECT item_id FROM fk))/(SELECT COUNT(*) FROM dim),6) AS item_coverage_pct, round(100.0*(SELECT COUNT(DISTINCT seller_id) FROM dim WHERE item_id IN (SELECT item_id FROM fk))/(SELECT COUNT(DISTINCT seller_id) FROM dim),6) AS seller_coverage_pct)"


@query("coverage", "ev dim test_users", f"WITH {FK}, {COV} SELECT * FROM cov")
def _(s):
    return V.coverage(filled(s), s.dim)


FRS = "frs AS (SELECT COUNT(*) AS slots, round(100.0*AVG(coalesce((age<=30)::INT,0)),6) AS freshness_pct FROM fk LEFT JOIN ia USING (item_id))"


@query("freshness_at_k", "ev dim test_users", f"WITH {FK}, {ITEM_AGE}, {FRS} SELECT * FROM frs")
def _(s):
    return V.freshness_at_k(filled(s), aged(s), max_age=30)


@query("exposure_vs_pool", "ev dim test_users", f"""WITH {FK}, {ITEM_AGE}, sl2 AS (SELECT item_id, COUNT(*) AS slots FROM fk GROUP BY 1), j AS (SELECT ia.*, slots, CASE WHEN age<=7 THEN '0-7d (fresh)' WHEN age<=30 THEN '8-30d' WHEN age<=90 THEN '31-90d' WHEN age<=365 THEN '91-365d' ELSE '>365d' END AS age_bucket FROM ia LEFT JOIN sl2 USING (item_id)),
l AS (SELECT slots, unnest([{{'d':'age_bucket','v':age_bucket}},{{'d':'category','v':category::VARCHAR}},{{'d':'seller_type','v':seller_type}}]) AS p FROM j), c AS (SELECT p.d AS dimension, p.v AS value, COUNT(*) AS listings, coalesce(SUM(slots),0)::BIGINT AS slots FROM l GROUP BY 1,2),
s AS (SELECT *, 100.0*listings/SUM(listings) OVER w AS pp, 100.0*slots/SUM(slots) OVER w AS ep FROM c WINDOW w AS (PARTITION BY dimension)) SELECT dimension, value, listings, slots, round(pp,6) AS pool_pct, round(ep,6) AS exposure_pct, round(ep/pp,6) AS exposure_ratio FROM s""")
def _(s):
    return V.exposure_vs_pool(filled(s), aged(s))


SE = "se AS (SELECT seller_id, COUNT(*) AS x FROM fk JOIN dim USING (item_id) GROUP BY 1), so AS (SELECT *, row_number() OVER (ORDER BY x) AS i, COUNT(*) OVER () AS n FROM se)"


@query("seller_exposure_inequality", "ev dim test_users", f"""WITH {FK}, {SE} SELECT COUNT(*) AS sellers, round(SUM((2*i-n-1)*x)::DOUBLE/(MAX(n)*SUM(x)),6) AS gini, round(100.0*SUM(CASE WHEN n-i+1<=GREATEST(1,ceil(n*0.1)) THEN x ELSE 0 END)/SUM(x),6) AS top10_pct, round(100.0*SUM(CASE WHEN i<=floor(n*0.5) THEN x ELSE 0 END)/SUM(x),6) AS bottom50_pct FROM so""")
def _(s):
    return V.seller_exposure_inequality(filled(s), s.dim)


@query("seller_lorenz", "ev dim test_users", f"""WITH {FK}, {SE}, h AS (SELECT x, COUNT(*) AS n FROM se GROUP BY 1) SELECT x AS exposure, round(100.0*SUM(n) OVER (ORDER BY x)/SUM(n) OVER (),6) AS cum_population_pct, round(100.0*SUM(n*x) OVER (ORDER BY x)/SUM(n*x) OVER (),6) AS cum_value_pct FROM h""")
def _(s):
    return V.seller_lorenz(filled(s), s.dim)


@query("item_exposure_hhi", "ev dim test_users", f"WITH {FK}, x AS (SELECT item_id, COUNT(*) AS x FROM fk GROUP BY 1) SELECT round(10000.0*SUM(x*x)/(SUM(x)*SUM(x)),6) AS item_hhi, 1000.0::DOUBLE AS popularity_hhi, round(10000.0/COUNT(*),6) AS uniform_hhi FROM x")
def _(s):
    return V.item_exposure_hhi(filled(s))


@query("personalization", "ev dim test_users", f"""WITH {FK}, u AS (SELECT user_id, COUNT(*) FILTER (item_id IN (SELECT item_id FROM p10)) AS o, COUNT(*) AS n FROM fk GROUP BY 1) SELECT COUNT(*) AS users, round(AVG(n-o),6) AS avg_personal, round(100.0*AVG((o=0)::INT),6) AS fully_personal_pct, round(100.0*AVG((o>=5)::INT),6) AS mostly_popular_pct FROM u""")
def _(s):
    return V.personalization(filled(s), popular(s))


@query("health_scorecard", "ev dim test_users", f"""WITH {FK}, {ITEM_AGE}, {COV}, {SE}, ct AS (SELECT COUNT(*)::DOUBLE/SUM(COUNT(*)) OVER () AS p FROM fk JOIN dim USING (item_id) GROUP BY category), x AS (SELECT item_id, COUNT(*) AS x FROM fk GROUP BY 1),
v AS (SELECT 'freshness_at_10' AS metric, (SELECT 100.0*AVG(coalesce((age<=7)::INT,0)) FROM fk LEFT JOIN ia USING (item_id)) AS value, 1.0 AS lo, 3.0 AS hi, 'higher' AS direction UNION ALL SELECT 'seller_coverage',(SELECT seller_coverage_pct FROM cov),5,15,'higher' UNION ALL SELECT 'item_coverage',(SELECT item_coverage_pct FROM cov),2,5,'higher'
 UNION ALL SELECT 'category_entropy',(SELECT -SUM(p*ln(p))/ln(COUNT(*)) FROM ct),0.7,0.9,'higher' UNION ALL SELECT 'seller_gini',(SELECT SUM((2*i-n-1)*x)::DOUBLE/(MAX(n)*SUM(x)) FROM so),0.85,0.95,'lower' UNION ALL SELECT 'item_hhi',(SELECT 10000.0*SUM(x*x)/(SUM(x)*SUM(x)) FROM x),200,1000,'lower')
SELECT metric, round(value,6) AS value, CASE WHEN direction='higher' THEN CASE WHEN value>=hi THEN 'good' WHEN value>=lo THEN 'warn' ELSE 'bad' END ELSE CASE WHEN value<=lo THEN 'good' WHEN value<=hi THEN 'warn' ELSE 'bad' END END AS verdict, direction FROM v""")
def _(s):
    return V.health_scorecard(filled(s), aged(s))
