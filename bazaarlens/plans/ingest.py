"""Source, sink, sampling and split queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive
from bazaarlens.plans.primitives import PO, TWO_LISTS, two_lists
from bazaarlens.plans.registry import query
from bazaarlens.schemas import DIM_LISTING, LISTING_SNAPSHOT, POSITIVE, POST_CONTACT, USER_EVENTS
from bazaarlens.session import shared_folder
from bazaarlens.sources import star as R

FOLDS = [
    {"train_end": "2024-01-09", "valid_start": "2024-01-10", "valid_end": "2024-01-15"},
    {"train_end": "2024-01-15", "valid_start": "2024-01-16", "valid_end": "2024-01-22"},
    {"train_end": "2024-01-22", "valid_start": "2024-01-23", "valid_end": "2024-01-30"},
]


def scratch(s, name: str) -> str:
    return f"{shared_folder(s.spark).rstrip('/')}/bazaarlens/{name}-{uuid.uuid4().hex}"


@query("read_star", "ev dim snap inter", """
SELECT 'dim_listing' AS name, COUNT(*) AS n, COUNT(expected_expired_date) AS filled FROM dim UNION ALL SELECT 'fact_user_events', COUNT(*), COUNT(query) FROM ev
UNION ALL SELECT 'fact_listing_snapshot', COUNT(*), COUNT(listing_age_days) FROM snap UNION ALL SELECT 'fact_post_contact_interactions', COUNT(*), COUNT(purchased) FROM inter""")
def _(s):
    parts = [
        ("dim_listing", R.conform(s.dim, DIM_LISTING), "expected_expired_date"), ("fact_user_events", R.conform(s.ev, USER_EVENTS), "query"),
        ("fact_listing_snapshot", R.conform(s.snap, LISTING_SNAPSHOT), "listing_age_days"),
        ("fact_post_contact_interactions", R.conform(s.inter, POST_CONTACT), "purchased"),
    ]
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n"), F.count(c).alias("filled")).select(F.lit(name).alias("name"), "n", "filled") for name, df, c in parts])


@query("filtered_scan", "ev", f"""
SELECT date::VARCHAR AS date, event_type, COUNT(*) AS n FROM ev WHERE date BETWEEN DATE'2024-01-10' AND DATE'2024-01-20' AND event_type IN {PO} GROUP BY ALL""")
def _(s):
    narrow = R.filtered_scan(s.ev, ["user_id", "item_id", "date", "event_type"], "date", "2024-01-10", "2024-01-20", POSITIVE)
    return narrow.groupBy("date", "event_type").agg(F.count("*").alias("n"))


@query("stage_write", "ev", "SELECT event_type, COUNT(*) AS n, 'written' AS first, 'kept' AS second FROM ev GROUP BY 1")
def _(s):
    path = scratch(s, "stage")
    _, first = R.stage_write(s.ev.select("user_id", "item_id", "event_type"), path)
    table, second = R.stage_write(s.ev.select("user_id", "item_id", "event_type"), path)
    return table.groupBy("event_type").agg(F.count("*").alias("n")).select("*", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("write_ranked_list_csv", "ev", f"""WITH {TWO_LISTS}
SELECT row_number() OVER (ORDER BY user_id, rank) AS "ID", user_id, rank, item_id FROM a""")
def _(s):
    return R.write_ranked_list_csv(two_lists(s)[0], scratch(s, "list"))


@query("read_ranked_list_csv", "ev", f"""WITH {TWO_LISTS}
SELECT rank, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items FROM a GROUP BY 1""")
def _(s):
    path = scratch(s, "list")
    two_lists(s)[0].write.csv(path, header=True)
    back = R.read_ranked_list_csv(s.spark, path)
    return back.groupBy("rank").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


@query("align_to_template", "ev", f"""WITH {TWO_LISTS}
SELECT user_id*100+rank AS "ID", user_id, rank, item_id FROM a""")
def _(s):
    predicted = two_lists(s)[0]
    template = predicted.select((F.col("user_id") * 100 + F.col("rank")).alias("ID"), "user_id", "rank")
    return R.align_to_template(predicted, template)


@query("block_sample")
def _(s):
    return R.block_sample(s.raw("events"), 20).groupBy("event_type").agg(F.count("*").alias("n"))


@query("row_sample")
def _(s):
    return R.row_sample(s.ev, 0.2).groupBy("event_type").agg(F.count("*").alias("n"))


@query("hash_sample", "ev", """
SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT session_id) AS sessions FROM ev
WHERE ((('0x'||substr(md5(session_id::VARCHAR),1,16))::UBIGINT::HUGEINT%1000)*616+(('0x'||substr(md5(session_id::VARCHAR),17,16))::UBIGINT::HUGEINT%1000))%1000<300 GROUP BY 1""")
def _(s):
    return R.hash_sample(s.ev, "session_id", 0.3).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("scale_up", "ev", """
WITH c AS (SELECT query, COUNT(*) AS n FROM ev WHERE query IS NOT NULL GROUP BY 1), e AS (SELECT query, n, round_even(n/0.1,0)::BIGINT AS estimate FROM c)
SELECT *, round(100.0*estimate/SUM(estimate) OVER (),6) AS share_pct FROM e""")
def _(s):
    counts = s.ev.filter("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("n"))
    return R.scale_up(counts, "n", 0.1)


@query("hash_split", "ev", """
WITH u AS (SELECT DISTINCT user_id FROM ev)
SELECT user_id, CASE WHEN ((('0x'||substr(md5(user_id::VARCHAR),1,16))::UBIGINT::HUGEINT%100)*16+(('0x'||substr(md5(user_id::VARCHAR),17,16))::UBIGINT::HUGEINT%100))%100<80 THEN 1 ELSE 0 END::INT AS is_train FROM u""")
def _(s):
    return R.hash_split(s.ev.select("user_id").distinct(), "user_id")


@query("stratified_sample", "dim", "SELECT category, LEAST(20, COUNT(*)) AS n FROM dim GROUP BY 1")
def _(s):
    return R.stratified_sample(s.dim, "category", 20).groupBy("category").agg(F.count("*").alias("n"))


@query("temporal_split", "ev", f"""
WITH p AS (SELECT * FROM ev WHERE event_type IN {PO}), t AS (SELECT * FROM p WHERE date<DATE'2024-01-20'), v AS (SELECT * FROM p WHERE date BETWEEN DATE'2024-01-20' AND DATE'2024-01-30')
SELECT DISTINCT user_id, item_id FROM v WHERE user_id IN (SELECT user_id FROM t)""")
def _(s):
    return R.temporal_split(s.ev.filter(is_positive()), "2024-01-20", "2024-01-30")["truth"]


@query("walk_forward_folds", "ev", f"""
WITH f(fold,te,vs,ve) AS (VALUES (1,DATE'2024-01-09',DATE'2024-01-10',DATE'2024-01-15'),(2,DATE'2024-01-15',DATE'2024-01-16',DATE'2024-01-22'),(3,DATE'2024-01-22',DATE'2024-01-23',DATE'2024-01-30'))
SELECT fold::INT AS fold, CASE WHEN date<=te THEN 'train' ELSE 'valid' END AS part, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users
FROM ev, f WHERE event_type IN {PO} AND (date<=te OR date BETWEEN vs AND ve) GROUP BY 1,2""")
def _(s):
    folds = R.walk_forward_folds(s.ev.filter(is_positive()).select("user_id", "item_id", "date"), FOLDS)
    return folds.groupBy("fold", "part").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


