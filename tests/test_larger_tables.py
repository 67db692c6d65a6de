"""Steps whose cost grew faster than their tables: what travels, what is read, and that results stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import features, segment, text
from bazaarlens.operators.quality import price_log
from bazaarlens.operators.retrieve import merge_candidates
from bazaarlens.plans import retrieve
from bazaarlens.plans.features import CUT
from bazaarlens.plans.registry import QUERIES
from bazaarlens.sources.adapters import Star

FOLDER = "/root/testdata/sf0.001"


def test_cross_features_read_only_what_they_compare(spark):
    plan = QUERIES["cross_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
    s = Star(spark, FOLDER)
    columns = ["user_id", "top_category", "top_city", "price_pref_log"]
    tastes, whole = features.user_tastes(s.ev, features.priced(s.dim), CUT).select(columns), features.user_features_v2(s.ev, s.dim, CUT).select(columns)
    assert sorted(map(tuple, tastes.collect())) == sorted(map(tuple, whole.collect()))


def test_a_price_text_is_read_once_for_all_its_listings(spark):
    rows = [(1, "3B–5B"), (2, "3B–5B"), (3, None), (4, "Thỏa thuận"), (5, "<500M")]
    dim = spark.createDataFrame(rows, "item_id long, price_bucket string")
    got = {r.item_id: r.price_log for r in features.priced(dim).collect()}
    assert got == {r.item_id: r.p for r in dim.select("item_id", price_log("price_bucket").alias("p")).collect()}
    plan = features.priced(dim)._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "regexp_extract" in line]
    assert read and all("Aggregate [price_bucket" in line for line in read)


def test_profiles_do_not_travel_with_every_pair(spark):
    s = Star(spark, FOLDER)
    pairs = s.ev.select("user_id", "item_id").distinct()
    joined = features.title_similarity(pairs, features.user_embedding_profile(pairs, s.vectors), s.vectors)
    outer = next(x for x in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "user_id" in outer and "item_id" not in outer
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_events_are_read_once_for_all_retrievers_of_a_merge(spark, monkeypatch):
    stages, write = {}, retrieve.durable

    def told(df, name):
        stages[name] = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(retrieve, "durable", told)
    plan = retrieve.merged(Star(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" in stages.pop("events") and "events.parquet" not in plan
    assert {"touches", "pairs"} <= set(stages) and not any("events.parquet" in p for p in stages.values())


def test_a_merge_deals_its_rows_once(spark):
    sources = {"a": [(1, 10, 2.0), (1, 11, 4.0), (2, 10, 5.0), (None, 10, 1.0), (None, 12, 3.0)], "b": [(1, 11, 7.0), (1, 12, 9.0), (1, 12, 8.0)]}
    frames = {n: spark.createDataFrame(rows, "user_id long, item_id long, score double") for n, rows in sources.items()}
    repeats = spark.createDataFrame([(1, 10, 3), (3, 13, 2)], "user_id long, item_id long, repeat_count long")
    merged = merge_candidates(frames, repeats, {"a": 0.5, "b": 0.25}, 0.1, cap=3)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.user_id, r.item_id): (round(r.a_norm, 6), round(r.b_norm, 6), r.repeat_count, r.is_repeat, r.source_count, round(r.blend_score, 6), r.cand_rank) for r in merged.collect()}
    assert got == {
        (1, 11): (1.0, 0.0, 0.0, 0, 2, 0.5, 1), (1, 12): (0.0, 1.0, 0.0, 0, 1, 0.25, 2), (1, 10): (0.0, 0.0, 3.0, 1, 2, 0.1, 3),
        (2, 10): (0.0, 0.0, 0.0, 0, 1, 0.0, 1), (3, 13): (0.0, 0.0, 2.0, 1, 1, 0.1, 1),
        (None, 12): (1.0, 0.0, 0.0, 0, 1, 0.5, 1), (None, 10): (0.0, 0.0, 0.0, 0, 1, 0.0, 2)}


def test_ngrams_of_frequent_words_are_all_ngrams(spark):
    rows = [("en", "a b a b a b c d"), ("en", "a b x y x y z"), ("fr", "q r s"), ("fr", None), (None, "a b  a b\tc"), ("es", "")]
    rows += [("de", " ".join(f"m{i} n{i}" for i in range(30)))]  # every pair once: ties, decided by the text
    texts = spark.createDataFrame(rows, "lang string, t string")
    cells = lambda df: sorted(map(str, df.collect()))
    for sizes in ([2], [2, 3]):
        whole = cells(text.weighted_ngrams(texts, "t", F.lit(1), sizes, 2, ["lang"]))
        for frequent in (1, 2, 4, 1000):
            assert cells(text.weighted_ngrams(texts, "t", F.lit(1), sizes, 2, ["lang"], frequent=frequent)) == whole
    tokens = texts.filter("lang = 'en'").select("lang", F.lit(1).alias("w"), F.split("t", " ").alias("tok"))
    assert text._ngrams_of_frequent_words(tokens, [2], 1, ["lang"], 2) is not None
    assert text._ngrams_of_frequent_words(tokens, [2], 3, ["lang"], 2) is None


def test_rare_bigrams_of_documents_do_not_travel(spark):
    plan = QUERIES["document_ngrams"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # counted already, from the frequent words


def test_sessions_bring_their_user_along(spark):
    s = Star(spark, FOLDER)
    users = segment.user_intent_features(s.ev, s.dim).select("user_id", "category", (F.col("n_events") % 3).cast("int").alias("cluster"))
    users = spark.createDataFrame(users.collect(), users.schema)
    one = segment.session_funnel_by_cluster(s.ev, segment.session_journey_features(s.ev, 2, owner=True), users)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1  # the events are not read again for it
    two = segment.session_funnel_by_cluster(s.ev, segment.session_journey_features(s.ev, 2), users)
    cells = lambda df: sorted(tuple(round(float(v), 6) for v in r) for r in df.collect())
    assert cells(one) == cells(two)
