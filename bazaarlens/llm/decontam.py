"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A benchmark window is WINDOW consecutive words of an item (an item with fewer is one window). Its
set holds its word shingles, ordered by rarity over all documents, ties by hash. Whole containment
leaves a prefix of one: |set| - ceil(1.0 * |set|) + 1, the rarest shingle. Documents are joined on
prefix shingles alone; a candidate must fit between the document's ends (position and length
bounds), and is verified word for word over the item-sized window.

Null and empty texts have no words; items without words have no windows, and an item without id
counts under the empty id. Repeated items are one item if they share the id. Each document row
gives one row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.grams import gram_bits, gram_counts, gram_places, text_grams
from bazaarlens.llm.shared import keyed
from bazaarlens.session import durable

WINDOW = 10
SHINGLE = 3


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text): the windows of every item; equal windows of one item once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return text_grams(items, window).select("id", F.col("gram").alias("text")).distinct()


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(window, n, hash, offset): each distinct window with its rarest shingle and where it stands."""
    shingles = durable(text_grams(windows.select(F.col("text").alias("id"), "text").distinct(), SHINGLE), "shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # 1 to SHINGLE
    found = gram_counts(docs, sizes, gram_bits(shingles))
    ranked = shingles.join(found, "hash", "left").withColumn(
        "place", F.row_number().over(W.partitionBy("text").orderBy(F.coalesce(F.col("n"), F.lit(0)), "hash", "pos")))
    return ranked.filter("place = 1").select(F.col("text").alias("window"), F.col("n_words").alias("n"), "size", "hash", F.col("pos").alias("offset"))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (key, doc_id, n_words), and (key, start, n, id): verified item windows in them."""
    windows = durable(item_windows(benchmark, window), "windows")
    prefix = durable(prefixes(windows, docs), "prefixes")
    sizes = [r[0] for r in prefix.select("size").distinct().collect()]
    places = durable(gram_places(docs, sizes, gram_bits(prefix), window), "places")
    start = F.col("pos") - F.col("offset")
    candidates = (
        places.filter("pos >= 0").drop("size").join(prefix, "hash")
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (start >= F.col("context_start")))
    )
    exact = F.array_join(F.slice(F.split("context", " "), start - F.col("context_start") + 1, F.col("n")), " ") == F.col("window")
    hits = candidates.filter(exact).select("key", start.alias("start"), "n", F.col("window").alias("text")).join(windows, "text")
    return places.filter("pos < 0").select("key", "doc_id", "n_words"), hits.select("key", "start", "n", "id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids): words inside any benchmark window, and whose."""
    rows, _ = keyed(docs)
    every, hits = contaminated_words(rows, benchmark, window)
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))

    def cover(acc, s):
        end = s["start"] + s["n"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["reach"], s["start"]))).alias("hit"), F.greatest(acc["reach"], end).alias("reach"))

    by_doc = hits.groupBy(F.col("key").alias("other")).agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.sort_array(F.collect_set("id")).alias("item_ids"))
    found = by_doc.select("other", F.aggregate("spans", zero, cover)["hit"].alias("n_hit"), "item_ids")
    return every.join(found, F.col("key") == F.col("other"), "left").select(
        "doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    rows, _ = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), "_row")
    found = durable(contaminated_words(rows, benchmark, window)[1].select("key").distinct(), "contaminated")
    return rows.join(found, "key", "left_anti").select("_row.*")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
