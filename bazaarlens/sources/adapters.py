"""The marketplace star read from the TPC-H-like tables, as DataFrames and as the same SQL.

Every column is a plain row expression of the source table, so filters and column pruning still
reach the parquet scan; only the snapshot and interaction facts aggregate.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The price texts and title words the cleaning operators must read.
PRICE_TEXTS = [
    "<500M", "3B–5B", "<2M/tháng", "3M–5M/tháng", ">30M/tháng", "3 tỷ - 5 tỷ",
    "5 triệu/tháng - 7 triệu/tháng", "Thỏa thuận",
]
TITLE_WORDS = ["cho thuê", "bán", "cần bán gấp", "nhà view ban công", "phòng trọ giá rẻ"]
QUERY_WORDS = [
    "cho thuê phòng trọ", "bán nhà", "căn hộ chung cư quận 7", "đất nền", "mặt bằng kinh doanh",
    "nhà nguyên căn gần trường",
]
QUERY_PRICES = ["", "dưới 3 tỷ", "5 triệu", "2-3 tỷ"]
STATUSES = ["accepted", "shop_accepted", "hidden", "deleted", "refused"]
DEVICES = ["Desktop", "MSite", "iOS", "Android"]


def _case(index: str, values: list[str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {whens} ELSE {otherwise} END"


# One expression list per table, valid in both dialects.
_EVENTS = f"""
  event_id, event_ts, date, user_id, item_id,
  CAST(1010 + 10 * (item_id % 5) AS INT) AS category,
  CASE WHEN event_type = 'view' OR event_type = 'error' THEN 'pageview'
       WHEN event_type = 'click' THEN 'other_interaction'
       WHEN event_type = 'purchase' AND dwell_time_sec < 30 THEN 'contact_zalo'
       WHEN event_type = 'purchase' THEN 'view_phone'
       WHEN dwell_time_sec < 20 THEN 'contact_sms'
       ELSE 'contact_chat' END AS event_type,
  CASE WHEN dwell_time_sec < 8 THEN 'non-login' ELSE 'login' END AS is_login,
  CONCAT(CAST(user_id AS STRING), '-', CAST(date AS STRING)) AS session_id,
  CONCAT('NATION_', CAST(item_id % 25 AS STRING)) AS city_name,
  {_case("cents % 4", ["ad_view", "adview", "other"])} AS surface,
  {_case("user_id % 4", DEVICES)} AS device,
  CASE WHEN cents <= 15000 THEN CAST(cents % 30 + 1 AS DOUBLE) END AS position,
  dwell_time_sec, cents,
  CASE WHEN event_type = 'error' THEN TRIM(CONCAT(
    {_case("item_id % 6", QUERY_WORDS, "''")}, ' ',
    CASE WHEN user_id % 3 = 0 THEN CONCAT('Nation_', CAST(user_id % 25 AS STRING))
         WHEN user_id % 3 = 1 THEN CONCAT('brand#', CAST(user_id % 25 + 1 AS STRING)) ELSE '' END, ' ',
    {_case("user_id % 4", QUERY_PRICES, "''")})) END AS query,
  CASE WHEN event_type = 'purchase' OR event_type = 'signup' AND cents % 50 <> 0 THEN 1 ELSE 0 END AS is_contact
"""

_DIM = f"""
  p_partkey AS item_id, s_suppkey AS seller_id,
  CASE WHEN p_type = 'MEDIUM' THEN 3030 ELSE CAST(1010 + 10 * (p_partkey % 5) AS INT) END AS category,
  CONCAT({_case("p_size % 5", TITLE_WORDS)}, ' ', p_name) AS title,
  CASE WHEN s_acctbal > 5000 THEN 'agent' ELSE 'private' END AS seller_type,
  CASE WHEN p_size % 2 = 0 THEN 'sell' ELSE 'let' END AS ad_type,
  {_case("(p_partkey * 7 % 11) % 5", STATUSES)} AS ad_status,
  CASE WHEN p_size <> 50 THEN p_size * 4.0E0 END AS area_sqm,
  CASE WHEN p_size % 6 > 0 THEN CAST(p_size % 6 AS DOUBLE) END AS bedrooms,
  CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 4 AS DOUBLE) END AS bathrooms,
  CAST(p_size % 7 AS DOUBLE) AS floors,
  CASE WHEN p_size % 7 > 0 THEN p_size / 5.0E0 END AS width_m,
  {_case("p_size % 9", ["dong", "tay", "nam", "bac"])} AS direction,
  {_case("p_size % 3", ["so_hong", "hop_dong"])} AS legal_status,
  p_type AS house_type,
  {_case("p_partkey % 4", ["full", "basic", "none"])} AS furnishing,
  n_name AS city_name, n_regionkey AS region_key, p_brand AS district_name,
  CONCAT(p_brand, '-', CAST(p_size % 5 AS STRING)) AS ward_name,
  CASE WHEN p_size % 4 = 0 THEN CONCAT(p_brand, '/', p_type) END AS project_id,
  {_case("p_size % 9", PRICE_TEXTS)} AS price_bucket,
  p_retailprice AS price, CAST(p_size % 12 AS DOUBLE) AS images_count,
  DATE_ADD(DATE'2023-11-01', CAST((p_partkey * 37) % 75 AS INT)) AS posted_date,
  CASE WHEN p_size % 10 > 0
       THEN DATE_ADD(DATE'2023-11-01', CAST((p_partkey * 37) % 75 + p_size * 3 - 10 AS INT)) END AS expected_expired_date
"""

_SNAP_SRC = """
  l_partkey AS item_id,
  DATE_ADD(DATE'2023-12-01', CAST(PMOD(DATEDIFF(CAST(l_shipdate AS DATE), DATE'1995-01-01'), 61) AS INT)) AS date,
  CASE WHEN l_discount >= 0.02 THEN l_quantity ELSE 0.0E0 END AS views,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS DOUBLE) ELSE 0.0E0 END AS contacts
"""

_ORDERED_SRC = """
  o_custkey AS user_id, l_partkey AS item_id, o_orderstatus, l_quantity, l_linenumber, l_returnflag,
  CAST(o_orderdate AS DATE) AS date
"""


class Star:
    """The marketplace tables of one data folder, built lazily and without running anything."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def over(self, events: DataFrame) -> Star:
        """The same tables with ``events`` in the place of the event table, such as a written copy of it."""
        other = Star(self.spark, self.folder)
        other.ev = events
        return other

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """fact_user_events from ``events``."""
        base = self.raw("events").selectExpr(
            "event_id", "ts AS event_ts", "CAST(ts AS DATE) AS date", "user_id", "event_type",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS item_id", "value AS dwell_time_sec",
            "CAST(ROUND(value * 100) AS BIGINT) AS cents",
        )
        return base.selectExpr(*_split(_EVENTS))

    @cached_property
    def dim(self) -> DataFrame:
        """dim_listing from ``part``, each item sold by one supplier in one nation."""
        part, supplier = self.raw("part"), self.raw("supplier")
        nation = self.raw("nation")
        sellers = supplier.agg(F.count("*")).scalar()
        joined = (
            part.withColumn("s_suppkey", F.col("p_partkey") % sellers)
            .join(supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "left")
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        )
        return joined.selectExpr(*_split(_DIM))

    @cached_property
    def region(self) -> DataFrame:
        """city_region_mapping: 25 nations, a table of fixed size."""
        return (
            self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("city_name"), F.col("r_name").alias("region"))
        )

    @cached_property
    def snap(self) -> DataFrame:
        """fact_listing_snapshot from ``lineitem``: one row per item and day."""
        offset = F.pmod(F.col("item_id") * 37, F.lit(75)).cast("int")
        age = F.datediff("date", F.date_add(F.lit("2023-11-01").cast("date"), offset))
        return (
            self.raw("lineitem").selectExpr(*_split(_SNAP_SRC))
            .groupBy("item_id", "date")
            .agg(F.sum("views").alias("views_24h"), F.sum("contacts").alias("contacts_24h"))
            .withColumn("listing_age_days", F.when(age >= 0, age.cast("double")))
        )

    @cached_property
    def inter(self) -> DataFrame:
        """fact_post_contact_interactions from ``events``: one row per user, item and day."""
        from bazaarlens.functions.columns import is_explicit, is_pageview

        chat = F.col("event_type") == "contact_chat"
        messages = F.sum(F.when(chat, F.col("cents") % 7).otherwise(0))
        return (
            self.ev
            .groupBy("user_id", "item_id", "date")
            .agg(
                F.sum(F.when(is_pageview(), 1.0).otherwise(0.0)).alias("adview_count"),
                F.sum(F.when(is_explicit(), 1.0).otherwise(0.0)).alias("lead_count"),
                messages.cast("double").alias("chat_message_count"),
                F.floor(messages / 2).cast("double").alias("chat_turn_count"),
                F.max(F.when(chat, 1.0).otherwise(0.0)).alias("chat_lead"),
                (F.max("dwell_time_sec") > 120).alias("purchased"),
                F.max("category").alias("category"),
            )
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Every ordered item with its buyer and day: ``orders`` joined to ``lineitem``."""
        return (
            self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr(*_split(_ORDERED_SRC))
        )

    @cached_property
    def test_users(self) -> DataFrame:
        """The users to recommend to: every customer; those without events are cold."""
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"))

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("documents")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def _split(text: str) -> list[str]:
    """The select list cut at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return out


def _duck(text: str) -> str:
    text = text.replace("DATE_ADD(DATE'2023-11-01', ", "(DATE'2023-11-01' + (")
    text = text.replace("DATE_ADD(DATE'2023-12-01', ", "(DATE'2023-12-01' + (")
    text = text.replace("AS INT)) AS posted_date", "AS INT))) AS posted_date")
    text = text.replace("AS INT)) END AS expected", "AS INT))) END AS expected")
    text = text.replace("61) AS INT)) AS date", "61) AS INT))) AS date")
    text = text.replace("PMOD(DATEDIFF(CAST(l_shipdate AS DATE), DATE'1995-01-01'), 61)",
                        "(DATE_DIFF('day', DATE'1995-01-01', CAST(l_shipdate AS DATE)) % 61)")
    return text.replace("CAST((CAST", "CAST(CAST")


_SQL = {
    "ev": (
        (),
        f"ev AS (SELECT {_duck(_EVENTS)} FROM (SELECT event_id, ts AS event_ts, CAST(ts AS DATE) AS date, user_id, "
        "event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, value AS dwell_time_sec, "
        "CAST(ROUND(value * 100) AS BIGINT) AS cents FROM events) e0)",
    ),
    "dim": (
        (),
        f"dim AS (SELECT {_duck(_DIM)} FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % (SELECT COUNT(*) FROM supplier) "
        "LEFT JOIN nation ON s_nationkey = n_nationkey)",
    ),
    "region_map": (
        (),
        "region_map AS (SELECT n_name AS city_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)",
    ),
    "snap": (
        (),
        f"snap AS (SELECT item_id, date, SUM(views) AS views_24h, SUM(contacts) AS contacts_24h, "
        "CASE WHEN date >= DATE'2023-11-01' + CAST((item_id * 37) % 75 AS INT) THEN CAST(DATE_DIFF('day', "
        "DATE'2023-11-01' + CAST((item_id * 37) % 75 AS INT), date) AS DOUBLE) END AS listing_age_days "
        f"FROM (SELECT {_duck(_SNAP_SRC)} FROM lineitem) s0 GROUP BY item_id, date)",
    ),
    "inter": (
        ("ev",),
        "inter AS (SELECT user_id, item_id, date, "
        "SUM(CASE WHEN event_type = 'pageview' THEN 1.0E0 ELSE 0 END) AS adview_count, "
        "SUM(CASE WHEN event_type IN ('view_phone','contact_chat','contact_zalo','contact_sms') THEN 1.0E0 ELSE 0 END) AS lead_count, "
        "CAST(SUM(CASE WHEN event_type = 'contact_chat' THEN cents % 7 ELSE 0 END) AS DOUBLE) AS chat_message_count, "
        "FLOOR(SUM(CASE WHEN event_type = 'contact_chat' THEN cents % 7 ELSE 0 END) / 2.0E0) AS chat_turn_count, "
        "MAX(CASE WHEN event_type = 'contact_chat' THEN 1.0E0 ELSE 0 END) AS chat_lead, "
        "MAX(dwell_time_sec) > 120 AS purchased, MAX(category) AS category "
        "FROM ev GROUP BY user_id, item_id, date)",
    ),
    "ordered": ((), f"ordered AS (SELECT {_ORDERED_SRC} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"),
    "test_users": ((), "test_users AS (SELECT c_custkey AS user_id FROM customer)"),
    "docs": ((), "docs AS (SELECT * FROM documents)"),
}


def with_tables(tables: str, sql: str) -> str:
    """``sql`` behind the common table expressions of the named star tables."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _SQL[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in tables.split():
        add(name)
    ctes = [_SQL[n][1] for n in ordered]
    body = sql.strip()
    recursive = body.startswith("WITH RECURSIVE_ ")
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(ctes + [body[len("WITH RECURSIVE_ "):]])
    if body[:5].upper() == "WITH ":
        extra = body[5:]
        return "WITH " + ",\n".join(ctes + [extra]) if ctes else body
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
