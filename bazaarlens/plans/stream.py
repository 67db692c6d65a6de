"""Streaming queries: the event file is read as a stream, closed windows are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bazaarlens.plans.ingest import scratch
from bazaarlens.plans.primitives import PO
from bazaarlens.plans.registry import query
from bazaarlens.sources.adapters import Star
from bazaarlens.streaming import jobs


class StreamStar(Star):
    """The star with its raw tables read as streams."""

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def source(s) -> DataFrame:
    return StreamStar(s.spark, s.folder).ev


@query("stream_trending", "ev", f"""WITH w AS (SELECT unnest(range(0,7)) AS k), e AS (SELECT *, date_trunc('day',event_ts)-to_days(k::INT) AS ws FROM ev, w), m AS (SELECT MAX(event_ts)-INTERVAL 1 DAY AS wm FROM ev)
SELECT ws::VARCHAR AS window_start, (ws+INTERVAL 7 DAY)::VARCHAR AS window_end, item_id, COUNT(*) AS events, COUNT(*) FILTER (event_type IN {PO}) AS positives FROM e, m WHERE ws+INTERVAL 7 DAY<=wm GROUP BY ALL""")
def _(s):
    return jobs.run_available(jobs.stream_trending(source(s)), scratch(s, "trending"), scratch(s, "trending-state"))


@query("stream_sessions", "ev", f"""WITH l AS (SELECT *, lag(event_ts) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS p FROM ev), n AS (SELECT *, SUM((p IS NULL OR event_ts-p>=INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS k FROM l),
g AS (SELECT user_id, k, MIN(event_ts) AS a, MAX(event_ts)+INTERVAL 6 HOUR AS b, COUNT(*) AS events, COUNT(*) FILTER (event_type IN {PO}) AS positives FROM n GROUP BY 1,2), m AS (SELECT MAX(event_ts)-INTERVAL 1 DAY AS wm FROM ev)
SELECT user_id, epoch_us(a) AS session_start, epoch_us(b) AS session_end, events, positives FROM g, m WHERE b<=wm""")
def _(s):
    from pyspark.sql import functions as F
    out = jobs.run_available(jobs.stream_sessions(source(s), gap="6 hours"), scratch(s, "sessions"), scratch(s, "sessions-state"))
    return out.withColumns({"session_start": F.unix_micros("session_start"), "session_end": F.unix_micros("session_end")})
