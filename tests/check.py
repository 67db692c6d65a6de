"""Compare registered queries with their SQL in DuckDB: python tests/check.py [folder] [name...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    as_text = df.astype(object).where(df.notna(), None)
    order = as_text.apply(lambda r: tuple(str(v) for v in r), axis=1) if len(df) else pd.Series([], dtype=object)
    return as_text.loc[order.sort_values(kind="stable").index].reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in df.columns}


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    a, b = canon(spark_df), canon(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    ka, kb = kinds(spark_df), kinds(sql_df)
    bad_kinds = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and not {ka[c], kb[c]} <= {"O", "U", "b"}}
    # whole numbers beside NULLs are floats in one frame and nullable integers in the other
    bad_kinds = {c: k for c, k in bad_kinds.items() if not (set(k) == {"f", "i"} and spark_df[c].isna().any() and (spark_df[c].dropna() % 1 == 0).all())}
    for c in a.columns:
        for i, (x, y) in enumerate(zip(a[c], b[c])):
            same = x == y or (x is None and y is None)
            if not same and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = abs(x - y) <= 2e-5 * max(1.0, abs(x) * 1e-4)
            if not same:
                return f"row {i} column {c}: {x!r} vs {y!r}\n{a.iloc[[i]].to_string()}\n{b.iloc[[i]].to_string()}"
    if bad_kinds:
        return f"types {bad_kinds}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    oracles = oracle_sql()
    failed = []
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL {name}: spark {str(e)[:1200]}", flush=True)
            continue
        took = time.time() - start
        note = "rows only"
        if name in oracles:
            try:
                note = difference(got, con.execute(oracles[name]).df()) or "ok"
            except Exception as e:  # noqa: BLE001
                note = f"duckdb {str(e)[:900]}"
        if note not in ("ok", "rows only"):
            failed.append(name)
            print(f"FAIL {name}: {note}", flush=True)
        else:
            print(f"{note:9s} {name} rows={len(got)} {took:.1f}s", flush=True)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
