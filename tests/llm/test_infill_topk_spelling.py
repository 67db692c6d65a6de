"""Fill-in-middle, exact top-k and spelling variants against plain Python, with odd rows and empty tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import fim, queries, spelling, topk

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, output string, word string, n string, form string"


def odd_texts(n=150, seed=5):
    """Nulls, empty and long texts, sentinels, letters beyond ASCII, repeated rows and ids."""
    r = random.Random(seed)
    words = ["alphabet", "alphabets", "alphabte", "alphbet", "Ünïcôde", "ünïcôdes", "çaÿ×÷éèê", "snow", "x1", "<P>", "<S", "M>", "日本", "\n", "aaaaaaaa", "aaaaaaaaa", *["q" * n for n in range(11, 16)], "z" * 300, "z" * 301]
    rows = []
    for i in range(n):
        text = r.choice([None, "", "e", "<S>", *[" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(12)]])
        rows.append((r.choice([i, i, None, 3]), text, "o", "w", "n", "f"))
    return [*rows, *rows[:5], (9, "long " * 300_000 + "é" * 200_000, "o", "w", "n", "f"), (10, "b" * 2_500_000, "o", "w", "n", "f"), (11, "b" * 2_500_000 + " " + "b" * 2_499_999, "o", "w", "n", "f")]


@pytest.fixture(scope="module", params=["made", "empty", "given"])
def docs(spark, request):
    if request.param == "given":
        return spark.read.parquet(f"{SMALL}/documents.parquet")
    return spark.createDataFrame(odd_texts() if request.param == "made" else [], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle ------------------------------------------------------------------------------

def brute_infill(rows):
    out = []
    for d, text in rows:
        t = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        n, x = len(units), sha(f"1:{'' if d is None else d}")
        h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
            out.append((d, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 20:
            out.append((d, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            out.append((d, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return out


def test_infill(docs):
    assert ordered(fim.infill_digest(docs).collect()) == ordered(brute_infill(rows_of(docs)))


def test_infill_counts_units_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)
    for _, text in [r[:2] for r in odd_texts(60, 8)][:60]:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        ends = np.cumsum([0, *[len(u.encode()) for u in units]]).tolist()
        picks = sorted({0, len(units) // 3, len(units) // 2, len(units)})
        assert fim.cut_bytes(data, lambda n, p=picks: p) == (len(units), *[ends[p] for p in picks])


def test_exchange_and_its_inverse():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab<>é PMS") for _ in range(r.randint(1, 30))).replace("<P>", "").replace("<M>", "").replace("<S>", "")
        cuts = sorted(r.randint(0, len(text)) for _ in range(2))
        a, b = (len(text[:c].encode()) for c in cuts)
        p, m, s = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
        if any(x in text for x in ("<P>", "<M>", "<S>")):
            continue
        for form, want in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            got = bytes(fim.exchange(text.encode(), a, b, form))
            assert got.decode() == want and bytes(fim.invert(got, form)).decode() == text


def test_restore_keeps_other_columns(docs):
    got = fim.restore(fim.rearrange(docs).withColumn("restored", F.lit("old")).withColumn("doc id", F.lit(1)))
    assert got.columns[-2:] == ["doc id", "restored"]
    assert ordered(got.select("doc_id", "restored").collect()) == ordered((d, t or "") for d, t in rows_of(docs))


# ---- top-k ---------------------------------------------------------------------------------------

def brute_top(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(sound):
        if q % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(sound) if a != b)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, row string, id int")


def odd_vectors(n=700, seed=2):
    """Copies held by a third of the rows, clusters, ties, repeated ids, odd lengths and unusable rows."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, 9))
    rows = []
    for i in range(n):
        v = [0.5] * 9 if i % 3 == 0 else (centers[i % 6] + 0.1 * r.normal(size=9)).round(1).tolist()
        rows.append((int(r.choice([i, i, i, 100, -50])), v[: int(r.choice([9, 9, 9, 4, 0]))] if i % 7 == 0 else v))
    bad = [(None, [1.0]), (0, None), (50, [float("nan"), 1.0]), (100, [float("inf")]), (150, [1.0, None])]
    return rows + bad


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "query_rows": 6, "lists": 3}, {"lists": 1}])
def test_top_k(spark, sizes):
    rows = [(i, [np.float32(x).item() if x is not None else None for x in v] if v is not None else None) for i, v in odd_vectors()]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, **sizes)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert ordered(got.collect()) == ordered(brute_top(rows))


def test_top_k_of_few_no_and_given_rows(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0]), (50, [-1.0]), (7, [3.0])], [(1, [1.0]), (2, [1.0])]):
        assert ordered(topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()) == ordered(brute_top(rows))
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in given.select("vec_id", "embedding").collect()]
    assert ordered(queries.QUERIES["op12_exact_top_k"](spark, SMALL).collect()) == ordered(brute_top(rows))


def test_top_k_over_many_partitions(spark):
    """Blocks of both sides meet whatever partition their keys hash to."""
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.random.default_rng(6).normal(size=(900, 6)))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = topk.top_k(vectors(spark, rows).repartition(7), F.col("vec_id") % 50 == 0, cell_rows=60, query_rows=5)
        assert ordered(got.collect()) == ordered(brute_top(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cutoff_spares_most_entries(spark):
    """What the lists send after the cutoff is a small part of all entries."""
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(3000, 16)))]
    objects = topk.scaled_vectors(vectors(spark, rows)).select(F.col("row").alias("id"), "v", "dims", F.col("vec_id").alias("min_id"))
    asked = objects.filter("min_id % 50 = 0")
    cut = topk.nearest_objects(asked, objects, 6).filter("place = 6").select(F.col("q").alias("id"), F.col("score").alias("cut"))
    told = topk._blocks(asked.join(cut, "id"), 1024, 60, 16, 2, "q_cell")
    items = topk._blocks(objects.withColumn("cut", F.lit(None).cast("long")), 4096, 3000, 16, 2, "cell")
    assert topk._entries(told, items, 1, 1, topk._reaching(2)).count() < 0.1 * 2 * 60 * 3000


def test_large_components_stay_exact(spark):
    rows = [(0, [float(2**20), 1.0]), (50, [float(2**20 - 1), 3.0]), (1, [float(2**20 - 2), -5.0])]
    assert ordered(topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()) == ordered(brute_top(rows))


# ---- spelling ------------------------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, least=7):
    counts = collections.Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_spelling(counts):
    near = collections.defaultdict(set)
    holes = collections.defaultdict(list)
    for w in counts:
        if len(w) > 1000:  # compared one by one
            near[w] |= {x for x in counts if one_edit(w, x)}
            continue
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
    for (a, b), group in holes.items():
        for w in [*group, *([a + b] if a + b in counts else [])]:
            near[w] |= {x for x in [*group, a + b] if x in counts and x != w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def test_spelling(docs, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 13)
    counts = brute_counts(rows_of(docs))
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert ordered(got.collect()) == ordered(brute_spelling(counts))


@pytest.mark.parametrize("long", [6, 64])
def test_spelling_of_dense_words(spark, monkeypatch, long):
    """A small alphabet gives many neighbours, chains of forms and shared nodes; levels end at any length."""
    monkeypatch.setattr(spelling, "LONG", long)
    r = random.Random(11)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))): 10 ** r.randint(0, 4) * r.randint(1, 3) for _ in range(900)}
    counts |= {"a" * n: 5 + n for n in range(10, 16)} | {"ab" * 7 + "c": 7, "ab" * 7: 90, "ab" * 6 + "cab": 900}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    forms = spelling.with_forms(words, spelling.near_words(words))
    got = {r.word: r for r in forms.collect()}
    chains = {r.word: r.root for r in spelling.roots(forms).collect()}
    assert ordered((w, x.n, x.n_near, x.form, x.form_n, chains.get(w, w)) for w, x in got.items()) == ordered(brute_spelling(counts))


def test_crc_of_spans():
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    start = np.sort(r.integers(0, 4000, 200))
    end = start + r.choice([0, 1, 7, 300, 900], 200)
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], dtype=np.uint32)
    assert spelling.crc_of_spans(data, start, end, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before)]
