"""Every training-data query against brute force: given documents, odd rows and empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from bazaarlens.llm import decontam, huffman, licenses, ngram_join, packing, pii, ppm, quality, queries, repeats, substring, suffix, token_output
from bazaarlens.llm.components import components
from bazaarlens.llm.shared import keyed

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n string"


def twins(n):
    """Two words whose polynomial hashes modulo a power of two are equal for every base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def made(n=160, seed=3):
    """Copies, near copies, shared passages, repeated and missing ids, null, empty, long and repetitive texts."""
    r = random.Random(seed)
    base = [" ".join(r.choice(["the", "of", "a", "Hash", "x", "yy", "zed", "q1", "é"]) for _ in range(r.choice([0, 1, 3, 4, 30, 34, 35, 36, 60, 200]))) for _ in range(40)]
    rows = []
    for i in range(n):
        p = r.choice(base).split() + r.choice(base).split()[: r.randint(0, 50)]
        if r.random() < 0.5 and p:
            p[r.randrange(len(p))] = f"edit{i % 7}"
        if r.random() < 0.1:
            p.insert(0, twins(r.choice([1024, 2048]))[r.random() < 0.5])
        rows.append((r.choice([i, i, i, None, 7]), r.choice([" ".join(p)] * 12 + [None, "", " \n", "ha " * 400, "é" * 100 + "\0" * 60]), r.choice(["en", "de", None, "xx"]), r.choice(["s", "s", "t", None]), 1, 5, "n"))
    return rows


@pytest.fixture(scope="module", params=["made", "empty", "given"])
def docs(spark, request):
    if request.param == "given":
        return spark.read.parquet(f"{SMALL}/documents.parquet")
    return spark.createDataFrame(made() if request.param == "made" else [], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_near(docs):
    assert ordered(ngram_join.jaccard_components(docs).collect()) == ordered(brute.near(rows_of(docs)))


def test_near_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(made(300, 5), SCHEMA)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 5)
    assert ordered(ngram_join.jaccard_components(docs).collect()) == ordered(brute.near(rows_of(docs)))


def test_bitmaps_of_levels_follow_the_text_and_sets_are_sent_for_neighbours_alone(spark, monkeypatch):
    """Before, bitmaps of one size filled up, and then every document's set was written and moved."""
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    near = [text() for _ in range(20)]
    rows = [(i, text()) for i in range(400)] + [(400 + i, t) for i, t in enumerate(near)] + [(500 + i, t + " x") for i, t in enumerate(near)] + [(600 + i, t) for i, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "LEVELS", ((2, 1 << 8), (16, 1 << 8), (256, 1 << 8)))
    monkeypatch.setattr(ngram_join, "TEXT_BYTES", 8)
    grown = ngram_join._levels_for(docs)
    assert [n for n, _ in grown] == [2, 16, 256] and len({b for _, b in grown}) == 1
    assert grown[0][1] == 1 << 13  # stops at 32 times
    monkeypatch.setattr(ngram_join, "GROWN", 1 << 10)
    assert 8 * ngram_join._levels_for(docs)[0][1] >= sum(len(t) for _, t in rows)
    sent, plain = [], ngram_join._bodies
    monkeypatch.setattr(ngram_join, "_bodies", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs).collect()}
    assert got == {**{i: (57, i) for i in range(400)}, **{400 + i: (57, 400 + i) for i in range(20)}, **{500 + i: (58, 400 + i) for i in range(20)}, **{600 + i: (57, 400 + i) for i in range(20)}}
    assert 40 <= sent[0].count() < 80
    assert "shingles" not in ngram_join.SETS


def test_levels_of_more_buckets_than_the_bitmaps_have_words(spark):
    """Every shingle of two documents is marked, however many shuffle partitions a cluster uses."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x y z w v")], "doc_id long, text string")
    maps = ngram_join._levels(docs, 4, 20_000)
    hashes = np.concatenate([h for _, _, h in ngram_join.shingle_sets(docs.select("text").limit(1).toArrow().column("text").combine_chunks(), 4)])
    bits = ngram_join._place(hashes, 20_000, ngram_join.LEVELS[0][1])
    marks = np.unpackbits(maps[0], bitorder="little")
    assert marks[bits.astype(np.int64)].all() and marks.sum() <= len(hashes)


def test_divide_skip_links_what_a_plain_join_links():
    r = random.Random(1)
    for _ in range(30):
        base = r.sample(range(1000), 40)
        sets = [np.array(sorted({x if r.random() > 0.06 else r.randrange(5000) for x in base}), dtype=np.uint64) for _ in range(25)]
        group = list(range(25))
        for a, b in ngram_join.divide_skip(sets, 85):
            group = [group[a] if g == group[b] else g for g in group]
            o = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o)
        for a in range(25):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                    assert group[a] == group[b]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5), (100, 300)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_substrings(docs):
    got = substring.substring_digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(got) == ordered(brute.substrings(rows_of(docs)))


def test_substring_texts_match_their_digest(docs):
    kept = [(r.doc_id, brute.sha(r.kept)) for r in substring.remove_substrings(docs).collect()]
    assert ordered(kept) == ordered(substring.substring_digest(docs).select("doc_id", "kept_sha256").collect())


def test_automaton_counts_places():
    a = substring.SuffixAutomaton()
    texts = [[1, 2, 3, 1, 2], [2, 3, 1], [9, 9, 9]]
    for t in texts:
        a.add(t, 1)
    a.finish()
    assert a.statistics([1, 2, 3, 1, 2]) == [1, 2, 2, 3, 2]
    assert a.statistics([9, 9, 9, 7]) == [1, 2, 2, 0]


def test_suffixes(docs):
    assert ordered(suffix.suffix_digest(docs).collect()) == ordered(brute.suffixes(rows_of(docs)))


def test_levels_grow_geometrically():
    r = random.Random(2)
    words = np.array([b"%03d" % r.randrange(300) for _ in range(1000)])
    order = np.sort(np.array([r.randrange(400) for _ in range(1000)]))
    got = suffix.earlier(words, order, batch=16)
    assert got.tolist() == [any(order[j] < order[i] for j in range(i) if words[j] == words[i]) for i in range(1000)]
    family = suffix.SuffixLevels()
    for i in range(64):
        family.add(np.array([b"%04d" % i]))
    assert [len(x) for x in family.levels] == [64]


def test_packing(docs):
    got = packing.pack(docs).collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= packing.CAPACITY
        for values in ([r.source for r in rows if r.source is not None], [r.cluster for r in rows]):
            assert len(values) == len(set(values))
    tokens: dict = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    expected: dict = {}
    for d, t in rows_of(docs):
        expected[d] = expected.get(d, 0) + len(brute.PLAIN.findall(t or "")) + 1
    assert tokens == expected


def plain_best_fit(sizes, sources, clusters, capacity):
    """Every bin is looked at for every piece."""
    bins, at = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(capacity - used, b) for b, (used, s, c) in enumerate(bins) if used + sizes[i] <= capacity and sources[i] not in s and clusters[i] not in c and used < capacity]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((0, set(), set()))
        used, s, c = bins[b]
        at[i] = (b, used)
        bins[b] = (used + sizes[i], s | ({sources[i]} - {-1}), c | ({clusters[i]} - {-1}))
    return [at[i][0] for i in range(len(sizes))], [at[i][1] for i in range(len(sizes))]


def test_best_fit_equals_the_plain_rule():
    r = random.Random(7)
    for n, kinds in ((200, 9), (200, 60), (120, 1)):
        pieces = [r.randint(1, 100) for _ in range(n)], [r.randint(-1, kinds) for _ in range(n)], [r.choice([-1, r.randint(0, n)]) for _ in range(n)]
        assert packing.best_fit(*pieces, 100) == plain_best_fit(*pieces, 100)


def test_packing_equals_the_plain_rule(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        n = len(brute.PLAIN.findall(r.text or "")) + 1
        pieces += [(r.doc_id, k, min(packing.CAPACITY, n - at), r.source, r.text or "") for k, at in enumerate(range(0, n, packing.CAPACITY))]
    number = lambda values: [-1 if v is None else sorted({x for x in values if x is not None}).index(v) for v in values]
    bins, offsets = plain_best_fit([p[2] for p in pieces], number([p[3] for p in pieces]), number([p[4] for p in pieces]), packing.CAPACITY)
    got = {(r.doc_id, r.piece): (r.bin, r.bin_offset, r.n_tokens) for r in packing.pack(docs).collect()}
    assert got == {(p[0], p[1]): (b, o, p[2]) for p, b, o in zip(pieces, bins, offsets)}


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, offsets = packing.best_fit([60, 70, 30, 25, 25], [0, 1, 1, 2, 2], [-1] * 5, 100)
    assert bins == [1, 0, 1, 0, 2] and offsets == [0, 0, 60, 70, 0]


def test_quality(docs):
    got = quality.quality_digest(docs).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered((d, *brute.quality(t)) for d, t in rows_of(docs))
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_follows_the_labels(spark):
    """Labelled good documents stay; of the bad ones that the base rule passes most go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in quality.quality_digest(docs).collect() if not r.base_failed]
    good, bad = ([r.kept for r in got if label.get(r.doc_id) == q] for q in (1, 0))
    assert all(good) and sum(bad) < 0.35 * len(bad)


def test_js_distance(spark):
    h = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(quality.js_distance(h(1, 0), h(0, 3)), quality.js_distance(h(2, 2), h(5, 5)), quality.js_distance(h(0, 0), h(1, 1))).first()
    assert row[0] == pytest.approx(1) and row[1] == 0 and row[2] is None


def test_scores(docs):
    got = ordered(ppm.score_digest(docs).collect())
    want = ordered(brute.scores(rows_of(docs), ppm.ORDER))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for i in (5, 6):
        assert [r[i] for r in got] == pytest.approx([r[i] for r in want], rel=1e-9)


def test_a_unit_forms_its_numbers_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(3)
    stream = np.frombuffer(b"".join(r.choice([b"the ", b"cat ", b"sat ", b"mat "], 1 << 21)), dtype=np.uint8)
    use, train = r.random(len(stream)) < 0.9, r.random(len(stream)) < 0.8
    use[: ppm.ORDER] = False
    tracemalloc.start()
    code, n = ppm.distinct_codes(stream, use, train)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = ppm.grams(stream)
    assert (code == np.unique(whole[use])).all() and peak < 14 * len(stream)
    trained, times = np.unique(whole[use & train], return_counts=True)
    assert (trained == code[n > 0]).all() and (times == n[n > 0]).all()


def test_scores_do_not_depend_on_the_slices_of_a_unit(spark, monkeypatch):
    docs = spark.createDataFrame(made(40, 9), SCHEMA)
    want = ordered(ppm.score_digest(docs).collect())
    monkeypatch.setattr(ppm, "LOOKUP_BYTES", 97)
    got = ordered(ppm.score_digest(docs).collect())
    assert [r[0] for r in got] == [r[0] for r in want] and [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-12)


def test_byte_model_beats_the_words_on_held_out_texts(spark):
    got = ppm.score_digest(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_tokens_round_trip(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    own = Tokenizer.from_file(path)
    rows = [r for r in rows_of(docs) if r[0] is not None and r[0] != 7]  # repeated ids have an order of their own
    docs = docs.filter("doc_id != 7")
    start, want = 0, []
    for d, t in sorted(rows):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert ordered(token_output.token_digest(docs, path).collect()) == ordered(want)


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    own, known = Tokenizer.from_file(path), token_output.WordIds(path, 2)
    odd = ["The <|endoftext|> the<|startoftext|>x don't I'LL É́ é \xa0 a b ΑΣ ΣΑΣ.", "12ab3!! ... _x_ \x85y", "don't!!! we're, x's \"quoted\" (a) b-c-d e/f <|x|> a<b>c 'tis 't", "日本 語　x", "a\x1cb c\x00d"]
    for t in odd:
        data = t.encode()
        chunk = token_output.chunks(__import__("pyarrow").array([t]))
        c = next(chunk)
        ids, counts = known.ids(c.data, token_output.words(c, token_output.PLAIN_WORD))
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids + [2] and counts.tolist() == [len(ids)], data


@pytest.mark.parametrize("limit", [4, 6, 16])
def test_huffman_round_trip(limit):
    r = np.random.default_rng(limit)
    counts = np.concatenate((2 ** r.integers(0, 30, 12), [0, 0, 1]))
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and (lengths[counts > 0] > 0).all() and (2.0**-used).sum() == 1
    book = huffman.Codebook(lengths)
    for n in (0, 1, 7, 5000):
        ids = r.choice(np.flatnonzero(counts), n)
        data, marks = book.encode(ids, 64)
        assert book.decode(data, marks, n, 64).tolist() == ids.tolist()


def test_huffman_of_one_symbol():
    book = huffman.Codebook(huffman.code_lengths(np.array([0, 5]), 16))
    data, marks = book.encode(np.array([1, 1, 1]), 2)
    assert book.decode(data, marks, 3, 2).tolist() == [1, 1, 1]


PERSONAL = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f x@y z@q.com é a@b.c@d.e %@a.b"), (None, "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.003.004 1.2.3 " * 3),
    (5, "4532015112830366 4532-0151-1283-0366 45320151128303660 +1 (509) 555-6973 +49 30 1234 +123456789012345678 " + "1" * 30000),
    (5, 'é +1 (509) 555-6973, token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" 2024-01-01 10'), (7, "@" * 3000 + " a." * 500 + "x" * 20000 + "@q")]


def test_personal(spark, docs):
    odd = spark.createDataFrame(PERSONAL, "doc_id long, text string")
    for df in (odd, docs):
        got = pii.pii_digest(df).collect()
        want = [(d, *brute.personal(t)[0]) for d, t in rows_of(df)]
        assert ordered(tuple(r)[:6] for r in got) == ordered(want)
    texts = dict(rows_of(docs))
    for r in pii.pii_digest(docs.filter("doc_id is not null and doc_id != 7")).collect():
        assert set(brute.personal(texts[r.doc_id])[1]) <= set(r.spans.split(","))


def test_redaction_masks_base_spans_and_secrets(spark):
    rows = [(d, t, "x", 9) for d, t in PERSONAL]
    got = {(r.doc_id, (r.text or "")[:1]): r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, kind string, start long")).collect()}
    assert got[5, "é"].text == 'é [PHONE], token = "[SECRET]" 2024-01-01 10' and got[5, "é"].start == 9
    assert got[1, ""].text is None and got[3, "["].text == "[EMAIL][EMAIL] x@y [EMAIL] é [EMAIL]@d.e [EMAIL]"


def test_labelers_are_told_apart():
    """A labeler that contradicts the others loses weight."""
    patterns = [((1, 1, 1, 0, 0, 0), "a:0", 90), ((-1, -1, -1, 0, 0, 0), "a:0", 90), ((1, 1, -1, 0, 0, 0), "a:0", 30), ((-1, -1, 1, 0, 0, 0), "a:0", 30)]
    right, posterior = pii.fit_labelers(patterns)
    assert right["gazetteer"] < right["pattern"] and posterior[2] > 0.5 > posterior[3]


LICENSES = [
    (1, None), (2, ""), (4, "under the MIT license. Under the mit License cc by-nc; Apache License, Version 2"), (4, "under the MIT license. Under the mit License cc by-nc; Apache License, Version 2"),
    (None, "x " * 9 + licenses.NOTICES[1][0].replace("copy of", "whole copy of", 1)), (6, "license under the mit"), (7, "This work is licensed under the GNU General Public License, version 3.")]


def test_licenses(spark, docs):
    odd = spark.createDataFrame(LICENSES, "doc_id long, text string")
    for df in (odd, docs):
        got = licenses.license_digest(df).collect()
        assert ordered(tuple(r)[:6] for r in got) == ordered((d, *brute.licenses(t, licenses.PHRASES)) for d, t in rows_of(df))
        assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)
    found = {r.doc_id: r for r in licenses.license_digest(odd).collect()}
    assert found[None].labels == "mit" and found[None].n_base == 0 and found[7].labels == "gpl-3" and found[6].labels == ""


ITEMS = [(1, "one two"), (2, "three"), (3, None), (4, ""), (5, "a b c d e f g h i j k l a"), (6, "x"), (5, "one two three four five six seven eight nine ten"), (None, "yy zed the of")]


def test_contamination(spark, docs):
    odd = spark.createDataFrame([(1, None), (2, ""), (5, "One two"), (6, "alpha one two one, two-three"), (7, "a b c d e f g h i j k l " * 50), (7, "x"), (None, "x")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    given = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    for df, bench in ((odd, items), (docs, items), (docs, given), (odd, items.limit(0))):
        want = [(d, *r) for d, *r in brute.contamination(rows_of(df), [(("" if i is None else i), t) for i, t in map(tuple, bench.collect())])]
        assert ordered(decontam.contamination_digest(df, bench).collect()) == ordered(want)


def test_every_query_has_the_columns_of_its_contract(spark):
    want = {
        "op1": "doc_id n_shingles component_id", "op2": "doc_id n_words n_removed kept_sha256", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6": "doc_id n_bytes n_removed n_spans kept_sha256", "op7": "doc_id start n_tokens ids_crc32",
        "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op9": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op10": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3": "doc_id"}
    for name, query in queries.QUERIES.items():
        columns = query(spark, SMALL).columns
        assert set(want[name.split("_")[0]].split()) <= set(columns), name


def test_scores_keep_rare_contexts(spark):
    """A passage seen twice counts, however many other bytes were trained; before, entries under 2**-20 of them went."""
    train, held = [[i for i in range(1, 300) if brute.held_out(i) == h] for h in (False, True)]
    rows = [(train[0], "ab cd " * 400_000), (train[1], "the quixotic zephyr"), (train[2], "the quixotic zephyr"), (held[0], "the quixotic zephyr ab"), (held[1], "unknown")]
    got = {r.doc_id: r.score for r in ppm.score_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute.scores(rows, ppm.ORDER)}, rel=1e-9)


@pytest.mark.parametrize("limit", [0, 2])
def test_repeats_of_hot_anchors(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "HOT_ROWS", limit)
    for seed in (3, 8):
        docs = spark.createDataFrame(made(200, seed), SCHEMA)
        assert ordered(substring.substring_digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(brute.substrings(rows_of(docs)))
        assert ordered(suffix.suffix_digest(docs).collect()) == ordered(brute.suffixes(rows_of(docs)))


def test_no_group_holds_all_surroundings_of_a_passage(spark):
    """Before, all rows of an anchor came to one call: 3000 here."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, " ".join([*(f"a{i}x{j}" for j in range(30)), passage, *(f"b{i}x{j}" for j in range(30))]), i) for i in range(3000)], "doc_id long, text string, key long")

    def largest(table):
        n = int(np.unique(table.column("anchor").to_numpy(), return_counts=True)[1].max())
        return __import__("pyarrow").table({"key": [-1], "start": np.array([0], "i4"), "end": np.array([n], "i4")})

    got = repeats.repeated_spans(docs, repeats.Kind("word", 35, 8, True), 1, largest).cache()
    assert max([r.end for r in got.filter("key < 0").collect()], default=0) <= repeats.HOT_ROWS
    covered = got.filter("key >= 0").select("key", F.explode(F.sequence("start", F.col("end") - 1)).alias("word")).distinct()
    assert covered.filter("word between 30 and 89").count() == 3000 * 60 and covered.count() == 3000 * 60


def test_keys_are_unique_however_many_rows_share_an_id(spark):
    """Before, an id of more than 2**20 rows ran into the keys of the next id."""
    many = spark.range((1 << 20) + 50).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    docs = many.union(spark.createDataFrame([(8 + i, "y") for i in range(99)] + [(None, "z")] * 3, "doc_id long, text string"))
    rows, divisor = keyed(docs)
    n, keys = rows.agg(F.count("*"), F.countDistinct("key")).first()
    assert n == keys == (1 << 20) + 152
    place = {r.doc_id: (r.a, r.b) for r in rows.withColumn("p", F.floor(F.col("key") / divisor)).groupBy("doc_id").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()}
    order = [place[d] for d in (*range(7, 107), None)]
    assert all(a == b for a, b in order) and order == sorted(set(order))


def test_secrets_without_digits_are_candidates(spark):
    """Before, a text without a digit or an address had no candidates."""
    docs = spark.createDataFrame([(1, "password: abcdefghijklmnopqrstuvwxyz"), (2, "token=ABCDEFGHIJKLMNOPQRST end"), (3, "short words")], "key long, text string")
    got = {r.key: r for r in pii.votes(pii.candidates(docs)).collect()}
    assert {k: (r.kind, r.match, r.v_secret_context) for k, r in got.items()} == {1: ("secret", "abcdefghijklmnopqrstuvwxyz", 1), 2: ("secret", "ABCDEFGHIJKLMNOPQRST", 1)}
    assert [r.key for r in docs.filter(pii.may_hold(F.col("text"))).orderBy("key").collect()] == [1, 2]


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "mail bob@example.com now", 5, 6, None), (2, None, 7, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ long, __ long, key string")
    got = {r.doc_id: tuple(r) for r in pii.redact(docs).collect()}
    assert got == {1: (1, "mail [EMAIL] now", 5, 6, None), 2: (2, None, 7, 8, "x")}


def test_the_bitmap_of_edge_anchors_follows_their_number(spark, monkeypatch):
    """Before, it had one size; as it filled up, the content of all runs was sent as if they were edges."""
    monkeypatch.setattr(repeats, "EDGE_BITS", 1 << 8)
    edge = spark.range(3000).select((F.col("id") * 7919).alias("anchor"), F.lit(0).alias("end"))
    known = repeats._edge_bits(edge)
    assert len(known) * 64 == 1 << 16 and len(repeats._edge_bits(edge.limit(0))) * 64 == 1 << 8
    set_bits = int(np.unpackbits(known.view(np.uint8)).sum())
    assert 2700 < set_bits <= 3000
    monkeypatch.setattr(repeats, "MOST_EDGE_BITS", 1 << 10)
    assert len(repeats._edge_bits(edge)) * 64 == 1 << 10
