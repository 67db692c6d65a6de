"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and its histogram of common words are compared with the
references of its language by Jensen-Shannon distance (base 2, 0 to 1). References are sums over
all documents of the language, one row each. Each test has a guard: below its least number of words
a histogram says too little and the test is passed. A base rule rejects texts under 50 words and
texts that mostly repeat their own word triples.

Null and empty texts have no words and fail the base rule. A language that is null or has no word
list is judged by character classes alone. Each row gives one row; repeated rows count each. Other
columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import durable

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
#: Least words and largest distance of the two tests.
CLASS_WORDS, CLASS_DISTANCE = 80, 0.25
COMMON_WORDS, COMMON_DISTANCE = 100, 0.3

# Frequent words of the languages.
COMMON = {
    "en": "the of and to a in is that it for was on are with as be this have from or by not but at",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un une du dans est que pour qui sur pas plus par au avec il ne se",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}
#: Character classes that are counted; besides them white space, continuation bytes of characters beyond ASCII, and the others.
CLASSES = ["A-Z", "0-9", r".,;:!?'\"()\-", "#*$%&|<>"]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that stands twice or more in the text."""

    def marked(triples: Column) -> Column:
        ordered = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda e, k, step: F.coalesce(F.get(s, k + step)["h"] == e["h"], F.lit(False))
            found = F.filter(F.transform(s, lambda e, k: F.when(same(e, k, 1) | (F.when(k > 0, same(e, k, -1)).otherwise(False)), e["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(triples)) == F.size(triples), 0).otherwise(let(ordered, covered))

    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0))), marked))


def without(text: Column, characters: str) -> Column:
    """Code points of the text that are none of ``characters``."""
    return F.length(F.regexp_replace(text, f"[{characters}]+", "")).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The base figures; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {"_base": words, "n_dup_lines": lines.cast("long")}


def class_histogram(text: Column) -> Column:
    """CLASSES in their order, white space, continuation bytes, and all other code points."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text).cast("long")
    counts = F.array(*[size - without(text, c) for c in CLASSES], size - without(text, r"\x20\x09-\x0D"), F.octet_length(text) - size)
    return let(counts, lambda n: F.transform(F.concat(n, F.array(F.greatest(F.lit(0), size - F.aggregate(n, F.lit(0).cast("long"), lambda a, b: a + b)))), lambda v: v.cast("double")))


def common_histogram(text: Column, lang: Column) -> Column:
    """How often each common word of the language stands in the text, and all other words; null without a list."""
    every = sorted({w for line in COMMON.values() for w in line.split()})
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?]+")

    def count(words: Column) -> Column:
        known = F.filter(words, lambda w: w.isin(every))

        def of(k: Column) -> Column:
            own = F.transform(lists[lang], lambda v: (F.size(k) - F.size(F.array_remove(k, v))).cast("double"))
            return let(own, lambda o: F.concat(o, F.array(F.size(words) - F.aggregate(o, F.lit(0.0), lambda a, b: a + b))))

        return let(known, of)

    return F.when(lists[lang].isNotNull(), let(found, count))


def total(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0.0), lambda a, b: a + b)


def js_distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two histograms over the same bins; null where one is empty."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    ratio = lambda h: let(total(h), lambda t: F.transform(h, lambda v: F.try_divide(v, t)))
    terms = F.zip_with(ratio(one), ratio(other), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.when((total(one) > 0) & (total(other) > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms))))


def measured(docs: DataFrame, *carry: str, base: bool = True) -> DataFrame:
    """The carried columns with histograms and, if wanted, base figures of each row.

    The figures pass a generator as one struct, so that later filters and projections read them
    instead of computing them again.
    """
    text, lang = F.col("text"), F.coalesce(F.col("lang"), F.lit(""))
    figures = {"_lang": lang, "_chars": F.length(F.coalesce(text, F.lit(""))).cast("long"), "_classes": class_histogram(text), "_common": common_histogram(text, lang)}
    figures |= base_columns(text) if base else {}
    return docs.select(*carry, F.explode(F.array(F.struct(*[c.alias(n) for n, c in figures.items()]))).alias("_m")).select(*carry, "_m.*")


def language_references(rows: DataFrame) -> DataFrame:
    """(ref_lang, ref_classes, ref_common): sums over all documents of a language, a written table of one row each."""
    common = max(len(v.split()) for v in COMMON.values()) + 1
    sums = lambda column, n: F.array(*[F.coalesce(F.sum(F.get(F.col(column), F.lit(i))), F.lit(0.0)) for i in range(n)])
    return durable(rows.groupBy(F.col("_lang").alias("ref_lang")).agg(sums("_classes", len(CLASSES) + 3).alias("ref_classes"), sums("_common", common).alias("ref_common")), "references")


def judge(rows: DataFrame, references: DataFrame) -> DataFrame:
    """The figures, both distances, base_failed and kept of rows that have histograms and base columns.

    The references are written tables, so Spark knows their size and sends them to the documents
    while they are small; texts are not shuffled.
    """
    rows = rows.join(references, F.col("_lang") == F.col("ref_lang"), "left")
    rows = rows.withColumns({
        "n_words": F.col("_base")["n"], "n_repeat_words": F.col("_base")["repeated"], "n_symbols": F.get("_classes", F.lit(3)).cast("long"),
        "word_chars": F.col("_chars") - F.get("_classes", F.lit(4)).cast("long"),
        "class_distance": js_distance(F.col("_classes"), F.col("ref_classes")),
        "common_distance": js_distance(F.col("_common"), F.slice("ref_common", F.lit(1), F.greatest(F.size("_common"), F.lit(0))))})
    far = lambda d, limit, least: F.coalesce((F.col("n_words") >= least) & (F.col(d) > limit), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    diverges = far("class_distance", CLASS_DISTANCE, CLASS_WORDS) | far("common_distance", COMMON_DISTANCE, COMMON_WORDS)
    return rows.withColumns({"base_failed": failed, "kept": ~(failed | diverges)})


def quality_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, common_distance).

    Texts are read once; what is measured of them is a written table.
    """
    rows = durable(measured(docs, "doc_id"), "measured")
    return judge(rows, language_references(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Their texts are read twice and never shuffled."""
    references = language_references(measured(docs.select("text", "lang"), base=False))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(measured(docs.select(own.alias("_row"), "text", "lang"), "_row"), references).filter("kept").select("_row.*")
