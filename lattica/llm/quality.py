"""Quality rules: base counts, and how far a document's histograms lie from its language's.

A document's histogram of character classes and that of its language's common
words are compared, by Jensen-Shannon distance, with those of all documents of
the language that pass the base rules. Too short a text is not judged by a histogram. DataFrame
functions only: one pass over the texts makes a narrow table of counts; the
references (a row for each known language, and one for all others) are sums of
it and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

SPACE = r"[\x20\x09-\x0D]"
# Frequent function words, with which languages are told apart.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des ein".split(),
    "en": "the of and to in a is that for it was on".split(),
    "es": "de la que el en y a los se del las un".split(),
    "fr": "de la le et les des en un du que est pour".split(),
}
OTHER = "other"
SHARED_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
LEAST_WORDS, MOST_REPEATED = 20, 30  # percent
#: Below these lengths a histogram says nothing of a text.
LEAST_CHARS_JUDGED, LEAST_WORDS_JUDGED = 200, 100
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.29, 0.23


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and counts of each row's text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strip = lambda c, rx: F.regexp_replace(c, rx, "")
    lang = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(OTHER)
    # What is left after each strip; the first takes most characters, so the others are cheap.
    a = docs.select("doc_id", lang.alias("lang"), text.alias("text"))
    a = a.withColumn("t1", strip(F.col("text"), "[a-z]+")).withColumn("t2", strip(F.col("t1"), f"{SPACE}+")).withColumn("t3", strip(F.col("t2"), "[A-Z]+"))
    a = a.withColumn("t4", strip(F.col("t3"), "[0-9]+")).withColumn("t5", strip(F.col("t4"), r"[\x00-\x7F]+"))
    n = lambda c: F.length(c).cast("long")
    classes = [n("text") - n("t1"), n("t1") - n("t2"), n("t2") - n("t3"), n("t3") - n("t4"), n("t4") - n("t5"), n("t5")]
    trimmed = F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))).withColumn("lines", lines)
    a = a.select(
        "doc_id", "lang", "words", F.array(*classes).alias("chars"), F.size("words").cast("long").alias("n_words"),
        (n("text") - (n("t1") - n("t2"))).alias("word_chars"), n(strip(F.col("t4"), r"[^#*$%&|<>]+")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hits = F.filter(F.transform("words", F.lower), lambda w: w.isin(SHARED_WORDS))
    own = F.lit(None).cast("array<string>")
    for k, words in COMMON_WORDS.items():
        own = F.when(F.col("lang") == k, F.array(*map(F.lit, words))).otherwise(own)
    own = F.coalesce(own, F.array(*map(F.lit, SHARED_WORDS)))
    a = a.withColumn("hits", hits).withColumn("windows", F.when(F.col("n_words") >= 8, F.expr("transform(sequence(1, int(n_words) - 7), i -> xxhash64(slice(words, i, 8)))")))
    counted = F.transform(own, lambda c: F.size(F.filter("hits", lambda w: w == c)).cast("long"))
    return a.select("doc_id", "lang", "chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", counted.alias("common"), repeated_words(F.col("windows"), 8).alias("n_repeat_words"))


def repeated_words(windows: Column, words: int) -> Column:
    """Words covered by windows (hashes in order) that occur twice or more; 0 for null.

    Sorting pairs of hash and place sets equal windows side by side; the places of
    those, sorted again, cover up to ``words`` words each. Only texts with a
    repeat get that far.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def sides(p: Column) -> Column:
        keep = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(keep, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-words).alias("last"), F.lit(0).cast("long").alias("sum")), lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(words), i - s["last"])).alias("sum")), lambda s: s["sum"])

    # Bound once by a one-element transform: else each use would be worked out anew.
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    distinct = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(distinct, bound(pairs, lambda p: covered(sides(p)))).otherwise(F.lit(0).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts; null where either sums to 0."""
    share = lambda c: F.transform(c, lambda x: F.try_divide(x, F.aggregate(c, F.lit(0).cast("double"), lambda s, y: s + y)))
    term = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    terms = F.zip_with(share(a), share(b), lambda p, q: (term(p, q) + term(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, most_char_distance: float = MOST_CHAR_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE) -> DataFrame:
    """Counts, distances and verdict for every row of docs.

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows.
    kept: passes those, and lies within both distances of its language, where the
    text is long enough for the histogram. Null and empty texts fail; a null or
    unknown language is held against all such documents. The references are sums
    over the rows that pass the base rules; a language without any judges nobody by
    histograms. Repeated rows are judged alike; null ids are kept; texts of any
    length are counted whole. Other columns are not read.
    """
    counts = cut(base_counts(docs).withColumn("base_failed", base_failed()))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    n_common = F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)
    words = F.concat(F.col("common"), F.array(F.greatest(F.col("n_words") - n_common, F.lit(0).cast("long"))))
    rows = counts.withColumn("words", words)
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(n)])
    widest = max(len(SHARED_WORDS), *map(len, COMMON_WORDS.values())) + 1
    refs = rows.filter(~F.col("base_failed")).groupBy("lang").agg(sums("chars", 6).alias("ref_chars"), sums("words", widest).alias("ref_words"))
    refs = refs.withColumn("ref_words", F.filter("ref_words", lambda x: x.isNotNull()))
    rows = rows.join(F.broadcast(refs), "lang", "left")  # at most a row for each known language and one more
    rows = rows.withColumn("char_distance", F.when(n_chars >= LEAST_CHARS_JUDGED, distance(F.col("chars"), F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS_JUDGED, distance(F.col("words"), F.col("ref_words"))))
    failed = F.col("base_failed")
    far = (F.coalesce("char_distance", F.lit(0.0)) > most_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > most_word_distance)
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & ~far).alias("kept"), "char_distance", "word_distance")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "char_distance", "word_distance")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base counts alone, which SQL can express."""
    counts = base_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w),
counts AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""
