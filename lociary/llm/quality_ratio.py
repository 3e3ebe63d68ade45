"""Quality rules: fixed measures of a text, then a hashed n-gram log-likelihood ratio of trusted against raw text.

The words and neighbouring word pairs of a text are hashed into buckets. Two multinomials over the buckets are counted
from whole tables: the target from the documents whose every label trusts them, the raw one from all documents; both are
drawn together by ``PRIOR`` target counts a bucket, so that a bucket seen seldom says little. A text's score is the mean,
over its n-grams, of log(target / raw) of their buckets: the importance weight of sampling towards the target, normalised
by length. Every text is judged by the same bound, without a draw. The logarithms are rounded to millionths once, so that sums are whole numbers and no order of adding matters.

All of it is DataFrame functions: one scan counts, a second one scores, and the only shuffle is that of partial counts
per bucket. The weights, ``buckets`` whole numbers, come to the second scan as the value of a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociary.llm.common import store
from lociary.operators.keyed import attach

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed values: the characters counted as symbols
BUCKETS = 1 << 16
PAIR = 40503
PRIOR = 16
BOUND = -0.08  # nats an n-gram: where good texts end even if the counts come from a few hundred texts only
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SCALE = 1_000_000


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words that stand in a window of 3 words found twice or more."""

    def covered(starts: Column) -> Column:
        """Places within 3 of a start, of starts in rising order."""
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def starts_of_repeated(windows: Column) -> Column:
        """Of windows as (hash, start), sorted: the starts of those whose hash stands twice."""
        def told(window: Column, k: Column) -> Column:
            hash_ = window["h"]
            return F.when((F.get(windows, k - 1)["h"] == hash_) | (F.get(windows, k + 1)["h"] == hash_), window["i"])

        return F.array_sort(F.array_compact(F.transform(windows, told)))

    def counted(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(_with(_with(F.sort_array(windows), starts_of_repeated), covered))

    return _with(words, counted)


def repeated_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _with(lines, lambda l: (F.size(l) - F.size(F.array_distinct(l))).cast("long"))


def bucket_hashes(words: Column, buckets: int) -> Column:
    """The bucket of every word, from the crc32 of its bytes, and of every two neighbours, from both of these."""

    def both(crcs: Column) -> Column:
        pairs = F.zip_with(F.slice(crcs, 1, F.greatest(F.size(crcs) - 1, F.lit(0))), F.slice(crcs, 2, F.size(crcs)), lambda a, b: (PAIR * a + b) % buckets)
        return F.concat(F.transform(crcs, lambda c: c % buckets), pairs)

    return F.transform(_with(F.transform(words, lambda w: F.crc32(F.encode(w, "UTF-8"))), both), lambda b: b.cast("int"))


def trusted(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose every label of ``labels (doc_id, quality)`` is 1; null labels do not count."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def bucket_weights(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, weight``: millionths of log(target / raw) of every bucket, counted over all ``docs (doc_id, text)``.

    Without any trusted n-gram all weights are 0: nothing is known.
    """
    marked = trusted_ids.select("doc_id", F.lit(1).alias("in_target"))
    texts = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), marked, ["doc_id"], "left")
    grams = texts.select("in_target", F.explode(bucket_hashes(words_of("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("in_target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = store(every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"]), "buckets")
    total = filled.agg(F.sum("raw"), F.sum("target")).first()
    expected = F.col("raw") * (total[1] or 0) / float(total[0] or 1)
    ratio = F.log((F.col("target") + PRIOR) / (expected + PRIOR))
    return filled.select("bucket", F.round(ratio * SCALE).cast("int").alias("weight"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: float = BOUND) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` per row of ``docs (doc_id, text)``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. ``score`` is the mean
    log ratio in nats an n-gram, null without words; ``kept`` needs the base rules and a score of ``bound`` or more.

    Null and empty texts have no words and fail the base rules. A null id stays null and is never trusted; repeated rows
    stay as many rows and count as often. Other columns are ignored; an empty table gives an empty table.
    """
    weights = store(bucket_weights(docs, trusted(labels), buckets), "weights")
    table = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w")).scalar()
    text = F.coalesce("text", F.lit(""))

    def judged(words: Column) -> Column:
        hashes = bucket_hashes(words, buckets)
        total = F.aggregate(hashes, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get("weights", b))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"), total.alias("total"))

    measured = docs.select("doc_id", "text", table.alias("weights")).select(
        F.col("doc_id").cast("long").alias("doc_id"), _with(words_of(text), judged).alias("j"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), repeated_lines(text).alias("n_dup_lines"),
    )
    n = F.col("j.n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("j.n_repeat_words") > MAX_REPEATED_PERCENT * n)
    grams = 2 * n - 1
    enough = F.col("j.total") >= F.ceil(F.lit(bound * SCALE)).cast("long") * grams
    return measured.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("j.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & enough).alias("kept"), F.when(n > 0, F.col("j.total") / (grams * SCALE)).alias("score"),
    )
