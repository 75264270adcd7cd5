"""Quality rules: measures of each whole text, and the log-likelihood ratio of its hashed n-grams under a trusted and a raw model.

All is DataFrame expressions. Texts are never shuffled: counts of buckets are
pre-aggregated where the texts are, and the ratios of all buckets come back as
one array of a fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, let, words

#: Characters that count as symbols; fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Found in a line that has a word.
WORD = r"[^\x20\x09-\x0D]"
BUCKETS = 1 << 16
#: Pseudo-count of a bucket in either model; the raw model is scaled to the trusted one's size first.
SMOOTH = 5.0
#: A text is rejected if its mean log ratio per n-gram is lower; clean text of any language is near zero.
THRESHOLD = -0.19
#: So many labelled documents at most, those with the smallest ids, make the trusted model: a documented bound, so that they can be broadcast.
TRUSTED = 50_000
WINDOW = 5


def hashed(w: Column) -> Column:
    """The hash of each word."""
    return F.transform(w, lambda x: F.xxhash64(x))


def paired(w: Column) -> Column:
    """The hash of each pair of neighbouring words."""
    return F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, k: F.xxhash64(F.get(w, k), x))


def repeated_words(one: Column, two: Column) -> Column:
    """How many words lie in windows of five words that are found twice or more, from the hashes of words and of pairs."""

    def heavy(hashes: Column) -> Column:
        def marked(s: Column) -> Column:
            twin = lambda e, k: (F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"]))
            places = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["k"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return let(F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k")))), marked)

    fifth = F.slice(one, WINDOW, F.greatest(F.size(one) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(fifth, lambda x, k: F.xxhash64(F.get(two, k), F.get(two, k + 2), x))
    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), heavy(x)).otherwise(0))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame) -> Column:
    """One array: for each bucket the log of its probability in the trusted documents over that in all documents."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().orderBy("id").limit(TRUSTED)
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"))
    grams = let(words(F.col("text")), lambda w: F.concat(hashed(w), paired(w)))
    marked = own.join(F.broadcast(trusted), F.col("own_id") == F.col("id"), "left").select(F.when(F.col("id").isNotNull(), 1).otherwise(0).alias("t"), F.explode(grams).alias("h"))
    counts = marked.groupBy(bucket(F.col("h")).alias("bucket")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["t", "r"])
    packed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("b"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    share = F.col("nt") / F.greatest("nr", F.lit(1))
    return packed.select(F.transform("b", lambda x: F.log((x["t"] + SMOOTH) / (x["r"] * share + SMOOTH))).alias("ratios")).scalar()


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs` and last a struct `measured`: the base measures, base_failed, ratio (mean log ratio) and kept.

    Null texts and texts without words have no words, fail the base rule and have ratio 0. Rows are judged one by one, repeated or not;
    null ids are raw documents only. Without any trusted document both models are equal and every ratio is 0. `docs` may have any other
    columns; if one is named measured, the struct's name has as many underscores after it as make it differ.
    """
    name = free("measured", docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measures(w: Column) -> Column:
        return let(hashed(w), lambda one: let(paired(w), lambda two: measured(w, one, two)))

    def measured(w: Column, one: Column, two: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        # the array of ratios is bound once; summed over words first, then over pairs
        total = lambda r: F.aggregate(two, F.aggregate(one, F.lit(0.0), lambda a, h: a + F.get(r, bucket(h))), lambda a, h: a + F.get(r, bucket(h)))
        mean = let(F.col(name), lambda r: F.when(F.size(w) == 0, 0.0).otherwise(total(r) / (F.size(one) + F.size(two))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(one, two).cast("long").alias("n_repeat_words"),
            mean.alias("ratio"),
        )

    # a subquery can't stand in a lambda itself; the optimiser moves it there, so the array is in no row
    found = docs.withColumn(name, log_ratios(docs, labels)).withColumn(name, let(words(text), measures))
    m = F.col(name)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    found = found.withColumn(name, m.withField("base_failed", failed))
    return found.withColumn(name, m.withField("kept", ~m["base_failed"] & (m["ratio"] >= THRESHOLD)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""
    found = quality(docs, labels)
    # generated and not filtered: a filter would be moved below the measures and take them once for each of its conditions
    kept = F.explode(F.when(F.col(found.columns[-1])["kept"], F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias(free("kept", docs))
    return found.select(*docs.columns, kept).select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    return found.select("doc_id", *(F.col(found.columns[-1])[n].alias(n) for n in names))
