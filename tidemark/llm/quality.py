"""Quality rules: fixed text rules and a hashed n-gram likelihood ratio, all in DataFrame functions.

The ratio compares two multinomials over ``BUCKETS`` hashed features (words and word pairs): the trusted
target (documents labelled good and not toxic) and the raw corpus (all documents). Both are counted over
whole texts and all rows, with one added to each bucket. A document's score is the sum over its
features of log p(target) / p(raw), divided by their number; it is kept from ``THRESHOLD`` on.
The weights are whole numbers (millionths), so a score does not depend on the order of rows or tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

BUCKETS = 1 << 14
THRESHOLD = -0.07  # nats per feature
UNIT = 1_000_000
WINDOW = 8
SPACE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where Catalyst copies the expression into filters."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs without ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def hashes(text: Column) -> Column:
    """A hash of each word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def pairs(h: Column, step: int = 1) -> Column:
    """Hash of each element of ``h`` with the one ``step`` further on."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.least(F.lit(1 + step), F.size(h) + 1), n), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def repeated_words(windows: Column) -> Column:
    """Words covered by windows (hashes, one for each first word) that occur more than once."""

    def covered(s: Column) -> Column:  # windows in order of hash: those equal to a neighbour, by place
        equal = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        again = F.transform(s, lambda x, j: F.when(equal(x, j - 1) | equal(x, j + 1), x["i"]))
        at = F.array_sort(F.filter(again, lambda i: i.isNotNull()))
        step = lambda p: F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW))))
        return let(at, lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda t, x: t + x))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, covered)).otherwise(F.lit(0).cast("long"))


def facts(text: Column, h: Column, h2: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text, given its word and pair hashes."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return [
        F.size(h).cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(pairs(h2, 2), lambda h4: let(pairs(h4, 4), repeated_words)).alias("n_repeat_words"),
    ]


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, weight): log ratio of the smoothed target and raw frequencies in millionths; one row per bucket seen."""
    ids = trusted.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().withColumn("_good", F.lit(1))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(ids.hint("merge"), "_id", "left")  # labels grow with the documents: never broadcast
    features = let(hashes(F.col("_text")), lambda h: F.transform(F.concat(h, pairs(h)), bucket))
    counts = rows.select(F.explode(features).alias("bucket"), "_good").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    counts = materialize(counts, "counts")
    totals = counts.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))  # one row
    ratio = F.log((F.col("good") + 1) / (F.col("goods") + BUCKETS)) - F.log((F.col("raw") + 1) / (F.col("raws") + BUCKETS))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.when(F.col("goods") > 0, F.round(ratio * UNIT).cast("long")).otherwise(F.lit(0)).alias("weight"))


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, ``score``
    (nats per feature, null without words) and ``kept``.

    ``trusted`` holds ids of the target documents; without any the ratio decides nothing. Null texts have no
    words and fail; null and repeated ids are rows like any other. Column names starting with _ are reserved.
    """
    table = materialize(weights(docs, trusted, id_col, text), "weights")
    # One row of at most BUCKETS numbers, in order of bucket; buckets never seen are not asked for.
    dense = (
        table.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(table, "bucket", "left")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0)).alias("weight")))), lambda x: x["weight"]).alias("_weights"))
    )

    def verdict(h: Column, h2: Column) -> Column:
        total = F.aggregate(F.concat(h, h2), F.lit(0).cast("long"), lambda s, x: s + F.get("_weights", bucket(x)))
        return F.struct(*facts(F.col(text), h, h2), total.alias("total"), (F.size(h) + F.size(h2)).cast("long").alias("n"))

    v = let(hashes(F.col(text)), lambda h: let(pairs(h), lambda h2: verdict(h, h2)))
    failed = lambda v: (v["n_words"] < 20) | (100 * v["n_repeat_words"] > 30 * v["n_words"])
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    v = let(v, lambda v: F.struct(
        *(v[c].alias(c) for c in fields),
        failed(v).alias("base_failed"),
        F.when(v["n"] > 0, v["total"] / v["n"] / UNIT).alias("score"),
        (~failed(v) & (v["total"] >= int(THRESHOLD * UNIT) * v["n"])).alias("kept"),
    ))
    names = [*fields, "base_failed", "score", "kept"]
    out = docs.crossJoin(F.broadcast(dense)).withColumn("_v", v)
    return out.withColumns({c: F.col(f"_v.{c}") for c in names}).drop("_v", "_weights")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
