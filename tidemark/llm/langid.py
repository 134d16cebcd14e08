"""Language by prediction by partial matching: code lengths under per-language byte context trees.

Each language has a tree of contexts of 0 to ``ORDER`` bytes with the counts of the bytes that follow (of lower-cased
UTF-8, all training documents). The probability of a byte is taken in the longest context seen; a byte not
seen there costs an escape to the next shorter context, with probability d / (n + d) for d different bytes in n; below
all contexts every byte has 8 bits. The statistics are frozen, so the bits of a byte depend on it and
``ORDER`` bytes before it only: they are tabled once, and a text's code length is a sum of table values.
A language's share of 2^-bits is the score.

The tables are sent to all tasks while they have at most ``ROWS`` rows; beyond, the texts' n-grams are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

ORDER = 3  # with one more byte an n-gram fills 32 bits
ROWS = 1_000_000
SLICE = 1 << 18  # bytes looked up together
PAD = b"\0" * ORDER


def parts(texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, where each begins, n-grams): whole texts in slices, each byte with ORDER bytes before it."""
    held, which, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
        g = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        ends = np.cumsum([len(x) for x in held])
        real = np.ones(len(data), bool)
        for i in range(ORDER):
            real[np.r_[0, ends[:-1]] + i] = False
        counts = [len(x) - ORDER for x in held]
        return which, np.r_[0, np.cumsum(counts)[:-1]], g[real[3:]]

    for i, text in enumerate(texts):
        data = PAD + (text or "").lower().encode("utf-8", "replace")
        for at in range(0, len(data) - ORDER, SLICE):
            part = data[at : at + SLICE + ORDER]
            held.append(part)
            which.append(i)
            size += len(part)
            if size > SLICE:
                yield flush()
                held, which, size = [], [], 0
    if held:
        yield flush()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of a partition, merged in bounded memory."""
    sums: dict[str, list] = {}
    held = 0

    def merged(pairs):
        grams, where = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([n for _, n in pairs])).astype(np.int64)

    def rows():
        for lang, pairs in sums.items():
            grams, n = merged(pairs)
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for _, _, g in parts(texts):
                found = np.unique(g, return_counts=True)
                sums.setdefault(lang, []).append(found)
                held += len(found[0])
                if len(sums[lang]) > 32:
                    sums[lang] = [merged(sums[lang])]
        if held > 1 << 26:
            yield from rows()
            sums, held = {}, 0
    yield from rows()


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``train`` (text, lang)."""
    return train.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics: ``langs``, and tables of bits with one value for each language."""

    def __init__(self, langs: list[str], costs: DataFrame, escapes: DataFrame):
        self.langs, self.costs, self.escapes = langs, costs, escapes


def fit(train: DataFrame) -> Model:
    """``costs`` (order, key, bits): bits of the last byte of each n-gram seen in some language;
    ``escapes`` (order, key, bits): bits of an escape from each context seen, 0 in languages without it."""
    counts = materialize(gram_counts(train), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # labels, a handful
    if not langs:
        return Model([], None, None)
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    counts = counts.withColumn("l", place.cast("int"))
    every = F.sequence(F.lit(0), F.lit(len(langs) - 1))
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    costs, escapes, lower = [], [], None
    for order in range(ORDER + 1):
        own = counts.groupBy("l", F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        own = materialize(own.withColumn("context", F.shiftright("key", 8)), "order")
        seen = own.groupBy("l", "context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        seen = materialize(seen.withColumn("total", F.col("all") + F.col("kinds")), "contexts")
        bits = own.join(seen, ["l", "context"]).withColumn("bits", log2(F.col("total") / F.col("n")))
        pick = lambda value: F.map_from_entries(F.collect_list(F.struct("l", value))).alias("m")
        cost = bits.groupBy("key", "context").agg(pick("bits"))
        escape = seen.withColumn("bits", log2(F.col("total") / F.col("kinds"))).groupBy("context").agg(pick("bits"))
        escape = escape.select("context", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("escape"))
        escape = materialize(escape, "escape")
        cost = cost.join(escape, "context").withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * order) - 1))
        if lower is None:
            cost = cost.withColumn("lower", F.transform(every, lambda i: F.lit(8.0)))
        else:  # the shorter n-gram was seen wherever the longer one was
            cost = cost.join(lower.select(F.col("key").alias("suffix"), F.col("bits").alias("lower")), "suffix")
        full = F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.get("escape", i) + F.get("lower", i)))
        lower = materialize(cost.select("key", full.alias("bits")), "bits")
        costs.append(lower.withColumn("order", F.lit(order)))
        escapes.append(escape.select(F.col("context").alias("key"), F.col("escape").alias("bits"), F.lit(order).alias("order")))
    both = []
    for frames in (costs, escapes):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        both.append(out)
    return Model(langs, *both)


def _table(frame: DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order sorted keys and their bits. The caller has checked the size."""
    pdf = frame.select("order", "key", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(width))).toPandas()
    out = []
    for order in range(ORDER + 1):
        rows = pdf[pdf["order"] == order].sort_values("key")
        out.append((rows["key"].to_numpy(np.uint32), rows[[f"b{i}" for i in range(width)]].to_numpy(np.float64)))
    return out


def bits(grams: np.ndarray, costs: list, escapes: list) -> np.ndarray:
    """Bits of each n-gram's last byte, one column for each language."""
    out = np.zeros((len(grams), costs[0][1].shape[1]))
    todo = np.arange(len(grams))
    for order in range(ORDER, -1, -1):
        g = grams[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
        keys, values = costs[order]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[at] == g
        out[todo[hit]] += values[at[hit]]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            return out
        keys, values = escapes[order]
        context = g >> np.uint32(8)
        at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        hit = keys[at] == context
        out[todo[hit]] += values[at[hit]]
    out[todo] += 8
    return out


def _verdict(sums: np.ndarray, letters: np.ndarray, langs: list[str]) -> pd.DataFrame:
    share = np.exp2(sums.min(axis=1, keepdims=True) - sums)
    score = share.max(axis=1) / share.sum(axis=1)
    names = np.array(langs, object)[sums.argmin(axis=1)]
    return pd.DataFrame({"lang_pred": np.where(letters, names, "und"), "score": np.where(letters, score, 0.0)})


def predict(docs: DataFrame, model: Model, text: str = "text", rows: int = ROWS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. Null texts and texts without a letter are ``und`` with score 0, and
    so are all without any language learned. Equal code lengths go to the first name."""
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    if model.costs.count() + model.escapes.count() > rows:
        return _joined(docs, model, text)
    spark, width = docs.sparkSession, len(model.langs)
    sent = spark.sparkContext.broadcast((model.langs, _table(model.costs, width), _table(model.escapes, width)))

    @F.pandas_udf("lang_pred string, score double")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        langs, costs, escapes = sent.value
        sums = np.zeros((len(texts), len(langs)))
        for which, starts, grams in parts(texts):
            np.add.at(sums, which, np.add.reduceat(bits(grams, costs, escapes), starts, axis=0))
        return _verdict(sums, np.array([any(map(str.isalpha, t or "")) for t in texts], bool), langs)

    return docs.withColumn("_v", verdict(F.col(text))).withColumns({"lang_pred": F.col("_v.lang_pred"), "score": F.col("_v.score")}).drop("_v")


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for which, starts, grams in parts(pdf["_text"]):
            ends = np.r_[starts[1:], len(grams)]
            for i, a, b in zip(which, starts, ends, strict=True):
                kinds, n = np.unique(grams[a:b], return_counts=True)
                yield pd.DataFrame({"_a": pdf["_a"].iloc[i], "_b": pdf["_b"].iloc[i], "gram": kinds.astype(np.int64), "n": n})


def _joined(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The same by joins: n-grams are counted for each text, costed once for each n-gram, and summed for each text."""
    marked = docs.withColumn("_b", F.xxhash64(text)).withColumn("_a", F.xxhash64(F.lit(1), text))
    texts = marked.select("_a", "_b", F.col(text).alias("_text")).dropDuplicates(["_a", "_b"])
    grams = materialize(texts.mapInPandas(_spelled, "_a long, _b long, gram long, n long"), "spelled")
    zero = F.transform(F.sequence(F.lit(1), F.lit(len(model.langs))), lambda _: F.lit(0.0))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    todo, done = grams.select("gram").distinct().withColumn("sum", zero), None
    for order in range(ORDER, -1, -1):
        key = F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1)
        cost = model.costs.filter(F.col("order") == order).select("key", F.col("bits").alias("cost"))
        escape = model.escapes.filter(F.col("order") == order).select("key", F.col("bits").alias("escape"))
        met = materialize(todo.withColumn("key", key).join(cost, "key", "left"), "met")
        hit = met.filter("cost is not null").select("gram", added("sum", "cost").alias("sum"))
        done = hit if done is None else done.unionByName(hit)
        todo = met.filter("cost is null").select("gram", "sum", F.shiftright("key", 8).alias("key")).join(escape, "key", "left")
        todo = materialize(todo.select("gram", added("sum", F.coalesce("escape", zero)).alias("sum")), "todo")
    done = materialize(done.unionByName(todo.select("gram", F.transform("sum", lambda x: x + 8.0).alias("sum"))), "costed")
    sums = grams.join(done, "gram").groupBy("_a", "_b").agg(
        F.array(*(F.sum(F.col("n") * F.get("sum", F.lit(i))) for i in range(len(model.langs)))).alias("_sums")
    )
    langs = model.langs

    @F.pandas_udf("lang_pred string, score double")
    def verdict(texts: pd.Series, sums: pd.Series) -> pd.DataFrame:
        table = np.array([np.zeros(len(langs)) if s is None else s for s in sums], float).reshape(len(sums), len(langs))
        return _verdict(table, np.array([any(map(str.isalpha, t or "")) for t in texts], bool), langs)

    out = marked.join(sums, ["_a", "_b"], "left").withColumn("_v", verdict(F.col(text), "_sums"))
    return out.withColumns({"lang_pred": F.col("_v.lang_pred"), "score": F.col("_v.score")}).drop("_a", "_b", "_sums", "_v")


def held_out(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", rows: int = ROWS) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, learned from rows with a language whose crc32(id) mod 4 is not 2.

    Rows with a null id are not learned from and not held out.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    train = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold != 2)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return predict(docs, fit(train), text, rows).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
