"""Line dedup over overlapping windows of three lines, all in DataFrame functions.

Windows are compared as whole lines (by two 64-bit hashes of the three lines). Of equal windows anywhere in the table the
first, by (id, place), stays; the lines of all later ones are covered, overlapping windows join into one
span, and covered lines go. Every line removed is also at an earlier place, where it was kept or goes
for the same reason, so each removed text survives at least once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

LINES = 3
BLANKS = " \t\n\x0b\x0c\r"


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` columns other than the text, ``at`` (first line, from 0), ``h1`` and ``h2``: one row per window of three
    lines of which one has a word. Texts with fewer lines have none."""
    keep = [c for c in docs.columns if c != text]
    lined = docs.select(*keep, F.split(text, "\n").alias("_lines")).filter(F.size("_lines") >= LINES)
    # Lines count without the white space around them.
    lined = lined.withColumn("_lines", F.transform("_lines", lambda x: F.trim(x, F.lit(BLANKS))))
    n = F.size("_lines") - LINES + 1
    hashed = lined.select(
        *keep,
        F.posexplode(
            F.arrays_zip(*(F.slice("_lines", i + 1, n).alias(f"l{i}") for i in range(LINES)))
        ).alias("at", "w"),
    )
    lines = [F.col(f"w.l{i}") for i in range(LINES)]
    return hashed.filter(F.concat(*lines) != "").select(
        *keep, F.col("at").cast("long").alias("at"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1), *reversed(lines)).alias("h2")
    )


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _tie, start, end): lines to remove of each row, half-open, disjoint, from 0."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_tie"), F.col(text).alias("_text"))
    every = materialize(windows(rows, "_text"), "windows")
    first = (
        every.groupBy("h1", "h2")
        .agg(F.min(F.struct("_id", "_tie", "at")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    first = materialize(first.select("h1", "h2", F.struct("first.*").alias("first")), "first")
    later = every.join(first, ["h1", "h2"]).filter(F.struct("_id", "_tie", "at") != F.col("first")).select("_id", "_tie", "at").distinct()
    own = Window.partitionBy("_id", "_tie").orderBy("at")  # of one text
    islands = later.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(own) + LINES, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(own)
    )
    return islands.groupBy("_id", "_tie", "island").agg(F.min("at").alias("start"), (F.max("at") + LINES).alias("end")).drop("island")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` and ``n_removed`` (lines, long).

    Null texts stay null with 0 lines removed; a text of which all lines go becomes empty. Rows with a null id
    sort first and rows with equal ids by a hash of the text; of rows equal in both, which cannot be told apart,
    each counts as the first place, so they stay alike. Column names starting with _ are reserved.
    """
    cuts = (
        removed_spans(docs, id_col, text)
        .groupBy("_id", "_tie")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
        .withColumnsRenamed({"_id": "_cut_id", "_tie": "_cut_tie"})
    )
    marked = docs.withColumn("_tie", F.xxhash64(text))
    out = marked.join(cuts, F.col(id_col).eqNullSafe(F.col("_cut_id")) & (F.col("_tie") == F.col("_cut_tie")), "left")
    out = out.withColumn("_lines", F.when(F.col("_cuts").isNotNull(), F.split(text, "\n"))).withColumn(
        "_keep",  # the gaps between cuts: from the end of one (or 0) to the start of the next (or the last line)
        F.expr(
            "transform(sequence(0, size(_cuts)), i -> named_struct('start', cast(coalesce(get(_cuts, i - 1).end, 0) as int),"
            " 'end', cast(coalesce(get(_cuts, i).start, size(_lines)) as int)))"
        ),
    )
    kept = F.array_join(F.flatten(F.transform("_keep", lambda k: F.slice("_lines", k["start"] + 1, k["end"] - k["start"]))), "\n")
    return out.withColumns(
        {
            "kept_text": F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(kept),
            "n_removed": F.coalesce(F.aggregate("_cuts", F.lit(0).cast("long"), lambda s, c: s + c["end"] - c["start"]), F.lit(0).cast("long")),
        }
    ).drop("_tie", "_cut_id", "_cut_tie", "_cuts", "_lines", "_keep")
