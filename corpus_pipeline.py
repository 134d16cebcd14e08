"""Documents through quality rules, line dedup, near dedup, repeat removal and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of documents; where a stage changes texts, n_chars follows. Null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near, packing, quality, suffix
from tidemark.llm.queries import tokenizer
from tidemark.session import materialize, scratch

REPEAT_BYTES = 240  # a passage of some fifty words


def rules(spark, docs, sf_dir):
    """Documents that the rules or the likelihood ratio reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, quality.trusted(labels)).filter("kept").select(*docs.columns)


def lines(spark, docs, sf_dir):
    """Lines of later occurrences of three-line windows go; a document of which all lines go stays, empty."""
    return _with_text(docs, line_dedup.deduplicated(docs), F.col("kept_text"))


def copies(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one with the smallest id; near are five-word shingle sets
    of Jaccard similarity 0.8 or more. SimHash by deletion variants links first, and the sets verify its links and complete them."""
    return near.keep_first(docs)


def repeats(spark, docs, sf_dir):
    """Passages of ``REPEAT_BYTES`` bytes that occur more than once go wherever they occur."""
    return _with_text(docs, suffix.without_repeats(docs, size=REPEAT_BYTES), F.col("cut.kept_text"))


def sequences(spark, docs, sf_dir):
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    made = packing.pieces(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return packing.packed(materialize(made, "pieces"))


def _with_text(docs, changed, text):
    new = changed.withColumns({"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)})
    return new.select(*docs.columns)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("SimHash near-dedup", copies),
    ("suffix-array dedup", repeats),
    ("best-fit packing", sequences),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


ORACLE_SQL = None  # SQL has neither the hashes nor the genetic search; tests/llm holds brute-force versions
