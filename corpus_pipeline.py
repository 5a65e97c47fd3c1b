"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the
columns of documents; run() writes each stage's rows to the shared folder and reads them again.  Further columns are
carried along, whatever their names.  A null text counts as empty: it links with nothing, loses nothing, is not mixed in.
Rows that are repeated whole are near duplicates of each other.  No documents give no pieces.  A very long text is one
document in every stage: it is scored, compared, cut and tokenised as a whole, by one task of each stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import jaccard, mixing, nbsvm, packing, substrings
from lamina.llm._spark import WORD, materialise, table, word_count
from lamina.llm.queries import tokenizer_path
from lamina.session import ship


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(stage):
    """The stage with all columns but COLUMNS renamed while it runs, so that none clashes with its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
        out = stage(ship(spark), docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


@guarded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of quality, doesn't reject (score below 0.3).

    Equal texts have equal scores, so of repeated rows all stay or all go; null and empty texts get the score of an empty
    one.  Without usable labels every document has the same score, 0.5, and stays.
    """
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return nbsvm.classify(docs, model).filter("predicted = 1").select(docs.columns)


@guarded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    Of rows that share that id, the one with the least hash stays, once if it is repeated.  A null id counts as the least here.
    Null, empty and blank texts link with nothing; all such rows stay, but for rows that are equal in every column.
    """
    found = jaccard.jaccard_components(docs, size=5, percent=80)
    kept = found.filter("keep").select(F.col("doc_id").alias("kept_id"), "row_key").distinct()
    rows = docs.withColumn("row_key", F.xxhash64(*docs.columns)).alias("d")
    one = rows.join(kept.alias("k"), (F.col("d.row_key") == F.col("k.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return one.dropDuplicates(["row_key", "doc_id"]).select(docs.columns)


@guarded
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that also stand elsewhere; n_chars is counted again.

    All places of a passage go, judged on the input.  A text that loses nothing stays as it is, one that loses all
    becomes empty, and a null one becomes empty; no row goes.
    """
    out = substrings.dedup_substrings(docs, window=50, keep_untouched=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@guarded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the last may be a run of its words.

    Sources weigh 1, 2, 3, repeating, by code point, null last.  Equal rows give equal parts.  Texts without words are
    not taken.  n_chars is counted again.
    """
    sized = docs.withColumns({"mix_size": word_count(F.col("text")), "mix_key": F.xxhash64("doc_id", "text")})
    keys = materialise(sized.select("source", "mix_size", "mix_key"), "keys")
    mixed = mixing.mix_sources(sized, "source", "mix_size", "mix_key", keys=keys)
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("cut_start") + 1).cast("int"), F.col("cut_length").cast("int"))
    part = F.when(F.col("cut_length") == 0, F.array().cast("array<string>")).when(F.col("cut_length") == F.col("mix_size"), F.array("text")).otherwise(F.array(F.array_join(words, " ")))
    texts = F.concat(F.array_repeat("text", F.col("copies").cast("int")), part)
    out = mixed.filter("taken > 0").withColumn("text", F.explode(texts))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@guarded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; an empty text is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
