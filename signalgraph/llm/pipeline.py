"""Stages of the corpus pipeline: ``(name, function(spark, docs, sf_dir))``.

Each stage gets all that the one before it kept, with all columns of ``documents``;
its decisions take effect. The last one returns the places of packed pieces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from signalgraph.llm import line_dedup, packing, quality_rules, shingle_dedup, suffix_dedup


def quality(spark, docs, sf_dir):
    """Without the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def lines(spark, docs, sf_dir):
    """Without lines that an earlier document holds."""
    return _counted(line_dedup.drop_repeated_lines(docs).select(*docs.columns))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8):
    the one with the smallest id. ``op2`` has a contract of its own."""
    return shingle_dedup.one_of_each(docs)


def repeats(spark, docs, sf_dir):
    """Without strings of 100 bytes that occur earlier."""
    return _counted(suffix_dedup.drop_repeats(docs))


def windows(spark, docs, sf_dir):
    """Packed into windows of 4096 tokens."""
    return packing.pack_documents(docs)


def _counted(docs):
    """``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("packing", windows),
]
