"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

The normalised text (white space deleted) is cut where its own characters say so: a chunk ends after three characters of set
classes, once it has `LEAST_CHUNK` characters, and after `MOST_CHUNK` at the latest. Equal texts are cut alike, and a change moves
only the cuts near it. Each distinct chunk moves once: partial aggregation keeps, for each 64-bit identifier, the least and
the greatest chunk; where they are the same, byte for byte, the identifier is verified. A text's recipe is its ordered
list of identifiers, and texts are equal when recipes are; in a recipe that holds an unverified identifier, the SHA-256 of the
normalised text takes part as well. Documents move no more after their chunks; their groups are formed on recipes.

Group facts are partial aggregates, joined back to the rows by recipe; a group with a third of all rows is one aggregate row, and
the join's side that holds its members is an ordinary skewed side that adaptive execution splits.

Defined cases: null counts as empty, all empty texts are one group with an empty recipe; rows that repeat a doc_id count separately
in group_size and share `kept` if they tie with the row that stays; a null doc_id sorts before all others; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHUNK = 512
MOST_CHUNK = 4096
#: Character classes whose succession ends a chunk: each holds about an eighth of common letters and every second character beyond Latin.
TRIGGER = "[aftz3][behn5][ciot7]"


def normalised(text: Column) -> Column:
    """The text without the characters `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def chunks(text: Column, *, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    pattern = f"(?s).{{{least - 3},{most - 3}}}?{TRIGGER}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unverified(texts: DataFrame) -> DataFrame:
    """One row: the identifiers under which different chunks were found. `texts` has the normalised text in _norm."""
    found = texts.select(F.explode(chunks(F.col("_norm"))).alias("_chunk")).select(F.xxhash64("_chunk").alias("_id"), "_chunk")
    dictionary = found.groupBy("_id").agg(F.min("_chunk").alias("_least"), F.max("_chunk").alias("_greatest"))
    return dictionary.filter(F.col("_least") != F.col("_greatest")).agg(F.collect_list("_id").alias("ids"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of `docs` (doc_id, text).

    Of equal texts, the row with the most code points in the original text, then smallest doc_id stays.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = own.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_points"), normalised(F.col("text")).alias("_norm"))
    doubtful = unverified(texts).scalar()
    recipes = texts.select("doc_id", "_points", F.sha2("_norm", 256).alias("text_sha256"), F.transform(chunks(F.col("_norm")), lambda c: F.xxhash64(c)).alias("_recipe"))
    # an unverified identifier, which takes a 64-bit collision, makes the text's own digest part of the comparison
    recipes = recipes.withColumn("_more", F.when(F.arrays_overlap("_recipe", doubtful), F.col("text_sha256")).otherwise(""))
    groups = recipes.groupBy("_recipe", "_more").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("_points")).alias("p"), F.col("doc_id").alias("i"))).alias("_best"))
    placed = recipes.join(groups, ["_recipe", "_more"])
    kept = F.col("doc_id").eqNullSafe(F.col("_best.i")) & (-F.col("_points") == F.col("_best.p"))
    return placed.select("doc_id", F.col("_best.i").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", F.size("_recipe").alias("n_chunks"))
