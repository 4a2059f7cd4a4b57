"""Cross-site boilerplate removal by distinct-site spread, in DataFrame functions only.

A line is what stands between newlines, trimmed of `[\\x20\\x09-\\x0D]`; lines under `least_words` words are never boilerplate: `LEAST_WORDS` where
the SQL of op6 says so, 1 in the pipeline, where spread alone decides on every line that isn't empty. A line is known by
96 bits of two hashes. One HyperLogLog sketch for each line collects the sites (sources) it was seen on; sketches merge in partial aggregation, so that a line on
every page costs one sketch a task. A line whose estimate is at least `CLEAR` times `SITES` is boilerplate, one under
`SITES / CLEAR` isn't, and those between get an exact distinct count. Of a boilerplate line one occurrence stays: the first in the
document of smallest doc_id that has it, so that of copied documents one remains whole.

Line hashes and doc_ids travel, texts only once, in the join that brings each document the places of the lines it loses. All work on a
text is linear in its length.

Defined cases: a null text stays null and has 0 lines; empty lines are kept as they are; a null source is a site of its own; rows that
repeat a doc_id each keep their first occurrence if the doc_id is the smallest; null doc_ids count as one
document, which keeps a line only if no other has it; an empty table gives an empty result; other columns are carried or ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.rows import columns_of, quoted, row_of
from tidemill.session import cut

SITES = 10
CLEAR = 1.25
LEAST_WORDS = 3
SKETCH_BITS = 10
#: Lines that may be boilerplate up to which their table, of 20 bytes a line, is broadcast.
BROADCAST_LINES = 200_000
EDGES = " \t\n\x0b\x0c\r"


def line_keys(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """The 96 bits of two hashes for each line of a text, null for lines too short to be boilerplate."""
    short = f"^(?:[^\\x20\\x09-\\x0D]+(?:[\\x20\\x09-\\x0D]+|$)){{0,{least_words - 1}}}$"

    def key(line: Column) -> Column:
        trimmed = F.trim(line, F.lit(EDGES))
        return F.when(~trimmed.rlike(short), F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b")))

    return F.transform(F.split(text, "\n"), key)


def spread_lines(docs: DataFrame, *, sites: int = SITES, clear: float = CLEAR, sketch_bits: int = SKETCH_BITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """_id, _hash, gone: for each text that loses lines, their places from 0."""
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0null"))
    text = F.col("text").cast("string")
    # what stands beside an explode is worked out for every row it makes, so all but column names comes before
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"), site.alias("_site"), line_keys(text, least_words).alias("_keys"))
    lines = keyed.select("_id", "_hash", "_site", F.posexplode("_keys").alias("_at", "_line")).filter(F.col("_line").isNotNull())
    sketches = lines.groupBy("_line").agg(F.hll_sketch_agg("_site", sketch_bits).alias("_sketch"))
    spread = sketches.select("_line", F.hll_sketch_estimate("_sketch").alias("_estimate")).filter(F.col("_estimate") >= sites / clear)
    # wide-spread lines are few: up to a counted bound they go to where lines are, so that a very common one is no task's own
    spread = cut(spread, "spread")
    sent = F.broadcast if spread.count() <= BROADCAST_LINES else lambda table: table
    # the occurrences of wide-spread lines: read twice, so written once
    hits = cut(lines.join(sent(spread), "_line"), "line-hits")
    near = F.col("_estimate") < sites * clear
    exact = hits.groupBy("_line").agg(F.count_distinct(F.when(near, F.col("_site"))).alias("_exact"), F.max(~near).alias("_clear"), F.min("_id").alias("_keeper"))
    flagged = exact.filter(F.col("_clear") | (F.col("_exact") >= sites)).select("_line", "_keeper")
    mine = F.col("_id").eqNullSafe(F.col("_keeper"))
    own = hits.join(sent(flagged), "_line").groupBy("_id", "_hash", "_line").agg(F.collect_set("_at").alias("_places"), F.first(mine).alias("_mine"))
    lost = F.when(F.col("_mine"), F.array_remove("_places", F.array_min("_places"))).otherwise(F.col("_places"))
    return own.groupBy("_id", "_hash").agg(F.flatten(F.collect_list(lost)).alias("gone"))


def cleaned(docs: DataFrame, *, sites: int, clear: float, least_words: int) -> DataFrame:
    """_row (the columns of `docs` as they are), _text, _n_lines, _n_removed of every row; no column of `docs` stands beside them."""
    lost = spread_lines(docs, sites=sites, clear=clear, least_words=least_words)
    rows = docs.select(row_of(docs))
    text = F.col("_row.text").cast("string")
    rows = rows.withColumn("_own", F.xxhash64(text))
    # texts that lose lines grow with the table: joined alike at every size, never broadcast where there happen to be few
    placed = rows.join(lost.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    # places and lines are columns of their own: inside a lambda they would be worked out again for every line
    placed = placed.withColumn("_lines", F.split(text, "\n")).withColumn("_n_removed", F.size(F.coalesce("gone", F.array().cast("array<int>"))).cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    kept = F.array_join(F.transform(places, lambda k: F.get("_lines", k)), "\n")
    lines = F.when(text.isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return placed.select("_row", F.when(F.col("_n_removed") > 0, kept).otherwise(text).alias("_text"), lines.alias("_n_lines"), "_n_removed")


def remove_boilerplate(docs: DataFrame, *, sites: int = SITES, clear: float = CLEAR, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with boilerplate lines out of text, and columns n_lines, n_removed, which replace columns of these names."""
    out = cleaned(docs, sites=sites, clear=clear, least_words=least_words)
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    return out.select(*columns_of(kept, {"text": F.col("_text")}), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def without_boilerplate(docs: DataFrame, *, sites: int = SITES, clear: float = CLEAR, least_words: int = 1) -> DataFrame:
    """`docs` without boilerplate lines and without the rows of which nothing else was left; n_chars, if there, follows the text."""
    out = cleaned(docs, sites=sites, clear=clear, least_words=least_words).filter((F.col("_n_removed") == 0) | F.col("_text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        # a row that lost nothing keeps what it had
        changed["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*columns_of(docs, changed))
