"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words. The target over the source's size is what a word is taken on average: its whole part is allocated to
every document for certain. What remains of the target is sampled with inclusion probabilities in proportion to size, p = min(1, c * size)
with the c at which sum(p * size) is the remainder; documents of p = 1 get their copy for certain too. The others are ranked by Pareto's
q = (u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, with u from a hash of doc_id, and the smallest q are taken until the
remaining words are met. So a long document, which stands for more of its source's words, is more likely to come twice than a short one.

c comes from the numbers of documents of each size, largest first: one row for each source and size, never a row for each document.
The rank is never a sort of a whole source. q / (1 + q) lies in (0, 1) and is cut into `RANK_BUCKETS` equal buckets; the words of each
bucket are summed, and only the bucket in which a source's remainder ends is ordered document by document. Per-bucket sums
are partial aggregates, so a source with a third of all rows shuffles at most one row for each bucket and task.

Defined cases: null text has size 0; null is a source, the last one; a repeated row is a document of its own, and rows that tie
in doc_id have the same u and are ordered by q, then size; a source of size 0 has target 0; a document of size 0 is taken 0 words; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.rows import columns_of, row_of
from tidemill.session import cut

#: Source weights, repeating over the sources by code point.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
RANK_BUCKETS = 4096
SEED = 7
#: Sources up to which their table is broadcast; beyond, it is joined like any other.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """_source, source_size, target of every source: water-filling of the shared words under each source's cap.

    With sources ordered by cap / weight, those before the first source that its proportional share doesn't exceed are at their cap.
    """
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    nth = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * most_copies).cast("double"))
    rising = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share_percent / 100 - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    filled = caps.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    first = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level").alias("level")))).over(whole)["level"]
    return filled.withColumn("target", F.least(F.coalesce(first * F.col("_weight"), F.col("_cap")), F.col("_cap"))).select("_source", "source_size", "target")


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """`targets` (_source, _left words to sample) with _c, the inclusion probability for each word of size, and _rest, what the ranked documents get.

    `sizes` has the number _n of documents of each _source and size. With sizes in falling order, the largest are certain as long as the c
    of all that follow would give the next size a probability above 1.
    """
    left = targets.select(F.col("_source").alias("_s"), F.col("_left").alias("_l"))
    own = sizes.filter(F.col("size") > 0).join(left, F.col("_source").eqNullSafe(F.col("_s")))
    falling = Window.partitionBy("_s").orderBy(F.col("size").desc())
    # exact sums, whatever the order of rows
    n, size = F.col("_n").cast("decimal(12,0)"), F.col("size").cast("decimal(12,0)")
    before = F.coalesce(F.sum(n * size).over(falling.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    after = F.sum((n * size * size).cast("decimal(28,0)")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    tried = own.select("_s", "size", "_l", before.alias("_before"), after.alias("_after")).withColumn("_try", (F.col("_l") - F.col("_before")) / F.col("_after"))
    # the first size that isn't certain; without one, all are
    first = tried.filter(F.col("_try") * F.col("size") < 1).groupBy("_s").agg(F.max(F.struct("size", "_try", "_before")).alias("_f"))
    found = targets.join(first, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    c = F.greatest(F.coalesce("_f._try", F.when(F.col("_left") > 0, 1.0).otherwise(0.0)), F.lit(0.0))
    rest = F.greatest(F.col("_left") - F.coalesce("_f._before", F.lit(0.0)), F.lit(0.0))
    return found.withColumn("_c", c).withColumn("_rest", rest).drop("_f", "_left")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES, buckets: int = RANK_BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of `docs` (doc_id, text, source)."""
    return mix_sized(counted(docs), weights=weights, share_percent=share_percent, most_copies=most_copies, buckets=buckets, seed=seed)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, _source, size of every row, written: words are counted once and read for each of the statistics."""
    return cut(docs.select("doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size")), "sized")


def mix_sized(sized: DataFrame, *, plain: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES, buckets: int = RANK_BUCKETS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """`mix` over rows doc_id, _source, size and the columns to `carry` along. `plain` has the same rows without these, for the statistics."""
    plain = sized if plain is None else plain
    sizes = cut(plain.groupBy("_source", "size").agg(F.count("*").alias("_n")), "sizes")
    targets = source_targets(sizes.select("_source", (F.col("size") * F.col("_n")).alias("size")), weights=weights, share_percent=share_percent, most_copies=most_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("_whole", F.floor(rate)).withColumn("_left", F.col("target") - F.floor(rate) * F.col("source_size"))

    # one row a source: counted, so that rows which carry texts meet it without a shuffle where that is safe
    targets = cut(inclusion(sizes, targets), "targets")
    sent = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda table: table

    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    u = (draw + 0.5) / float(1 << 48)
    odds = (u / (1 - u)) * ((1 - F.col("_p")) / F.col("_p"))
    # those taken for certain don't stand in the ranking, nor those that can't be taken
    chance = (F.col("_p") > 0) & (F.col("_p") < 1)
    bucket = F.when(chance, F.least(F.floor(F.col("_q") * buckets), F.lit(buckets - 1))).otherwise(F.lit(buckets).cast("long"))

    def ranked(rows: DataFrame) -> DataFrame:
        both = rows.join(sent(targets), rows["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"])
        both = both.withColumn("_p", F.least(F.col("_c") * F.col("size"), F.lit(1.0)))
        return both.withColumn("_q", F.when(chance, odds / (1 + odds)).otherwise(1.0)).withColumn("_bucket", bucket)

    sums = ranked(plain).filter(F.col("_bucket") < buckets).groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    running = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", running)
    # the bucket in which the remainder ends: at most one row a source
    edges = sums.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words"))).select(F.col("_source").alias("_edge_source"), F.col("_bucket").alias("_edge"), "_before")
    edges = cut(edges, "edges")
    placed = ranked(sized).join(sent(edges), F.col("_source").eqNullSafe(F.col("_edge_source")), "left").drop("_edge_source")

    inside = placed.filter(F.col("_bucket") == F.col("_edge"))
    order = Window.partitionBy("_source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("_before") + F.sum("size").over(order)
    # a document is in if the remainder covers more than half of it: the nearest prefix
    inside = inside.withColumn("_in", reached - F.col("_rest") <= F.col("size") / 2)
    outside = placed.filter(F.col("_edge").isNull() | (F.col("_bucket") != F.col("_edge")))
    outside = outside.withColumn("_in", (F.col("_p") >= 1) | (F.col("_bucket") < F.coalesce("_edge", F.lit(buckets))))
    copies = (F.col("_whole") + F.col("_in").cast("long")).cast("long")
    return inside.unionByName(outside).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *carry)


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with the columns of `docs`."""
    sized = docs.select("doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size"), row_of(docs))
    taken = mix_sized(sized, plain=counted(docs), weights=weights, share_percent=share_percent, most_copies=most_copies, carry=("_row",)).filter(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns_of(docs))
