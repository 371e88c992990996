"""Relations between entities that stand in the same chunks, with support and association.

A pair is related if at least `least` chunks hold both and these are at least a `share` of the chunks that hold either. In a chunk of
LIGHT entities or fewer all pairs are made and counted: that is less than a look into both entities' chunks for each pair that meets at all. In the
heavier chunks a pair costs more than its entities' mentions, and candidates come first. An entity of n chunks
shares max(least, share * n) of them with any partner, so it suffices to look for partners in all its chunks but one less than that.
Chunks are ordered by the number of entities in them, the light ones first: what an entity leaves out
are its heaviest chunks, and a chunk of very many entities makes pairs only of those that hardly stand anywhere else. Only pairs that their heavy chunks
could still bring to the support have these compared. No pair is lost by this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.session import dropped, saved, spread_join

#: Chunks are ordered by the size's level (four to a doubling), then by a hash of so many values: an entity's chunks fall in a bounded number of bins.
BINS = 256
LIGHT = 32


def npmi(together: Column, a: Column, b: Column, chunks: Column) -> Column:
    """Normalised mutual information of two entities' chunks: -1 to 1; 1 if both are in every chunk."""
    every = F.lit(1.0)
    return F.when(together == chunks, every).otherwise(F.log(together * chunks / (a * b)) / F.log(chunks / together))


def cooccurring(mentions: DataFrame, chunk: str, entity: str, least: int, share: float = 0.0) -> DataFrame:
    """(a, b, together, a_chunks, b_chunks, jaccard, npmi) of each related pair, a before b.

    Rows repeated in a chunk count once; a mention without chunk or entity is in no pair. Rare entities go before any pair is made.
    """
    if least < 1 or not 0 <= share <= 1:
        raise ValueError("least must be 1 or more and share from 0 to 1")
    held = saved(mentions.select(F.col(chunk).alias("chunk"), F.col(entity).alias("entity")).dropna().distinct(), "mentions")
    chunks = held.select("chunk").distinct().count()
    common = held.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    held = saved(spread_join(held, common, "entity"), "common")
    sizes = held.groupBy("chunk").agg(F.count("*").alias("size"))
    order = [F.floor(4 * F.log2("size")).cast("int").alias("level"), F.pmod(F.xxhash64("chunk"), F.lit(BINS)).alias("bin")]
    ordered = saved(spread_join(held, sizes, "chunk").select("chunk", "entity", "n", "size", *order), "ordered")
    dropped(held)
    sides = ["a", "b", "a_chunks", "b_chunks"]

    def met(rows: DataFrame) -> DataFrame:
        other = rows.select("chunk", F.col("entity").alias("b"), F.col("n").alias("b_chunks"))
        pairs = rows.select("chunk", F.col("entity").alias("a"), F.col("n").alias("a_chunks")).join(other, "chunk").filter("a < b")
        return pairs.filter(F.least("a_chunks", "b_chunks") >= F.greatest("a_chunks", "b_chunks") * share - 1e-9)

    found = met(ordered.filter(F.col("size") <= LIGHT)).groupBy(*sides).agg(F.count("*").alias("together"))
    # Of a and b chunks, both in share * (a + b) / (1 + share) at least.
    needed = F.greatest(F.lit(float(least)), (F.col("a_chunks") + F.col("b_chunks")) * (share / (1 + share)) - 1e-9)
    heavy = ordered.filter(F.col("size") > LIGHT)
    if not heavy.isEmpty():
        bins = ordered.groupBy("entity", "n", "level", "bin").agg(F.count("*").alias("k"))
        before = F.coalesce(F.sum("k").over(W.partitionBy("entity").orderBy("level", "bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        own = F.greatest(F.lit(least), F.ceil(F.col("n") * share - 1e-9))
        bins = bins.withColumn("before", before).filter(F.col("before") <= F.col("n") - own).select("entity", "level", "bin")
        looked = met(heavy.join(bins, ["entity", "level", "bin"], "left_semi")).select(*sides).distinct()
        pairs = found.unionByName(looked.withColumn("together", F.lit(0).cast("long"))).groupBy(*sides).agg(F.sum("together").alias("light"))
        many = saved(heavy.groupBy("entity").agg(F.count("*").alias("h")), "heavy")
        for side in ("a", "b"):
            pairs = pairs.join(many.select(F.col("entity").alias(side), F.col("h").alias(f"{side}_heavy")), side, "left").fillna(0, [f"{side}_heavy"])
        pairs = saved(pairs.filter(F.col("light") + F.least("a_heavy", "b_heavy") >= needed), "pairs")
        swap = F.col("a_heavy") > F.col("b_heavy")  # the chunks of the one in fewer are looked up among the other's
        asked = pairs.filter("least(a_heavy, b_heavy) > 0").select("a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("entity"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("partner"))
        both = asked.join(heavy.select("entity", "chunk"), "entity").join(heavy.select(F.col("entity").alias("partner"), "chunk"), ["partner", "chunk"])
        more = both.groupBy("a", "b").agg(F.count("*").alias("more"))
        found = pairs.join(more, ["a", "b"], "left").select(*sides, (F.col("light") + F.coalesce("more", F.lit(0))).alias("together"))
    jaccard = F.col("together") / (F.col("a_chunks") + F.col("b_chunks") - F.col("together"))
    found = found.withColumns({"jaccard": jaccard, "npmi": npmi(F.col("together"), F.col("a_chunks"), F.col("b_chunks"), F.lit(chunks))})
    return found.filter((F.col("together") >= least) & (F.col("jaccard") >= share)).select("a", "b", "together", "a_chunks", "b_chunks", "jaccard", "npmi")
