"""Sources mixed to target weights from fixed-length blocks of their words.

Each source's words, its documents one after another in a seeded order, are cut into blocks of equal length. Every
output shard draws how many of its slots each source gets: the whole part of the expected number for sure, the rest by
multinomial draws with the fractions as chances. A source's n-th slot takes the block that a pseudorandom permutation of
the source's block numbers gives for n, a new permutation for each turn through the source. Joining slots and documents
by (source, block) gives the mixture. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import WORD, cells_for, keyed, ranked, stage

# Turns that a mixture takes through one source at most.
TURNS = 3
_ROUNDS = 16
_POSITIVE = (1 << 62) - 1


class Mixture(NamedTuple):
    """``sources``: sizes and targets; ``slots``: which block each slot of each shard takes; ``pieces``: which words of
    which rows a block holds; ``taken``: key, size, source's size and target, how many words the mixture takes, and the
    hash of the id that the row is laid out by."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    taken: DataFrame


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def weigh_in_turn(place: Column) -> Column:
    """Weights 1, 2, 3, 1, ... by a source's place from 0, in code-point order, null last."""
    return (place % 3 + 1).cast("double")


def targets(sizes: DataFrame, weigh=weigh_in_turn, turns: int = TURNS) -> DataFrame:
    """(source, number, size, weight, target): all sizes shared by weight; a target stops at ``turns`` times its
    source's size and what is over goes to the others by weight.

    In the order of size per weight the sources that stop come first, and one stops if it does so when those before it
    have. The window holds one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    held = sizes.withColumn("number", place).withColumn("weight", weigh(place)).withColumn("cap", F.col("size") * turns)
    line = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    unit = left / F.sum("weight").over(rest)
    marked = held.withColumn("unit", unit).withColumn("stops", F.col("cap") <= F.col("unit") * F.col("weight"))
    share = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "number", "unit"))).over(everything)
    return marked.withColumn("share", share["unit"]).select(
        "source", "number", "size", "weight",
        F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"),
    )


def _permuted(seed: int, source: Column, turn: Column, index: Column, size: Column) -> Column:
    """A pseudorandom permutation of 0 to ``size`` - 1: in each round a number may change places with its mirror image
    about a round's key; both of the pair compute the same bit, so the map stays one to one."""

    def swap(x, k):
        mirror = F.pmod(F.xxhash64(F.lit(seed), source, turn, k).bitwiseAND(F.lit(_POSITIVE)) - x, size)
        coin = F.xxhash64(F.lit(seed + 1), source, turn, k, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index, swap)


def draw_slots(sources: DataFrame, block: int, shard_slots: int, seed: int, turns: int = TURNS) -> DataFrame:
    """(source number, block, shard): a row per slot. ``sources`` has number, size, target and blocks."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, int(total / block // shard_slots))
    drawn = sources.filter("size > 0").select(
        "number", "blocks", (F.col("target") * F.col("blocks") / F.col("size") / shards).alias("expected")
    )
    drawn = drawn.withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.floor("expected"))
    line = Window.orderBy("number")
    upto = F.sum("part").over(line)
    parts = drawn.select("number", "part", (upto - F.col("part")).alias("low"), upto.alias("high"))
    row = drawn.agg(F.round(F.sum("part")).cast("long"), F.sum("part")).first()
    chances, whole_part = int(row[0] or 0), float(row[1] or 0.0)
    coin = F.xxhash64(F.lit(seed), "shard", "draw").bitwiseAND(F.lit(_POSITIVE)) / F.lit(float(1 << 62))
    draws = drawn.sparkSession.range(shards * chances).select(
        (F.col("id") % shards).alias("shard"), F.call_function("div", F.col("id"), F.lit(shards)).alias("draw")
    ).select("shard", (coin * whole_part).alias("point"))
    # A fraction is below 1, so its interval touches two whole numbers at most: an equi-join finds each draw's source.
    low, high = F.floor("low"), F.floor("high")
    reach = parts.filter("part > 0").select("number", "low", "high", F.explode(F.array_distinct(F.array(low, high))).alias("at"))
    won = draws.withColumn("at", F.floor("point")).join(reach, "at").filter("point >= low and point < high")
    extra = won.groupBy("number", "shard").agg(F.count("*").alias("extra"))
    # A row for each source and shard, made in many tasks; a source's shards are summed up in cells of some thousands.
    last = sources.agg(F.max("number")).first()[0]
    every = drawn.sparkSession.range(shards * ((-1 if last is None else last) + 1)).select(
        F.call_function("div", F.col("id"), F.lit(shards)).alias("number"), (F.col("id") % shards).alias("shard")
    ).join(drawn.select("number", "blocks", "whole"), "number")
    counts = every.join(extra, ["number", "shard"], "left").withColumn("count", F.col("whole") + F.coalesce("extra", F.lit(0)))
    # Written before it is ranked, as are the lots: the plan of all steps in one would be too large for a small driver.
    counts = stage(counts.withColumn("cell", F.call_function("div", F.col("shard"), F.lit(4096))), "counts")
    # Lots are rows that become thousands of slots each, so they are dealt out by their slots, not by their own size.
    parts = max(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / block / 100_000) + 1)
    lots = stage(ranked(counts, ["number"], "cell", ["shard"], "begin", value="count").filter("count > 0"), "lots")
    slots = lots.repartition(parts, "number", "shard").select(
        "number", "blocks", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("count") - 1)).alias("n")
    ).filter(F.col("n") < F.col("blocks") * turns)
    turn, index = F.call_function("div", F.col("n"), F.col("blocks")), F.col("n") % F.col("blocks")
    return slots.select(
        "number", "shard", _permuted(seed + 2, F.col("number"), turn, index, F.col("blocks")).alias("block")
    )


def mix(
    docs: DataFrame, key: str = "__row", source: str = "source", id_column: str = "doc_id", text: str = "text",
    weigh=weigh_in_turn, block: int = 64, shard_slots: int = 4096, seed: int = 29, turns: int = TURNS,
) -> Mixture:
    """The mixture of all words of ``docs``, which has a column ``key`` that differs between any two rows.

    ``weigh`` gives a source's weight by its place in code-point order, null last. Null, empty and blank texts have no
    words and take none; a source without words has target 0; a null source is a source; rows with equal or null ids
    are rows of their own; without rows all parts are empty. No row is taken more than ``turns`` times.
    """
    plain = stage(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_column)).bitwiseAND(F.lit(_POSITIVE)).alias("h"),
        ),
        "sizes",
    )
    sizes = plain.groupBy("source").agg(F.sum("size").alias("size"))
    sources = targets(sizes, weigh, turns).withColumn("blocks", F.call_function("div", F.col("size") + (block - 1), F.lit(block)))
    sources = stage(sources, "sources")
    cells = cells_for(plain.count())
    named = sources.select(F.col("source").alias("of"), "number", F.col("size").alias("source_size"), "target")
    rows = plain.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    rows = rows.withColumn("cell", F.shiftright("h", 62 - (cells.bit_length() - 1)))
    laid = stage(ranked(rows.filter("size > 0"), ["number"], "cell", ["h", "key"], "start", value="size").select("key", "number", "size", "start"), "laid")
    end = F.col("start") + F.col("size")
    first, last = F.call_function("div", F.col("start"), F.lit(block)), F.call_function("div", end - 1, F.lit(block))
    pieces = laid.select("key", "number", "start", end.alias("end"), F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = pieces.select("number", "block", "key", (low - F.col("start")).alias("from"), (high - low).alias("words"))
    slots = draw_slots(sources, block, shard_slots, seed, turns)
    often = stage(slots.groupBy("number", "block").agg(F.count("*").alias("times")), "often")
    sums = pieces.join(often, ["number", "block"]).groupBy("key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = rows.select("key", "size", "source_size", "target", "h").join(sums, "key", "left").select(
        F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "h"
    )
    return Mixture(sources, slots, pieces, taken)


def copies(docs: DataFrame, key: str, seed: int = 31, **how) -> DataFrame:
    """(key, copies): how often the mixture takes each row, those it does not take left out. Taken words by size, a part
    of a turn rounded up with that chance by a seeded hash of the row's id, so that the expected words of a source stay
    its target. Rows without words weigh nothing and stay once."""
    taken = mix(docs, key, **how).taken
    turns = F.col("taken") / F.col("size")
    coin = F.xxhash64(F.lit(seed), "h").bitwiseAND(F.lit(_POSITIVE)) / F.lit(float(1 << 62))
    made = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(turns + coin)).cast("int")
    return taken.select(key, made.alias("copies")).filter("copies > 0")


def repeat_rows(docs: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """``docs`` with each row as often as ``counted`` says, those it does not name left out. Joined by a shuffle at every
    size, since the counts grow with the rows."""
    named = counted.withColumnRenamed("copies", "__copies").hint("merge")
    return docs.join(named, key).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop(
        "__copies", "__copy"
    )
