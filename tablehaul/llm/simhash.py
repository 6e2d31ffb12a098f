"""SimHash fingerprints of word shingles and the groups that fingerprints within a few bits form.

Postings are kept by byte position. A posting list of one positional byte would hold 1/256 of all fingerprints, so the
lists are kept for conjunctions of positional bytes: the eight bytes are dealt into four units of two, and a pair that
differs in at most two bits agrees in at least two units, so it meets in at least one of the six lists of two units.
Pairs of a list tally the positional bytes that they share, those with the guaranteed number (8 less the distance) stay,
and the exact distance is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import connected_components, kind, map_rows, stage, text_bytes

_UNITS = tuple(combinations(range(4), 2))
# Beyond this, trying all pairs of a list costs more than the 33 variants of each member.
LIST_PAIRS = 64


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text: a bit is 1 if more than half of the shingles' hashes have it. No words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
    counts = np.zeros(64, np.int64)
    held = np.array(hashes, "<u8")
    for start in range(0, len(held), 1 << 15):
        part = held[start : start + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(held), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, the columns ``keep``, fingerprint): one row per row of ``docs``; the fingerprint's bits as a signed long.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles keep their repeats. A text with fewer
    words is one shingle; null, empty and blank texts have fingerprint 0. A null id stays null. Other columns of
    ``docs`` are not read.
    """

    def rows(part):
        for row in part:
            value = fingerprint_of(row.pop("text"), shingle)
            yield row | {"fingerprint": value - (1 << 64) if value >> 63 else value}

    read = docs.select(F.col(id_column).alias("doc_id"), *keep, text_bytes(text).alias("text"))
    kept = "".join(f"{c} {kind(read, c)}, " for c in ("doc_id", *keep))
    return map_rows(read, rows, f"{kept}fingerprint long")


def _unit(value: Column, unit: int) -> Column:
    return F.shiftrightunsigned(value, 16 * unit).bitwiseAND(F.lit(0xFFFF))


def _list_key(value: Column, pair: tuple[int, int]) -> Column:
    return F.shiftleft(_unit(value, pair[0]), 16).bitwiseOR(_unit(value, pair[1]))


def links(values: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within ``distance`` (0 to 2) bits.

    ``values`` has one column ``fingerprint`` of distinct values. Lists of up to ``LIST_PAIRS`` members try all pairs.
    In longer lists, which a group of near copies may fill with any share of all rows, each member is written under
    itself and under every value one bit away; members that meet under a value are within two bits, and those within
    two bits meet, so the links to the smallest member of each value connect the same groups with 33 rows a member.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the distance is 0, 1 or 2 bits")
    f = F.col("fingerprint")
    listed = F.array(*[F.struct(F.lit(i).alias("list"), _list_key(f, p).alias("key")) for i, p in enumerate(_UNITS)])
    postings = values.select(f, F.explode(listed).alias("k")).select("fingerprint", "k.list", "k.key")
    counts = postings.groupBy("list", "key").agg(F.count("*").alias("members")).filter("members > 1")
    held = stage(postings.join(counts, ["list", "key"]), "postings")
    short = held.filter(F.col("members") <= LIST_PAIRS).groupBy("list", "key").agg(
        F.sort_array(F.collect_list("fingerprint")).alias("all")
    )
    pairs = short.select(F.posexplode("all").alias("at", "a"), "all").select(
        "a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b")
    )
    apart = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(
        F.when(F.shiftrightunsigned(apart, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for i in range(8)
    )
    near = pairs.withColumn("shared", shared).filter((F.col("shared") >= 8 - distance) & (F.bit_count(apart) <= distance))
    long = held.filter(F.col("members") > LIST_PAIRS)
    free = [
        F.when(F.col("list") == i, F.array(*[F.lit(16 * u + b) for u in range(4) if u not in p for b in range(16)]))
        for i, p in enumerate(_UNITS)
    ]
    flips = F.concat(F.array(F.lit(-1)), F.coalesce(*free))
    variants = long.select("fingerprint", "list", "key", F.explode(flips).alias("bit")).withColumn(
        "value", F.when(F.col("bit") < 0, f).otherwise(f.bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    )
    if distance == 1:
        center = F.max(F.when(F.col("bit") < 0, f))
    else:
        center = F.min(f)
    hubs = variants.groupBy("list", "key", "value").agg(center.alias("center"), F.count("*").alias("n")).filter("n > 1")
    met = variants.join(hubs, ["list", "key", "value"]).select(F.col("center").alias("a"), f.alias("b"))
    if distance == 0:
        return near.select("a", "b").limit(0)
    return near.select("a", "b").union(met.filter("a is not null and a != b")).distinct()


def near_groups(prints: DataFrame, distance: int = 2) -> DataFrame:
    """``prints`` with component_id, the smallest doc_id that links of at most ``distance`` bits reach, and root, the
    smallest fingerprint they reach. Equal fingerprints are linked at distance 0 and joined as one class, so copies make
    no pairs. Null ids are in a group, but never its smallest; a group of null ids has component_id null.
    """
    prints = stage(prints, "fingerprints")
    classes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fingerprint"), distance))
    labelled = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    components = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(labelled.join(components, "root").select("fingerprint", "component_id", "root"), "components")
    return prints.join(by_print, "fingerprint")


def first_of_each_group(docs: DataFrame, key: str, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(key): of each near-duplicate group the row that stays, the one with the smallest doc_id, then ``key``, a column
    that differs between any two rows; a null doc_id comes after all others."""
    groups = near_groups(fingerprints(docs, shingle, keep=(key,)), distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", key)).alias("first")
    return groups.groupBy("root").agg(first).select(F.col("first")[key].alias(key))
