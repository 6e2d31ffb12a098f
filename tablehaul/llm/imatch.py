"""I-Match fingerprints: hashes of a text's terms of middling rarity, under several random subsets of the lexicon.

The lexicon holds the terms whose document frequency lies in a band. A text's distinct lexicon terms are sorted, and for
each of 48 seeded subsets of the lexicon those in the subset are hashed together. Texts that differ in a few terms keep
the hashes of the subsets that hold none of these. The subsets hold a 4th, 16th, 64th or 256th of the lexicon, twelve of
each size: the small ones survive large edits of long texts, the large ones tell texts of few terms apart. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import keyed, stage

# The band of document frequencies, as shares of all rows. As a row has a bounded mean number of distinct terms, at most
# mean / LEAST_SHARE terms are that frequent, however many rows there are: that bounds what is broadcast.
LEAST_SHARE = 0.002
MOST_SHARE = 0.01
# Subsets as (shift, mask, cell): they hold the terms of which these bits of the hash are the cell's number.
SUBSETS = tuple(
    [(0, 0xFF, c) for c in range(12)] + [(8, 0x3F, c) for c in range(12)] + [(14, 0xF, c) for c in range(12)]
    + [(18 + 2 * (c // 4), 0x3, c % 4) for c in range(12)]
)
_PRINT = 4
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The hashes of the distinct words of a text: runs of letters, digits and other characters beyond ASCII."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), _APART))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term): the hashed terms whose document frequency is in the band of shares, counted over all rows, staged; one band
    at every size, but that a term of one row tells nothing and is left out."""
    rows = docs.count()
    often = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stage(often.filter((F.col("df") >= max(2, least * rows)) & (F.col("df") <= most * rows)).select("term"), "lexicon")


def _digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFF))), _PRINT, "0"))


def _print(found: Column, whole: Column) -> Column:
    """Four hex digits per subset, from the hash of the terms of ``found`` in it, which are sorted and distinct. A text
    without any lexicon term has the hash of all its terms for every subset."""

    held = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("shift", "mask", "cell"), s)]) for s in SUBSETS])

    def subset(s: Column) -> Column:
        inside = F.filter(found, lambda t: F.call_function("shiftright", t, s["shift"]).bitwiseAND(s["mask"]) == s["cell"])
        return _digits(F.xxhash64(inside))

    parts = F.array_join(F.transform(held, subset), "")
    return F.when(F.size(found) == 0, F.repeat(_digits(whole), len(SUBSETS))).otherwise(parts)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that hold terms of either text; equal fingerprints give 1."""
    blank = _digits(F.xxhash64(F.array().cast("array<int>")))
    places = F.sequence(F.lit(0), F.lit(len(SUBSETS) - 1))

    def piece(side: Column, i: Column) -> Column:
        return F.substring(side, i * _PRINT + 1, F.lit(_PRINT))

    held = F.size(F.filter(places, lambda i: (piece(a, i) != blank) | (piece(b, i) != blank)))
    same = F.size(F.filter(places, lambda i: (piece(a, i) != blank) & (piece(a, i) == piece(b, i))))
    return F.when(a == b, F.lit(1.0)).when(held == 0, F.lit(0.0)).otherwise(same / held)


def print_sides(texts: DataFrame, words: DataFrame, sides: dict[str, str], key: str, carried: list[str]) -> DataFrame:
    """(key, carried columns, a fingerprint per side): ``sides`` names the text column of each fingerprint column.

    The terms of all sides are one exploded stream: it meets the broadcast lexicon and goes back to one row per key,
    with partial lists before the shuffle. A row's other columns travel once, in an element of their own.
    """
    info = F.struct(*carried, *[F.xxhash64(F.array_sort(terms(F.col(c)))).alias(f"__all_{n}") for n, c in sides.items()])
    empty = F.lit(None).cast(texts.select(info.alias("i")).schema["i"].dataType)
    parts = [F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).cast("long").alias("term"), info.alias("info")))]

    def side(number: int, column: str) -> Column:
        element = [F.lit(number).alias("side"), empty.alias("info")]
        return F.transform(terms(F.col(column)), lambda t: F.struct(element[0], t.alias("term"), element[1]))

    parts += [side(i, c) for i, c in enumerate(sides.values())]
    stream = texts.select(F.col(key).alias("key"), F.explode(F.concat(*parts)).alias("e")).select("key", "e.*")
    known = F.broadcast(words.select(F.col("term").alias("known")))
    met = stream.join(known, F.col("term") == F.col("known"), "left").filter("side < 0 or known is not null")
    rows = met.groupBy("key").agg(
        F.first("info", ignorenulls=True).alias("info"),
        *[F.collect_list(F.when(F.col("side") == i, F.col("term").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias(f"__found_{n}") for i, n in enumerate(sides)],
    )
    rows = rows.select("key", "info", *[F.array_sort(F.array_distinct(f"__found_{n}")).alias(f"__found_{n}") for n in sides])
    rows = rows.select("key", "info", *[_print(F.col(f"__found_{n}"), F.col(f"info.__all_{n}")).alias(n) for n in sides])
    return rows.select(F.col("key").alias(key), *[F.col(f"info.{c}").alias(c) for c in carried], *sides)


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE
) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``. Null texts are empty; all texts without words share a
    fingerprint; equal texts have equal ones; null and repeated ids keep a row each."""
    rows = keyed(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    return print_sides(rows, lexicon(rows, "text", least, most), {"fingerprint": "text"}, "__row", ["doc_id"]).drop("__row")


def with_next(rows: DataFrame, key: str, id_column: str, text: str) -> DataFrame:
    """Add ``next_text`` and ``next_key`` of the following row by descending id (null last, equal ids by key); the
    last row's next is the first.

    Rows are dealt into cells by quantiles of the ids, and a window looks ahead inside a cell. The last row of a cell
    takes the first row of the next cell that has rows, of which there is one per cell.
    """
    count = rows.count()
    cells = max(2, min(4096, count // 1024))
    cuts = rows.agg(F.percentile_approx(id_column, [i / cells for i in range(1, cells)], 20 * cells)).first()[0]
    order = [F.col(id_column).desc_nulls_last(), F.col(key)]
    above = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<long>"), lambda c: c > F.col(id_column)))
    dealt = rows.withColumn("__cell", F.when(F.col(id_column).isNull(), F.lit(cells)).otherwise(above))
    inside = Window.partitionBy("__cell").orderBy(*order)
    ahead = dealt.withColumn("__n", F.lead(F.struct(F.col(text).alias("t"), F.col(key).alias("k"))).over(inside))
    place = F.struct(F.coalesce(-F.col(id_column), F.lit(0)), F.col(key))
    heads = dealt.groupBy("__cell").agg(F.min_by(F.struct(F.col(text).alias("t"), F.col(key).alias("k")), place).alias("head"))
    heads = stage(heads, "heads")
    line = Window.orderBy("__cell")
    turn = heads.select("__cell").withColumn("to", F.coalesce(F.lead("__cell").over(line), F.min("__cell").over(Window.partitionBy())))
    follow = turn.join(heads.select(F.col("__cell").alias("to"), "head"), "to").select("__cell", "head")
    found = ahead.join(follow, "__cell").withColumn("__n", F.coalesce("__n", "head"))
    return found.withColumn("next_text", F.col("__n.t")).withColumn("next_key", F.col("__n.k")).drop("__n", "head", "__cell")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the following one."""
    half = F.call_function("div", F.char_length(text), F.lit(2)).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row."""
    rows = keyed(docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    words = lexicon(rows)
    pairs = with_next(rows, "__row", "doc_id", "text").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    made = stage(print_sides(
        pairs, words, {"fingerprint": "text", "edited_fingerprint": "edited"}, "__row",
        ["doc_id", "n_chars", "edited_sha256", "next_key"],
    ), "prints")
    following = made.select(F.col("__row").alias("next_key"), F.col("fingerprint").alias("next_print"))
    return made.join(following, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
