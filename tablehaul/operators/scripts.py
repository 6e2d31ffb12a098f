"""Scripts of any size, split into statements chunk by chunk.

A chunk does not know whether it begins in plain text, in a string, in a quoted name or in a comment. So each chunk first
tells for every state in which it may begin the state in which it ends. These functions are put together in the order of
the chunks, block by block, which gives each chunk the state in which it begins; then it is split on its own. What a border
has cut is joined by the statement's number. No task holds more than a block of functions, a chunk, or one statement, and
a statement longer than ``most`` stays in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehaul.operators.positions import number_rows, whole_division
from tablehaul.session import stage

# The states, and a text that leads from plain text into each: plain; after "-" and "/", which may begin a comment; in a
# string, after a quote in it that may be doubled; the same in a quoted name; in a line comment; in a block comment, after
# "*" and "/" in it.
_OPENERS = {
    "p": "", "d": "-", "s": "/", "q": "'", "Q": "''", "n": '"', "N": '""', "l": "--", "b": "/*", "t": "/**", "u": "/*/",
}
STATES = "".join(_OPENERS)
_WHOLE = (
    r"""[^'"/-]++|--[^\r\n]*+[\r\n]|/\*(?:/\*|[^*]|\*(?!/))*+\*/|'(?:[^']++|'')*+'(?=[^'])|"(?:[^"]++|"")*+"(?=[^"])"""
    r"|-(?=[^-])|/(?=[^*])"
)
# All that is whole from the beginning on, and what goes on at the end of a block comment, a string and a name.
_LEADING = rf"(?s)\A(?:{_WHOLE})*+"
_IN_BLOCK = r"(?s)\A/\*(?:/\*|[^*/]|/(?=[^*])|\*(?=[^/]))*+"
_IN_STRING, _IN_NAME = r"(?s)\A'(?:[^']++|'')*+", r'(?s)\A"(?:[^"]++|"")*+'
# Statements that end inside the text, one after the other from its beginning on.
_ENDED = (
    r"(?s)\G((?:--[^\r\n]*+|/\*(?:/\*|[^*]|\*(?!/))*+(?:\*/|\z)|'(?:[^']++|'')*+(?:'|\z)"
    r"""|"(?:[^"]++|"")*+(?:"|\z)|[^;'"/-]++|[/-])*+);"""
)
# Characters that no state tells apart, with single ones between of what may begin or end a comment: a run of them does
# what one of them does, and that leads from each state to one of these.
_ALIKE = r"""[^'"/*\r\n-]++(?:[-/*][^'"/*\r\n-]++)*+"""
_AFTER_ALIKE = dict.fromkeys(STATES, "p") | {"q": "q", "n": "n", "l": "l", "b": "b", "t": "b", "u": "b"}
BLOCK = 256
_BLANKS = " \t\n\x0b\f\r"


def _state_of(rest: Column) -> Column:
    """The state of a text that begins with what is not whole in it."""
    block, string, name = (F.regexp_replace(rest, p, "") for p in (_IN_BLOCK, _IN_STRING, _IN_NAME))
    return (
        F.when(rest == "", "p").when(rest == "-", "d").when(rest == "/", "s").when(F.startswith(rest, F.lit("--")), "l")
        .when(F.startswith(rest, F.lit("/*")), F.when(block == "", "b").when(block == "*", "t").otherwise("u"))
        .when(F.startswith(rest, F.lit("'")), F.when(string == "", "q").otherwise("Q"))
        .otherwise(F.when(name == "", "n").otherwise("N"))
    )


def transition(text: Column, openers: list[str]) -> Column:
    """The states in which a text ends, one for each of the texts that may come before it. The text is read once; what is
    left of it, without all that makes no difference, is read for each of them."""

    def after(short: Column) -> Column:
        rests = F.transform(F.array(*[F.lit(o) for o in openers]), lambda o: F.regexp_replace(F.concat(o, short), _LEADING, ""))
        plain = "".join(_AFTER_ALIKE[state] for state, opener in _OPENERS.items() if opener in openers)
        return F.when(short == "x", plain).otherwise(F.array_join(F.transform(rests, _state_of), ""))

    return F.transform(F.array(F.regexp_replace(text, _ALIKE, "x")), after)[0]


def _after(state: Column, function: Column) -> Column:
    """The state, or the states of a function, after another function."""
    return F.call_function("translate", state, F.lit(STATES), function)


def _begin_states(functions: DataFrame, total: int, block: int) -> DataFrame:
    """(at, state): the state in which each place begins, of places from 0 to ``total`` with a ``function`` each."""
    lists = functions.groupBy(whole_division(F.col("at"), block).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "function"))), lambda x: x["function"]).alias("functions")
    )
    if total <= block:
        begun = lists.withColumn("state", F.lit("p"))
    else:
        lists = stage(lists, "functions")
        whole = lists.select(F.col("block").alias("at"), F.aggregate("functions", F.lit(STATES), _after).alias("function"))
        above = _begin_states(whole, -(-total // block), block)
        begun = lists.join(above.select(F.col("at").alias("block"), "state"), "block")
    first = F.struct("state", F.lit("").alias("begun"))
    states = F.aggregate(
        "functions", first,
        lambda a, f: F.struct(_after(a["state"], f).alias("state"), F.concat(a["begun"], a["state"]).alias("begun")),
        lambda a: a["begun"],
    )
    return begun.select("block", F.posexplode(F.split(states, "")).alias("place", "state")).select(
        (F.col("block") * block + F.col("place")).alias("at"), "state"
    )


def _running(counts: DataFrame, total: int, block: int) -> DataFrame:
    """(at, before): the sum of ``n`` at all places before each, of places from 0 to ``total``."""
    blocked = counts.withColumn("block", whole_division(F.col("at"), block))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("at")) - F.col("n")
    if total <= block:
        return blocked.select("at", inside.alias("before"))
    sums = stage(blocked.groupBy(F.col("block").alias("at")).agg(F.sum("n").alias("n")), "sums")
    above = _running(sums, -(-total // block), block).select(F.col("at").alias("block"), F.col("before").alias("begin"))
    return blocked.withColumn("inside", inside).join(above, "block").select("at", (F.col("begin") + F.col("inside")).alias("before"))


def read_chunks(spark: SparkSession, path: str, lines: int = 256) -> DataFrame:
    """(script, part, begin, chunk_no, text): text files as chunks of some lines. Carriage returns stay as they are."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("script"), F.col("_metadata.file_block_start").alias("begin"), F.col("value"),
        F.monotonically_increasing_id().alias("id"),
    )
    first = Window.partitionBy("script", "begin")
    placed = read.withColumn("chunk_no", whole_division(F.col("id") - F.min("id").over(first), lines))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    return placed.groupBy("script", "begin", "chunk_no").agg(joined.alias("text"))


def split_chunks(
    chunks: DataFrame, order: tuple[str, ...] = ("chunk_no",), script: str = "script", text: str = "text", most: int = 1 << 20,
    block: int = BLOCK,
) -> DataFrame:
    """(script, statement_no, part_no, statement): the statements of scripts that come in chunks, cut anywhere.

    ``order`` are the columns that put a script's chunks in order. A statement is trimmed, empty ones are left out, and
    the others numbered from 0 in each script. One longer than ``most`` characters is in several rows, whose ``part_no``
    counts from 0; nothing is lost between them. A null text is an empty chunk, a null script a script like any other.
    """
    plain = chunks.select(F.col(script).alias("script"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, total = number_rows(plain, ["script", *[f"__o{i}" for i in range(len(order))]], "place")
    rows = rows.select("script", (F.col("place") - 1).alias("at"), "text")
    begins = stage(rows.groupBy("script").agg(F.min("at").alias("first")), "scripts")
    # Where a script begins, what was before does not count: its function is the same for every state.
    known = rows.join(begins.select(F.col("first").alias("at"), F.lit(True).alias("is_first")), "at", "left")
    alone = F.repeat(transition(F.col("text"), [""]), len(STATES))
    any_state = transition(F.col("text"), list(_OPENERS.values()))
    functions = stage(known.select("at", F.when(F.col("is_first"), alone).otherwise(any_state).alias("function")), "functions")
    states = _begin_states(functions, total, block)
    begun = known.join(states, "at").withColumn("state", F.when(F.col("is_first"), "p").otherwise(F.col("state")))

    lookup = F.create_map(*[F.lit(x) for pair in _OPENERS.items() for x in pair])
    opener = F.element_at(lookup, F.col("state"))
    whole = F.concat(opener, F.col("text"))
    none = F.array().cast("array<string>")
    ended = F.when(F.contains("text", F.lit(";")), F.regexp_extract_all(whole, F.lit(_ENDED), F.lit(1))).otherwise(none)
    length = F.aggregate("ended", F.lit(0), lambda n, s: n + F.length(s) + 1)
    pieces = begun.select("script", "at", "is_first", opener.alias("opener"), whole.alias("whole"), ended.alias("ended"))
    pieces = pieces.withColumn("rest", F.substring("whole", length + 1, F.length("whole"))).withColumn(
        "pieces", F.concat("ended", F.array("rest"))
    )
    counts = stage(
        pieces.select("script", "at", "pieces", F.length("opener").alias("skip"), (F.size("ended") + F.coalesce(F.col("is_first").cast("int"), F.lit(0))).alias("n")),
        "pieces",
    )
    # A script's first chunk counts one more, before its pieces, so that no statement goes on from one script to the next.
    numbered = counts.join(_running(counts.select("at", "n"), total, block), "at").withColumn(
        "base", F.col("before") + F.col("n") - F.size("pieces") + 1
    )
    parts = numbered.select(
        "script", "at", "skip", "base", F.size("pieces").alias("size"), F.posexplode("pieces").alias("place", "piece")
    ).select(
        "script", "at", (F.col("base") + F.col("place")).alias("raw"), ((F.col("place") > 0) & (F.col("place") < F.col("size") - 1)).alias("inside"),
        F.when(F.col("place") == 0, F.substring("piece", F.col("skip") + 1, F.length("piece"))).otherwise(F.col("piece")).alias("piece"),
    )
    inside = parts.filter("inside").select("script", "raw", F.lit(0).cast("long").alias("part"), "piece")
    found = inside.union(_joined(stage(parts.filter("NOT inside").drop("inside"), "cut"), most))
    trimmed = found.withColumn("piece", F.when(F.col("part") == 0, _trimmed(F.col("piece"))).otherwise(F.col("piece")))
    return _renumbered(stage(trimmed.filter("piece != ''"), "statements"))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _joined(cut: DataFrame, most: int) -> DataFrame:
    """(script, raw, part, piece): what borders have cut, joined; longer statements in parts from 1 on."""
    is_text = F.col("piece").rlike(r"\S")
    sizes = cut.groupBy("raw").agg(
        F.sum(F.length("piece")).alias("size"), F.min(F.when(is_text, F.col("at"))).alias("first"), F.max(F.when(is_text, F.col("at"))).alias("last")
    )
    known = cut.join(sizes, "raw").filter("at BETWEEN first AND last")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    short = known.filter(F.col("size") <= most).groupBy("raw").agg(F.first("script").alias("script"), F.array_join(pieces, "").alias("piece"))
    left = F.when(F.col("at") == F.col("first"), F.ltrim("piece", F.lit(_BLANKS))).otherwise(F.col("piece"))
    both = F.when(F.col("at") == F.col("last"), F.rtrim(left, F.lit(_BLANKS))).otherwise(left)
    long = known.filter(F.col("size") > most).select("script", "raw", (F.col("at") - F.col("first") + 1).alias("part"), both.alias("piece"))
    return short.select("script", "raw", F.lit(0).cast("long").alias("part"), "piece").union(long)


def _renumbered(found: DataFrame) -> DataFrame:
    """Statements from 0 in each script, and parts from 0 in each statement."""
    heads = number_rows(found.groupBy("raw").agg(F.first("script").alias("script"), F.min("part").alias("begin")), ["raw"], "place").rows
    firsts = heads.groupBy(F.col("script").alias("of")).agg(F.min("place").alias("least"))
    placed = heads.join(firsts, F.col("script").eqNullSafe(F.col("of"))).select("raw", (F.col("place") - F.col("least")).alias("statement_no"), "begin")
    return found.join(placed, "raw").select("script", "statement_no", (F.col("part") - F.col("begin")).alias("part_no"), F.col("piece").alias("statement"))
