"""Scripts in chunks against the same scripts in one piece."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tablehaul.functions.text import statements
from tablehaul.operators import scripts

SCRIPT = """-- first; comment's "x
insert into t values ('a;b''c', "na;me""x");; /* block ; ' " */ update - x / y;
'unfinished -- not /* comment ; ''' ; --- ; x
/*/ ; */ select 1; /**/;/* ** ; **/ - -; last 'x"""


def whole(spark, texts):
    made = spark.createDataFrame(list(texts.items()), "k string, t string")
    return {k: held for k, held in made.select("k", statements(F.col("t"))).collect()}


def joined(rows):
    """The statements by script; their numbers and those of their parts have to be without gaps."""
    found = {}
    for r in rows:
        found.setdefault(r["script"], {}).setdefault(r["statement_no"], {})[r["part_no"]] = r["statement"]
    assert all(sorted(held) == list(range(len(held))) for of in found.values() for held in (of, *of.values()))
    return {k: ["".join(of[i][p] for p in sorted(of[i])) for i in sorted(of)] for k, of in found.items()}


def cut(name, text, size):
    return [(name, i, text[k : k + size]) for i, k in enumerate(range(0, len(text), size))]


def test_every_border(spark):
    sizes = (1, 2, 3, 5, 11, 1000)
    rows = [r for size in sizes for r in cut(f"s{size}", SCRIPT, size)]
    rows += [("empty", 0, None), ("blank", 0, " \n"), ("blank", 1, ";;"), (None, 0, "a;"), (None, 1, "b")]
    df = spark.createDataFrame(rows, "script string, chunk_no int, text string").withColumn("raw", F.lit("x")).repartition(5)
    wanted = whole(spark, {"x": SCRIPT})["x"]
    assert joined(scripts.split_chunks(df, block=4).collect()) == {f"s{size}": wanted for size in sizes} | {None: ["a", "b"]}


@pytest.mark.parametrize("seed", range(3))
def test_random_scripts(spark, seed):
    rng = random.Random(seed)
    pieces = ["'", '"', "--", "-", "/", "*", "/*", "*/", ";", "\n", "\r", " ", "x", "''", '""', "abä"]
    texts = {f"t{i}": "".join(rng.choices(pieces, k=rng.randrange(1, 60))) for i in range(40)}
    rows = [r for name, text in texts.items() for r in cut(name, text, rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "script string, chunk_no int, text string").repartition(4)
    wanted = {k: v for k, v in whole(spark, texts).items() if v}
    assert joined(scripts.split_chunks(df, block=8).collect()) == wanted


def test_long_statements_stay_in_parts(spark):
    text = "a;  insert 'x" + "y;'' " * 2000 + "' ;\n\n b"
    rows = spark.createDataFrame(cut("s", text, 100), "script string, chunk_no int, text string")
    found = scripts.split_chunks(rows, most=1000).collect()
    assert joined(found) == {"s": whole(spark, {"s": text})["s"]}
    assert max(len(r["statement"]) for r in found) <= 100 and max(r["part_no"] for r in found) > 50


def test_large_chunks_of_quotes(spark):
    text = "select '" + "''" * 300_000 + "'; -- " + "-" * 300_000 + "\n/*" + "*" * 300_000 + "/ x"
    rows = spark.createDataFrame(cut("s", text, 250_001), "script string, chunk_no int, text string")
    assert joined(scripts.split_chunks(rows, most=1 << 22).collect()) == {"s": text.split("; ")}


def test_files(spark, tmp_path):
    text = "".join(f"insert into t\r\nvalues ({i}, 'a;\n{i}'); -- {i};\n" for i in range(3000))
    (tmp_path / "one.sql").write_text(text, newline="")
    (tmp_path / "two.sql").write_text("x;y", newline="")
    chunks = scripts.read_chunks(spark, str(tmp_path), lines=7)
    found = joined(scripts.split_chunks(chunks, ("begin", "chunk_no")).collect())
    wanted = whole(spark, {"one": text, "two": "x;y"})
    assert {k.rsplit("/", 1)[1][:3]: v for k, v in found.items()} == wanted


def test_nothing(spark):
    assert scripts.split_chunks(spark.createDataFrame([], "script string, chunk_no int, text string")).collect() == []


def test_cutting_a_long_script_takes_one_pass(spark, tmp_path):
    """Each chunk sought from the script's beginning takes time with the square of its length: minutes for this one."""
    text = "ab ä " * 700_000
    docs = spark.createDataFrame([(0, "en", text, 7), (401, "en", None, 1)], "doc_id long, lang string, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    found = joined(driver.queries()["split_chunked_script"](spark, str(tmp_path)).collect())
    assert time.monotonic() - began < 40
    insert = "INSERT INTO t VALUES ('" + text + "; it''s')"
    assert found == {"en": [insert, '-- a ; comment\nUPDATE "t;" SET n = 7 /* ; */']}


def test_states_after_what_no_state_tells_apart(spark):
    """A text leads from each state to where it leads with its plain runs as they are."""
    texts = ["x", "-x", "x-", "a-b", "a/b*c", "a--b", "a/*b", "b*/c", "a\nb", "a'b-c", "a**/b", " - / ", "ab*", "", "//", "a-/b", "'a-b'"]
    openers = list(scripts._OPENERS.values())
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rests = [F.regexp_replace(F.concat(F.lit(o), F.col("t")), scripts._LEADING, "") for o in openers]
    slow = F.concat(*map(scripts._state_of, rests))
    for row in df.select("t", slow.alias("slow"), scripts.transition(F.col("t"), openers).alias("quick")).collect():
        assert row["slow"] == row["quick"], row["t"]
