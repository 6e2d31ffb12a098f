"""Ranked search against brute force, tiles against plain sums."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import small
from tablehaul.llm import search
from tablehaul.llm.search import Best, Weights, length_marks, term_pieces, tile_scores


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, best=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n_docs, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in docs:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return sorted(out, key=str)


def the_items(rows):
    long = [r[1] for r in rows if r[1] and len(r[1]) > 20000][0]
    made = [(f"i{i}", rows[i][1][:200]) for i in range(0, 40, 3)] + [("long", long), ("copy", rows[0][1]), ("copy", rows[0][1])]
    return made + [("none", None), ("empty", ""), (None, "alpha ALPHA beta"), ("absent", "qqqq 42"), ("marks", "!? -")]


@pytest.mark.parametrize("best", [1, 10])
@pytest.mark.parametrize("rows", [small.rows(), small.odd_rows()], ids=["plain", "odd"])
def test_ranks(spark, tmp_path, rows, best):
    items = the_items(rows)
    asked = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, rank int").repartition(3)
    found = search.search(small.frame(spark, rows, tmp_path), asked, best).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, items, best)


def test_slices_blocks_and_salts(spark, tmp_path, monkeypatch):
    rows = [(i, f"common word{i % 7} rare{i % 61} " + "filler " * (i % 13), *small.rows()[0][2:]) for i in range(800)]
    items = [(str(i), f"common rare{i} word{i % 7} word{i % 7}") for i in range(70)]
    for name, value in (("SLICE", 1000), ("BLOCK", 300), ("ITEMS", 5), ("TOGETHER", 2)):
        monkeypatch.setattr(search, name, value)
    asked = spark.createDataFrame(items, "item_id string, text string")
    found = search.search(small.frame(spark, rows, tmp_path), asked).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, items)


def test_no_rows(spark, none):
    asked = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "alpha"), (2, None)], "doc_id long, text string")
    assert search.search(none, asked).count() == 0
    assert search.search(docs, asked.filter("false")).count() == 0
    assert search.search(docs.filter("doc_id = 2"), asked).count() == 0


def test_products_stay_exact():
    """Weights of which one alone passes 2^53 with the largest impact, and sums that do."""
    rng = np.random.default_rng(5)
    items, columns, documents = 6, 300, 40
    item, column = map(np.ravel, np.mgrid[:items, :columns])
    value = rng.integers(1, search.EXACT, len(item))
    value[::50] = 3 * search.EXACT + 17
    tiles = Weights(items, item, column, value).tiles(most=64)
    assert all((dense.sum(axis=1) <= search.EXACT).all() and len(c) <= 64 for c, dense in tiles)
    document, place = map(np.ravel, np.mgrid[:documents, :columns])
    impact = rng.integers(1, 100, len(place))
    impact[::9] = search.IMPACT
    wanted = defaultdict(int)
    by = impact.reshape(documents, columns)
    for i, c, v in zip(item.tolist(), column.tolist(), value.tolist()):
        for d in range(documents):
            wanted[i, d] += v * int(by[d, c])
    held = np.array([[wanted[i, d] for d in range(documents)] for i in range(items)], dtype=object)
    small_enough = held < 2**63
    got = tile_scores(tiles, documents, document, place, impact, items)
    assert small_enough.all() and (got == held.astype(np.int64)).all()


def test_ties_are_kept_in_the_order_of_ids():
    held = Best(1, 3)
    for ids in ([9, 8, 7, 6, 5], [4, 30], [2, 1, 50]):
        held.add(np.full((1, len(ids)), 7), np.array(ids), np.zeros(len(ids), bool))
    held.add(np.array([[9, 0, 7]]), np.array([0, 0, 0]), np.array([True, False, True]))
    assert held.rows[1].tolist() == [9, 7, 7] and held.rows[3].tolist() == [0, 1, 2] and held.rows[2].tolist() == [1, 0, 0]


def test_marks_and_pieces():
    assert length_marks(np.array([0, 10**8]), 10**12, 10**13).tolist() == [25, 25 + 75 * 10**20 // 10**13]
    text = b"Ab cd-ef 12 " * 40 + b"x" * 90 + b" \xc3\x84 end"
    assert [w for p in term_pieces(text, 50) for w in p] == [w for p in term_pieces(text, 1 << 20) for w in p]
