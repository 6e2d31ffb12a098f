"""Phrases against brute force, and the filters against plain dictionaries."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import small
from tablehaul.llm import collocations
from tablehaul.llm.collocations import words_and_ends
from tablehaul.llm.quotients import Layout, counted, decoded, encoded
from tablehaul.session import scratch_dir


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(r[1] or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        held = {}
        for g, a in counts.items():
            if len(g) > 1 and a >= least:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                held[g] = (score, a, counts[g[:k]], counts[g[k:]])

        def inside(g):
            return any(
                len(h) > len(g) and 100 * held[h][1] >= share * held[g][1] and any(h[i : i + len(g)] == g for i in range(len(h)))
                for h in held
            )

        kept = sorted((-s, -a, " ".join(g).encode(), g, left, right) for g, (s, a, left, right) in held.items() if not inside(g))
        out += [(lang, i + 1, " ".join(g), -a, left, right, n[lang], -s) for i, (s, a, _, g, left, right) in enumerate(kept[:top])]
    return sorted(out)


def ours(df, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


def several_langs():
    made = small.odd_rows()
    extra = [(5000 + i, "ab ab ab ab, ab AB\tab. Ünder über ünder.x\ny z y z Y z!", lang, *made[0][3:]) for i, lang in enumerate([None, "en", "fr", None, "fr", "und"])]
    return [(*r[:2], ("en", "fr", None)[i % 3], *r[3:]) for i, r in enumerate(made)] + extra


@pytest.mark.parametrize("least,longest,top,share", [(3, 5, 2000, 100), (2, 4, 15, 60), (40, 5, 2000, 100)])
def test_phrases(spark, tmp_path, least, longest, top, share):
    rows = several_langs()
    wanted = brute(rows, least, longest, top, share)
    assert ours(small.frame(spark, rows, tmp_path), least=least, longest=longest, top=top, share=share) == wanted
    assert wanted


def test_ranges_do_not_change_the_result(spark, tmp_path, monkeypatch):
    rows = several_langs()
    monkeypatch.setattr(collocations, "RANGE", 512)
    assert ours(small.frame(spark, rows, tmp_path), least=3) == brute(rows, 3, 5, 2000, 100)


def test_no_rows_and_no_phrases(spark, none):
    assert ours(none) == []
    assert ours(spark.createDataFrame([("a b", None), (None, "en")], "text string, lang string")) == []


def test_long_texts_are_read_piece_by_piece():
    text = b"ab cd. ef! " * 50 + b"gh " * 100 + b"? IJ \xc3\x84"
    whole = [w for words in words_and_ends(text, 1 << 20) for w in words]
    parts = list(words_and_ends(text, 32))
    assert [w for words in parts for w in words] == whole and len(parts) > 10
    assert all(words[-1] == b"." for words in parts[:-1])


@pytest.mark.parametrize("length", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 3, 12, 13, 17, 26, 31, 40])
def test_filters(length, bits):
    rng = np.random.default_rng(length * 100 + bits)
    ids = [np.append(rng.integers(0, 1 << bits, 3000), [0, (1 << bits) - 1]).astype(np.uint64) for _ in range(length)]
    ids = [np.append(i, i[:500]) for i in ids]
    layout = Layout(length, bits)
    keys, counts, place = counted(layout.keys(ids))
    assert all((a == b[place]).all() for a, b in zip(ids, layout.ids(keys)))
    wanted = Counter(zip(*(i.tolist() for i in ids)))
    found = zip(zip(*(i.tolist() for i in layout.ids(keys))), counts.tolist())
    assert dict(found) == wanted
    counts[::7] += 253
    counts[::11] += 1 << 40
    held, again = decoded(encoded(keys, counts, layout.width, layout.tails), layout.width, layout.tails)
    assert all((a == b).all() for a, b in zip(held, keys)) and (again == counts).all()
    if bits == 17:
        plain = len(counts) * (8 * len(keys) + 1)
        assert len(encoded(keys, np.ones(len(counts), np.int64), layout.width, layout.tails)) < plain


def test_texts_are_removed_once_their_ids_are_written(spark, plain):
    def held():
        return {p.name for p in Path(scratch_dir(spark).removeprefix("file:")).glob("coded-*")}

    before = held()
    assert collocations.collocations(plain[1], least=3).count() > 0
    assert held() == before


def test_a_slice_is_full_after_a_million_words():
    assert list(collocations._Slice().add("en", b"ab " * 1_100_000)) == [True]
    assert list(collocations._Slice().add("en", b"ab " * 900_000)) == [False]


def test_rounds_carry_only_what_they_count(spark, monkeypatch):
    """Slices meet the answers of a round by a shuffle, so texts go along no further than phrases may still be frequent,
    and what is known of a language is a written table, small enough to be sent to the slices."""
    staged, kept = [], collocations.stage

    def stage(df, label="stage"):
        staged.append((label, kept(df, label)))
        return staged[-1][1]

    monkeypatch.setattr(collocations, "stage", stage)
    monkeypatch.setattr(collocations, "remove_staged", lambda df: None)
    lines = [f"red blue green gold {'. '.join(f'w{(i * 37 + j * j) % 90}' for j in range(60))}" for i in range(200)]
    docs = spark.createDataFrame([("en", line) for line in lines], "lang string, text string")
    rows = collocations.collocations(docs).collect()
    assert ("red blue green gold", 200) in {(r.phrase, r.a) for r in rows}
    rounds = [df for label, df in staged if label == "round"]
    carried = [df.agg(F.sum(F.length("tokens"))).first()[0] for df in rounds]
    assert len(rounds) == 4 and carried[1] * 2 < carried[0] and carried[2] <= carried[1] and carried[3] is None
    assert [df.count() for label, df in staged if label == "parts"] == [1]
