"""Removal of repeated strings against brute force, and the suffix array against sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tablehaul.llm import suffix


def brute(docs: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """(bytes, removed, spans, hash of what is left) per place in ``docs``, which are in order."""
    seen, out = set(), {}
    for place, (_, text) in enumerate(docs):
        covered = np.zeros(len(text) + 1, bool)
        for start in range(len(text) - length + 1):
            string = text[start : start + length]
            if string in seen:
                covered[start : start + length] = True
            seen.add(string)
        kept = bytes(b for b, c in zip(text, covered) if not c)
        spans = int(np.sum(covered[:-1] & ~np.append(False, covered[:-2]))) if len(text) else 0
        out[place] = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def results(df, length):
    made = suffix.remove_repeats(df, length, keep_text=False).collect()
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in made]


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abcdefgh", bytes(range(256))])
@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 7, 30, 31, 32, 500])
def test_suffix_array(letters, size):
    rng = random.Random(size)
    text = np.array([1 + rng.choice(letters) for _ in range(size)], np.int64)
    wanted = sorted(range(size), key=lambda i: text[i:].tolist())
    assert suffix.suffix_array(text).tolist() == wanted


@pytest.mark.parametrize("length", [24, 60, 100])
@pytest.mark.parametrize("hot", [0, 10_000])
def test_brute_force(plain, length, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_UNITS", hot)
    made, df = plain
    docs = sorted((r[0], (r[1] or "").encode()) for r in made)
    wanted = {docs[p][0]: v for p, v in brute(docs, length).items()}
    got = results(df, length)
    assert len(got) == len(wanted)
    assert {g[0]: g[1:] for g in got} == wanted
    assert sum(v[1] for v in wanted.values()) > 1000


def test_repeated_and_null_ids(odd):
    made, df = odd
    got = results(df, 60)
    assert len(got) == len(made)
    # Rows of one id come in any order, so only what does not depend on it is compared: the bytes that stay in all.
    docs = sorted(((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in made)
    wanted = brute(docs, 60)
    assert sum(g[1] for g in got) == sum(v[0] for v in wanted.values())
    twice = [g for g in got if g[0] == made[0][0]]
    assert len(twice) == 2 and sorted(g[2] == g[1] for g in twice)[1]


def test_empty(none):
    assert results(none, 100) == []
