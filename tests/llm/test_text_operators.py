"""Decontamination, SimHash, packing and I-Match against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablehaul.llm import common, decontamination, imatch, packing, simhash
from tablehaul.llm.common import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Decontamination


def contaminated(docs, items, window):
    phrases = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for phrase, ids in phrases.items():
            for i in range(len(words) - len(phrase) + 1):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= ids
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def items_of(made):
    return [(1, made[0][1]), (2, "one two"), (3, None), (4, "..."), (5, made[5][1][:200]), (5, made[5][1][:200]),
            (None, made[6][1]), (6, "aaaa aaaa"), (7, "no such words at all here")]


@pytest.mark.parametrize("window", [3, 10])
@pytest.mark.parametrize("block", [300, 2 << 20])
def test_contamination(spark, odd, window, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    made, df = odd
    items = items_of(made)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(df, benchmark, window).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    wanted = contaminated([(r[0], r[1]) for r in made], named, window)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == wanted
    assert sum(w[2] for w in wanted) > 50


def test_contamination_near(spark):
    docs = spark.createDataFrame([(1, "a b c d x e f g"), (2, "a b c d e f g"), (3, "g f e d c b a"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d e f g")], "item_id long, text string")

    def hit(slop):
        return {r["doc_id"] for r in decontamination.contamination(docs, items, 7, slop).collect() if r["n_hit"]}

    assert hit(0) == {2}
    assert hit(1) == {1, 2}


def test_contamination_empty(spark, plain, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(plain[1], nothing).collect()} == {0}
    assert decontamination.contamination(none, nothing).collect() == []


# SimHash


def simhash_of(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_of(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(odd):
    made, df = odd
    got = simhash.near_groups(simhash.fingerprints(df)).collect()
    prints = [simhash_of(r[1]) for r in made]
    roots = groups_of(prints, 2)
    least = {}
    for r, root in zip(made, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    wanted = sorted(((r[0], p, least.get(root)) for r, p, root in zip(made, prints, roots)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=repr) == wanted


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("most", [2, 64])
def test_simhash_links(spark, distance, most, monkeypatch):
    """Dense clouds of fingerprints, so that lists of any length occur."""
    monkeypatch.setattr(simhash, "LIST_PAIRS", most)
    rng = random.Random(distance)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(30):
            v = center
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), distance).collect()
    for a, b in edges:
        assert 0 < bin((a ^ b) & (1 << 64) - 1).count("1") <= distance
    at = {s[0]: i for i, s in enumerate(signed)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(at[a])] = find(at[b])
    wanted = groups_of(values, distance)
    pairs = {(find(i), w) for i, w in enumerate(wanted)}
    assert len(pairs) == len(set(wanted)) == len({p[0] for p in pairs})


def test_one_of_each_group(odd, none):
    from tablehaul.llm.common import keyed

    made, df = odd
    kept = simhash.first_of_each_group(keyed(df), "__row")
    assert kept.distinct().count() == kept.count()
    assert kept.count() == len(set(groups_of([simhash_of(r[1]) for r in made], 2)))
    assert simhash.near_groups(simhash.fingerprints(none)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200, 250: 200}


def test_a_round_of_components_has_three_shuffles(spark, monkeypatch):
    """Its tasks, each of which the driver keeps a record of, are as many as the shuffles take."""
    plans, kept = [], common.stage

    def stage(df, label="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(common, "stage", stage)
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(10)], "a long, b long"))
    assert {r["root"] for r in got.collect()} == {0}
    assert len(plans) > 2 and all(p.count("Exchange ") <= 3 for p in plans)


# Packing


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 2, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(200))
        room: list[int] = []
        for item in sorted(range(200), key=lambda i: (-lengths[i], i)):
            fits = [r for r in room if r >= lengths[item]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - lengths[item])
            else:
                room.append(capacity - lengths[item])
        assert sorted(room) == sorted(capacity - sum(lengths[i] for i in r) for r in rows)


@pytest.mark.parametrize("length", [16, 512])
def test_pack_round_trip(odd, vocabulary, length):
    made, df = odd
    encode = packing.encoder(*vocabulary)
    parts = {}
    for r in packing.pack(df, *vocabulary, length=length).collect():
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == length and set(ids[r["n_tokens"] :]) <= {50256}
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        for i, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            parts.setdefault(doc, []).append((start, ids[r["cu_seqlens"][i] : r["cu_seqlens"][i + 1]]))
    wanted = Counter((r[0], tuple([*encode.encode_ordinary(r[1] or ""), 50256])) for r in made)
    once = {k[0]: k[1] for k, n in wanted.items() if n == 1 and sum(x[0] == k[0] for x in wanted) == 1 and k[0] is not None}
    for doc, tokens in once.items():
        assert [t for _, piece in sorted(parts[doc]) for t in piece] == list(tokens)
    assert sum(len(p) for ps in parts.values() for _, p in ps) == sum(len(t) * n for (_, t), n in wanted.items())


def test_pack_empty(none, vocabulary):
    assert packing.pack(none, *vocabulary).collect() == []


# I-Match


def edits(made):
    order = sorted(made, key=lambda r: -r[0])
    out = {}
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[r[0]] = (len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())
    return out


def test_edited(plain):
    made, df = plain
    got = imatch.compare_edited(df).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == edits(made)
    by_text = {}
    texts = {r[0]: r[1] or "" for r in made}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])


def test_imatch_prints(plain):
    """The fingerprint from its definition: the frequencies, the band and each subset's terms."""
    made, df = plain
    texts = {r[0]: {w for w in re.split(imatch._APART, (r[1] or "").lower()) if w} for r in made}
    often = Counter(w for t in texts.values() for w in t)
    band = {w for w, n in often.items() if 2 <= n <= 0.6 * len(made)}
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, most=0.6).collect()}

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    for doc, words in texts.items():
        codes = sorted(signed(xxhash.xxh64_intdigest(w.encode(), 42)) & 0x7FFFFFFF for w in words & band)
        if not codes:
            assert len({got[doc][i : i + 4] for i in range(0, 192, 4)}) == 1
            continue
        for i, (shift, mask, cell) in enumerate(imatch.SUBSETS):
            h = 42
            for c in codes:
                if c >> shift & mask == cell:
                    h = xxhash.xxh64_intdigest(c.to_bytes(4, "little", signed=True), h)
            assert got[doc][4 * i : 4 * i + 4] == f"{h & 0xFFFF:04x}"


def test_imatch_odd(odd, none):
    made, df = odd
    assert imatch.compare_edited(df).count() == len(made)
    assert imatch.compare_edited(none).collect() == []
    assert imatch.fingerprints(none).collect() == []
    one = df.filter(F.col("text") == "one two").limit(1)
    row = imatch.compare_edited(one).first()
    assert (row["n_chars"], row["near_next"]) == (7, 1.0)
