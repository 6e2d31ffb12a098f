"""Toxicity, sharding, mixing, page extraction and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablehaul.llm import extraction, mixing, queries, sharding, toxicity
from tablehaul.llm.common import keyed
from tablehaul.llm.labelled_pages import labelled_page
from tablehaul.session import stage

SMALL = "/root/testdata/sf0.01"


# Toxicity


def test_nearest_is_exact():
    rng = random.Random(2)
    idf = np.array([rng.random() + 0.5 for _ in range(40)])
    examples = []
    for i in range(700):
        terms = sorted(rng.sample(range(40), rng.randint(0, 6)))
        examples.append((i, int(any(t < 10 for t in terms)), terms, [rng.randint(1, 4) for _ in terms]))
    index = toxicity.make_index(examples, idf, {0: 1.0, 1: 1.0})
    dense = np.zeros((700, 40))
    place = {int(d): p for p, d in enumerate(index.ids)}
    for d, _, terms, counts in examples:
        t, w = index.vector(terms, counts)
        dense[place[d], t] = w
    for _ in range(200):
        terms = sorted(rng.sample(range(40), rng.randint(1, 6)))
        t, w = index.vector(terms, [rng.randint(1, 3) for _ in terms])
        q = np.zeros(40)
        q[t] = w
        scores = dense @ q
        wanted = sorted(((s, i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-round(x[0], 9), x[1]))[:15]
        got = index.nearest(t, w, 15)
        assert [i for _, i in got] == [i for _, i in wanted]


def test_scores_against_dense_vectors(spark):
    """Scores from plain dense vectors of all words, with votes over all examples sorted by their cosine."""
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("ka", "mu", "ro", "li", "té") for b in ("ta", "li", "no", "se", "x")]
    rows = []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 30))] + [f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        if i % 4 == 0:
            words += [rng.choice(("vile", "crude"))] * rng.randint(1, 3)
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 240, 2)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}

    words = {i: Counter(t.lower().replace(",", "").split()) for i, t in rows}
    examples = {i: int(i % 4 == 0) for i in range(0, 240, 2)}
    up, down = sum(examples.values()), len(examples) - sum(examples.values())

    def marks(word):
        held = f" {word} "
        return {held[i : i + 4] for i in range(len(held) - 3)} | {held[:3]}

    def tests(sets):
        found = {}
        for t in set().union(*(sets[i] for i in examples)):
            a = sum(y for i, y in examples.items() if t in sets[i])
            b = sum(1 - y for i, y in examples.items() if t in sets[i])
            chi = (a * (down - b) - b * (up - a)) ** 2 * (up + down) / (up * down * (a + b) * (up + down - a - b + 0.5))
            found[t] = chi, (a + 0.5) / up / ((b + 0.5) / down)
        return found

    bearing = {t: min(1.0, max(toxicity.LEAST_BEARING, chi / toxicity.CHI_SQUARE)) for t, (chi, _) in tests(words).items()}
    runs = tests({i: set().union(*map(marks, w)) for i, w in words.items()})
    telling = {("run", t) for t, (chi, ratio) in runs.items() if chi >= toxicity.CHI_SQUARE and ratio >= toxicity.RATIO}
    bearing |= dict.fromkeys(telling, 1.0)
    counts = {
        i: Counter({t: n for t, n in w.items() if t in bearing})
        + Counter({("run", m): sum(n for x, n in w.items() if m in marks(x)) for _, m in telling if any(m in marks(x) for x in w)})
        for i, w in words.items()
    }
    df = Counter(t for c in counts.values() for t in c)
    order = list(bearing)
    weight = np.array([(np.log(241 / (1 + df[t])) + 0.1) * bearing[t] for t in order])
    dense = {i: np.array([1 + np.log(c[t]) if c[t] else 0.0 for t in order]) * weight for i, c in counts.items()}
    dense = {i: v / (np.linalg.norm(v) or 1) for i, v in dense.items()}
    assert all(dense[i].any() for i in examples)
    bare = toxicity.Index(*[np.array([*examples.values()])] * 2, np.ones(len(examples)), *[np.zeros(0)] * 11)
    bare.base = up / (len(examples) + 1)
    near = {
        i: sorted(((float(v @ dense[e]), k) for k, e in enumerate(examples) if e != i), key=lambda x: -x[0])[: toxicity.NEAREST]
        for i, v in dense.items()
    }
    near = {i: [x for x in held if x[0] > 1e-12] for i, held in near.items()}
    votes = np.array([toxicity._logit(bare.vote(near[e])) for e in examples])
    bare.calibration = toxicity._calibrate(votes, bare.labels, bare.importance)
    others = [i for i in dense if i not in examples]
    # Ties at the end of the nearest may fall to another example of the same cosine.
    same = [abs(got[i]["score"] - bare.score(near[i])) < 1e-6 for i in others]
    assert sum(same) >= 0.95 * len(others)
    assert all(len(got[i]["nearest"]) == min(3, len(near[i])) for i in others)
    assert all(abs(got[i]["nearest"][0]["similarity"] - near[i][0][0]) < 1e-9 for i in others if near[i])


def test_toxicity_held_out(spark):
    """Trained on two thirds of made-up labels, it finds the rest, whatever languages and ids."""
    rng = random.Random(4)
    bad, plain = ["vilething", "crudeword", "snarlmuck"], [f"{a}{b}" for a in "kamuro" for b in ("ta", "li", "no", "se")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, 1), (5001, "", 1), (None, "vilething crudeword", 1)], "doc_id long, text string, score int")
    known = spark.createDataFrame(labels + labels[:3] + [(7000, 1), (None, 1), (5001, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known, queries.learned_rows()).collect()}
    assert len(got) == 903
    held = [(got[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((s >= 0.7) == bool(y) for s, y in held)
    assert got[5000]["score"] == got[5001]["score"] < 0.2 and got[None]["score"] >= 0.7
    assert got[None]["nearest"][0]["label"] == 1


def test_toxicity_without_labels(spark, odd, none):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r["score"] for r in toxicity.toxicity(odd[1], nothing).collect()]
    assert len(scores) == len(odd[0]) and len(set(scores)) == 1 and 0 <= scores[0] < 0.7
    assert toxicity.toxicity(none, nothing).collect() == []


# Sharding


@pytest.mark.parametrize("shards", [1, 7, 40, 200])
def test_sharding(odd, shards):
    made, df = odd
    out = sharding.shard(df, shards).collect()
    assert Counter(repr(r["doc_id"]) + repr(r["text"]) for r in out) == Counter(repr(r[0]) + repr(r[1]) for r in made)
    slots, sources = defaultdict(list), defaultdict(Counter)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sources[r["source"]][r["shard"]] += 1
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    for source, by_shard in sources.items():
        even = sum(by_shard.values()) / shards
        assert all(abs(by_shard[s] - even) <= 2.5 for s in range(shards))


def test_sharding_is_steady(odd, none):
    def places():
        return sorted(map(repr, sharding.shard(odd[1], 5).select("doc_id", "text", "shard", "slot").collect()))

    assert places() == places()
    assert sharding.shard(none, 5).collect() == []


# Mixing


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 0), (None, 5000), ("e", 900)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = sorted((s for s in sizes if s[0]), key=lambda s: s[0]) + [s for s in sizes if s[0] is None]
    weight, cap = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}, {s: 3 * n for s, n in sizes}
    fixed, total = {}, sum(n for _, n in sizes)
    while True:
        free = [s for s in weight if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > cap[s]]
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    wanted = fixed | {s: unit * weight[s] for s in free}
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, size):
    df = spark.range(size).select(mixing._permuted(3, F.lit(4), F.lit(0), F.col("id"), F.lit(size).cast("long")).alias("p"))
    assert sorted(r["p"] for r in df.collect()) == list(range(size))


def test_mixture(odd):
    made, df = odd
    mixed = mixing.mix(keyed(df), block=8)
    rows = mixed.taken.collect()
    assert len(rows) == len(made)
    pieces, size, taken, target = defaultdict(list), Counter(), Counter(), {}
    for p in mixed.pieces.collect():
        pieces[p["key"]].append((p["from"], p["words"]))
    for r in rows:
        held = sorted(pieces[r["__row"]])
        assert sum(w for _, w in held) == r["size"] and r["taken"] <= 3 * r["size"]
        assert [f for f, _ in held] == [sum(w for _, w in held[:i]) for i in range(len(held))]
        size[r["source_size"]] += r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    for s in size:
        assert size[s] == s and abs(taken[s] - target[s]) <= 24
    again = {repr(r["__row"]): r["taken"] for r in mixing.mix(keyed(df), block=8).taken.collect()}
    assert again == {repr(r["__row"]): r["taken"] for r in rows}


def mixed(docs, **how):
    rows = keyed(docs)
    return mixing.repeat_rows(rows, mixing.copies(rows, "__row", **how), "__row").drop("__row")


def test_mixture_does_not_depend_on_where_files_lie(plain, tmp_path):
    df = plain[1]
    df.orderBy("n_chars").repartition(2).write.parquet(f"{tmp_path}/other")
    other = df.sparkSession.read.parquet(f"{tmp_path}/other")

    def taken(docs):
        return Counter(r["doc_id"] for r in mixed(docs, block=8).collect())

    assert taken(df) == taken(other)


def test_mixed_rows(odd, none):
    made, df = odd
    out = mixed(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in made}
    assert mixed(none).collect() == []


# Extraction


def expected(pieces):
    page = extraction.parse("".join(h for h, _ in pieces))
    y = extraction.labels_of(page, pieces)
    return "\n\n".join(t for i, t in enumerate(page.texts) if t is not None and y[i])


def test_marginals_are_exact():
    """Message passing against the sum over all states of small trees."""
    rng = np.random.default_rng(1)
    parents = np.array([-1, 0, 0, 1, 1, 2])
    features = rng.normal(size=(6, 3))
    model = extraction.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
    levels = [np.array([0]), np.array([1, 2]), np.array([3, 4, 5])]
    chance, joint, total = extraction.marginals(extraction.Forest(features, parents, levels), model)
    sums, pairs, whole = np.zeros(6), np.zeros((6, 2, 2)), 0.0
    for state in range(64):
        s = [(state >> i) & 1 for i in range(6)]
        score = sum(s[i] * (features[i] @ model.weights) for i in range(6)) + sum(model.edges[s[parents[i]], s[i]] for i in range(1, 6))
        whole += np.exp(score)
        sums += np.exp(score) * np.array(s)
        for i in range(1, 6):
            pairs[i, s[parents[i]], s[i]] += np.exp(score)
    assert np.allclose(chance, sums / whole) and np.allclose(joint, pairs / whole) and np.isclose(total, np.log(whole))


def test_extraction_on_held_out_pages(spark):
    pages = [labelled_page(i) for i in range(5000, 5150)]
    rows = [(i, "u", "".join(h for h, _ in p), "x") for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows + [(900, "u", None, "x"), (901, None, "", "x"), (None, "u", "<nav>a</nav>", "x"), (0, "u", rows[0][2], "x")],
                               "page_id long, url string, html string, text string")
    got = extraction.extract(df).collect()
    assert len(got) == 154
    by_id = {r["page_id"]: r for r in got}
    assert by_id[900]["text"] == by_id[901]["text"] == by_id[None]["text"] == ""
    right = sum(by_id[i]["text"] == expected(p) for i, p in enumerate(pages))
    assert right >= 145
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extraction.extract(df.limit(0)).collect() == []


def test_parsing():
    page = extraction.parse(
        "<p>a &amp; b&nbsp; c<br>d<p>e <b>f</b>\n g<script>x</script><li>h<li>i</ul><!-- no --><div title='<p>'>j<table><tr><td>k<td>l"
    )
    assert [t for t in page.texts if t] == ["a & b c d", "e f g", "h", "i", "j", "k", "l"]
    assert extraction.parse("").texts == [None]
    assert [t for t in extraction.parse("<div>" * 3000 + "deep").texts if t] == ["deep"]


# The pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    kept = docs
    counts = []
    for name, step in corpus_pipeline.STAGES[:3]:
        kept = stage(step(spark, kept, SMALL), name)
        assert kept.columns == names
        counts.append(kept.count())
    assert docs.count() > counts[0] > counts[1] > counts[2] > 700
    scores = queries.QUERIES["op6_toxicity"](spark, SMALL).filter("predicted = 1").count()
    assert counts[0] == docs.count() - scores
    assert kept.select("text").distinct().count() == counts[2]
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.select("doc_id", "shard", "slot").collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd[1], none):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SMALL), name)
        assert set(odd[1].columns) <= set(docs.columns) | {"shard"}


def test_words_of_plain_and_other_texts():
    """A text of ASCII alone has the words that it has beside other characters."""
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices([chr(c) for c in range(128)], k=80)).encode()
        assert toxicity.words_of(text) == toxicity.words_of(text + " ÄÉ".encode())[:-1]
    assert toxicity.words_of("Ärger\x00İx K9z".encode()) == ["ärger".encode(), "i̇x".encode(), b"k", b"z"]
    assert toxicity.words_of(b"") == [] and toxicity.words_of(b"a\xffB")[0].startswith(b"a")


def test_terms_of_many_texts_at_once(monkeypatch):
    """Counts as word by word, without asking for the runs of each word."""
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abcdäößß語İı ") for _ in range(rng.randrange(1, 7)))

    texts = [" ".join(word() for _ in range(rng.randrange(30))).encode() for _ in range(300)]
    texts += [b"", b"   ", b"a\xff b", b"a", b"a b c"]
    words = sorted({w.decode() for t in texts for w in toxicity.words_of(t)})
    runs_of = toxicity.runs_of
    runs = sorted(set().union(*map(runs_of, words)))
    for some, telling in ((words[::3], runs[::2][:1024]), (words, []), ([], runs[:1000]), ([], []), (words, [r for r in runs if len(r) == 3])):
        number = {w: i for i, w in enumerate(some)}
        run = {r: len(some) + i for i, r in enumerate(telling)}
        wanted = []
        for t in texts:
            met = [w.decode() for w in toxicity.words_of(t)]
            wanted.append(Counter([number[w] for w in met if w in number] + [run[r] for w in met for r in runs_of(w) if r in run]))
        with monkeypatch.context() as patch:
            patch.setattr(toxicity, "runs_of", None)
            got = toxicity.Terms(some, telling).counts(texts)
        assert [dict(zip(n.tolist(), o.tolist())) for n, o in got] == wanted


def test_mixing_writes_its_steps(spark, plain):
    """The plan of what is taken starts from written steps, so it has few exchanges."""
    taken = mixing.mix(keyed(plain[1])).taken
    assert taken._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8


def test_an_index_has_segments_of_frequent_terms_only():
    examples = [(i, i % 2, np.array([0, 1 + i % 50, 51 + i % 7]), np.ones(3)) for i in range(700)]
    index = toxicity.make_index(examples, np.ones(58), {0: 1.0, 1: 1.0})
    held = np.diff(index.segments)
    assert (held[51:] > 0).sum() + (index.row[51:] >= 0).sum() == 7 and not held[:51].any()
