"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, through a block-max inverted index.

Terms are all words of a bounded sample of labelled documents, which are the examples, and beside them the runs of a few
letters of words that speak for label 1. Document frequencies come from all documents. A term's weight in a text is
(1 + ln of its occurrences) times its idf times its bearing: 1 for terms whose chi-square over the labels is high, less
for the others, which are never left out. The index holds, per term, its postings in blocks of examples and each block's
largest weight. A query adds these up to a bound per block, reads the best blocks, and then all others whose bound reaches
the worst of the nearest found, so the nearest are exact. Examples vote with the inverse of their distance; leave-one-out
votes of the sample are calibrated to probabilities by a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import kind, map_rows, stage, text_bytes
from tablehaul.llm.dictionaries import squeezed, unsqueezed

# Bounds of what is fitted: examples of each label, and runs of letters beside the words.
EXAMPLES = 2000
RUNS = 1024
# A telling term's chi-square, and for runs how many times likelier they are under label 1, at least.
CHI_SQUARE = 25.0
RATIO = 6.0
# The bearing of a term that says nothing about the label.
LEAST_BEARING = 0.1
NEAREST = 15
BLOCK = 64
# Terms of more than one in so many examples are laid out as a matrix.
COMMON = 10
# Terms of so few examples are read at once: their blocks would be almost as many as their postings.
FEW = 64
# Blocks that are read before there is a worst of the nearest.
FIRST = 8
# Texts that are scored together, and bytes of text whose terms are numbered together.
TOGETHER = 128
NUMBERED = 2 << 20
# Added to a distance before it is inverted, and the weight of the base rate beside the votes.
SOFT = 0.05
BASE = 8.0

# A word is a run of letters a-z and characters beyond ASCII; all else is a space.
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SCORED = (
    "score double, terms array<string>, "
    "nearest array<struct<doc_id:long,label:int,similarity:double>>"
)


def _folded(text: bytes) -> bytes:
    """A text in lower case with spaces for what is in no word."""
    if text.isascii():
        return text.lower().translate(_FOLD)
    return text.decode("utf-8", "replace").lower().encode().translate(_FOLD)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case."""
    return _folded(text).split()


def _words_of_all(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """(the words of all texts one after the other, which text each is of)."""
    folded = [_folded(t) for t in texts]
    held = np.frombuffer(b" ".join([b"", *folded, b""]), np.uint8)
    inside = held != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(ends - begins)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(held[inside])])
    after = np.cumsum([len(f) + 1 for f in folded])
    return words, np.searchsorted(after, begins, "right")


def runs_of(word: str) -> set[str]:
    """The runs of four letters of a word, its ends included as spaces, and its first two letters."""
    marked = f" {word} "
    return {marked[i : i + 4] for i in range(len(marked) - 3)} | {marked[:3]}


class Terms:
    """Numbers the terms of texts."""

    def __init__(self, words: list[str], runs: list[str]):
        self.words = pa.array([w.encode() for w in words], pa.binary())
        self.runs = runs
        self.size = len(words) + len(runs)

    @cached_property
    def _codes(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(a number for each character, 0 for those in no run; for runs of three and of four characters their codes in
        order and which terms they are)."""
        letters = sorted({ord(c) for r in self.runs for c in r})
        known = np.zeros(letters[-1] + 2, np.int64)
        known[letters] = np.arange(1, len(letters) + 1)
        tables = []
        for length in (3, 4):
            # Runs have 4 * ``RUNS`` characters at most, so the numbers of four fit into 60 bits.
            held = [(sum(int(known[ord(c)]) << 15 * j for j, c in enumerate(r)), i) for i, r in enumerate(self.runs) if len(r) == length]
            codes, which = np.array(sorted(held), np.int64).reshape(-1, 2).T
            tables.append((codes, which + len(self.words)))
        return known, tables

    def of(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(how many terms each word has, word by word the numbers of the word and of the runs in it that are terms)."""
        number = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        owner = [np.flatnonzero(number >= 0)]
        term = [number[owner[0]]]
        if self.runs and len(words):
            known, (short, long) = self._codes
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            sizes, inside = np.diff(offsets), np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            # The words with a space before each. No run has a space inside, so what reaches into the next word is none.
            spaced = np.full(len(inside) + len(words) + 3, 0x20, np.uint8)
            spaced[np.arange(len(inside)) + np.repeat(np.arange(1, len(words) + 1), sizes)] = inside
            letters = np.frombuffer(spaced.tobytes().decode().encode("utf-32-le"), "<u4")
            code = known[np.minimum(letters, len(known) - 1)]
            begins = np.flatnonzero(letters == 0x20)[: len(words)]
            three = code[:-2] | code[1:-1] << 15 | code[2:] << 30
            four = three[:-1] | code[3:] << 45
            for (codes, terms), at, held in ((short, begins, three[begins]), (long, np.arange(len(four)), four)):
                if len(codes):
                    place = np.minimum(np.searchsorted(codes, held), len(codes) - 1)
                    met = np.flatnonzero(codes[place] == held)
                    owner.append(np.searchsorted(begins, at[met], "right") - 1)
                    term.append(terms[place[met]])
        cells = np.unique(np.concatenate(owner) * self.size + np.concatenate(term))
        return np.bincount(cells // max(1, self.size), minlength=len(words)), cells % max(1, self.size)

    def counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (numbers in order, how often each occurs). A run counts each time a word holds it."""
        if not len(texts):
            return []
        words, text = _words_of_all(texts)
        met = words.dictionary_encode()
        many, numbers = self.of(met.dictionary)
        begins = np.cumsum(many) - many
        # Each word of a text once, with its occurrences.
        pairs, often = np.unique(text * max(1, len(many)) + met.indices.to_numpy(), return_counts=True)
        text, codes = np.divmod(pairs, max(1, len(many)))
        cells = np.repeat(text, many[codes]) * self.size + numbers[_spread(begins[codes], many[codes])]
        cells, place = np.unique(cells, return_inverse=True)
        often = np.bincount(place, np.repeat(often, many[codes]), len(cells)).astype(np.int64)
        cuts = np.searchsorted(cells, np.arange(1, len(texts)) * self.size)
        return list(zip(np.split(cells % max(1, self.size), cuts), np.split(often, cuts)))


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


@dataclass
class Index:
    """Examples in blocks of ``BLOCK`` places. The postings of a term follow one another by place; those of one block are a
    segment with a largest weight. Terms of many examples are rows of a matrix instead, and those of a few are read whole."""

    ids: np.ndarray
    labels: np.ndarray
    importance: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    matrix: np.ndarray
    place: np.ndarray
    value: np.ndarray
    start: np.ndarray
    segments: np.ndarray
    block: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    highest: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)
    base: float = 0.0

    def vector(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        weights = (1 + np.log(np.asarray(counts, float))) * self.weight[terms]
        return terms, weights / (np.linalg.norm(weights) or 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> list[tuple[float, int]]:
        return self.nearest_of([(terms, weights)], k, [leave])[0]

    def nearest_of(self, vectors: list, k: int, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector (cosine, place) of the ``k`` nearest with a cosine above 0, exact; equal ones by place. The place
        ``leave`` is left out. The vectors go through each step together."""
        n, m = len(self.ids), len(vectors)
        if not n or not m:
            return [[] for _ in vectors]
        blocks = -(-n // BLOCK)
        terms = np.concatenate([t for t, _ in vectors])
        weights = np.concatenate([w for _, w in vectors])
        owner = np.repeat(np.arange(m), [len(t) for t, _ in vectors])
        dense, rows = np.zeros((m, len(self.matrix))), self.row[terms]
        dense[owner[rows >= 0], rows[rows >= 0]] = weights[rows >= 0]
        scores = np.zeros((m, blocks * BLOCK))
        scores[:, :n] = dense @ self.matrix
        size = self.start[terms + 1] - self.start[terms]
        whole = (size > 0) & (size <= FEW)
        scores += self._read(owner[whole], weights[whole], self.start[terms[whole]], size[whole], scores.shape)
        rare = size > FEW
        first, last = self.segments[terms[rare]], self.segments[terms[rare] + 1]
        own = _spread(first, last - first)
        heavy, owner = np.repeat(weights[rare], last - first), np.repeat(owner[rare], last - first)
        cell = owner * blocks + self.block[own]
        bounds = scores.reshape(m, blocks, BLOCK).max(axis=2)
        bounds = bounds + np.bincount(cell, heavy * self.highest[own], m * blocks).reshape(m, blocks)

        def read(wanted: np.ndarray) -> np.ndarray:
            here = wanted.ravel()[cell]
            return self._read(owner[here], heavy[here], self.begin[own[here]], self.size[own[here]], scores.shape)

        def known(done: np.ndarray) -> np.ndarray:
            """The totals of the examples in blocks that are read, 0 for all others."""
            held = total.reshape(m, blocks, BLOCK) * done[:, :, None]
            held = np.maximum(held, 0.0).reshape(scores.shape)
            if leave is not None:
                held[np.arange(m), leave] = 0.0
            return held

        done = np.zeros((m, blocks), bool)
        np.put_along_axis(done, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        total = scores + read(done)
        held = known(done)
        # The worst of the nearest so far is in one of the best blocks.
        best = held.reshape(m, blocks, BLOCK)[done].reshape(m, -1)
        least = np.partition(best, -k, axis=1)[:, -k] if k < best.shape[1] else np.zeros(m)
        more = ~done & (bounds > 0) & (bounds >= least[:, None] - 2e-9)
        if more.any():
            total = total + read(more)
            held = known(done | more)
        row, place = np.nonzero(held >= np.maximum(least - 2e-9, 1e-300)[:, None])
        value = held[row, place]
        order = np.lexsort((place, -np.round(value, 9), row))
        cuts = np.searchsorted(row, np.arange(m + 1))
        return [[(float(value[j]), int(place[j])) for j in order[a : min(a + k, b)]] for a, b in zip(cuts, cuts[1:])]

    def _read(self, owner: np.ndarray, weights: np.ndarray, begin: np.ndarray, size: np.ndarray, shape: tuple) -> np.ndarray:
        """What stretches of postings add to the owners' cosines with all examples."""
        at = _spread(begin, size)
        cells = np.repeat(owner.astype(np.int64) * shape[1], size) + self.place[at]
        return np.bincount(cells, np.repeat(weights, size) * self.value[at], shape[0] * shape[1]).reshape(shape)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of toxic votes. A vote weighs cosine by distance, times how many labelled rows it stands for, so that
        a text with one chance term, which is far from all examples, stays near the base rate."""
        votes = [self.importance[i] * s / (SOFT + 1 - min(s, 1.0)) for s, i in near]
        toxic = sum(v for v, (_, i) in zip(votes, near) if self.labels[i])
        return (toxic + BASE * self.base) / (sum(votes) + BASE)

    def score(self, near: list[tuple[float, int]]) -> float:
        slope, shift = self.calibration
        return 1 / (1 + math.exp(-(slope * _logit(self.vote(near)) + shift)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def make_index(examples: list[tuple], weight: np.ndarray, importance: dict[int, float]) -> Index:
    """The index of (doc_id, label, terms, counts). Examples with the same heaviest term share blocks, which keeps
    the bounds of the other blocks low."""
    none = np.zeros(0, np.int64)
    bare = Index(none, none, none, weight, *[none] * 10)
    vectors = [(np.asarray(e[2], np.int32), bare.vector(e[2], e[3])[1]) for e in examples]
    order = sorted(
        range(len(examples)),
        key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, examples[i][:2]),
    )
    sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
    term = np.concatenate([vectors[i][0] for i in order]).astype(np.int64) if len(order) else none
    value = np.concatenate([vectors[i][1] for i in order]) if len(order) else np.zeros(0)
    place = np.repeat(np.arange(len(order)), sizes)
    often = np.bincount(term, minlength=len(weight))
    common = np.flatnonzero(often * COMMON > len(order))
    row = np.full(len(weight), -1, np.int64)
    row[common] = np.arange(len(common))
    matrix = np.zeros((len(common), len(order)))
    dense = row[term] >= 0
    matrix[row[term[dense]], place[dense]] = value[dense]
    term, place, value = term[~dense], place[~dense], value[~dense]
    by = np.lexsort((place, term))
    term, place, value = term[by], place[by], value[by]
    starts = np.searchsorted(term, np.arange(len(weight) + 1))
    # Only terms that are not read whole have segments.
    begin = np.flatnonzero(often[term] > FEW)
    if len(begin):
        block = place[begin] // BLOCK
        new = np.append(True, (term[begin][1:] != term[begin][:-1]) | (block[1:] != block[:-1]))
        highest = np.maximum.reduceat(value[begin], np.flatnonzero(new))
        held = np.diff(np.append(np.flatnonzero(new), len(begin)))
        begin, block = begin[new], block[new]
    else:
        block, held, highest = none, none, np.zeros(0)
    labels = np.array([examples[i][1] for i in order], np.int64)
    small = [x.astype(np.int32) for x in (row, place, starts, np.searchsorted(term[begin], np.arange(len(weight) + 1)), block, begin, held)]
    row, place, starts, segments, block, begin, held = small
    index = Index(
        np.array([examples[i][0] for i in order], np.int64), labels, np.array([importance[int(y)] for y in labels], float),
        weight, row, matrix, place, value, starts, segments, block, begin, held, highest,
    )
    # A text far from all examples gets about the share of toxic ones among all labelled.
    index.base = float((index.importance * labels).sum() / (index.importance.sum() + 1)) if len(order) else 0.0
    votes = []
    for at in range(0, len(order), TOGETHER):
        some = range(at, min(at + TOGETHER, len(order)))
        votes += [index.vote(near) for near in index.nearest_of([vectors[order[p]] for p in some], NEAREST, list(some))]
    index.calibration = _calibrate(np.array([_logit(v) for v in votes]), labels, index.importance)
    return index


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the votes, with targets drawn in a little from 0 and 1."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * (beta - [1, 0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def _sample(labels: DataFrame) -> DataFrame:
    """At most ``EXAMPLES`` labelled rows of each label, those with the smallest hash of their id."""
    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    return stage(parts[0].union(parts[1]), "examples")


def choose_terms(texts: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """(all words of the sample (label, text), the ``RUNS`` runs that speak for label 1 most, the bearing of each)."""

    def rows(part):
        for row in part:
            words = {w.decode() for w in words_of(row["text"])}
            yield {"label": row["label"], "run": False, "terms": list(words)}
            yield {"label": row["label"], "run": True, "terms": list(set().union(*map(runs_of, words)))}

    held = stage(map_rows(texts, rows, "label int, run boolean, terms array<string>"), "terms")
    sizes = {r[0]: r[1] for r in held.filter("NOT run").groupBy("label").count().collect()}
    up, down = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not up or not down:
        return [], [], np.zeros(0)
    found = held.select("label", "run", F.explode("terms").alias("term")).groupBy("run", "term").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    chi = F.pow(a * (down - b) - b * (up - a), 2) * (up + down) / (up * down * (a + b) * (up + down - a - b + 0.5))
    ratio = (a + 0.5) / up / ((b + 0.5) / down)
    rated = found.withColumn("chi", chi)
    words = rated.filter("NOT run").select("term", "chi").toArrow().sort_by("term")
    runs = rated.filter(F.col("run") & (F.col("chi") >= CHI_SQUARE) & (ratio >= RATIO)).orderBy(F.desc("chi"), "term").limit(RUNS)
    bearing = np.clip(words.column("chi").to_numpy() / CHI_SQUARE, LEAST_BEARING, 1.0)
    telling = sorted(r["term"] for r in runs.collect())
    return words.column("term").to_pylist(), telling, np.append(bearing, np.ones(len(telling)))


def _lots(part: list[dict]) -> Iterator[list[dict]]:
    """The rows in lots of some megabytes of text."""
    held, size = [], 0
    for row in part:
        held.append(row)
        size += len(row["text"]) + 64
        if size > NUMBERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _vectors(plain: DataFrame, terms: Terms) -> DataFrame:
    """The staged rows with the numbers and occurrences of their terms instead of their text."""

    def rows(part):
        for some in _lots(part):
            for row, (numbers, often) in zip(some, terms.counts([row.pop("text") for row in some])):
                yield row | {"held": squeezed(numbers.astype("<i4")), "often": squeezed(often.astype("<i4"))}

    kept = "".join(f"{c} {kind(plain, c)}, " for c in plain.columns if c != "text")
    return stage(map_rows(plain, rows, kept + "held binary, often binary"), "vectors")


def _vectors_of_examples(shown: DataFrame, terms: Terms) -> list[tuple]:
    """(doc_id, label, numbers, occurrences) of each example in the order of its id. Only these reach the driver, not the
    texts."""
    rows = _vectors(shown, terms).toArrow()
    held = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "label", "held", "often")))
    return sorted(((i, y, unsqueezed(a), unsqueezed(b)) for i, y, a, b in held), key=lambda e: e[:2])


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term. Each task sends one number for each term it has met."""

    def run(batches):
        often = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                often[unsqueezed(held)] += 1
        met = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(often[met])], names=["term", "n"])

    often = np.zeros(size, np.int64)
    sums = vectors.select("held").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    often[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return often


def toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_column: str = "doc_id", text: str = "text",
    label: str = "toxic", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, the columns ``keep``, score, terms, nearest) for each row of ``docs``: the probability of label 1, the telling terms that
    occur, and the three nearest examples with their labels and cosines.

    ``learn`` chooses the rows of ``labels`` to learn from. Nothing but texts enters a score. Null and empty texts, and
    texts without any word of an example, get the calibrated base rate; without labelled examples of both
    labels there are no terms and all scores are one base rate. A document labelled twice has the larger label, labels
    other than 0 and 1 are left out, and rows with equal or null ids are scored each. Ids are whole numbers. Other columns
    are not read.
    """
    known = labels if learn is None else labels.filter(learn)
    known = known.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    sample = _sample(known)
    plain = docs.select(F.col(id_column).alias("doc_id"), *keep, text_bytes(text).alias("text"))
    kept = "".join(f"{c} {kind(plain, c)}, " for c in ("doc_id", *keep))
    # Of rows with one id, one is the example.
    shown = plain.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("e"))
    shown = stage(shown.select("doc_id", "e.*"), "shown")
    words, runs, bearing = choose_terms(shown.select("label", "text"))
    terms = Terms(words, runs)
    held = _vectors(plain, terms)
    total = held.count()
    weight = (np.log((1 + total) / (1 + _frequencies(held, terms.size))) + 0.1) * bearing
    vectors = _vectors_of_examples(shown, terms)
    taken = {y: sum(v[1] == y for v in vectors) for y in (0, 1)}
    index = make_index(vectors, weight, {y: sizes.get(y, 0) / max(1, taken[y]) for y in (0, 1)})
    telling = np.flatnonzero(bearing >= 1)
    # What scores needs no more of the terms than the names of these.
    names = {int(t): words[t] if t < len(words) else runs[t - len(words)] for t in telling}

    def scored(part):
        for at in range(0, len(part), TOGETHER):
            some = part[at : at + TOGETHER]
            own = [index.vector(unsqueezed(row.pop("held")), unsqueezed(row.pop("often"))) for row in some]
            for row, (numbers, _), near in zip(some, own, index.nearest_of(own, NEAREST)):
                said = numbers[np.isin(numbers, telling, assume_unique=True)]
                yield row | {
                    "score": index.score(near), "terms": [names[int(t)] for t in said],
                    "nearest": [
                        {"doc_id": int(index.ids[i]), "label": int(index.labels[i]), "similarity": s} for s, i in near[:3]
                    ],
                }

    return map_rows(held, scored, kept + _SCORED)
