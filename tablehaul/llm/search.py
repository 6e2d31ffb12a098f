"""Ranked lexical search by dense blocked matrix products.

Documents become slices of sparse rows (document, term, occurrences) with a dictionary each, and so do the items that are
searched for, in blocks. Dictionaries meet by term, which gives each slice and block the terms that they share, under the
block's compact numbers. Where a block's weights (items by vocabulary) meet a slice's impacts (vocabulary by documents),
both are laid out as dense tiles of float64 and multiplied by BLAS. Weights and impacts are whole numbers, and the
vocabulary is cut so that no sum of a tile can reach 2^53: products are exact, and tiles add up in 64-bit integers.

Each tile leaves its best documents, ties decided by id, so nothing that could be among the best of all is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import slices, stage, text_bytes
from tablehaul.llm.decontamination import _FOLD
from tablehaul.llm.dictionaries import CODED, Numbers, coded_batches, slice_numbers, squeezed, unsqueezed

# Bytes of text of a slice of documents, and of a block of items; items of a block.
SLICE, BLOCK, ITEMS = 8 << 20, 256 << 10, 256
# Columns of a tile of the vocabulary, and values of a tile of documents.
VOCABULARY, TILE = 4096, 1 << 20
# Slices that meet a copy of a block's weights in one go.
TOGETHER = 8
BEST = 10
# No impact is larger; sums of float64 are exact below 2^53.
IMPACT = 1_000_000
EXACT = (1 << 53) // IMPACT


def term_pieces(text: bytes, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z in lower case, in lists of some megabytes of it."""
    plain = text.translate(_FOLD)
    at = 0
    while at < len(plain):
        end = len(plain)
        if end - at > most:
            end = plain.rfind(b" ", at, at + most) + 1 or plain.find(b" ", at + most) + 1 or end
        yield plain[at:end].split()
        at = end


def weight(rows: int, df: int) -> int:
    """The weight of a term that ``df`` of ``rows`` documents hold."""
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How much ``tf`` occurrences count in documents of the relative length ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_marks(lengths: np.ndarray, rows: int, total: int) -> np.ndarray:
    """m of documents of so many terms. The product may pass 64 bits."""
    return np.array([25 + 75 * n * rows // total for n in lengths.tolist()], np.int64)


class _Rows:
    """Texts as rows of (term, occurrences)."""

    def __init__(self):
        self.ids, self.none, self.lengths, self.codes, self.numbers, self.size = [], [], [], [], Numbers(), 0

    def add(self, id_: int | None, text: bytes) -> None:
        codes = [self.numbers.of(words) for words in term_pieces(text)]
        self.ids.append(id_ or 0)
        self.none.append(id_ is None)
        self.lengths.append(sum(map(len, codes)))
        self.codes += codes
        self.size += len(text)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        lengths, terms = np.array(self.lengths), max(1, len(self.numbers))
        codes = np.concatenate(self.codes).astype(np.int64) if self.codes else np.zeros(0, np.int64)
        cells, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * terms + codes, return_counts=True)
        row, term = np.divmod(cells, terms)
        parts = [np.array(self.ids, np.int64), np.array(self.none), lengths, np.diff(row, prepend=0).astype(np.int32), term.astype(np.int32), tf.astype(np.int32)]
        df = np.bincount(term, minlength=len(self.numbers))
        yield from coded_batches(number, None, pack(parts), self.numbers, df, int((lengths > 0).sum()), int(lengths.sum()))
        self.__init__()


def pack(arrays: list[np.ndarray]) -> bytes:
    held = [squeezed(a) for a in arrays]
    return b"".join(x for h in held for x in (len(h).to_bytes(8, "little"), h))


def unpack(held: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(held):
        size = int.from_bytes(held[at : at + 8], "little")
        out.append(unsqueezed(held[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _encode(size: int, most: int):
    """(id, text) as coded slices of about ``size`` bytes and at most ``most`` rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, names = _Rows(), slice_numbers()
        for batch in batches:
            for part in slices(batch):
                for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.add(id_, text)
                    if held.size >= size or len(held.ids) >= most:
                        yield from held.batches(next(names))
        if held.ids:
            yield from held.batches(next(names))

    return run


_MET = "block long, salt long, side int, body binary, dfs array<struct<local:int,df:long>>"
_MET_NAMES = ["block", "salt", "side", "body"]


def _compact(salts: int):
    """From (slice, block, body, numbers) the documents' rows in the block's numbers of the terms that both hold."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row = part.to_pylist()[0]
                ids, none, lengths, steps, term, tf = unpack(row["body"])
                column = np.full(int(term.max(initial=0)) + 1, -1, np.int32)
                column[[x["local"] for x in row["numbers"]]] = [x["column"] for x in row["numbers"]]
                column = column[term]
                held = column >= 0
                at, document = np.unique(np.cumsum(steps)[held], return_inverse=True)
                body = pack([ids[at], none[at], lengths[at], document.astype(np.int32), column[held], tf[held]])
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                values = (row["block"], row["slice"] % salts, 1, body)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=_MET_NAMES)

    return run


@dataclass
class Weights:
    """A block's weights: values of (item, column), cut into tiles whose sums stay exact."""

    items: int
    item: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def tiles(self, limit: int = EXACT, most: int = VOCABULARY) -> list[tuple[np.ndarray, np.ndarray]]:
        """(columns, items by these columns). A value beyond the limit is cut into several that are not, in tiles of
        their own, and so stands in one column of each of them."""
        item, column, value = self.item, self.column, self.value
        out = []
        while (value > 0).any():
            here = np.minimum(value, limit)
            columns = np.unique(column[here > 0])
            todo = [columns[i : i + most] for i in range(0, len(columns), most)]
            while todo:
                part = todo.pop()
                own = np.isin(column, part) & (here > 0)
                sums = np.zeros(self.items)
                np.add.at(sums, item[own], here[own].astype(float))
                if len(part) > 1 and sums.max() > limit:
                    todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                    continue
                dense = np.zeros((self.items, len(part)))
                dense[item[own], np.searchsorted(part, column[own])] = here[own]
                out.append((part, dense))
            value = value - here
        return out


class Best:
    """The best documents of each item so far: highest scores, equal ones by id, a null id last."""

    def __init__(self, items: int, best: int):
        self.items, self.best = items, best
        self.rows = [np.zeros(0, np.int64)] * 4
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Takes the scores of all items and some documents."""
        least = self.least
        if scores.shape[1] > self.best:
            least = np.maximum(least, np.partition(scores, -self.best, axis=1)[:, -self.best])
        item, at = np.nonzero(scores >= least[:, None])
        made = [item, scores[item, at], none[at].astype(np.int64), ids[at]]
        rows = [np.append(a, b) for a, b in zip(self.rows, made)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        begin = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(rows[0])) - begin
        last = place == self.best - 1
        self.least[rows[0][last]] = rows[1][last]
        self.rows = [r[place < self.best] for r in rows]


def tile_scores(tiles: list, documents: int, document: np.ndarray, column: np.ndarray, impact: np.ndarray, items: int) -> np.ndarray:
    """The scores of items by documents, from the tiles of the weights and the documents' impacts."""
    scores = np.zeros((items, documents), np.int64)
    for columns, weights in tiles:
        at = np.minimum(np.searchsorted(columns, column), len(columns) - 1)
        own = columns[at] == column
        present, place = np.unique(at[own], return_inverse=True)
        if not len(present):
            continue
        dense = np.zeros((len(present), documents))
        dense[place, document[own]] = impact[own]
        scores += (weights[:, present] @ dense).astype(np.int64)
    return scores


_FOUND = "block long, at long, doc_id long, score long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _multiply(rows: int, total: int, best: int):
    """From the weights of a block (side 0) and after them the documents that meet them (side 1) the best documents."""

    def found(block: int, held: Best) -> pa.RecordBatch:
        item, score, none, ids = held.rows
        columns = [pa.array(np.full(len(item), block)), pa.array(item), pa.array(ids, mask=none.astype(bool)), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=_FOUND_NAMES)

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, tiles, held = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["block"], row["salt"]) != key:
                    if held is not None:
                        yield found(key[0], held)
                    key, held = (row["block"], row["salt"]), None
                if row["side"] == 0:
                    _, _, lengths, steps, term, tf = unpack(row["body"])
                    w = np.zeros(int(term.max(initial=0)) + 1, np.int64)
                    w[[x["local"] for x in row["dfs"]]] = [weight(rows, x["df"]) for x in row["dfs"]]
                    tiles = Weights(len(lengths), np.cumsum(steps), term, tf * w[term]).tiles()
                    held = Best(len(lengths), best)
                elif held is not None:
                    _add(held, tiles, row["body"])
        if held is not None:
            yield found(key[0], held)

    def _add(held: Best, tiles: list, body: bytes) -> None:
        ids, none, lengths, document, column, tf = unpack(body)
        marks = length_marks(lengths, rows, total)
        impact = impacts(tf.astype(np.int64), marks[document])
        widest = max((len(c) for c, _ in tiles), default=1)
        step = max(16, TILE // max(widest, held.items))
        for begin in range(0, len(ids), step):
            here = slice(*np.searchsorted(document, [begin, begin + step]))
            some = slice(begin, begin + step)
            n = len(ids[some])
            held.add(tile_scores(tiles, n, document[here] - begin, column[here], impact[here], held.items), ids[some], none[some])

    return run


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``best`` highest-scoring documents with a score above 0.

    Terms are runs of digits, letters A-Z in lower case, and characters beyond ASCII. A term's weight is
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` for N documents with any term, of which df hold it; with n of all L
    terms in a document, m is ``25 + 75 n N div L``, and a term that occurs tf times in it adds its weight times
    ``10^9 tf div (1000 tf + 8 m)`` for each time it occurs in the item. Equal scores are ranked by id, a null id last.

    Document ids are whole numbers and may repeat: each row is ranked. Each row of ``items`` is an item of its own, with
    an id of any type. A null or empty text has no terms: such a document is never found, such an item finds nothing. No
    rows on either side give none; other columns are not read.
    """
    read = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(text).alias("text"))
    coded = stage(read.mapInArrow(_encode(SLICE, 1 << 16), CODED), "coded")
    numbered = stage(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_column).alias("item_id"), text_bytes(item_text).alias("text")), "items")
    blocks = stage(numbered.select("item", "text").mapInArrow(_encode(BLOCK, ITEMS), CODED), "blocks")
    bodies = coded.filter("body is not null")
    rows, total, count = bodies.agg(F.coalesce(F.sum("local"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    salts = max(1, count // TOGETHER)

    wanted = blocks.filter("word is not null").select(F.col("slice").alias("block"), F.col("local").alias("column"), "word")
    held = coded.filter("word is not null").select("slice", "local", "word", F.col("count").alias("df"))
    shared = stage(held.join(wanted, "word").select("slice", "local", "block", "column", "df"), "shared")
    numbers = shared.groupBy("slice", "block").agg(F.collect_list(F.struct("local", "column")).alias("numbers"))
    met = bodies.select("slice", "body").join(numbers, "slice").select("slice", "block", "body", "numbers")
    documents = met.mapInArrow(_compact(salts), ", ".join(_MET.split(", ")[:4])).withColumn("dfs", F.lit(None).cast(_MET.split(" ")[-1]))
    dfs = shared.groupBy("block", "column").agg(F.sum("df").alias("df"))
    dfs = dfs.groupBy("block").agg(F.collect_list(F.struct(F.col("column").alias("local"), "df")).alias("dfs"))
    weights = blocks.filter("body is not null").select(F.col("slice").alias("block"), "body").join(dfs, "block")
    weights = weights.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    sides = weights.select("block", "salt", F.lit(0).alias("side"), "body", "dfs").union(documents)
    dealt = sides.repartition("block", "salt").sortWithinPartitions("block", "salt", "side")
    found = dealt.mapInArrow(_multiply(rows, total, best), _FOUND)

    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranks = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return _named(ranks, blocks, numbered).select("item_id", "rank", "doc_id", "score")


def _named(ranks: DataFrame, blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """The ranks with the items' ids instead of their places in blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["body"])[0]
                columns = [np.full(len(ids), row["block"]), np.arange(len(ids)), ids]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "at", "item"])

    places = blocks.filter("body is not null").select(F.col("slice").alias("block"), "body").mapInArrow(run, "block long, at long, item long")
    return ranks.join(places, ["block", "at"]).join(numbered.select("item", "item_id"), "item")
