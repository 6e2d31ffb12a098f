"""Benchmark passages inside training texts, found through a positional inverted index of the training words.

The index is partitioned by document: every shard of some megabytes of text stores, for each of its words, the sorted
positions where it occurs. The test items become blocks of bounded size, on the executors too. A few shards at a time are
opened and meet all blocks, one after the other; each phrase starts with the positions of its rarest word in the shard,
shifted back by the word's offset, and is intersected with the shifted lists of the other words until nothing or a match
is left. So the index is read once, neither the documents nor the items pass through the driver, and a lost executor
repeats a few shards.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import kind, map_rows, slices, stage, text_bytes, unpacked
from tablehaul.llm.dictionaries import slice_numbers

# Keeps 0-9, a-z and every byte above 0x7F, turns A-Z into lower case and all else into a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
# Empty positions between two documents of a shard, so that no phrase matches across them.
_GAP = 64
# Bytes of test text in a block.
BLOCK_BYTES = 2 << 20
# Shards that are open at a time, on average.
TOGETHER = 4

_INDEX = "shard long, doc_ids array<{}>, lengths array<long>, terms binary, counts binary, positions binary"
_HITS = "shard long, ordinal int, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), kind) if count else np.zeros(0, kind)


def _shard(rows: list[dict], number: int) -> dict:
    """The index of some documents: words in order of first sight, how often each occurs, and their positions."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    codes, places, lengths, base = [], [], [], 0
    for row in rows:
        words = words_of(row["text"])
        codes.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        places.append(np.arange(base, base + len(words)))
        lengths.append(len(words))
        base += len(words) + _GAP
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    steps = np.diff(np.concatenate(places)[order], prepend=0)
    terms = b" ".join(ids)
    return {
        "shard": number, "doc_ids": [r["doc_id"] for r in rows], "lengths": lengths,
        "terms": len(terms).to_bytes(8, "little") + pa.compress(terms, codec="zstd", asbytes=True),
        "counts": _pack(np.bincount(code, minlength=len(ids)).astype(np.int32)), "positions": _pack(steps),
    }


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The staged index: a row per shard, with all words of whole texts. A null text has no words."""

    made = [-1]

    def rows(part):
        made[0] += 1
        yield _shard(part, (TaskContext.get().partitionId() << 32) + made[0])

    read = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text).alias("text"))
    return stage(map_rows(read, rows, _INDEX.format(kind(read, "doc_id"))), "index")


@dataclass
class Phrases:
    """Test phrases: a row of word numbers per distinct phrase (-1 after its end) and the items it comes from."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str, bytes]], window: int) -> Phrases:
    """All runs of ``window`` words of each item; an item of fewer words is one phrase, one without words is none."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, dict] = {}
    for item, text in items:
        codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for i in range(max(1, len(codes) - window + 1) if codes else 0):
            found.setdefault(tuple(codes[i : i + window]), {})[item] = None
    words = np.full((len(found), window), -1, np.int32)
    for i, phrase in enumerate(found):
        words[i, : len(phrase)] = phrase
    return Phrases(vocabulary, words, np.array([len(p) for p in found], np.int64), [list(v) for v in found.values()])


def _near(starts: np.ndarray, offset: int, places: np.ndarray, slop: int) -> np.ndarray:
    """The starts that have one of ``places`` at ``offset``, up to ``slop`` words off."""
    low = np.searchsorted(places, starts + (offset - slop), "left")
    return starts[np.searchsorted(places, starts + (offset + slop), "right") > low]


@dataclass
class Shard:
    """An opened shard: the number of each of its words, and the places of all words one after the other."""

    number: int
    lengths: np.ndarray
    terms: dict[bytes, int]
    counts: np.ndarray
    ends: np.ndarray
    places: np.ndarray


def open_shard(row: dict) -> Shard:
    size = int.from_bytes(row["terms"][:8], "little")
    terms = pa.decompress(row["terms"][8:], size, codec="zstd", asbytes=True).split() if size else []
    counts = _unpack(row["counts"], np.int32, len(terms))
    ends = np.cumsum(counts, dtype=np.int64)
    places = np.cumsum(_unpack(row["positions"], np.int64, int(ends[-1]) if len(ends) else 0))
    return Shard(row["shard"], np.array(row["lengths"], np.int64), {t: i for i, t in enumerate(terms)}, counts, ends, places)


def search_shard(shard: Shard, phrases: Phrases, slop: int = 0) -> list[dict]:
    """The documents of a shard that hold phrases, with the word spans these cover and the items they come from."""
    counts, ends, places, lengths = shard.counts, shard.ends, shard.places, shard.lengths
    here = np.full(len(phrases.vocabulary) + 1, -1, np.int64)
    for term, number in phrases.vocabulary.items():
        here[number] = shard.terms.get(term, -1)
    bases = np.cumsum(lengths + _GAP) - (lengths + _GAP)
    codes = here[phrases.words]
    whole = ((codes >= 0) | (phrases.words < 0)).all(1)
    spans: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for i in np.flatnonzero(whole):
        length = int(phrases.lengths[i])
        code = codes[i, :length]
        order = np.argsort(counts[code], kind="stable")
        starts = None
        for offset in order:
            of = code[offset]
            at = places[ends[of] - counts[of] : ends[of]]
            starts = at - offset if starts is None else _near(starts, offset, at, slop)
            if not len(starts):
                break
        for start in starts:
            # The rarest word lies in this document; with slop, a phrase may begin before it or end after it.
            doc = int(np.searchsorted(bases, start + order[0], "right")) - 1
            first = max(0, int(start - bases[doc]))
            spans[doc].append((first, min(int(lengths[doc]), int(start - bases[doc]) + length)))
            items[doc].update(phrases.items[i])
    return [
        {"shard": shard.number, "ordinal": doc, "spans": [{"start": a, "end": b} for a, b in _merged(spans[doc])],
         "items": sorted(items[doc])}
        for doc in sorted(spans)
    ]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_column: str, text: str, size: int) -> DataFrame:
    """(block, items): the distinct test items as staged blocks of about ``size`` bytes, an item at least."""
    items = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("text")
    ).distinct()

    def run(batches):
        names, held, much = slice_numbers(), [], 0

        def block():
            raw = pickle.dumps(sorted(held))
            packed = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([next(names)]), pa.array([packed], pa.binary())], names=["block", "items"])

        for batch in batches:
            for part in slices(batch):
                for item, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.append((item, words))
                    much += len(words)
                    if much >= size:
                        yield block()
                        held, much = [], 0
        if held:
            yield block()

    return stage(items.mapInArrow(run, "block long, items binary"), "blocks")


_HIT_NAMES = ["shard", "ordinal", "spans", "items"]


def _search(window: int, slop: int):
    """From the shards of a group (side 0) and after them all blocks (side 1) the hits."""

    def run(batches):
        group, shards = None, []
        arrow = pa.schema([
            ("shard", pa.int64()), ("ordinal", pa.int32()), ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ])
        arrow = pa.schema([arrow.field(n) for n in _HIT_NAMES])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["salt"] != group:
                    group, shards = row["salt"], []
                if row["side"] == 0:
                    shards.append(open_shard(row))
                    continue
                phrases = phrases_of(pickle.loads(unpacked(row["items"])), window)
                for shard in shards:
                    yield pa.RecordBatch.from_pylist(search_shard(shard, phrases, slop), schema=arrow)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, id_column: str = "doc_id",
    text: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans): a row for each row of ``docs``.

    ``window`` consecutive words of a test item are a phrase; spans are the runs of document words that phrases cover,
    n_hit the words in them, items the sorted ids of the test items whose phrases occur. With ``slop`` a phrase also
    matches if each word is at most that many places (64 at most) off its place relative to the rarest one.

    Null texts have no words and no hits, an item with a null id is listed as the empty string, repeated ids of
    documents keep a row each, repeated items count once; an empty benchmark hits nothing. Other columns are not read.
    """
    if not 0 <= slop < _GAP // 2:
        raise ValueError(f"the slop is 0 to {_GAP // 2 - 1} words")
    index = build_index(docs, id_column, text)
    blocks = _blocks(benchmark, item_column, item_text, BLOCK_BYTES)
    salts = max(1, index.count() // TOGETHER)
    opened = ["shard", "lengths", "terms", "counts", "positions"]
    shards = index.select(F.pmod(F.xxhash64("shard"), F.lit(salts)).alias("salt"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("block"), *opened, F.lit(None).cast("binary").alias("items"))
    salted = blocks.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(1).alias("side"), "block",
        *[F.lit(None).cast(kind(index, c)).alias(c) for c in opened], "items",
    )
    met = shards.union(salted).repartition("salt").sortWithinPartitions("salt", "side", "block")
    found = met.mapInArrow(_search(window, slop), _HITS)
    length = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], done["to"]))).alias("n"),
            F.greatest(done["to"], s["end"]).alias("to"),
        ),
        lambda done: done["n"],
    )
    hits = found.groupBy("shard", "ordinal").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).withColumn("n_hit", length)
    each = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("ordinal", "doc"))
    return each.join(hits, ["shard", "ordinal"], "left").select(
        F.col("doc.doc_ids").alias("doc_id"), F.col("doc.lengths").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
    )
