"""Bytes covered by strings of a given length that occur earlier, through suffix arrays built by difference cover.

Only equal strings have to meet in one suffix array. Every string (100 bytes, say) has an anchor, the run of 24 bytes in
it with the smallest hash, so equal strings have equal anchors. Consecutive strings with the same anchor form a unit,
the stretch of text they span. Units are dealt by the hash of their anchor: a unit that is equal to an earlier one is
settled, and an anchor with a single distinct unit holds no other repeats. The units that are left, mostly at the borders
of copied passages, are joined into texts of some megabytes by anchor. A suffix array of each is built by the difference
cover of 3 (sort the triples at two of three positions, recurse on their names, sort the remaining suffixes by their
first letter and the rank behind it, merge), and strings that begin adjacent suffixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import keyed, packed_texts, remove_staged, slices, stage, text_bytes, unpacked
from tablehaul.operators.positions import number_rows

_GRAM = 24
# Bytes of text that are hashed at once, and of units that share one suffix array.
_SLICE = 1 << 20
_ARRAY = 1 << 20
# An anchor with more distinct units than fit one suffix array is settled by grouping its strings instead.
HOT_UNITS = 10_000
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the end."""
    w = np.zeros(len(text) + 8, np.uint64)
    w[: len(text)] = text
    for shift in (1, 2, 4):
        w[:-shift] |= w[shift:] << np.uint64(8 * shift)
    return w[: len(text)]


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    w = np.concatenate([words8(text), np.zeros(16, np.uint64)])
    n = len(text)
    h = w[:n] * _M[0]
    h ^= h >> np.uint64(31)
    h += w[8 : n + 8] * _M[1]
    h ^= h >> np.uint64(29)
    h += w[16 : n + 16] * _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[3]
    h ^= h >> np.uint64(29)
    return h


def units(text: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string start, number of strings, anchor hash) of the units of joined texts that begin at ``bounds``."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _gram_hashes(data)
    bits = np.uint64(max(1, len(data).bit_length()))
    key = hashes >> bits << bits | np.arange(len(data), dtype=np.uint64)
    span, reach = length - _GRAM + 1, 1
    while 2 * reach <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    starts = len(data) - length + 1
    anchor = (key[:starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(starts, bool)
    for end in bounds[1:]:
        inside[max(0, end - length + 1) : end] = False
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return first, stop - first + 1, hashes[anchor[first]]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a text of whole numbers from 1 on, by the difference cover of 3."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.uint64)
    s[:n] = text
    base = s.max() + np.uint64(1)
    # One more sample behind the end if n leaves 1 by 3, so that every remaining suffix is followed by a sampled one.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    triple = (s[sample] * base + s[sample + 1]) * base + s[sample + 2]
    order = np.argsort(triple, kind="stable")
    names = np.empty(len(sample), np.int64)
    sorted_triple = triple[order]
    names[order] = np.concatenate([[1], 1 + np.cumsum(sorted_triple[1:] != sorted_triple[:-1])])
    if names.max() < len(sample):
        order = suffix_array(names)
    ranks = np.zeros(n + 3, np.uint64)
    ranks[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    most = np.uint64(len(sample) + 1)
    rest = np.arange(0, n, 3)
    rest_key = s[rest] * most + ranks[rest + 1]
    by_key = np.argsort(rest_key, kind="stable")
    rest, rest_key = rest[by_key], rest_key[by_key]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(s[ones] * most + ranks[ones + 1], rest_key)
    pair = (s[twos] * base + s[twos + 1]) * most + ranks[twos + 2]
    before += np.searchsorted(pair, (s[rest] * base + s[rest + 1]) * most + ranks[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = ordered
    return out


def repeated_strings(texts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, text number, start) of the strings that occur more than once among the first ``counts`` of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    joined = b"\0".join(texts) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    numbers = data.astype(np.int64) + 1
    numbers[begins + sizes] = 257 + np.arange(len(texts))
    order = suffix_array(numbers)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = order - begins[owner[order]]
    valid = offset < counts[owner[order]]
    at, offset = order[valid], offset[valid]
    words = words8(data)
    same = np.arange(1, len(at))
    for step in [*range(0, length - 7, 8), length - 8]:
        same = same[words[at[same] + step] == words[at[same - 1] + step]]
    linked = np.zeros(len(at) + 1, bool)
    linked[same] = True
    group = np.cumsum(~linked[:-1])
    held = linked[:-1] | linked[1:]
    return group[held], owner[at[held]], offset[held]


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one document as (document, first start, number)."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + count[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + count[last] - start[first]


_OCCURRENCE = pa.schema([("anchor", pa.int64()), ("unit", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("strings", pa.int32())])
_OCCURRENCE_DDL = "anchor long, unit long, doc long, start long, strings int"


def _rows(anchor, unit, doc, start, strings) -> pa.RecordBatch:
    """A null unit marks strings that are settled as repeated; a null anchor goes with it where there is none."""
    made = [pa.array(a) if isinstance(a, np.ndarray) else a for a in (anchor, unit, doc, start)]
    return pa.RecordBatch.from_arrays([a.cast(pa.int64()) for a in made] + [pa.array(strings.astype(np.int32))], schema=_OCCURRENCE)


def _nulls(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def _find_units(length: int):
    """Scans (doc, text): the first of each unit in a slice, and the settled strings of the others."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _SLICE):
                texts = part.column(1).to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                joined = b"".join(texts)
                first, strings, anchor = units(joined, bounds, length)
                if not len(first):
                    continue
                owner = np.searchsorted(bounds, first, "right") - 1
                doc = part.column(0).to_numpy()[owner]
                start = first - bounds[owner]
                digest = xxhash.xxh3_64_intdigest
                unit = np.fromiter(
                    (digest(joined[a:b]) for a, b in zip(first.tolist(), (first + strings + length - 1).tolist())),
                    np.uint64, len(first),
                ).view(np.int64)
                order = np.lexsort((start, doc, unit))
                again = np.append(False, unit[order][1:] == unit[order][:-1])
                kept, settled = order[~again], order[again]
                yield _rows(anchor[kept].view(np.int64), unit[kept], doc[kept], start[kept], strings[kept])
                if len(settled):
                    d, s, n = _runs(doc[settled], start[settled], strings[settled])
                    # Dealt by document: a third of the rows may be copies with the same few anchors.
                    spread = d * 1000003 + s
                    yield _rows(spread, _nulls(len(d)), d, s, n)

    return scan


def _settle_units(batches) -> Iterator[pa.RecordBatch]:
    """Walks occurrences in the order of anchor, unit, document and start. The first of a unit waits until it is known
    whether its anchor has another unit; later ones are settled as repeated."""
    waiting = None
    last = (None, None)
    for batch in batches:
        anchor, unit = batch.column(0).to_numpy(), batch.column(1)
        settled = unit.is_null().to_numpy(zero_copy_only=False)
        doc, start, strings = (batch.column(i).to_numpy() for i in (2, 3, 4))
        if settled.any():
            yield _rows(_nulls(int(settled.sum())), _nulls(int(settled.sum())), doc[settled], start[settled], strings[settled])
        open_rows = np.flatnonzero(~settled)
        if not len(open_rows):
            continue
        a, u = anchor[open_rows], unit.fill_null(0).to_numpy()[open_rows]
        d, s, n = doc[open_rows], start[open_rows], strings[open_rows]
        same = np.append((a[0], u[0]) == last, (a[1:] == a[:-1]) & (u[1:] == u[:-1]))
        last = (a[-1], u[-1])
        if same.any():
            yield _rows(_nulls(int(same.sum())), _nulls(int(same.sum())), d[same], s[same], n[same])
        new = ~same
        a, u, d, s, n = a[new], u[new], d[new], s[new], n[new]
        if waiting is not None:
            a, u, d, s, n = (np.append(x[:1], y) for x, y in zip(waiting[0], (a, u, d, s, n)))
        if not len(a):
            continue
        twin = np.zeros(len(a), bool)
        pair = a[1:] == a[:-1]
        twin[1:] |= pair
        twin[:-1] |= pair
        if waiting is not None:
            twin[0] |= waiting[1]
        done = twin.copy()
        done[-1] = False
        if done.any():
            yield _rows(a[done], u[done], d[done], s[done], n[done])
        waiting = (tuple(x[-1:] for x in (a, u, d, s, n)), bool(twin[-1]))
    if waiting is not None and waiting[1]:
        yield _rows(*waiting[0])


_UNIT = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("strings", pa.int32()), ("bytes", pa.binary())])
_UNIT_DDL = "anchor long, doc long, start long, strings int, bytes binary"


def _cut_units(length: int):
    """From (doc, packed, list of units) the text of each unit."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = []
                for row in part.to_pylist():
                    text = unpacked(row["packed"])
                    for u in row["units"]:
                        rows.append({"anchor": u["anchor"], "doc": row["doc"], "start": u["start"], "strings": u["strings"],
                                     "bytes": text[u["start"] : u["start"] + u["strings"] + length - 1]})
                yield pa.RecordBatch.from_pylist(rows, schema=_UNIT)

    return run


_SETTLED = "doc long, start long, strings int"


def _settled_rows(doc, start, strings) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(strings, pa.int32())], names=["doc", "start", "strings"]
    )


def _compare_units(length: int):
    """Walks units in the order of their anchors; whole anchors are joined up to ``_ARRAY`` bytes into one suffix array."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        docs, starts, counts = (table.column(c).to_numpy() for c in ("doc", "start", "strings"))
        group, owner, offset = repeated_strings(table.column("bytes").to_pylist(), counts, length)
        doc, start = docs[owner], starts[owner] + offset
        order = np.lexsort((start, doc, group))
        later = order[np.append(False, group[order][1:] == group[order][:-1])] if len(order) else order
        return _settled_rows(*_runs(doc[later], start[later], np.ones(len(later), np.int64))) if len(later) else None

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), len(anchors)]
            widths = pa.compute.binary_length(batch.column(4)).to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(widths)])
            begin = 0
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if anchors[a] != last and size + total[a] - total[begin] >= _ARRAY:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    if held and (made := settle(held)):
                        yield made
                    held, size, begin = [], 0, a
                last = anchors[a]
            if len(anchors) > begin:
                held.append(batch.slice(begin))
                size += int(total[-1] - total[begin])
        if held and (made := settle(held)):
            yield made

    return run


def _hot_strings(length: int):
    """(first, second, doc, start): the 128-bit hash of every string of the units of hot anchors."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                out = {"first": [], "second": [], "doc": [], "start": []}
                for row in part.to_pylist():
                    for i in range(row["strings"]):
                        value = xxhash.xxh3_128_intdigest(row["bytes"][i : i + length])
                        out["first"].append((value >> 64) - (1 << 63))
                        out["second"].append((value & ((1 << 64) - 1)) - (1 << 63))
                        out["doc"].append(row["doc"])
                        out["start"].append(row["start"] + i)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def repeated_runs(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start, strings): runs of starts of ``length``-byte strings that also start earlier, staged. ``docs`` is
    (doc, text): distinct longs in the order of the documents, and bytes. Runs of one document may overlap."""
    if length < _GRAM:
        raise ValueError(f"strings have {_GRAM} bytes at least")
    found = docs.mapInArrow(_find_units(length), _OCCURRENCE_DDL)
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "unit", "doc", "start")
    walked = stage(dealt.mapInArrow(_settle_units, _OCCURRENCE_DDL), "units")
    settled = walked.filter("unit is null").select("doc", "start", "strings")
    left = walked.filter("unit is not null")
    hot = left.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_UNITS).select("anchor")
    lists = left.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "strings")).alias("units"))
    cut = stage(packed_texts(docs).join(lists, "doc").mapInArrow(_cut_units(length), _UNIT_DDL), "cut")
    cool = cut.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    compared = cool.mapInArrow(_compare_units(length), _SETTLED)
    strings = cut.join(hot, "anchor", "left_semi").mapInArrow(_hot_strings(length), "first long, second long, doc long, start long")
    least = strings.groupBy("first", "second").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = strings.join(least, ["first", "second"]).filter(F.struct("doc", "start") > F.col("least"))
    made = stage(settled.union(compared).union(later.select("doc", "start", F.lit(1).alias("strings"))), "repeats")
    remove_staged(walked)
    remove_staged(cut)
    return made


def numbered(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, doc_id, text): ``docs`` with a distinct long per row in the order of ids: the id itself, or, where ids repeat or are null, the
    row's place by (id, place in its file), null last."""
    plain = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text).alias("text"))
    repeated = plain.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return plain.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    rows = keyed(docs).select(F.col(id_column).alias("doc_id"), text_bytes(text).alias("text"), "__row")
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    placed = number_rows(rows.select("doc_id", F.col("__row").alias("place")), order, "doc").rows.select("doc", "doc_id", F.col("place").alias("__row"))
    return stage(rows.drop("doc_id").join(placed, "__row").select("doc", "doc_id", "text"), "numbered")


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = []
                for row in part.to_pylist():
                    text = unpacked(row["packed"])
                    spans: list[list[int]] = []
                    for r in sorted(row["runs"] or [], key=lambda r: r["start"]):
                        end = r["start"] + r["strings"] + length - 1
                        if spans and r["start"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([r["start"], end])
                    ends = [0, *(e for _, e in spans)]
                    kept = b"".join(text[e:s] for e, s in zip(ends, [s for s, _ in spans] + [len(text)]))
                    rows.append({
                        "doc_id": row["doc_id"], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans),
                        "kept": kept if keep_text else hashlib.sha256(kept).digest(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
                ]))

    return run


def remove_repeats(
    docs: DataFrame, length: int = 100, id_column: str = "doc_id", text: str = "text", keep_text: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``: ``kept`` are the bytes that no repeated
    string covers, or without ``keep_text`` their SHA-256.

    A string is repeated if it starts in an earlier document (smaller id; equal ids by place, null last) or earlier in
    the same one; strings are those of the input, not of what is left. Null texts are empty; texts shorter than
    ``length`` keep all. Other columns are not read.
    """
    rows = numbered(docs, id_column, text)
    runs = repeated_runs(rows.select("doc", "text"), length)
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    return packed_texts(rows).join(lists, "doc", "left").mapInArrow(_remove(length, keep_text), _KEPT)
