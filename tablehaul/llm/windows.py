"""Near-duplicate passages by compact windows.

A document's tokens are its five-word shingles. Under one hash function, all stretches of tokens with the same smallest
token form a compact window (first, smallest, last): every stretch that begins from ``first`` on, ends up to ``last`` and
holds the smallest token has that token as its min-hash. The windows are the nodes of the Cartesian tree over the
hashes; only those as wide as the shortest passage are kept, and these are the positions that are smallest in some
stretch of that width, so the tree is built over them alone, about 2 in 46 of all. A token that repeats has one window for
all its places that no smaller one parts, so a text of one line over and over has as many windows as the line has tokens.

Before that, tokens are counted: each slice of texts sends its different tokens to the part that their first bits name,
and gets back which of them are lone, of one document only, and which are hot, of very many. A passage that is like another
has few lone tokens, so windows are cut to stretches with few, which leaves out most of what has no copy. Hot tokens are the
smallest only where nearly all are hot, so that a line of many documents does not link all that stands around it.

Windows of different documents with equal min-hashes are linked. Those with the same tokens throughout are one text, which
its first window stands for, and the others are linked to that one; what differs is linked all to all. Documents are dealt
into lots, and each pair of lots is a cell, in which all links of a pair meet: few windows of a value are linked before that,
many go to the cells as they are. For each pair of documents the linked windows are joined as intervals: where those of
enough hash functions overlap, or one is of equal tokens, a passage is likely near-duplicate. The tokens of each document
are fetched once for some thousand pairs, and pairs are compared together, most by a few bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import packed_texts, remove_staged, slices, stage, unpacked
from tablehaul.llm.suffix import numbered

SHINGLE = 5
# Words of the shortest passage, hash functions, and how many of them have to agree before tokens are compared.
LEAST_WORDS = 50
FUNCTIONS = 6
ENOUGH = 3
SIMILARITY = 0.8
# Different windows of one min-hash that are linked in one go; more are linked cell by cell.
BLOCK = 64
# Of more different windows of one min-hash, the last strange ones, fewer than this, are linked as if they were not.
MANY = 256
# Added to the function of a link between windows of equal tokens.
EXACT = 8
# Lots that documents are dealt into, unless it is said how many; a pair of lots is a cell.
LOTS = 4
# In place of the function: a window of a cell, and what is added to that if it is strange.
WINDOW, STRANGE = 16, 4
# Links of a cell that are joined together.
TOGETHER = 400_000
# A token of one document alone, of some, and of more than ``CROWD``.
LONE, SHARED, HOT = 0, 1, 2
CROWD = 64
# Unmatched tokens that end a passage.
_GAP = 24
_MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) + 0x632BE59BD9B4E019 * i & (1 << 64) - 1 | 1) for i in range(1, 9)]


def tokens_of(text: bytes) -> np.ndarray:
    """The hashes of all five-word shingles of a text, in order; A-Z in lower case. Fewer words have none."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : n + i]) * _MIX[7]
        out ^= out >> np.uint64(32)
    return out


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest, first, last) of all compact windows of at least ``width`` tokens; of equal values the first is smaller."""
    n = len(values)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    bits = np.uint64(n.bit_length())
    key = values >> bits << bits | np.arange(n, dtype=np.uint64)
    low, reach = key, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    smallest = np.zeros(n, bool)
    smallest[low & ((np.uint64(1) << bits) - np.uint64(1))] = True
    chosen = np.flatnonzero(smallest)
    # The nearest smaller position on either side of a chosen one is chosen too.
    ranks = key[chosen]
    first, last = np.append(-1, chosen)[_smaller(ranks) + 1] + 1, np.append(chosen, n)[len(chosen) - 1 - _smaller(ranks[::-1])[::-1]] - 1
    return chosen, first, last


def _smaller(ranks: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller rank, or -1; no two ranks are equal."""
    before = np.arange(-1, len(ranks) - 1)
    going = np.flatnonzero(before >= 0)
    # All places between one and where it looks have larger ranks, so what is looked at from there is looked at next.
    for _ in range(16):
        going = going[ranks[before[going]] > ranks[going]]
        if not len(going):
            return before
        before[going] = before[before[going]]
        going = going[before[going] >= 0]
    # What is left, behind long runs of growing ranks, goes place by place.
    held, looked = ranks.tolist(), before.tolist()
    for i in going.tolist():
        at, rank = looked[i], held[i]
        while at >= 0 and held[at] > rank:
            at = looked[at]
        looked[i] = at
    return np.array(looked, np.int64)


_WINDOWS = "value long, doc long, first int, last int, content long"
# An odd number, whose powers weigh the tokens of a sum, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64)


def _covered(own: np.ndarray, walls: np.ndarray, width: int, part: float) -> np.ndarray:
    """Which tokens stand in a stretch of ``width`` tokens or more, of which at most ``part`` are ``own``. ``walls`` are in
    none."""
    most = int(np.ceil(part * 1000 - 1e-6))
    gain = np.where(own, most - 1000, most).astype(np.int64)
    gain[walls] = -(1 << 40)
    total = np.append(0, np.cumsum(gain))
    # The last end from which a stretch does not lose as a whole.
    end = len(own) - np.searchsorted(np.maximum.accumulate(total[::-1]), total)
    place = np.arange(len(total))
    reach = np.maximum.accumulate(np.where(end - place >= width, end, 0))
    return (reach > place)[:-1]


class _Runs:
    """Where windows may lie if tokens that are ``own`` meet no equal ones: in the runs of stretches that may still be
    similar to another. Of a token that a document repeats, only the first counts, as passages are compared as sets."""

    def __init__(self, own: np.ndarray, again: np.ndarray, walls: np.ndarray, width: int, similarity: float):
        place, n, self.width = np.arange(len(own)), len(own), width
        # The similarity is c / (a + b + c) with c tokens in common and a and b own ones on the two sides. So a / (a + c) is
        # at most 1 - similarity, and on one of the sides at most (1 - similarity) / (1 + similarity).
        self.covered = _covered(own & ~again, walls, width, 1 - similarity)
        half = _covered(own & ~again, walls, width, (1 - similarity) / (1 + similarity))
        self.first, self.last = self._ends(self.covered)
        self.half_first, self.half_last = self._ends(half)
        kept = ~own
        kept[walls] = False
        self.before = np.maximum.accumulate(np.where(kept, place, 0))
        self.after = np.minimum.accumulate(np.where(kept, place, n)[::-1])[::-1]

    @staticmethod
    def _ends(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last place of the run that each place is in."""
        place = np.arange(len(inside))
        first = np.maximum.accumulate(np.where(inside, 0, place + 1))
        return first, np.minimum.accumulate(np.where(inside, len(inside), place - 1)[::-1])[::-1]

    def cut(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(first, self.first[at]), np.minimum(last, self.last[at])

    def core(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches without the tokens of their own at their ends, where enough are left."""
        low, high = self.after[first], self.before[last]
        short = high - low + 1 < self.width
        return np.where(short, first, low), np.where(short, last, high)

    def strange(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether every stretch has so many tokens of its own that two of them are not similar."""
        return np.minimum(last, self.half_last[at]) - np.maximum(first, self.half_first[at]) + 1 < self.width


def _least_of(tokens: np.ndarray, values: np.ndarray, walls: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(head, at, first, last): the compact windows, of which all of one ``head`` are the same token's."""
    at, first, last = compact_windows(values, width)
    # Of equal tokens that follow one another without a smaller one between, the first has the window of all: a min-hash
    # is a token's value, wherever in the stretch it stands.
    head = np.arange(len(at))
    later = np.flatnonzero((first > 0) & (tokens[first - 1] == tokens[at]) & (tokens[at] != 0))
    head[later] = np.searchsorted(at, first[later] - 1)
    while np.any(head != head[head]):
        head = head[head]
    return head, at, first[head], last


def _scan(width: int, similarity: float = SIMILARITY):
    """The windows of (doc, text) or (doc, tokens, marks: ``LONE``, ``SHARED`` or ``HOT`` for each token). The texts of a slice
    are one sequence with a token between them that is smaller than all others under every function, so that no window
    reaches across it.

    A passage that is like one of another document has few lone tokens, so windows are only of stretches in which few are,
    and no lone token is their smallest. Hot tokens come after all others, so that a line of many documents does not link
    what stands around it; where almost all tokens are hot, these have windows too, of such stretches alone. The content
    of a window leaves out lone tokens at its ends, or all that are not hot. It is below 0 if windows are ``strange``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                docs = part.column(0).to_numpy()
                held = [np.frombuffer(t, np.uint64) if part.num_columns > 2 else tokens_of(t) for t in part.column(1).to_pylist()]
                long = [i for i, t in enumerate(held) if len(t) >= width]
                if not long:
                    continue
                sizes = np.array([len(held[i]) + 1 for i in long])
                begins = np.cumsum(sizes) - sizes
                tokens, marks = np.zeros(int(sizes.sum()), np.uint64), np.full(int(sizes.sum()), SHARED, np.uint8)
                for i, begin in zip(long, begins):
                    tokens[begin : begin + len(held[i])] = held[i]
                    if part.num_columns > 2:
                        marks[begin : begin + len(held[i])] = np.frombuffer(part.column(2)[i].as_py(), np.uint8)
                walls = begins + sizes - 1
                marks[walls] = LONE
                names = docs[long]
                # Sums by which the tokens of any stretch get a hash that does not depend on where it stands.
                sums = np.append(np.uint64(0), np.cumsum(tokens * _powers(_BASE, len(tokens))[:-1], dtype=np.uint64))
                back = _powers(_INVERSE, len(tokens))
                hot, again = marks == HOT, np.zeros(len(tokens), bool)
                if part.num_columns > 2:
                    again[:] = True
                    again[np.unique(tokens + np.repeat(np.arange(len(long), dtype=np.uint64), sizes) * _MIX[5], return_index=True)[1]] = False
                # What is smallest, the order of the marks, and where windows may lie.
                passes = [(marks == SHARED, np.where(marks == LONE, 3, marks), _Runs(marks == LONE, again, walls, width, similarity))]
                if np.count_nonzero(hot) * 2 > width:
                    passes.append((hot, np.where(marks == LONE, 3, 1), _Runs(~hot, again, walls, width, similarity)))
                for smallest, ranks, runs in passes:
                    if not runs.covered.any():
                        continue
                    ranks = ranks.astype(np.uint64) << np.uint64(62)
                    for f in range(FUNCTIONS):
                        values = (tokens ^ (tokens >> np.uint64(29))) * _MIX[f]
                        values ^= values >> np.uint64(31)
                        values = values >> np.uint64(2) | ranks
                        values[walls] = 0
                        head, at, first, last = _least_of(tokens, values, walls, width)
                        inside = smallest[at] & runs.covered[at]
                        head, at, first, last = head[inside], at[inside], first[inside], last[inside]
                        first, last = runs.cut(at, first, last)
                        _, once = np.unique(head * np.int64(len(tokens)) + first, return_index=True)
                        once = once[last[once] - first[once] + 1 >= width]
                        at, first, last = at[once], first[once], last[once]
                        own = np.searchsorted(begins, at, "right") - 1
                        marked = tokens[at] & ~np.uint64(7) | np.uint64(f)
                        low, high = runs.core(first, last)
                        content = (sums[high + 1] - sums[low]) * back[low] ^ (high - low).astype(np.uint64) * _MIX[6]
                        content = content >> np.uint64(1) | runs.strange(at, first, last).astype(np.uint64) << np.uint64(63)
                        rows = _thin(marked, names[own], first - begins[own], last - begins[own], content)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[0].view(np.int64)), pa.array(rows[1])]
                            + [pa.array(x.astype(np.int32)) for x in rows[2:4]] + [pa.array(rows[4].view(np.int64))],
                            names=["value", "doc", "first", "last", "content"],
                        )

    return run


def _thin(value: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """The windows of a slice in the order of value, document and place. All of them go on, also those of a crowd."""
    order = np.lexsort((rest[1], rest[0], value))
    return [value[order], *(r[order] for r in rest)]


_SLICES = "slice long, part int, docs binary, sizes binary, packed binary, marks binary"
_HELD = "part int, slice long, low binary, n binary"
_MARKED = "slice long, part int, marks binary"
# Parts of the tokens' hashes, by their first bits.
PARTS = 4096


def _slice(batches) -> Iterator[pa.RecordBatch]:
    """Texts of some megabytes together, as one row."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch, 4 << 20):
            texts = part.column(1).to_pylist()
            joined = b"".join(texts)
            packed = len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)
            row = [number, -1, part.column(0).to_numpy().tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), packed, None]
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _SLICES.split(", ")])
            number += 1


def _texts_of(sizes: bytes, packed: bytes) -> list[bytes]:
    joined, ends = unpacked(packed), np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def _by_part(tokens: np.ndarray) -> np.ndarray:
    """Where each part begins in sorted tokens, and their end."""
    return np.append(np.searchsorted(tokens, np.arange(PARTS, dtype=np.uint64) << np.uint64(52)), len(tokens))


def _different(tokens: np.ndarray) -> np.ndarray:
    """The different tokens in their order; np.unique hashes them, which takes longer."""
    tokens = np.sort(tokens)
    return tokens[np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]]


def _pieces(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between bounds that follow one another."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _held(batches) -> Iterator[pa.RecordBatch]:
    """From slices, for each part the different tokens, 32 bits after those of the part, and how many documents have them,
    ``CROWD`` + 1 at most."""
    for batch in batches:
        for row in batch.to_pylist():
            own = [_different(tokens_of(t)) for t in _texts_of(row["sizes"], row["packed"])]
            tokens, n = np.unique(np.concatenate(own), return_counts=True)
            bounds = _by_part(tokens)
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            if not len(full):
                continue
            cuts = np.append(bounds[full], len(tokens))
            low = (tokens >> np.uint64(20)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["slice"])), _pieces(low, cuts),
                 _pieces(np.minimum(n, CROWD + 1).astype(np.uint8), cuts)],
                names=["part", "slice", "low", "n"],
            )


def _mark(batches) -> Iterator[pa.RecordBatch]:
    """For the tokens of each slice and part, in their order, whether they are lone, shared or hot. Tokens that are equal in
    44 bits count as one, which may make a lone one shared, and never the other way round."""
    for (part,), held in _grouped(batches, 1):
        slices_of = np.concatenate([h.column(1).to_numpy() for h in held])
        low = [np.frombuffer(x, np.uint32) for h in held for x in h.column(2).to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint8) for h in held for x in h.column(3).to_pylist()])
        _, code = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(code, weights=n)
        marks = np.where(total > CROWD, HOT, np.where(total > 1, SHARED, LONE)).astype(np.uint8)[code]
        cuts = np.append(0, np.cumsum([len(x) for x in low]))
        # Some thousand slices at a time: offsets have 32 bits.
        for a in range(0, len(low), 4096):
            b = min(len(low), a + 4096)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices_of[a:b]), pa.array(np.full(b - a, part, np.int32)), _pieces(marks[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])],
                names=["slice", "part", "marks"],
            )


def _marked_texts(width: int, similarity: float):
    """From slices and the marks of their tokens (doc, tokens, marks) of the documents that may hold a passage."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, 1):
            first = held[0].slice(0, 1).to_pylist()[0]
            texts = _texts_of(first["sizes"], first["packed"])
            all_marks = np.frombuffer(b"".join(x for h in held for x in h.column(5).to_pylist() if x is not None), np.uint8)
            tokens = [tokens_of(t) for t in texts]
            order = np.argsort(joined := np.concatenate(tokens))
            new = np.append(0, joined[order][1:] != joined[order][:-1])[: len(order)]
            placed = np.empty(len(order), np.uint8)
            placed[order] = all_marks[np.cumsum(new)]
            ends, rows = np.cumsum([len(t) for t in tokens]), []
            for doc, own, marks in zip(np.frombuffer(first["docs"], np.int64).tolist(), tokens, np.split(placed, ends[:-1])):
                if np.count_nonzero(marks) >= similarity * width - 1e-6:
                    rows.append((doc, own.tobytes(), marks.tobytes()))
            if rows:
                columns = zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["doc", "tokens", "marks"])

    return run


def _marked_windows(width: int, similarity: float):
    """The windows (``_scan``) of slices with the marks of their tokens."""
    return lambda batches: _scan(width, similarity)(_marked_texts(width, similarity)(batches))


_LINKS = "cell long, a long, b long, f int, a_first int, a_last int, b_first int, b_last int, place long"
_LINK_NAMES = [c.split()[0] for c in _LINKS.split(", ")]


def lot_of(docs: np.ndarray, lots: int) -> np.ndarray:
    """The lot that a document is in, by its hash."""
    return (docs.astype(np.int64).view(np.uint64) * _MIX[3] >> np.uint64(32)).astype(np.int64) % lots


def _place(left: np.ndarray, right: np.ndarray, lots: int) -> np.ndarray:
    """The cell of two lots, above 0."""
    return np.minimum(left, right) * lots + np.maximum(left, right) + 1


def _link_rows(f: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], lots: int) -> Iterator[pa.RecordBatch]:
    """Links of windows (doc, first, last) of different documents, the smaller document first."""
    other = left[0] != right[0]
    turned = left[0] > right[0]
    a, b = ([np.where(turned, y, x)[other] for x, y in zip(*sides)] for sides in ((left, right), (right, left)))
    if len(a[0]):
        cells, places = np.zeros(len(a[0]), np.int64), _place(lot_of(a[0], lots), lot_of(b[0], lots), lots)
        yield _link_batch(cells, a[0], b[0], f[other], a[1], a[2], b[1], b[2], places)


def _link_batch(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype(), copy=False)) for c, k in zip(columns, kinds)], names=_LINK_NAMES)


def _all_pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs with one ``group``, which is sorted, some hundred thousand at a time."""
    new = np.append(True, group[1:] != group[:-1])
    turn = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    here, apart, held, size = np.arange(len(group)), 1, [], 0
    while len(here := here[turn[here] >= apart]):
        held.append((here - apart, here))
        size += len(here)
        if size > 200_000:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
        apart += 1
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _linked(value, doc, first, last, content, lots: int = LOTS) -> Iterator[pa.RecordBatch]:
    """The links of whole groups of one value, but of strange windows (content below 0) only those of equal content with each
    other (see ``MANY``). In rows with a ``cell`` other than 0 they are windows instead, (a: doc, b: value, f: ``WINDOW`` and the side,
    a_first, a_last), that cell by cell are linked later: side 0 with side 1, and all of side 2. Documents are in the same
    lots under all values, so that all links of a pair meet in one cell, and a window of a crowd goes to as many cells as
    there are lots, not to as many pairs as there are others. ``place`` is the cell of links and windows alike."""
    # The least document's window stands for all of equal tokens, under every function alike.
    order = np.lexsort((first, doc, content, value))
    value, doc, first, last, content = (x[order] for x in (value, doc, first, last, content))
    new = np.append(True, (value[1:] != value[:-1]) | (content[1:] != content[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    copies, rows = np.flatnonzero(~new), [doc, first, last]
    yield from _link_rows((value[copies] & 7) + EXACT, [r[start[copies]] for r in rows], [r[copies] for r in rows], lots)
    value, strange, rows = value[new], content[new] < 0, [r[new] for r in rows]
    begins = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    sizes = np.diff(np.append(begins, len(value)))
    for k in np.flatnonzero(sizes > MANY):
        # Strange windows come first.
        alone = np.count_nonzero(strange[begins[k] : begins[k] + sizes[k]]) // MANY * MANY
        strange[begins[k] + alone : begins[k] + sizes[k]] = False
    small = np.repeat(sizes <= max(BLOCK, 2 * lots), sizes)
    few, apart, held = value[small], strange[small], [r[small] for r in rows]
    for left, right in _all_pairs(few):
        near = ~(apart[left] & apart[right])
        left, right = left[near], right[near]
        yield from _link_rows(few[left] & 7, [r[left] for r in held], [r[right] for r in held], lots)
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        if size <= max(BLOCK, 2 * lots):
            continue
        # Those that are not strange are linked with all: as they are where they are few.
        common = begin + np.flatnonzero(~strange[begin : begin + size])
        if len(common) <= lots:
            for here in common:
                right = np.append(begin + np.flatnonzero(strange[begin : begin + size]), common[common > here])
                left = np.full(len(right), here)
                yield from _link_rows(value[left] & 7, [r[left] for r in rows], [r[right] for r in rows], lots)
            continue
        own = lot_of(rows[0][begin : begin + size], lots)
        others = np.unique(own)
        for low in range(0, size, step := max(1, 200_000 // len(others))):
            at = np.repeat(np.arange(low, min(size, low + step)), len(others))
            mine, other = own[at], np.tile(others, len(at) // len(others))
            side = WINDOW + np.where(mine == other, 2, np.where(mine < other, 0, 1)) + STRANGE * strange[begin + at]
            cell, (doc, first, last) = _place(mine, other, lots), (r[begin + at] for r in rows)
            yield _link_batch(cell, doc, np.full(len(at), value[begin]), side, first, last, first, last, cell)


def _link(batches, lots: int = LOTS) -> Iterator[pa.RecordBatch]:
    """Takes windows in the order of their values and links those of one value (``_linked``)."""
    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.append(h, r) for h, r in zip(held, rows)]
        # The last value may go on in the next batch.
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield from _linked(*(r[:cut] for r in rows), lots)
        held = [r[cut:] for r in rows]
    if held is not None:
        yield from _linked(*held, lots)


def _link_cells(batches, lots: int = LOTS) -> Iterator[pa.RecordBatch]:
    """The links in each cell and those of its windows (see ``_linked``), in the order of pairs, some hundred thousand at a
    time. All links of a pair come together."""
    for (cell,), held in _grouped(batches, 1):
        a, b, f, *ends = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(1, 8))
        low = (cell - 1) // lots
        linked, side = np.flatnonzero(f < WINDOW), (f - WINDOW) % STRANGE
        left, right = (np.flatnonzero((f >= WINDOW) & (side != i)) for i in (1, 0))
        right = right[np.argsort(b[right], kind="stable")]
        begin, end = (np.searchsorted(b[right], b[left], way) for way in ("left", "right"))
        # A document of the first lot has all its links in one chunk.
        turned = lot_of(a[linked], lots) != low
        mine = np.concatenate([a[left], np.where(turned, b[linked], a[linked])])
        docs, code = np.unique(mine, return_inverse=True)
        n = np.append(end - begin, np.ones(len(linked), np.int64))
        chunk = (np.cumsum(np.bincount(code, weights=n)) // TOGETHER).astype(np.int64)[code] if len(docs) else code
        order = np.argsort(chunk, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            x, y = at[at < len(left)], linked[at[at >= len(left)] - len(left)]
            many = n[x]
            v, w = left[np.repeat(x, many)], right[np.repeat(begin[x] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            # In a cell of one lot each pair comes both ways.
            near = (a[v] < a[w] if (cell - 1) % lots == low else a[v] != a[w]) & ((f[v] < WINDOW + STRANGE) | (f[w] < WINDOW + STRANGE))
            v, w = v[near], w[near]
            v, w = np.where(a[v] < a[w], v, w), np.where(a[v] < a[w], w, v)
            columns = [np.append(a[v], a[y]), np.append(a[w], b[y]), np.append(b[v] & 7, f[y])]
            columns += [np.append(ends[i][z], ends[k][y]) for i, z, k in ((0, v, 0), (1, v, 1), (0, w, 2), (1, w, 3))]
            if len(columns[0]):
                order_of = np.lexsort((columns[1], columns[0]))
                yield _link_batch(np.full(len(order_of), cell), *(c[order_of] for c in columns), np.full(len(order_of), cell))


_PAIRS = "part long, docs binary, spans binary, pairs binary"


def overlapping(pair: np.ndarray, links: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, (a_from, a_to, b_from, b_to)) of where the linked windows of pairs of documents overlap for enough functions.

    ``links`` are rows (f, a_first, a_last, b_first, b_last), and ``pair`` their pairs' numbers, in order. Along the first
    document windows open at their first and close after their last token; while enough functions, or a link of equal
    tokens, are open, the windows belong together. Where one closes just before another opens, none is open between.
    """
    f, first, last = links[:, 0].astype(np.int64), links[:, 1].astype(np.int64), links[:, 2].astype(np.int64)
    span = np.int64(last.max() + 2 if len(last) else 2)
    # Runs of places where any window of a function is open.
    group = pair * 2 * EXACT + f
    order = np.argsort(group * span + first)
    group, begin, end = group[order], first[order], last[order]
    reach = np.maximum.accumulate(group * span + end) - group * span
    new = np.append(True, (group[1:] != group[:-1]) | (begin[1:] > reach[:-1]))[: len(group)]
    runs = np.flatnonzero(new)
    weight = np.where(group[runs] % (2 * EXACT) >= EXACT, enough, 1)
    of, opens, closes = group[runs] // (2 * EXACT), begin[runs], reach[np.append(runs[1:], len(group)) - 1] + 1
    # What closes at a place comes before what opens there.
    event = np.append((of * span + opens) * 2 + 1, (of * span + closes) * 2)
    order = np.argsort(event)
    event, agreeing = event[order] >> 1, np.cumsum(np.append(weight, -weight)[order])
    before = np.append(0, agreeing[:-1])[: len(agreeing)]
    starts, stops = event[(before < enough) & (agreeing >= enough)], event[(before >= enough) & (agreeing < enough)]
    # A window may be in several of these stretches.
    low, high = np.searchsorted(stops, pair * span + first, "right"), np.searchsorted(starts, pair * span + last, "right")
    many = np.maximum(high - low, 0)
    stretch = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    order = np.argsort(stretch, kind="stable")
    held, cuts = np.repeat(np.arange(len(links)), many)[order], np.searchsorted(stretch[order], np.arange(len(starts)))
    if not len(held):
        return np.zeros(0, np.int64), np.zeros((0, 4), links.dtype)
    sides = [least.reduceat(links[held, i], cuts) for i, least in enumerate((np.minimum, np.maximum) * 2, 1)]
    return starts // span, np.column_stack(sides)


def _grouped(batches, keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of consecutive equal keys, the first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(c[a] for c in columns)
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _agreeing(batches, enough: int) -> Iterator[pa.RecordBatch]:
    """The links (a, b, f, ...) without those of pairs that too few functions link. Pairs that a batch may share with the
    one before or after it stay."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, f = (batch.column(i).to_numpy() for i in range(3))
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        begins = np.flatnonzero(new)
        seen = np.bitwise_or.reduceat(np.int64(1) << f.astype(np.int64), begins)
        # Links of equal tokens, whose functions count from EXACT on, are enough alone.
        kept = (np.bitwise_count(seen & ((1 << EXACT) - 1)) >= enough) | (seen >= 1 << EXACT)
        kept[[0, -1]] = True
        yield batch.filter(pa.array(kept[np.cumsum(new) - 1]))


def _join_intervals(batches) -> Iterator[pa.RecordBatch]:
    """From links, of which a batch has all of a pair, the pairs of a batch in one row: the documents, from and to where each
    is wanted, and the pairs by the documents' places among them."""
    for number, batch in enumerate(_agreeing((b.select(_LINK_NAMES[1:]) for b in batches), ENOUGH)):
        a, b, *links, cell = (batch.column(i).to_numpy() for i in range(8))
        if not len(a):
            continue
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        pair, spans = overlapping(np.cumsum(new) - 1, np.column_stack(links), ENOUGH)
        if not len(pair):
            continue
        at = np.flatnonzero(new)[pair]
        docs, code = np.unique(np.append(a[at], b[at]), return_inverse=True)
        spans = np.append(spans[:, :2], spans[:, 2:], axis=0).astype(np.int32)
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(docs)))
        whole = np.column_stack([np.minimum.reduceat(spans[order, 0], cuts), np.maximum.reduceat(spans[order, 1], cuts)])
        pairs = np.column_stack([code[: len(at)], code[len(at) :], spans[: len(at)], spans[len(at) :]]).astype(np.int32)
        # Batches of one task have parts of their own: the number of a cell goes to one task.
        part = int(cell[0]) << 32 | number
        columns = [pa.array([part]), *(pa.array([x.tobytes()], pa.binary()) for x in (docs.astype(np.int64), whole, pairs))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PAIRS.split(", ")])


_WANTED = "doc long, part long, begin int, end int"


def _wanted(batches) -> Iterator[pa.RecordBatch]:
    """(doc, part, begin, end) of the documents in rows of pairs."""
    for batch in batches:
        for row in batch.to_pylist():
            docs, spans = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["spans"], np.int32).reshape(-1, 2)
            columns = [docs, np.full(len(docs), row["part"]), spans[:, 0], spans[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _WANTED.split(", ")])


_SIDES = "part long, doc long, begin int, tokens binary"


def _fetch(batches) -> Iterator[pa.RecordBatch]:
    """From (doc, packed, wanted: part, begin, end) the tokens of each wanted stretch, 32 bits of each."""
    kinds = [("part", pa.int64()), ("doc", pa.int64()), ("begin", pa.int32()), ("tokens", pa.binary())]
    schema, rows, size = pa.schema(kinds), [], 0
    for batch in batches:
        for part in slices(batch, 2 << 20):
            for row in part.to_pylist():
                tokens = (tokens_of(unpacked(row["packed"])) >> np.uint64(32)).astype(np.uint32)
                for w in row["wanted"]:
                    held = tokens[w["begin"] : w["end"] + 1].tobytes()
                    rows.append({"part": w["part"], "doc": row["doc"], "begin": w["begin"], "tokens": held})
                    size += len(held) + 64
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the first, places in the second) of equal tokens. Of a token that occurs more than once, the place is
    taken that goes best with the tokens before which occur once, or else with the commonest shift."""
    held, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    return _matches(code[: len(a)], code[len(a) :], len(held))


def _matches(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``matches`` of numbers below ``n``; those of the second below 0 are no tokens of the first."""
    here = np.flatnonzero(right >= 0)
    count_a, count_b = np.bincount(left, minlength=n), np.bincount(right[here], minlength=n)
    at = np.flatnonzero(count_b[left] > 0)
    if not len(at):
        return at, at
    span = np.int64(len(right) + 1)
    placed = np.sort(right[here] * span + here)
    # The n-th of equal tokens on one side goes with the n-th on the other, to begin with.
    own = left[at]
    order = np.argsort(own, kind="stable")
    turn = np.empty(len(at), np.int64)
    turn[order] = np.arange(len(at)) - np.searchsorted(own[order], own[order])
    nth = placed[np.searchsorted(placed, own * span) + np.minimum(turn, count_b[own] - 1)] % span
    once = (count_a[own] == 1) & (count_b[own] == 1)
    if once.any():
        anchors, shifts = at[once], nth[once] - at[once]
    else:
        values = np.sort(nth - at)
        begins = np.append(0, np.flatnonzero(values[1:] != values[:-1]) + 1)
        often = np.append(begins[1:], len(values)) - begins
        anchors, shifts = at[:1], values[begins[np.argmax(often)]][None]
    near = np.maximum(np.searchsorted(anchors, at, "right") - 1, 0)
    wanted = np.minimum(np.maximum(at + shifts[near], 0), len(right) - 1)
    after = np.searchsorted(placed, own * span + wanted)
    after = np.minimum(after, len(placed) - 1)
    before = np.maximum(after - 1, 0)
    best = nth.copy()
    for choice in (before, after):
        place = placed[choice] % span
        better = (placed[choice] // span == own) & (np.abs(place - wanted) < np.abs(best - wanted))
        best[better] = place[better]
    return at, best


def _chains(at: np.ndarray, there: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matches without a long gap and without a jump in the second document. A stray match, of a token that stands
    elsewhere too, does not end the chain around it."""
    shift = there - at
    cut = np.flatnonzero((np.diff(at) > _GAP) | (np.abs(np.diff(shift)) > _GAP)) + 1
    open_chains: list[list[tuple[np.ndarray, np.ndarray]]] = []
    out = []
    for x, y in zip(np.split(at, cut), np.split(there, cut)):
        going = [c for c in open_chains if x[0] - c[-1][0][-1] <= _GAP]
        out += [c for c in open_chains if x[0] - c[-1][0][-1] > _GAP]
        apart = [abs(int(y[0] - x[0] - c[-1][1][-1] + c[-1][0][-1])) for c in going]
        if apart and min(apart) <= _GAP:
            going[apart.index(min(apart))].append((x, y))
        else:
            going.append([(x, y)])
        open_chains = going
    return [tuple(np.concatenate(side) for side in zip(*c)) for c in out + open_chains]


def _widened(low: int, high: int, begin: int, end: int, sizes: tuple[int, int], width: int) -> tuple[int, int, int, int] | None:
    """The two stretches with as many tokens around, the same on both sides, as they lack to be ``width`` long."""
    lacking = width - min(high - low, end - begin) - 1
    if lacking <= 0:
        return low, high, begin, end
    before = min(lacking, low, begin)
    after = min(lacking - before, sizes[0] - 1 - high, sizes[1] - 1 - end)
    return (low - before, high + after, begin - before, end + after) if before + after == lacking else None


def _score(a: np.ndarray, b: np.ndarray) -> float:
    left, right = np.unique(a), np.unique(b)
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common / (len(left) + len(right) - common)


def _blocks(x: np.ndarray, y: np.ndarray) -> list:
    """(firsts, lasts, x of each, x + y of each) of matches that follow one another: the place is the next on one side and at
    most the next on the other. As lists where there are few."""
    total = x + y
    cuts = (total[1:] - total[:-1] > 2).nonzero()[0]
    starts, ends = np.zeros(len(cuts) + 1, np.int64), np.full(len(cuts) + 1, len(x) - 1)
    starts[1:], ends[:-1] = cuts + 1, cuts
    blocks = [starts, ends, x[starts], x[ends], total[starts], total[ends]]
    return [b.tolist() for b in blocks] if len(starts) <= 24 else blocks


def _longest(blocks: list, bound: float) -> tuple[int, int]:
    """The first and last match of the longest run of matches that are that part of the tokens they span: with c of a and b
    tokens in common, c * (1 + bound) >= bound * (a + b), which adds up along the run. Inside a block no match loses
    anything, so runs begin and end with blocks."""
    starts, ends, begins, stops, total, total_end = blocks
    more, twice = 1 + bound, 2 * bound
    if isinstance(starts, list):
        upto = [more * (e + 1) - bound * t - twice for e, t in zip(ends, total_end)]
        best, found = -1, (0, -1)
        for k, begin in enumerate(begins):
            if stops[-1] - begin <= best:
                break
            least = more * starts[k] - bound * total[k] - 1e-9
            for last in range(len(ends) - 1, k - 1, -1):
                if stops[last] - begin <= best:
                    break
                if upto[last] >= least:
                    best, found = stops[last] - begin, (starts[k], ends[last])
                    break
        return found
    # The last block up to which ``upto`` is not below what the run begins with.
    upto = np.maximum.accumulate((more * (ends + 1) - bound * total_end - twice)[::-1])
    last = len(starts) - 1 - upto.searchsorted(more * starts - bound * total - 1e-9)
    span = np.where(last >= np.arange(len(starts)), stops[last] - begins, -1)
    k = int(span.argmax())
    return (int(starts[k]), int(ends[last[k]])) if span[k] >= 0 else (0, -1)


def passages(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(a from, a to, b from, b to, similarity) of near-duplicate passages of two stretches of tokens.

    Stretches of the first with matches and no long gap are set against the stretch of the second that their matches
    span; a passage has at least ``width`` tokens on both sides and a Jaccard similarity of at least ``similarity``. Where
    a whole stretch is less similar, the longest parts of it that are similar enough are taken. One that lacks some tokens
    to the width takes unmatched ones at its borders.
    """
    at, there = matches(a, b)
    score = lambda low, high, begin, end: _score(a[low : high + 1], b[begin : end + 1])
    return _passages(_chains(at, there), score, (len(a), len(b)), width, similarity) if len(at) else []


def _runs(x: np.ndarray, y: np.ndarray, width: int, similarity: float, growing: int) -> Iterator[tuple[int, int]]:
    """The runs of matches that are tried, as their first and last: the whole, and the longest by bounds around the
    similarity. Matches are as many as common tokens where none repeats; else the sets decide.

    ``growing`` is how many matches there are in all where both sides grow from one to the next and no token repeats, else 0.
    There a run that is wide enough is similar just if it is so by its matches. So if the longest by the similarity is too
    long for one with a lower bound to be short on the other side, that has the same outcome and is not tried; and similar
    parts have a run of as many matches as they need that are similar by themselves."""
    yield 0, len(x) - 1
    blocks, tried = _blocks(x, y), {(0, len(x) - 1), (0, -1)}
    if growing:
        i, j = run = _longest(blocks, similarity)
        if growing == len(x) and (j < i or x[j] - x[i] + 1 < _least_common(width, similarity)):
            return
        if j >= i and x[j] - x[i] + 1 > (width - 1) / max(similarity - 0.1, 0.1) and y[j] - y[i] + 1 >= width and run not in tried:
            tried.add(run)
            yield run
    for bound in (similarity - 0.1, similarity - 0.05, similarity, (1 + similarity) / 2, 1.0):
        run = _longest(blocks, bound)
        if run not in tried:
            tried.add(run)
            yield run


def _least_common(width: int, similarity: float) -> float:
    """How many different tokens similar passages have in common, at least: c of c + a + b, and ``width`` on either side."""
    return 2 * width * similarity / (1 + similarity) - 1e-6


def _passages(
    left: list[tuple[np.ndarray, np.ndarray]], score_of, sizes: tuple[int, int], width: int, similarity: float, growing: int = 0
) -> list[tuple[int, int, int, int, float]]:
    """The passages of chains of matches; ``score_of`` gives the similarity of two parts. ``growing``: see ``_runs``."""
    out = []
    while left:
        x, y = left.pop()
        for i, j in _runs(x, y, width, similarity, growing):
            begin, end = (int(y[i]), int(y[j])) if growing else (int(y[i : j + 1].min()), int(y[i : j + 1].max()))
            tight = (int(x[i]), int(x[j]), begin, end)
            found = _widened(*tight, sizes, width)
            if found is None:
                continue
            common = j - i + 1
            score = common / (tight[1] - tight[0] + end - begin + 2 - common) if growing and found == tight else score_of(*found)
            if score >= similarity:
                out.append((*found, score))
                left += [(x[p], y[p]) for p in (slice(0, i), slice(j + 1, None)) if len(x[p]) * (1 + similarity) >= similarity * width]
                break
    return sorted(out)


class _Side:
    """The tokens of a document, as numbers. Where any repeats: for each the place of the same one before it, or one
    far before all."""

    def __init__(self, tokens: np.ndarray, repeats: bool):
        self.tokens, self.before, self.far = tokens, None, None
        if repeats:
            order = np.argsort(tokens, kind="stable")
            again = np.flatnonzero(tokens[order][1:] == tokens[order][:-1])
            self.before = np.full(len(tokens), -(1 << 30))
            self.before[order[again + 1]] = order[again]

    def repeats(self, first: int, last: int) -> bool:
        return self.before is not None and bool(self.before[first : last + 1].max() >= first)

    def different(self, first: int, last: int) -> int:
        """How many different tokens the stretch has."""
        return last - first + 1 if self.before is None else int(np.count_nonzero(self.before[first : last + 1] < first))

    def apart(self, width: int) -> np.ndarray:
        """Which tokens stand ``width`` places or more after the same one before."""
        if self.far is None:
            place = np.arange(len(self.tokens))
            self.far = np.ones(len(place), bool) if self.before is None else place - self.before >= width
        return self.far


class _Pairs:
    """Compares stretches of documents, whose tokens are numbers below ``n``, as ``passages`` does."""

    def __init__(self, n: int, width: int, similarity: float):
        self.place, self.width, self.similarity = np.full(n, -1, np.int32), width, similarity
        # Own tokens of both sides for each that they have in common.
        self.spare = (1 / similarity - 1) + 1e-9
        self.least = _least_common(width, similarity)

    def passages(self, sides: list[_Side], pairs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int, int, float]]]]:
        """(number, passages) of the pairs that have any, from (a, b, a_from, a_to, b_from, b_to) in the order of a."""
        held, size = [], 0
        begins = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(pairs)]):
            a = sides[pairs[begin, 0]]
            # A token's number is its first place in the one.
            self.place[a.tokens[::-1]] = np.arange(len(a.tokens) - 1, -1, -1)
            code = self.place[a.tokens]
            for k, (_, b, a_from, a_to, b_from, b_to) in enumerate(pairs[begin:end].tolist(), begin):
                if min(a_to - a_from, b_to - b_from) + 1 >= self.width:
                    back = self.place[sides[b].tokens[b_from : b_to + 1]]
                    held.append((k, a, code, sides[b], back, (a_from, a_to, b_from, b_to)))
                    size += len(code) + len(back)
                    if size > 1_000_000:
                        yield from self._compared(held)
                        held, size = [], 0
            self.place[a.tokens] = -1
        yield from self._compared(held)

    def _compared(self, rows: list[tuple]):
        single = [a.repeats(*span[:2]) or b.repeats(*span[2:]) for _, a, _, b, _, span in rows]
        for few, compare in (([r for r, x in zip(rows, single) if not x], self._all_plain), ([r for r, x in zip(rows, single) if x], self._all_repeating)):
            if few:
                yield from compare(few, np.concatenate([r[4] for r in few]), np.array([r[5] for r in few]))

    def _all_plain(self, rows: list[tuple], back: np.ndarray, spans: np.ndarray):
        """Of pairs without repeated tokens. ``back``: what the tokens of the other are in the one, or -1."""
        sizes = np.column_stack([spans[:, 1] - spans[:, 0] + 1, spans[:, 3] - spans[:, 2] + 1])
        pair, ends = np.repeat(np.arange(len(rows)), sizes[:, 1]), np.cumsum(sizes[:, 1])
        for k, (_, a, code, _, own, (a_from, a_to, _, _)) in enumerate(rows):
            if a.before is not None:
                # Each token is once in the stretch, but not at its first place.
                places = np.full(len(code) + 1, -1)
                places[code[a_from : a_to + 1]] = np.arange(a_from, a_to + 1)
                back[ends[k] - len(own) : ends[k]] = places[own]
        back = back - np.repeat(spans[:, 0].astype(np.int32), sizes[:, 1])
        hit = np.flatnonzero((back >= 0) & (back < np.repeat(sizes[:, 0].astype(np.int32), sizes[:, 1])))
        of, at = pair[hit], back[hit].astype(np.int64)
        there = hit - (ends - sizes[:, 1])[of]
        n = np.bincount(of, minlength=len(rows))
        last = np.cumsum(n)
        within, step = of[1:] == of[:-1], np.diff(at)
        falls = np.bincount(of[1:][within & (step <= 0)], minlength=len(rows)) > 0
        cuts = np.bincount(of[1:][within & ((step > _GAP) | (np.abs(np.diff(there) - step) > _GAP))], minlength=len(rows)) > 0
        for k in np.flatnonzero(n >= self.least).tolist():
            here = slice(last[k] - n[k], last[k])
            if not falls[k] and not cuts[k]:
                a_first, a_last, b_first, b_last, common = int(at[here][0]), int(at[here][-1]), int(there[here][0]), int(there[here][-1]), int(n[k])
                whole = common / (a_last - a_first + b_last - b_first + 2 - common)
                if whole >= self.similarity and min(a_last - a_first, b_last - b_first) + 1 >= self.width:
                    yield rows[k][0], [(a_first, a_last, b_first, b_last, whole)]
                    continue
            if found := self._plain(at[here], there[here], tuple(sizes[k].tolist()), not falls[k]):
                yield rows[k][0], found

    def _least(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many own tokens the part of the width from each place on has, and the least of that of each stretch."""
        total, ends = np.zeros(len(own) + 1, np.int32), np.cumsum(sizes)
        np.cumsum(own, out=total[1:])
        low = np.append(total[self.width :] - total[: -self.width], 0)
        return low, np.minimum.reduceat(low, np.column_stack([ends - sizes, ends - self.width + 1]).ravel())[::2]

    def _all_repeating(self, rows: list[tuple], back: np.ndarray, spans: np.ndarray):
        """Of pairs with repeated tokens. Similar parts have few different tokens of their own, for as many as are common; what
        stands outside the stretch of the one counts as common here."""
        sizes, wide = spans[:, 3] - spans[:, 2] + 1, np.array([len(r[2]) for r in rows])
        ends, stands = np.cumsum(sizes), np.cumsum(wide) - wide
        hit, shared = back >= 0, np.zeros(int(wide.sum()), bool)
        shared[back[hit] + np.repeat(stands, sizes)[hit]] = True
        common = np.add.reduceat(shared, stands, dtype=np.int64)
        most = (common * self.spare).astype(np.int64)
        # Own tokens that are the first of their kind in any part of that width; where none may be own, all of them.
        far = np.concatenate([r[3].apart(self.width)[r[5][2] : r[5][3] + 1] if m else np.ones(n, bool) for r, m, n in zip(rows, most.tolist(), sizes.tolist())])
        low_b, own = self._least(~hit & far, sizes)
        left = np.flatnonzero((common > 0) & (own <= most)).tolist()
        if not left:
            return
        alone = [~shared[stands[k] : stands[k] + wide[k]][rows[k][2]] & (rows[k][1].apart(self.width) | (most[k] == 0)) for k in left]
        low_a, own_a = self._least(np.concatenate(alone), wide[left])
        for k, n, stand in zip(left, own_a.tolist(), (np.cumsum(wide[left]) - wide[left]).tolist()):
            if own[k] + n <= most[k]:
                here = slice(ends[k] - sizes[k], ends[k])
                low = low_a[stand + rows[k][5][0] : stand + rows[k][5][1] + 2 - self.width], low_b[here], most[k]
                if found := self._repeating(*rows[k][1:4], back[here], *rows[k][5], low):
                    yield rows[k][0], found

    def _plain(self, at: np.ndarray, there: np.ndarray, sizes: tuple[int, int], growing: bool) -> list[tuple[int, int, int, int, float]]:
        """Where no token repeats, each match is of the only two places of its token."""
        if not growing:
            order = np.argsort(at)
            at, there = at[order], there[order]

        def score(low: int, high: int, begin: int, end: int) -> float:
            common = int(np.count_nonzero((at >= low) & (at <= high) & (there >= begin) & (there <= end)))
            return common / (high - low + end - begin + 2 - common)

        cuts = np.count_nonzero((np.diff(at) > _GAP) | (np.abs(np.diff(there - at)) > _GAP))
        if growing and cuts:
            # As in ``_runs``, for all chains.
            i, j = _longest(_blocks(at, there), self.similarity)
            if j < i or at[j] - at[i] + 1 < self.least:
                return []
        chains = _chains(at, there) if cuts else [(at, there)]
        return _passages(chains, score, sizes, self.width, self.similarity, len(at) if growing and len(chains) == cuts + 1 else 0)

    def _repeating(self, a: _Side, code: np.ndarray, b: _Side, back: np.ndarray, a_from: int, a_to: int, b_from: int, b_to: int, low: tuple):
        """Of one pair with repeated tokens. ``low``: how many own tokens the parts from each place on have, on either side, and
        how many similar ones may have."""
        left, n = code[a_from : a_to + 1].astype(np.int64), len(code)
        if len(left) < n:
            inside = np.zeros(n + 1, bool)
            inside[left] = True
            back = np.where(inside[back], back, -1)
        back = back.astype(np.int64)

        def score(low: int, high: int, begin: int, end: int) -> float:
            held, other = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            held[left[low : high + 1]] = True
            other[back[begin : end + 1]] = True
            common = int(np.count_nonzero(held[:-1] & other[:-1]))
            both = a.different(a_from + low, a_from + high) + b.different(b_from + begin, b_from + end)
            return common / (both - common)

        at, there = _matches(left, back, n)
        chains, around = [], self.width - 1
        for x, y in _chains(at, there) if len(at) else []:
            # A passage has a part of the width that begins no earlier and no later.
            own = low[0][max(0, x[0] - around) : x[-1] + 1].min() + low[1][max(0, y.min() - around) : y.max() + 1].min()
            if own <= low[2]:
                chains.append((x, y))
        return _passages(chains, score, (len(left), len(back)), self.width, self.similarity)


_FOUND = "doc_id long, start_word long, n_words long, other_id long, other_start long, other_words long, similarity double"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
# A hash of the tokens where both sides have the same.
_VERIFIED = _FOUND + ", copy long"


def _verify(width: int, similarity: float):
    """From (part, doc, begin, tokens) of the documents of a part, in order, and before them its pairs, their near-duplicate
    passages."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, held in _grouped(batches, 1):
            first = held[0].slice(0, 1).to_pylist()[0]
            pairs = np.frombuffer(first["pairs"], np.int32).reshape(-1, 6)
            held[0] = held[0].slice(1)
            docs, begins = (np.concatenate([h.column(i).to_numpy() for h in held if h.num_rows]) for i in (1, 2))
            tokens = [np.frombuffer(t, np.uint32) for h in held for t in h.column(3).to_pylist()]
            sizes = np.array([len(t) for t in tokens])
            _, numbers = np.unique(np.concatenate(tokens), return_inverse=True)
            n = int(numbers.max()) + 1
            by_doc = np.sort(np.repeat(np.arange(len(docs)), sizes) * n + numbers)
            repeats = np.zeros(len(docs), bool)
            repeats[by_doc[1:][by_doc[1:] == by_doc[:-1]] // n] = True
            sides = [_Side(x, r) for x, r in zip(np.split(numbers, np.cumsum(sizes)[:-1]), repeats.tolist())]
            compare, names, starts = _Pairs(n, width, similarity), docs.tolist(), begins.tolist()
            pairs = np.column_stack([pairs[:, :2], pairs[:, 2:] - np.repeat(begins[pairs[:, :2]], 2, axis=1)])
            for k, found in compare.passages(sides, pairs):
                a, b = pairs[k, :2].tolist()
                for low, high, begin, end, score in found:
                    low, high, begin, end, copy = low + pairs[k, 2], high + pairs[k, 2], begin + pairs[k, 4], end + pairs[k, 4], None
                    if score == 1 and (same := tokens[a][low : high + 1].tobytes()) == tokens[b][begin : end + 1].tobytes():
                        copy = xxhash.xxh3_64_intdigest(same) - (1 << 63)
                    rows.append((
                        names[b], starts[b] + begin, end - begin + SHINGLE, names[a], starts[a] + low, high - low + SHINGLE, score, copy,
                    ))
                if len(rows) > 50_000:
                    yield _found_rows(rows)
                    rows = []
        yield _found_rows(rows)

    return run


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_FOUND_NAMES, "copy"])


def _copies_as_stars(verified: DataFrame) -> DataFrame:
    """The rows, in which those of equal passages are one for each place with the first that has the passage, and one
    with the place before: as many as places, where all to all would be their square."""
    copies = verified.filter("copy is not null")
    places = copies.select("copy", F.col("doc_id").alias("doc"), F.col("start_word").alias("at"), F.col("n_words").alias("n")).union(
        copies.select("copy", "other_id", "other_start", "other_words")
    ).distinct()
    by_copy = Window.partitionBy("copy").orderBy("doc", "at")
    place = F.struct("doc", "at")
    linked = places.withColumn("others", F.array_distinct(F.array(F.first(place).over(by_copy), F.lag(place).over(by_copy))))
    linked = linked.select("doc", "at", "n", F.explode("others").alias("other")).filter("other.doc != doc")
    stars = linked.select(
        F.col("doc").alias("doc_id"), F.col("at").alias("start_word"), F.col("n").alias("n_words"), F.col("other.doc").alias("other_id"),
        F.col("other.at").alias("other_start"), F.col("n").alias("other_words"), F.lit(1.0).alias("similarity"),
    )
    return verified.filter("copy is null").drop("copy").union(stars)


def near_passages(
    docs: DataFrame, words: int = LEAST_WORDS, similarity: float = SIMILARITY, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, start_word, n_words, other_id, other_start, other_words, similarity): passages of at least ``words``
    words of different documents whose sets of five-word shingles have a Jaccard similarity of at least ``similarity``.

    Of many documents with the very same passage each is named with the first and with the one before, not all with all;
    passages that differ are set against each other all to all. Null, empty and short texts have no passages. Each row is a
    document: of rows with one id, or without one, each is set against the others under that id. Ids are whole numbers;
    other columns are not read. No rows give none.
    """
    width = words - SHINGLE + 1
    rows = numbered(docs, id_column, text)
    plain = rows.select("doc", "text")
    cut = stage(plain.mapInArrow(_slice, _SLICES), "slices")
    by_part = cut.mapInArrow(_held, _HELD).repartition("part").sortWithinPartitions("part")
    marks = by_part.mapInArrow(_mark, _MARKED).select("slice", "part", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "sizes", "packed")], "marks")
    marked = cut.union(marks).repartition("slice").sortWithinPartitions("slice", "part")
    windows = marked.mapInArrow(_marked_windows(width, similarity), _WINDOWS)
    dealt = windows.repartition("value").sortWithinPartitions("value")
    # About half as many cells as slices of texts, so that a cell grows only as the pairs of a document do.
    lots = max(LOTS, math.ceil(math.sqrt(cut.count())))
    links = stage(dealt.mapInArrow(lambda batches: _link(batches, lots), _LINKS), "links")
    remove_staged(cut)
    by_cell = links.select(F.col("place").alias("cell"), *_LINK_NAMES[1:]).repartition("cell").sortWithinPartitions("cell")
    pairs = stage(by_cell.mapInArrow(lambda batches: _join_intervals(_link_cells(batches, lots)), _PAIRS), "pairs")
    remove_staged(links)
    wanted = pairs.select("part", "docs", "spans").mapInArrow(_wanted, _WANTED)
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("part", "begin", "end")).alias("wanted"))
    fetched = packed_texts(plain).join(wanted, "doc").select("doc", "packed", "wanted").mapInArrow(_fetch, _SIDES)
    fetched = fetched.withColumn("pairs", F.lit(None).cast("binary"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc", "long"), ("begin", "int"), ("tokens", "binary"))]
    ordered = fetched.union(pairs.select("part", *nothing, "pairs")).repartition("part")
    ordered = ordered.sortWithinPartitions("part", F.col("doc").asc_nulls_first())
    found = _copies_as_stars(stage(ordered.mapInArrow(_verify(width, similarity), _VERIFIED), "verified"))
    return _with_ids(found, rows.select("doc", "doc_id"))


def _with_ids(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with the documents' ids instead of their numbers."""
    for column in ("doc_id", "other_id"):
        named = ids.select(F.col("doc").alias("__doc"), F.col("doc_id").alias("__id"))
        found = found.join(named, F.col(column) == F.col("__doc")).withColumn(column, F.col("__id")).drop("__doc", "__id")
    return found.select(*_FOUND_NAMES)
