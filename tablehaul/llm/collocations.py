"""Phrases that occur more often than their parts would by chance, counted in counting quotient filters.

1. Texts become slices of word numbers with a dictionary each. Slices count hashes of their words into filters
   (``quotients``), cut into ranges of the keys, and a range is merged over all slices. What goes back to a slice is one bit
   for each key it sent: is it frequent in all? Words beyond that bit are counted again as themselves, so a hash that two
   words share adds work but no error, and those that are frequent get ids. All others end a stretch, as punctuation does.
2. Each slice counts its two-word phrases of ids into such filters, whose keys are permuted and not hashed, so the merged
   ranges hold exact counts of exact phrases. One bit for each key goes back again.
3. A longer phrase is counted only where both phrases of one word less, that it begins and ends with, are frequent. So
   each length is one more round, and no count is ever an estimate.

Slices and ranges have a size in bytes, so their number grows with the texts. Between rounds everything is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import remove_staged, slices, stage, text_bytes
from tablehaul.llm.dictionaries import Numbers, slice_numbers, squeezed, unsqueezed
from tablehaul.llm.quotients import Hashes, Layout, counted, decoded, encoded

# Bytes of text in a slice, and of filters in a range.
SLICE = 6 << 20
RANGE = 4 << 20
LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
NO_LANG = "und"
# Turns what ends a piece into full stops, which no word has, and leaves the rest as it is.
_ENDS = bytes(0x2E if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def words_and_ends(text: bytes, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lower case, with ``b"."`` between pieces, in lists that end with a piece where they can."""
    plain = text.lower().translate(_ENDS)
    at = 0
    while at < len(plain):
        end = len(plain)
        if end - at > most:
            end = plain.rfind(b".", at, at + most) + 1 or plain.find(b".", at + most) + 1 or end
        yield plain[at:end].replace(b".", b" . ").split()
        at = end


_TEXTS = "slice long, part string, tokens binary, words binary, counts binary, total long, entries long"
_TEXT_NAMES = [c.split()[0] for c in _TEXTS.split(", ")]


class _Slice:
    """Texts by language as numbers of words, 0 for what ends a piece, and the words in the order of their numbers with
    their counts, so that what only counts words needs no tokens."""

    def __init__(self):
        self.numbers, self.tokens, self.size = {}, {}, 0

    def add(self, part: str, text: bytes) -> Iterator[bool]:
        """Takes a text; says after each piece of it whether the slice is full."""
        numbers = self.numbers
        for words in words_and_ends(text):
            if part not in numbers:
                numbers[part], self.tokens[part] = Numbers({b".": 0}), []
            self.tokens[part] += [numbers[part].of(words), np.zeros(1, np.int32)]
            self.size += 6 * len(words)
            yield self.size > SLICE

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        for part, numbers in self.numbers.items():
            tokens = np.concatenate(self.tokens[part])
            counts = np.bincount(tokens, minlength=len(numbers)).astype(np.int32)
            row = (number, part, squeezed(tokens), packed_words(list(numbers)), squeezed(counts), int(counts[1:].sum(dtype=np.int64)), len(numbers) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=_TEXT_NAMES)
        self.__init__()


def packed_words(words: list[bytes]) -> bytes:
    return squeezed(np.frombuffer(b" ".join(words), np.uint8))


def unpacked_words(held: bytes) -> list[bytes]:
    return unsqueezed(held).tobytes().split(b" ")


def _encode(batches) -> Iterator[pa.RecordBatch]:
    held, names = _Slice(), slice_numbers()
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for full in held.add(lang, text):
                    if full:
                        yield from held.batches(next(names))
    yield from held.batches(next(names))


def _hashes(words: list[bytes], layout: Hashes) -> np.ndarray:
    return layout.keys(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def _word_filters(batches) -> Iterator[pa.RecordBatch]:
    """From (slice, part, bits, cuts, words, counts) the filters of the words' hashes."""
    for batch in batches:
        for part in slices(batch, 1):
            row = part.to_pylist()[0]
            words, layout = unpacked_words(row["words"]), Hashes(row["bits"])
            counts = unsqueezed(row["counts"]).astype(np.int64)[1:]
            keys, sums, _ = counted([_hashes(words[1:], layout)], counts)
            name = (row["slice"], row["part"], row["bits"], row["cuts"])
            yield from _in_batches(_filter_rows(name, keys, sums, layout))


_WORDS = "slice long, part string, range long, words binary, counts binary, numbers binary"
_WORD_NAMES = [c.split()[0] for c in _WORDS.split(", ")]
_WORD_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _dealt(words: list[bytes], flags: np.ndarray, layout: Hashes, cuts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the flagged words, by ranges; the ranges; where each begins)."""
    numbers = np.flatnonzero(flags)
    ranges = (_hashes([words[i] for i in numbers], layout) >> np.uint64(layout.width - layout.range_bits(cuts))).astype(np.int64)
    order = np.argsort(ranges, kind="stable")
    found, begin = np.unique(ranges[order], return_index=True)
    return numbers[order], found, begin


def _likely_words(batches) -> Iterator[pa.RecordBatch]:
    """From (slice, part, bits, cuts, words, counts, answers) the words whose hash is frequent, with their counts, by
    ranges, and the numbers of these words in the same order."""
    for batch in batches:
        for part in slices(batch, 1):
            row = part.to_pylist()[0]
            words, layout = unpacked_words(row["words"]), Hashes(row["bits"])
            counts = unsqueezed(row["counts"]).astype(np.int64)
            keys, _, place = counted([_hashes(words[1:], layout)])
            flags = np.append(False, _answered(row["answers"], keys, layout, row["cuts"])[place].astype(bool))
            numbers, ranges, begin = _dealt(words, flags, layout, row["cuts"])
            rows = [(row["slice"], row["part"], None, None, None, squeezed(numbers.astype(np.int32)))]
            for r, own in zip(ranges.tolist(), np.split(numbers, begin[1:])):
                rows.append((row["slice"], row["part"], r, packed_words([words[i] for i in own]), squeezed(counts[own]), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _WORD_KINDS)], names=_WORD_NAMES)


_KNOWN = "part string, word string, id long, f long, slice long, range long, ids binary"
_KNOWN_NAMES = [c.split()[0] for c in _KNOWN.split(", ")]
_KNOWN_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _number_words(least: int):
    """From (part, range, slice, cuts, words, counts), in this order, the frequent words with an id each, and for each slice
    the ids of what it sent, 0 for a word that is not frequent. Ranges take turns, so the ids are almost without gaps."""

    def answer(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, range_ = key
        held = [unpacked_words(r[2]) for r in rows]
        coded = pa.array([w for words in held for w in words], pa.binary()).dictionary_encode()
        sums = np.bincount(coded.indices.to_numpy(), np.concatenate([unsqueezed(r[3]) for r in rows])).astype(np.int64)
        often = sums >= least
        ids = np.where(often, range_ + ((np.cumsum(often) - 1) << rows[0][1]) + 1, 0)
        sent = np.split(ids[coded.indices.to_numpy()], np.cumsum([len(w) for w in held])[:-1])
        n, m = int(often.sum()), len(rows)
        words = coded.dictionary.filter(pa.array(often)).cast(pa.string())
        for columns in (
            ([part] * n, words, ids[often], sums[often], pa.nulls(n), pa.nulls(n), pa.nulls(n)),
            ([part] * m, pa.nulls(m), pa.nulls(m), pa.nulls(m), [r[0] for r in rows], [range_] * m, [squeezed(s) for s in sent]),
        ):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.StringArray) else pa.array(c, k) if not isinstance(c, pa.NullArray) else c.cast(k) for c, k in zip(columns, _KNOWN_KINDS)], names=_KNOWN_NAMES)

    return _by_group(answer, 6)


_ROUND = "slice long, part string, bits int, cuts int, range long, filter binary, tokens binary, held binary"
_ROUND_NAMES = [c.split()[0] for c in _ROUND.split(", ")]
_ROUND_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _round_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ROUND_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ROUND_KINDS)], names=_ROUND_NAMES)


def _phrase_keys(tokens: np.ndarray, at: np.ndarray, layout: Layout, length: int) -> list[np.ndarray]:
    return layout.keys([tokens[at + j] for j in range(length)])


def _ranges(keys: list[np.ndarray], layout: Layout, cuts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers of the ranges that sorted keys fall into, where each begins, bits of a head that are left)."""
    left = layout.width - layout.range_bits(cuts)
    number, begin = np.unique(keys[0] >> np.uint64(left), return_index=True)
    return number.astype(np.int64), begin, left


def _filters(name: tuple, tokens: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple]:
    """The rows of a slice's filters of the phrases that begin at ``at``."""
    layout = Layout(length, name[2])
    keys, counts, _ = counted(_phrase_keys(tokens, at, layout, length))
    yield from _filter_rows(name, keys, counts, layout)


def _filter_rows(name: tuple, keys: list[np.ndarray], counts: np.ndarray, layout: Layout | Hashes) -> Iterator[tuple]:
    slice_, part, bits, cuts = name
    if not len(counts):
        return
    number, begin, left = _ranges(keys, layout, cuts)
    rest = keys[0] & ((np.uint64(1) << np.uint64(left)) - np.uint64(1))
    for r, a, b in zip(number.tolist(), begin.tolist(), [*begin[1:].tolist(), len(counts)]):
        held = encoded([rest[a:b], *(k[a:b] for k in keys[1:])], counts[a:b], left, layout.tails)
        yield slice_, part, bits, cuts, r, held, None, None


def _answered(answers: list[dict], keys: list[np.ndarray], layout: Layout | Hashes, cuts: int) -> np.ndarray:
    """The bits that came back for sorted keys."""
    _, begin, _ = _ranges(keys, layout, cuts)
    sizes = np.diff(np.append(begin, len(keys[0])))
    held = sorted(answers, key=lambda a: a["range"])
    bits = [np.unpackbits(np.frombuffer(a["frequent"], np.uint8), count=n) for a, n in zip(held, sizes)]
    return np.concatenate(bits) if bits else np.zeros(0, np.uint8)


def _pairs(batches) -> Iterator[pa.RecordBatch]:
    """From (slice, part, bits, cuts, tokens, entries, numbers, answers: range and ids): the ids of the slice's words one
    after the other, and the filters of two words."""
    for batch in batches:
        for part in slices(batch, 1):
            row = part.to_pylist()[0]
            ids = np.zeros(row["entries"] + 1, "<u4" if row["bits"] <= 32 else "<u8")
            ids[unsqueezed(row["numbers"])] = np.concatenate([unsqueezed(a["ids"]) for a in sorted(row["answers"], key=lambda a: a["range"])])
            tokens = ids[unsqueezed(row["tokens"])]
            name = (row["slice"], row["part"], row["bits"], row["cuts"])
            yield _round_rows([(*name, None, None, squeezed(tokens), None)])
            yield from _in_batches(_filters(name, tokens, _starts(tokens), 2))


def _starts(tokens: np.ndarray) -> np.ndarray:
    """Where two words in a row begin."""
    return np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))


def _in_batches(rows: Iterator[tuple], size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _round_rows(held)
            held = []
    if held:
        yield _round_rows(held)


def _longer(length: int, last: bool):
    """From (slice, part, bits, cuts, tokens, held, answers: range and frequent) of phrases of one word less the filters of
    ``length`` words, and unless these are the last ones the tokens that they need. ``held`` has a bit for each place where
    a phrase begins that is counted; of two words, all are."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row = part.to_pylist()[0]
                tokens = unsqueezed(row["tokens"])
                name = (row["slice"], row["part"], row["bits"], row["cuts"])
                if row["held"] is None:
                    at = _starts(tokens)
                else:
                    at = np.flatnonzero(np.unpackbits(unsqueezed(row["held"]), count=len(tokens)))
                layout = Layout(length - 1, row["bits"])
                keys, _, place = counted(_phrase_keys(tokens, at, layout, length - 1))
                flags = np.zeros(len(tokens), np.uint8)
                flags[at] = _answered(row["answers"], keys, layout, row["cuts"])[place]
                at = _both(flags)
                if len(at):
                    tokens, held = _thinned(tokens, at, length)
                    if not last:
                        yield _round_rows([(*name, None, None, squeezed(tokens), squeezed(np.packbits(held)))])
                    yield from _in_batches(_filters(name, tokens, np.flatnonzero(held), length))

    return run


def _both(flags: np.ndarray) -> np.ndarray:
    """Places that are flagged, as the next one is."""
    return np.flatnonzero(flags[:-1] & flags[1:])


def _thinned(tokens: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the phrases of ``length`` words that begin at ``at``, with one 0 for all that is between two stretches
    of them, and for each whether a phrase begins there."""
    inside, begins = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    for j in range(length):
        inside[at + j] = True
    begins[at] = True
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    return np.where(inside, tokens, tokens.dtype.type(0))[kept], begins[kept]


_MERGED = "part string, words array<long>, f long, slice long, range long, frequent binary"
_MERGED_NAMES = [c.split()[0] for c in _MERGED.split(", ")]
_MERGED_KINDS = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _merge(length: int, least: int):
    """From (part, range, slice, bits, cuts, filter), in this order, the frequent phrases and the answer to each filter. A
    ``length`` of 0 stands for hashes of words, of which there are only answers."""

    def answer(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, range_ = key
        bits, cuts = rows[0][1:3]
        layout = Layout(length, bits) if length else Hashes(bits)
        left = layout.width - layout.range_bits(cuts)
        held = [decoded(r[3], left, layout.tails) for r in rows]
        keys = [np.concatenate(k) for k in zip(*(k for k, _ in held))]
        merged, sums, place = counted(keys, np.concatenate([c for _, c in held]))
        often = sums >= least
        ends = np.cumsum([len(c) for _, c in held])[:-1]
        flags = [np.packbits(f).tobytes() for f in np.split(often[place], ends)]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            ([part] * n, [None] * n, [None] * n, [r[0] for r in rows], [range_] * n, flags), _MERGED_KINDS)], names=_MERGED_NAMES)
        if not length:
            return
        found = [k[often] for k in merged]
        found[0] = found[0] | np.uint64(range_) << np.uint64(left)
        ids, n = np.stack(layout.ids(found), axis=1).astype(np.int64), int(often.sum())
        words = pa.ListArray.from_arrays(np.arange(0, n * length + 1, length, dtype=np.int32), ids.ravel())
        nulls = [pa.nulls(n, k) for k in _MERGED_KINDS[3:]]
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), words, pa.array(sums[often]), *nulls], names=_MERGED_NAMES)

    return _by_group(answer, 6)


def _by_group(answer, columns: int):
    """Collects the rows of each value of the first two columns, which come one after the other."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
                if row[:2] != key:
                    if held:
                        yield from answer(key, held)
                    key, held = row[:2], []
                held.append(row[2:])
        if held:
            yield from answer(key, held)

    return run


def _merged(rows: DataFrame, length: int, least: int) -> DataFrame:
    """The staged result of merging a round's filters."""
    filters = rows.filter("filter is not null").select("part", "range", "slice", "bits", "cuts", "filter")
    dealt = filters.repartition("part", "range").sortWithinPartitions("part", "range", "slice")
    return stage(dealt.mapInArrow(_merge(length, least), _MERGED), "merged")


def _answers(merged: DataFrame, held: str) -> DataFrame:
    """What goes back to each part of a slice."""
    return merged.filter(F.col(held).isNotNull()).groupBy("slice", "part").agg(F.collect_list(F.struct("range", held)).alias("answers"))


def _cuts(entries: Column, each: int) -> Column:
    """The bits by which keys are cut into ranges, so that filters of so many entries make ranges of some megabytes."""
    ranges = F.floor(entries * each / RANGE)
    return F.when(ranges > 0, F.length(F.bin(ranges))).otherwise(0).cast("int")


def _counts(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequent phrases: part, words, f; frequent words: part, word, id, f; languages: part, n)."""
    coded = stage(docs.mapInArrow(_encode, _TEXTS), "coded")
    # Eight bits more than the words of a language need to be told apart: one in 256 or fewer shares its hash.
    sums = coded.groupBy("part").agg(F.sum("total").alias("n"), F.sum("entries").alias("entries"))
    langs = stage(sums.select(
        "part", "n", F.least(F.length(F.bin("n")) + 8, F.lit(62)).cast("int").alias("hash_bits"), _cuts(F.col("entries"), 4).alias("hash_cuts"),
        _cuts(F.col("n"), 4).alias("cuts"),
    ), "languages")
    hashed = coded.join(langs, "part").select("slice", "part", F.col("hash_bits").alias("bits"), F.col("hash_cuts").alias("cuts"), "words", "counts")
    likely = _merged(hashed.mapInArrow(_word_filters, _ROUND), 0, least)
    asked = hashed.join(_answers(likely, "frequent"), ["slice", "part"]).select("slice", "part", "bits", "cuts", "words", "counts", "answers")
    sent = stage(asked.mapInArrow(_likely_words, _WORDS), "words")
    dealt = sent.filter("words is not null").join(langs.select("part", "hash_cuts"), "part").select("part", "range", "slice", "hash_cuts", "words", "counts")
    dealt = dealt.repartition("part", "range").sortWithinPartitions("part", "range", "slice")
    numbered = stage(dealt.mapInArrow(_number_words(least), _KNOWN), "known")
    known = numbered.filter("word is not null").select("part", "word", "id", "f")
    bits = known.groupBy("part").agg(F.length(F.bin(F.max("id"))).cast("int").alias("bits"))
    # Written, so that its size is known before slices are joined to it: else all of a language would go to one task.
    parts = stage(langs.select("part", "cuts").join(bits, "part"), "parts")
    found = [known.select("part", F.array("id").alias("words"), "f")]

    numbers = sent.filter("numbers is not null").select("slice", "part", "numbers")
    texts = coded.select("slice", "part", "tokens", "entries")
    ready = texts.join(numbers, ["slice", "part"]).join(_answers(numbered, "ids"), ["slice", "part"]).join(parts, "part")
    rows = stage(ready.select("slice", "part", "bits", "cuts", "tokens", "entries", "numbers", "answers").mapInArrow(_pairs, _ROUND), "round")
    for read in (sent, coded, likely):
        remove_staged(read)
    for length in range(2, longest + 1):
        merged = _merged(rows, length, least)
        phrases = merged.filter("words is not null").select("part", "words", "f")
        if phrases.isEmpty():
            break
        found.append(phrases)
        if length < longest:
            state = rows.filter("tokens is not null").select("slice", "part", "bits", "cuts", "tokens", "held")
            state = state.join(_answers(merged, "frequent"), ["slice", "part"])
            made = stage(state.mapInArrow(_longer(length + 1, length + 1 == longest), _ROUND), "round")
            remove_staged(rows)
            rows = made
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.union(more)
    return phrases, known, langs


def _scored(phrases: DataFrame, langs: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut."""
    size = F.size("words")
    cut = phrases.filter(size > 1).select("part", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("part", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    sides = [phrases.select("part", F.col("words").alias(side), F.col("f").alias(name)) for side, name in (("first", "l"), ("rest", "r"))]
    parts = cut.join(sides[0], ["part", "first"]).join(sides[1], ["part", "rest"]).join(langs.select("part", "n"), "part")
    # Products may have up to 38 digits; each of the four counts has fewer than 17.
    a, n, left, right = (F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r"))
    product = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    parts = parts.withColumn("above", product.cast("decimal(38,0)")).withColumn("below", (left * right).cast("decimal(38,0)"))
    least = F.min(F.struct(F.expr("above div below").alias("score"), "k", "a", "l", "r", "n")).alias("cut")
    return parts.groupBy("part", "words").agg(least).select("part", "words", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def _not_inside(scored: DataFrame, share: int) -> DataFrame:
    """Phrases that lie in no longer one that is frequent enough beside them. A phrase around one of two words less holds
    one of a word less around it that is as frequent at least, so phrases of one word more decide."""
    size = F.size("words")
    longer = scored.filter(size > 2).select(
        "part", "a", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words")
    )
    around = longer.groupBy("part", "words").agg(F.max("a").alias("around"))
    return scored.join(around, ["part", "words"], "left").filter(
        F.col("around").isNull() | (100 * F.col("around") < share * F.col("a"))
    ).drop("around")


def _first(df: DataFrame, top: int, order: list[Column], ties: bool) -> DataFrame:
    """The first ``top`` rows of each part, and those tied with the last of them. Salted groups are cut first, whose number
    grows with the root of the rows, as then does what either step sorts in one task."""
    salts = max(1, round((df.count() / top) ** 0.5))
    place = F.rank() if ties else F.row_number()
    salted = df.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(salts)))
    few = salted.withColumn("rank", place.over(Window.partitionBy("part", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", place.over(Window.partitionBy("part").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, their count and phrase.

    Words are what is between spaces and tabs, in lower case as far as A-Z goes; phrases are 2 to ``longest`` of them in a
    row, with none of ``. , ; : ! ?`` or a line end between, that occur ``least`` times or more, overlaps included. Cut
    into two parts, a phrase scores ``floor(1000 * a * n / (l * r))`` of its count, all words of its language, and the
    counts of the parts; the cut that scores lowest counts, the first of equal ones. Phrases inside a longer one with
    ``share`` percent or more of their count are left out. A null text is empty, a null language is ``und``; no rows
    give none; each row counts, also one that repeats another; other columns are not read.
    """
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), text_bytes(text).alias("text"))
    phrases, known, langs = _counts(read, least, longest)
    scored = stage(_scored(phrases, langs), "scored")
    listed = stage(_not_inside(scored, share), "listed")
    few = _first(listed, top, [F.desc("score"), F.desc("a")], True).drop("rank")
    spelt = few.select("part", "words", F.posexplode("words").alias("at", "id")).join(known.select("part", "id", "word"), ["part", "id"])
    spelt = spelt.groupBy("part", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    named = few.join(spelt, ["part", "words"]).withColumn("phrase", F.array_join("spelt.word", " "))
    ranks = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = named.withColumn("rank", F.row_number().over(ranks).cast("long")).filter(F.col("rank") <= top)
    return out.select(F.col("part").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
