"""Token ids of whole documents packed into rows of fixed length by best-fit decreasing.

Documents are tokenised where they are read and packed in groups of some megabytes of text: a group's pieces are placed
from the longest to the shortest, each into the row with the least room that still holds it. A segment tree over the
possible amounts of room finds that row. Nothing is shuffled; a lost executor repeats its groups.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import map_rows, text_bytes

_PACKED = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<{}>, starts array<long>"
)


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str):
    """The byte-level BPE encoder of a rank file, loaded once per worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Which amounts of room some row has: the smallest one that is at least a given amount, in log(room) steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.some = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.some[at] += 1
            at //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room from ``least`` on, taken out of the tree."""
        at = least + self.size
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.some[at] -= 1
            at //= 2
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; every item, of 1 to ``capacity``, is in one row. Equal lengths go in the order given."""
    tree, rows = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > lengths[item]:
            tree.put(room - lengths[item], row)
    return rows


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, length: int = 2048, end_id: int = 50256,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(pack_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, starts): a row per packed row.

    ``ids`` are ``length`` little-endian numbers, of 16 bits if ``end_id`` and all ids fit, else of 32, filled up with
    ``end_id`` after ``n_tokens``. Segment i is the tokens from cu_seqlens[i] to cu_seqlens[i + 1], those of document
    doc_ids[i] from its token starts[i] on; positions begin again at 0 at each of ``position_resets``. A document's
    tokens end with ``end_id``; one with more than ``length`` is cut into pieces, and all pieces are packed. Null and
    empty texts are the end token alone; rows with equal or null ids are packed one by one; no rows give no rows.
    """
    read = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text).alias("text"))
    made = [-1]

    def rows(part):
        encode = encoder(ranks_path, pattern)
        wide = "<u2" if max(encode.max_token_value, end_id) < 1 << 16 else "<u4"
        tokens = [np.array([*encode.encode_ordinary(r["text"].decode("utf-8", "replace")), end_id], wide) for r in part]
        pieces = [(d, s) for d, t in enumerate(tokens) for s in range(0, len(t), length)]
        held = best_fit_decreasing([min(length, len(tokens[d]) - s) for d, s in pieces], length)
        for packed in held:
            made[0] += 1
            segments = [tokens[pieces[i][0]][pieces[i][1] : pieces[i][1] + length] for i in packed]
            ends = np.cumsum([len(s) for s in segments])
            ids = np.full(length, end_id, wide)
            ids[: ends[-1]] = np.concatenate(segments)
            bounds = [0, *ends.tolist()]
            yield {
                "pack_id": (TaskContext.get().partitionId() << 32) + made[0], "n_tokens": bounds[-1], "ids": ids.tobytes(),
                "cu_seqlens": bounds, "position_resets": bounds[:-1],
                "doc_ids": [part[pieces[i][0]]["doc_id"] for i in packed], "starts": [pieces[i][1] for i in packed],
            }

    return map_rows(read, rows, _PACKED.format(read.schema["doc_id"].dataType.simpleString()))


def write_packed(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)
