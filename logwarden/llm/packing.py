"""Packing token sequences by best-fit decreasing (operator 9)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.tokens import Encoder, tokenizer_path
from logwarden.session import stored

WINDOW, END = 2048, 1
#: Pieces packed together in one task; more pieces make more groups, never larger ones.
GROUP = 65_536
VOCABULARY = "byte_bpe_50k.json"


class _Capacities:
    """Open windows by remaining capacity: a segment tree over capacities finds the least that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least capacity of at least ``length``: (capacity, window)."""
        count, i = self.count, self.leaves + length
        if not count[i]:
            while True:  # up to the first right neighbour that holds something
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to ``window``) the number of its window and its offset there; longer ones come first, ties in order."""
    place, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, opened = _Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.tightest(n) if n < window else None
        capacity, at = found or (window, opened)
        opened += found is None
        place[i], offset[i] = at, window - capacity
        if capacity > n:
            tree.add(capacity - n, at)
    return place, offset


def token_pieces(docs: DataFrame, *keep: str, window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """The columns ``keep``, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit): texts cut into windows.

    A document is its text's ids and ``end``; it is cut into whole windows and one shorter rest. Batches of texts become
    batches of pieces, so a very long text is held once and no other rows wait for it.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    file = path or tokenizer_path(VOCABULARY)
    names = [*keep, "start", "length", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = file if os.path.exists(file) else tokenizer_path(os.path.basename(file))
        encoder, last = Encoder(here), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # few at once: pieces are as large as texts
                part = batch.slice(lo, 256)
                rows: list[tuple[int, int, int, int, bytes]] = []
                for i, text in enumerate(part.column("text__").to_pylist()):
                    ids = (encoder.encode(text) if text else b"") + last
                    n = len(ids) // 4
                    rows += [(i, s, min(window, n - s), n, ids[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                index, start, length, tokens, pieces = zip(*rows, strict=True)
                of = [part.column(k).take(pa.array(index)) for k in keep]
                numbers = [pa.array(x, pa.int64()) for x in (start, length, tokens)]
                yield pa.RecordBatch.from_arrays([*of, *numbers, pa.array(pieces, pa.binary())], names)

    schema = f"{kept}, start bigint, length bigint, doc_tokens bigint, ids binary"
    return docs.select(*keep, F.col("text").alias("text__")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``pieces`` (length, any other columns) with sequence_id and offset: windows filled by best-fit decreasing.

    Pieces are dealt at random into groups of about ``group``, each packed by itself in one task: a segment tree over
    remaining capacities gives the tightest open window, longest pieces first. Each group leaves a few windows that are
    not full, so the padding doesn't depend on the number of groups. Offsets are gapless from 0. Pieces are told apart
    by their row, so repeated rows are packed as often as they come. No pieces give no rows.

    Only the rows handed in are shuffled; hand in lengths and keys, not ids.
    """
    pieces = stored(pieces, "pieces")
    groups = -(-max(pieces.count(), 1) // group)
    columns = list(pieces.columns)

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(columns).sort_by([(c, "ascending") for c in columns])
        place, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        place += key[0].as_py() << 32
        return table.append_column("sequence_id", pa.array(place)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("group__", F.pmod(F.xxhash64(F.lit(3), F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("group__").applyInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, window: int = WINDOW, group: int = GROUP, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of every row of ``docs`` (doc_id, text).

    Texts become ids of the vocabulary at ``path`` and an end id; null counts as empty, so it is the end id alone. Other
    columns are not looked at.
    """
    cut = token_pieces(docs, "doc_id", window=window, path=path)
    slim = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(slim, window, group)
