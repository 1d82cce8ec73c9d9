"""Which tokens of two tokenizers lie over the same bytes (operator 12).

Byte-level ids (A) and pieces (B) of one text tile its bytes. A sparse matrix holds which token covers which byte; the
product of one with the other's transpose links tokens that overlap, and where no link crosses, both end: there the text
falls into groups. The product of the group matrices links all tokens of a group.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.tokens import _bytes_of_characters, ranked, tokenizer_path
from logwarden.session import stored

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts are linked in chunks of so many bytes; a chunk asks for the count of each of its id pairs once.
CHUNK = 8 << 20
#: Segments whose links are worked out together, and terms of a product of matrices at a time.
SEGMENTS, TERMS = 1 << 14, 1 << 19
SPACE = "▁"
_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def segments(text: str) -> list[str]:
    """The text with a space in front, cut before each space or line end that follows something else.

    Neither tokenizer has a token that goes on from another character into a space or line end, so the ids of a text
    are those of its segments one after another.
    """
    text = " " + text
    if _TWO_SPACES.search(text):
        return _CUT.split(text)
    parts = text.replace("\n", " \n").split(" ")
    return [p if p[:1] == "\n" else " " + p for p in parts[1:]]


class Pair:
    """Both tokenizers. ``ids(segment)``: A's ids, B's ids and their tokens' byte lengths; None where B loses bytes."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        encoding = ranked(bytes_path)
        self.a = encoding._core_bpe.encode_ordinary
        self.a_length = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in names):
            raise ValueError(f"pieces of {pieces_path} cross from a character into a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.b_length = np.array([len(b) for b in self.b_bytes])
        self.start = self.pieces.encode("\n")

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int] | None]]:
        cut, token = len(self.start), self.b_bytes
        b = [x[cut:] for x in self.pieces.encode(["\n" + t for t in texts], num_threads=1)]
        kept = [x if b"".join([token[i] for i in x]) == t.encode() else None for x, t in zip(b, texts, strict=True)]
        return [self.a(t) for t in texts], kept


@functools.lru_cache(maxsize=2)
def _pair(bytes_path: str, pieces_path: str) -> Pair:
    here = [p if os.path.exists(p) else tokenizer_path(os.path.basename(p)) for p in (bytes_path, pieces_path)]
    return Pair(*here)


class Csr:
    """A sparse matrix by rows: row i has columns[at[i]:at[i + 1]] with values there."""

    def __init__(self, at: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.at, self.columns, self.values, self.width = at, columns, values, width

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """Ones at (row, column), added up where they repeat."""
        keys, n = np.unique(rows * np.int64(width) + columns, return_counts=True)
        return cls(np.searchsorted(keys, np.arange(height + 1, dtype=np.int64) * width), keys % max(width, 1), n, width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        by = np.argsort(self.columns, kind="stable")
        return Csr(np.searchsorted(self.columns[by], np.arange(self.width + 1)), rows[by], self.values[by], len(self.at) - 1)

    def times(self, other: Csr, terms: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of the product, Gustavson's way: a row adds up the rows of ``other`` that its columns name.

        Blocks of rows with at most ``terms`` terms (or one row) are worked out together.
        """
        length = np.diff(other.at)[self.columns]
        upto = np.append(0, np.cumsum(length))[self.at]
        lo, height = 0, len(self.at) - 1
        while lo < height:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + terms, side="right")) - 1)
            part = slice(self.at[lo], self.at[hi])
            n = length[part]
            rows = np.repeat(np.repeat(np.arange(lo, hi), np.diff(self.at[lo : hi + 1])), n)
            total = int(n.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(other.at[self.columns[part]], n) + inside
            values = np.repeat(self.values[part], n) * other.values[of]
            keys = rows * np.int64(other.width) + other.columns[of]
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if total else np.zeros(0, dtype=np.int64)
            added = np.add.reduceat(values[by], first) if total else values
            yield keys[first] // other.width, keys[first] % other.width, added
            lo = hi


def _tiles(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token covers the next ``lengths`` bytes."""
    at = np.append(0, np.cumsum(lengths))
    return Csr(at, np.arange(at[-1]), np.ones(at[-1], dtype=np.int64), int(at[-1]))


class Linked:
    """The links of many segments at once: matrices with a block for each segment.

    ``a`` and ``b`` are the ids of all segments in a row, ``a_of`` and ``b_of`` the segment of each, ``a_group`` and
    ``b_group`` its group (numbered over all segments), ``overlaps`` the pairs of tokens with a byte in common.
    """

    def __init__(self, pair: Pair, a: list[list[int]], b: list[list[int]]):
        self.size = len(a)
        self.a = np.fromiter((i for x in a for i in x), dtype=np.int64)
        self.b = np.fromiter((i for x in b for i in x), dtype=np.int64)
        self.a_of = np.repeat(np.arange(len(a)), [len(x) for x in a])
        self.b_of = np.repeat(np.arange(len(b)), [len(x) for x in b])
        covers, covered = _tiles(pair.a_length[self.a]), _tiles(pair.b_length[self.b]).transposed()
        found = list(covers.times(covered))
        at, to, shared = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
        self.overlaps = at, to, shared
        # a group begins at a token of A that shares no token of B with the one before it
        first, last = np.searchsorted(at, np.arange(len(self.a))), np.searchsorted(at, np.arange(len(self.a)), side="right") - 1
        new = np.append(True, to[first[1:]] != to[last[:-1]]) if len(self.a) else np.zeros(0, dtype=bool)
        self.a_group = np.cumsum(new) - 1
        self.b_group = self.a_group[at[np.searchsorted(to, np.arange(len(self.b)))]] if len(self.b) else self.a_group
        self.groups = int(new.sum())
        self.group_of = self.a_of[new]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, A id, B id, links): products of group matrices, in which a row is an id of a segment."""
        a_rows, a_row = np.unique(self.a_of << 32 | self.a, return_inverse=True)
        b_rows, b_row = np.unique(self.b_of << 32 | self.b, return_inverse=True)
        left = Csr.of(a_row, self.a_group, len(a_rows), self.groups)
        right = Csr.of(b_row, self.b_group, len(b_rows), self.groups).transposed()
        for at, to, n in left.times(right):
            yield a_rows[at] >> 32, a_rows[at] & 0xFFFFFFFF, b_rows[to] & 0xFFFFFFFF, n

    def texts(self) -> list[str]:
        """Each segment's groups: ``a1,a2|b1;a3|b2,b3``."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        ends = [np.searchsorted(g, np.arange(self.groups), side="right").tolist() for g in (self.a_group, self.b_group)]
        out: list[list[str]] = [[] for _ in range(self.size)]
        x = y = 0
        for of, p, q in zip(self.group_of.tolist(), *ends, strict=True):
            out[of].append(f"{','.join(a[x:p])}|{','.join(b[y:q])}")
            x, y = p, q
        return [";".join(g) for g in out]


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
#: Columns of a chunk's rows that are lists: a document's segments, then those of the chunk's own row.
_LISTS = {"segments": pa.int32(), "sizes": pa.int32(), "pairs": pa.int32(), "links": pa.int64(), "a": pa.int32(), "b": pa.int32(), "docs": pa.int32()}


def _lists(name: str, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, _LISTS[name]))


def _chunk(pair: Pair, number: int, ids: pa.Array, texts: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A chunk's documents with their segments, then its segments and id pairs."""
    known: dict[str, int] = {}
    of: list[int] = []
    ends: list[int] = []
    for text in texts:
        of += [known.setdefault(s, len(known)) for s in (segments(text) if text else ())]
        ends.append(len(of))
    part, ends = np.array(of, dtype=np.int32), np.array(ends)
    names, width = list(known), max(len(known), 1)
    del known, of
    lost, written = np.zeros(width, dtype=bool), []
    sums = np.zeros((len(_SUMS), width), dtype=np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(names), SEGMENTS):
        a, b = pair.ids(names[lo : lo + SEGMENTS])
        some = slice(lo, lo + len(a))
        lost[some] = [x is None for x in b]
        linked = Linked(pair, [[] if x is None else y for x, y in zip(b, a, strict=True)], [x or [] for x in b])
        mine = [(at + lo, x << 32 | y, n) for at, x, y, n in linked.links()]
        n_links = [np.bincount(at - lo, n, len(a)) for at, _, n in mine]
        counts = (linked.a_of, linked.b_of, linked.group_of)
        sums[:3, some] = [np.bincount(x, minlength=len(a)) for x in counts]
        sums[3, some] = np.sum(n_links, axis=0) if n_links else 0
        sums[4, some] = np.bincount(linked.a_of[linked.overlaps[0]], minlength=len(a))
        written += [t.encode() for t in linked.texts()]
        found += mine
    segment, both, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    del names, found
    pairs, pair_at = np.unique(both, return_inverse=True)
    by = np.argsort(segment, kind="stable")
    segment, pair_at, n = segment[by].astype(np.int32), pair_at[by].astype(np.int32), n[by]
    del both, by
    # documents in which B loses bytes have no tokens
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
    bad = np.zeros(len(texts), dtype=bool)
    bad[doc[lost[part]]] = True
    stay = ~bad[doc]
    part, doc = part[stay], doc[stay]
    ends = np.searchsorted(doc, np.arange(len(texts)), side="right")
    # how many of the chunk's documents hold each id pair
    once = np.unique(doc * np.int64(width) + part)
    of_doc, of_part = once // width, once % width
    at = np.searchsorted(segment, np.arange(width + 1))
    size = np.diff(at)[of_part]
    doc_at = np.searchsorted(of_doc, np.arange(len(texts) + 1))
    upto, docs, lo = np.append(0, np.cumsum(size))[doc_at], np.zeros(len(pairs), dtype=np.int64), 0
    while lo < len(texts) and len(pairs):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TERMS, side="right")) - 1)
        some = slice(doc_at[lo], doc_at[hi])
        inside = np.arange(int(upto[hi] - upto[lo])) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        held = pair_at[np.repeat(at[of_part[some]], size[some]) + inside]
        keys = np.unique(np.repeat(of_doc[some], size[some]) * np.int64(len(pairs)) + held)
        docs += np.bincount(keys % len(pairs), minlength=len(pairs))
        lo = hi
    digests, whole = [], [written[p] for p in part.tolist()]
    for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        digests.append(hashlib.sha256(b";".join(whole[s:e])).hexdigest() if e > s else "")
    rows = len(texts)
    totals = [pa.array(np.bincount(doc, s[part], minlength=rows).astype(np.int64)) for s in sums]
    chunk = pa.array(np.full(rows, number, dtype=np.int64))
    arrays = [chunk, ids, *totals, pa.array(digests), _lists("segments", part, ends)]
    for at_row in range(0, rows, 1024):
        some = [x.slice(at_row, 1024) for x in arrays]
        yield pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(some[0]), f.type) for f in schema][len(some) :]], schema=schema)
    if not len(pairs):
        return
    own = (np.diff(at), pair_at, n, pairs >> 32, pairs & 0xFFFFFFFF, docs)
    lists = [_lists(name, x, np.array([len(x)])) for name, x in zip(list(_LISTS)[1:], own, strict=True)]
    nulls = [pa.nulls(1, f.type) for f in schema][1 : len(arrays)]
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *nulls, *lists], schema=schema)


def linked_chunks(docs: DataFrame, chunk: int = CHUNK, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """Documents and, chunk by chunk, their segments and id pairs; written down.

    A document's row has its counts, the digest of its groups and its segments, by number in its chunk. A chunk's own
    row (no digest) has each segment's number of id pairs, these pairs (by number) with their links, and the pairs'
    A ids, B ids and documents of the chunk that hold them.
    """
    paths = bytes_path or tokenizer_path(BYTES), pieces_path or tokenizer_path(PIECES)
    kind = docs.schema["doc_id"].dataType
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, schema = _pair(*paths), None
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            if schema is None:
                fields = [("chunk", pa.int64()), ("doc_id", batch.column("doc_id").type), *[(s, pa.int64()) for s in _SUMS], ("groups_sha256", pa.string())]
                schema = pa.schema([*fields, *[(x, pa.list_(k)) for x, k in _LISTS.items()]])
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids.append(batch.column("doc_id").slice(i, 1))
                texts.append(text or "")
                held += len(texts[-1]) + 32
                if held >= chunk:
                    yield from _chunk(pair, number, pa.concat_arrays(ids), texts, schema)
                    number, ids, texts, held = number + 1, [], [], 0
        if texts:
            yield from _chunk(pair, number, pa.concat_arrays(ids), texts, schema)

    columns = f"chunk bigint, doc_id {kind.simpleString()}, {', '.join(f'{s} bigint' for s in _SUMS)}, groups_sha256 string"
    lists = ", ".join(f"{x} array<{'bigint' if k == pa.int64() else 'int'}>" for x, k in _LISTS.items())
    rows = docs.select("doc_id", "text").mapInArrow(link, f"{columns}, {lists}")
    return stored(rows, "linked")


def counted_pairs(chunks: DataFrame) -> DataFrame:
    """chunk, at, pair, n, best: for each id pair of a chunk the documents of the corpus that hold it, and whether no
    other pair of its A id is held by more.

    One shuffle of a row per chunk and pair; what is joined by broadcast is one row for each id of the vocabulary.
    """
    asked = chunks.where("groups_sha256 is null").select(
        "chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "x")
    ).select("chunk", "at", (F.shiftleft(F.col("x.a").cast("bigint"), 32) + F.col("x.b")).alias("pair"), F.col("x.docs").cast("bigint").alias("docs"))
    counted = asked.repartition("pair").withColumn("n", F.sum("docs").over(Window.partitionBy("pair"))).drop("docs")
    a = F.shiftright("pair", 32)
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), a == F.col("a")).select("chunk", "at", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _totals(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    own = left.column("groups_sha256").is_null()
    rows, segments = left.filter(pc.invert(own)), left.filter(own)
    count = best = np.zeros(1, dtype=np.int64)
    if segments.num_rows:
        at, n = right.column("at").to_numpy(), np.zeros(right.num_rows + 1, dtype=np.int64)
        top = n.copy()
        n[at], top[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        size, pairs, links = (segments.column(c).combine_chunks().flatten().to_numpy() for c in ("sizes", "pairs", "links"))
        ends = np.append(0, np.cumsum(size))
        count = np.append(0, np.cumsum(n[pairs] * links))
        best = np.append(0, np.cumsum(top[pairs] * links))
        count, best = np.diff(count[ends]), np.diff(best[ends])
    parts = rows.column("segments").combine_chunks()
    flat = parts.flatten().to_numpy()
    ends = np.append(0, np.cumsum(parts.value_lengths().to_numpy()))
    out = rows.select(["doc_id", *_SUMS, "groups_sha256"])
    for name, x in (("n_best", best), ("count_sum", count)):
        upto = np.append(0, np.cumsum(x[flat])) if len(flat) else np.zeros(1, dtype=np.int64)
        out = out.append_column(name, pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()))
    return out


def aligned(docs: DataFrame, chunk: int = CHUNK, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum for every row of ``docs`` (doc_id, text).

    A's tokens are byte-level ids of the text with a space in front, B's are pieces of the text. Offsets at which tokens
    of both end cut the text into groups. ``n_overlaps`` counts pairs of tokens with a byte in common, ``n_links`` pairs
    of tokens of one group. An id pair's count is the number of documents in which it is linked; ``n_best`` counts links
    whose id pair has the highest count of its A id, ``count_sum`` adds up the counts over links.

    Null and empty texts, and texts whose bytes B doesn't give back, have no tokens: zeros and an empty digest. Repeated
    rows count as documents of their own. Special tokens' strings are plain text. Other columns are not looked at; no
    rows give no rows. A long text is a chunk by itself; its task holds its distinct segments and id pairs.

    Texts are read once and not shuffled. Each chunk of documents asks once for each id pair it holds, whatever the
    number of its links, and its answers meet its documents' segment numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = linked_chunks(docs, chunk, bytes_path, pieces_path)
    answers = counted_pairs(chunks).select(F.col("chunk").alias("asked"), "at", "n", "best")
    held = chunks.drop("a", "b", "docs")
    schema = f"doc_id {kind}, {', '.join(f'{s} bigint' for s in _SUMS)}, groups_sha256 string, n_best bigint, count_sum bigint"
    return held.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(_totals, schema)


def overlap_links(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """doc_id, links array<struct<a_at, b_at, a, b, bytes, group>>: each document's overlapping token pairs, in text order.

    ``a_at`` and ``b_at`` number the document's tokens from 0, ``bytes`` is how many bytes they share. Documents without
    tokens have none.
    """
    paths = bytes_path or tokenizer_path(BYTES), pieces_path or tokenizer_path(PIECES)
    item = pa.struct([(n, pa.int64()) for n in ("a_at", "b_at", "a", "b", "bytes", "group")])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                a, b = pair.ids(segments(text)) if text else ([], [])
                if any(x is None for x in b):
                    a = b = []
                linked = Linked(pair, [[y for x in a for y in x]], [[y for x in b for y in x]])
                at, to, n = linked.overlaps
                columns = [at, to, linked.a[at], linked.b[to], n, linked.a_group[at]]
                flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(item))
                links = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), links], ["doc_id", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}`: bigint" for f in item)
    return docs.select("doc_id", "text").mapInArrow(link, f"doc_id {kind}, links array<struct<{fields}>>")
