"""SimHash fingerprints linked by covering locality-sensitive hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logwarden.llm.common import bounds, by_number, components, utf8, whole_groups
from logwarden.session import gathered, release, stored

SEED = 42
#: A bucket of more fingerprints isn't compared pair by pair.
BUCKET = 48
_BLOCK = 255 * 256


def shingles(data: bytes, words: int) -> Iterator[list[int]]:
    """XXH64 of the text's word shingles, repeats included, in blocks; A-Z is lower-cased, ASCII white space splits."""
    w = data.lower().split()
    if not w:
        return
    h = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(w) < words:
        yield [h(b" ".join(w))]
        return
    for i in range(0, len(w) - words + 1, _BLOCK):
        cut = w[i : i + _BLOCK + words - 1]
        yield [h(b" ".join(s)) for s in zip(*(cut[k:] for k in range(words)), strict=False)]


def fingerprint(data: bytes, words: int) -> int:
    """64 majority bits of the shingles' hashes as a signed number; zero for a text without words."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingles(data, words):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit into a byte
            total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp`` (bigint), one pass over the texts."""
    udf = F.pandas_udf(lambda data: pd.Series([fingerprint(bytes(x), words) for x in data], dtype="int64"), "bigint")
    return docs.select(*keep, udf(utf8("text")).alias("fp"))


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; any ``radius`` bits are all outside at least one of them.

    Bit i carries a non-zero vector of radius+1 bits, mask v has the bits whose vector has an odd product with v. Any
    ``radius`` vectors leave some v orthogonal to all of them: that mask misses all those bits, so two fingerprints that
    differ in no more bits are equal under it.
    """
    top = 1 << (radius + 1)
    order = np.random.default_rng(7).permutation(64)
    vector = [1 + int(order[i]) % (top - 1) for i in range(64)]
    masks = [sum(1 << i for i in range(64) if bin(vector[i] & v).count("1") % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of ``distinct``: at most ``radius`` differing bits, enough to connect all such pairs.

    A bucket is what agrees under one mask. Buckets of up to ``bucket`` fingerprints are compared pair by pair. The
    fingerprints of larger ones are dealt anew by every value up to radius/2 bits away: whatever shares a value is within
    the radius, whatever is within the radius shares one, and each such value has a bounded number of fingerprints, which
    are linked to their smallest. So large buckets give a number of rows linear in their size, and no link is lost.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(covering_masks(radius))]))
    keyed = distinct.select("fp", tables.alias("k")).select("fp", "k.t", "k.key")
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(full, ["t", "key"]), "buckets")
    small = shared.where(F.col("n") <= bucket)
    x, y = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = x.join(y, ["t", "key"]).where((F.col("a") < F.col("b")) & (differing <= radius)).select("a", "b")
    crowd = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(64)} | set(flips))
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    around = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))
    stars = around.select(F.col("fp").alias("b"), least.alias("a")).where("a < b").select("a", "b")
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    Documents link when their fingerprints differ in at most ``radius`` bits (an even number); component_id is the
    smallest doc_id reachable, null only where no document of the component has an id. Null and empty texts and texts
    of white space have fingerprint zero and are linked like any other; texts with fewer words than a shingle count as
    one shingle. Repeated rows stay. Other columns are not looked at. No rows give no rows.

    Texts are read once and not shuffled. Equal fingerprints become one before anything is compared.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    prints = stored(fingerprints(docs, words, "doc_id"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = stored(components(near_pairs(distinct.select("fp"), radius, bucket)), "components")
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A key of more texts isn't compared pair by pair at once; what is left of it is, in chunks of about so many texts.
CROWD, CHUNK = 24, 512
#: Texts whose shingles are counted for the order of shingles: so many, or this share of all; shingles kept of them.
COUNTED, COUNTED_SHARE, FREQUENT = 20_000, 1 / 16, 500_000
#: 64-bit words of parity bits of a shingle set.
PARITY = 8


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The text's different shingle hashes as sorted signed numbers."""
    return np.unique(np.array([h for hs in shingles(data, words) for h in hs], dtype="<u8").view("<i8"))


def least_common(size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Common shingles that sets of these sizes need at least for the Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * (size + other) - 1e-6)


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more of some of the texts, sorted, with their counts; ``FREQUENT`` at most, the most frequent ones."""
    n = docs.count()
    share = min(1.0, max(COUNTED / max(n, 1), COUNTED_SHARE))
    some = docs.where(F.pmod(F.xxhash64(F.lit(31), "row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    udf = F.pandas_udf(lambda data: pd.Series([shingle_set(bytes(x), words) for x in data], dtype=object), "array<bigint>")
    counts = some.select(F.explode(udf(utf8("text"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = counts.where("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    return rows["key"].to_numpy(dtype="i8"), rows["n"].to_numpy(dtype="i4")


def _keys(frames: Iterator[pd.DataFrame], words: int, similarity: float, sent) -> Iterator[pd.DataFrame]:
    """(key, row, size, place): the first shingles of each text in one order of all shingles, rare ones first.

    Sets of s shingles that are similar enough share at least similarity * s of them, so each has a common one among its first
    s - similarity * s + 1 in any order; the order only decides how many other texts share a key.
    """
    known, count = sent.value
    for frame in frames:
        key, row, size, place = [], [], [], []
        for r, data in zip(frame["row"].tolist(), frame["data"], strict=True):
            s = shingle_set(bytes(data), words)
            if not len(s):
                continue
            n = np.zeros(len(s), dtype="i4")
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                n = np.where(known[at] == s, count[at], 0)
            first = s[np.lexsort((s, n))[: len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1]]
            key.append(first)
            row.append(np.full(len(first), r))
            size.append(np.full(len(first), len(s), dtype="i4"))
            place.append(np.arange(len(first), dtype="i4"))
        if key:
            yield pd.DataFrame({"key": np.concatenate(key), "row": np.concatenate(row), "size": np.concatenate(size), "place": np.concatenate(place)})


def _possible(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and j can be similar enough if the key is the first shingle that they share."""
    after = np.minimum(size[i] - place[i], size[j] - place[j])
    return after >= least_common(size[i], size[j], similarity)


def _bucket_pairs(frames: Iterator[pd.DataFrame], similarity: float, crowd: int = CROWD) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of rows with one key that can be similar, of rows sorted by key and size.

    The rows of a key with more than ``crowd`` are paired with the row before and with one leader only, and come once more
    with their key, size and place, without b.
    """
    key_now, leader = None, None
    for frame in _with_key_runs(frames):
        key, row = frame["key"].to_numpy(), frame["row"].to_numpy()
        size_, place = frame["size"].to_numpy(), frame["place"].to_numpy()
        cut = bounds(frame, ["key"])
        size = np.repeat(np.diff(cut), np.diff(cut))
        crowded = (size > crowd) | (key == key_now if key_now is not None else False)
        a, b, lag = [], [], 0
        at = np.flatnonzero(~crowded)
        while len(at):
            lag += 1
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            ok = at[_possible(size_, place, at, at + lag, similarity)]
            a.append(row[ok])
            b.append(row[ok + lag])
        order = row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if crowded[lo]:
                if key[lo] != key_now:
                    key_now, leader = key[lo], row[lo:hi][order[lo:hi].argmin()]
                a += [np.full(hi - lo, leader), row[lo : hi - 1]]
                b += [row[lo:hi], row[lo + 1 : hi]]
        a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        pairs = pairs[pairs["a"] != pairs["b"]].drop_duplicates()
        left = frame.loc[crowded, ["row", "key", "size", "place"]].rename(columns={"row": "a"})
        for part in (pairs.assign(key=None, size=None, place=None), left.assign(b=None)):
            if len(part):
                types = {"a": "Int64", "b": "Int64", "key": "Int64", "size": "Int32", "place": "Int32"}
                yield part[list(types)].astype(types)


def _parity(sets: list[np.ndarray]) -> list[bytes]:
    """For each class of a set's shingles whether the set has an odd number of them, four to eight classes a shingle.

    A set that has twice the classes of another folds to them by exclusive or of its halves.
    """
    out = []
    for s in sets:
        classes = 1 << max(9, int(4 * max(len(s), 1) - 1).bit_length())
        out.append(np.packbits(np.bincount(s & (classes - 1), minlength=classes).astype(np.uint8) & 1, bitorder="little").tobytes())
    return out


def _folded(bits: list[bytes], rows: np.ndarray) -> np.ndarray:
    """The parity bits of ``rows``, all folded to the fewest classes among them, as 64-bit words."""
    words = [np.frombuffer(bits[r], dtype="<u8") for r in rows.tolist()]
    least = min(len(w) for w in words)
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, least), axis=0) for w in words])


def _chunk_pairs(frames: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of rows that aren't in one component yet and whose sets can be similar: those of chunks c and d of a key.

    Sizes and places come first, then parity bits: sets that differ in d shingles differ in at most d of them, and in
    nearly as many, so that hardly a pair leaves the task that isn't a link.
    """
    for frame in whole_groups(frames, ["key", "c", "d"]):
        cut = bounds(frame, ["key", "c", "d"])
        row, own, component = (frame[x].to_numpy() for x in ("row", "own", "component"))
        size, place, bits = frame["size"].to_numpy(), frame["place"].to_numpy(), frame["bits"].tolist()
        c, d = frame["c"].to_numpy(), frame["d"].to_numpy()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = np.arange(lo, hi)
            first, second = (at, at) if c[lo] == d[lo] else (at[own[at] == c[lo]], at[own[at] == d[lo]])
            for block in range(0, len(first), 64):
                i, j = np.meshgrid(first[block : block + 64], second, indexing="ij")
                i, j = i.ravel(), j.ravel()
                ok = (component[i] != component[j]) & _possible(size, place, i, j, similarity)
                ok &= (row[i] < row[j]) if c[lo] == d[lo] else True
                i, j = i[ok], j[ok]
                some = 0
                while some < len(i):  # pairs of sets of about one size together
                    x, y = i[some : some + 4096], j[some : some + 4096]
                    some += 4096
                    used, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                    words = _folded(bits, used)
                    differing = np.bitwise_count(words[where[: len(x)]] ^ words[where[len(x) :]]).sum(axis=1)
                    near = differing <= (1 - similarity) / (1 + similarity) * (size[x] + size[y]) + 1e-6
                    if near.any():
                        yield pd.DataFrame({"a": np.minimum(row[x[near]], row[y[near]]), "b": np.maximum(row[x[near]], row[y[near]])})


def _crowd_pairs(docs: DataFrame, crowd: DataFrame, found: DataFrame, words: int, similarity: float, chunk: int) -> DataFrame:
    """Distinct pairs of rows of different components that share a key in ``crowd`` (key, row, size, place) and can be similar.

    The rows of a key are dealt into chunks by a hash, and each two chunks meet in a task of their own. Keys whose rows
    are all in one component are left out.
    """
    crowd = crowd.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    crowd = stored(crowd, "crowd")
    open_ = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    rows = stored(crowd.join(open_.select("key", chunks.alias("chunks")), "key"), "open")

    def bits(data: pd.Series) -> pd.Series:
        return pd.Series(_parity([shingle_set(bytes(x), words) for x in data]), dtype=object)

    bits.__annotations__ = {"data": pd.Series, "return": pd.Series}
    texts = by_number(docs, rows.select("row").distinct(), "row").select("row", F.pandas_udf(bits, "binary")(utf8("text")).alias("bits"))
    rows = rows.join(stored(texts, "parity"), "row").withColumn("own", F.pmod(F.xxhash64(F.lit(37), "row"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "own", "row", "size", "place", "component", "bits")
    dealt = rows.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "size", "row")
    return dealt.mapInPandas(partial(_chunk_pairs, similarity=similarity), "a bigint, b bigint").distinct()


def _with_key_runs(frames: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """Frames that keep a key's rows together as long as there are fewer than ``most``; longer runs come in several frames."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        frame = pd.concat([*rest, frame], ignore_index=True) if rest else frame
        if not len(frame):
            continue
        key = frame["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if len(frame) - cut >= most:
            yield frame
            rest = []
            continue
        if cut:
            yield frame.iloc[:cut]
        rest = [frame.iloc[cut:]]
    if rest:
        yield rest[0]


def _sets(data: pd.Series, words: int) -> pd.DataFrame:
    """A text's shingle set, its size, and for each of 64 * ``PARITY`` classes of shingles whether the set has an odd number of them."""
    sets = [shingle_set(bytes(x), words) for x in data]
    odd = np.zeros((len(sets), 64 * PARITY), dtype=np.uint8)
    for i, s in enumerate(sets):
        odd[i] = np.bincount(s & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    bits = np.packbits(odd, axis=1, bitorder="little").view("<i8")
    return pd.DataFrame({"s": pd.Series(sets, dtype=object), "n": [len(s) for s in sets], **{f"p{k}": bits[:, k] for k in range(PARITY)}})


def _links(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` whose shingle sets have the similarity.

    Sets that differ in d shingles differ in at most d parity bits, so only pairs that fail for sure are left out before
    the sets themselves meet.
    """
    with gathered() as used:
        pairs = stored(pairs, "pairs")
        of = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        parity = [f"p{k}" for k in range(PARITY)]

        def sets_(data: pd.Series) -> pd.DataFrame:
            return _sets(data, words)

        sets_.__annotations__ = {"data": pd.Series, "return": pd.DataFrame}
        udf = F.pandas_udf(sets_, "s array<bigint>, n int, " + ", ".join(f"{c} bigint" for c in parity))
        sets = stored(by_number(docs, of, "row").select("row", udf(utf8("text")).alias("x")).select("row", "x.*"), "shingles")
        side = lambda x, columns: sets.select(F.col("row").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
        differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in parity), F.lit(0))
        most = (1 - similarity) / (1 + similarity) * (F.col("a_n") + F.col("b_n")) + 1e-6
        close = pairs.join(side("a", ["n", *parity]), "a").join(side("b", ["n", *parity]), "b").where(differing <= most).select("a", "b")
        close = stored(close, "close")
        sets = by_number(sets, close.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row")  # no other set is sent
        both = close.join(side("a", ["s"]), "a").join(side("b", ["s"]), "b")
        common = F.size(F.array_intersect("a_s", "b_s"))
        either = F.size("a_s") + F.size("b_s") - common
    links = stored(both.where(common >= similarity * either).select("a", "b"), "links")
    release(docs.sparkSession, used)
    return links


def print_pairs(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """Pairs (a, b) of rows whose fingerprints differ in at most ``radius`` bits: for each row but the first of its print that
    first row, for each print the first row of its smallest neighbour. They connect what such prints connect."""
    prints = stored(fingerprints(docs, words, "row"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("row").alias("first"))
    same = prints.join(distinct, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = near_pairs(distinct.select("fp"), radius).groupBy("b").agg(F.min("a").alias("a"))
    first = lambda x: distinct.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_row"))
    near = near.join(first("a"), "a").join(first("b"), "b")
    return same.unionByName(near.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose rows are not in one component of ``found``."""
    for x in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")), x, "left")
    return pairs.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")


def similar_groups(docs: DataFrame, row: str, words: int = 5, similarity: float = 0.8, crowd: int = CROWD, chunk: int = CHUNK, radius: int = 2) -> DataFrame:
    """``row`` and component (the smallest ``row`` reachable) for every row of ``docs`` (``row``: bigint, text).

    A link is a pair of texts whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``.
    Rows come together by their SimHash fingerprints first: covering masks find those that differ in at most ``radius`` bits, the
    sets tell which are links. Links of prints further apart, which no covers of 64 bits reach, are completed by an exact way for the rest:
    candidates that aren't in one component yet share one of their first shingles in an order that puts frequent shingles last (prefix filter), which every
    link does; the sizes and the shingle's places tell which of them can be links, the sets tell which are. The
    rows of a key with more than ``crowd`` texts are first compared with the row before and one leader; then those that aren't
    joined by that with each other, so no link is lost. That work grows with the square of the rows of a key that are not similar
    enough to be joined. Texts without words are linked; texts with fewer words than a shingle count as one shingle. No rows give no rows.
    """
    docs = docs.select(F.col(row).alias("row"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))
    texts = docs.select("row", utf8("text").alias("data"))
    keyed = texts.mapInPandas(partial(_keys, words=words, similarity=similarity, sent=sent), "key bigint, row bigint, size int, place int")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "size", "row")
    blank = F.coalesce("text", F.lit("")).rlike(r"\A[ \t\n\r\x0b\f]*\z")
    with gathered() as used:
        near = _links(docs, print_pairs(docs.where(~blank), words, radius), words, similarity)
        joined = stored(components(near), "joined")
        met = stored(dealt.mapInPandas(partial(_bucket_pairs, similarity=similarity, crowd=crowd), "a bigint, b bigint, key bigint, size int, place int"), "met")
        links = near.unionByName(_links(docs, _apart(met.where("key is null").select("a", "b").distinct(), joined), words, similarity))
        empty = stored(docs.where(blank).select("row"), "empty")
        least = empty.agg(F.min("row")).first()[0]
        first = components(links.unionByName(empty.select(F.lit(least).cast("bigint").alias("a"), F.col("row").alias("b"))))
    found = stored(first, "components")
    members = met.where("key is not null").select("key", F.col("a").alias("row"), "size", "place")
    with gathered() as later:
        more = _links(docs, _crowd_pairs(docs, members, found, words, similarity, chunk), words, similarity)
        joined = None if more.isEmpty() else components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    if joined is not None:
        found = stored(joined, "components")
    release(docs.sparkSession, used + later)
    return docs.select("row").join(found.withColumnRenamed("node", "row"), "row", "left").select(
        F.col("row").alias(row), F.coalesce("component", "row").alias("component")
    )
