"""Phrases whose words hold together, from counts of the longest windows alone (operator 11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import stored

#: Words counted together in a task before they are sent; bounds its memory.
BLOCK = 1 << 20
#: Words with a short code, at most (of 64 bytes at most): the frequent ones. Others are written out.
CODED, WORD_BYTES = 1 << 18, 64
#: Bits of the filter that tells which of the other words may be frequent.
FILTER = 1 << 24
#: A word with this share of all words is hot; windows that begin with three hot words are dealt out by their fourth, too.
HOT, SALT = 1 / 256, 6
#: A language's phrases are ranked in so many parts first, so that no task ranks them all.
PARTS = 64
_STOP = "."


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """The batch's words with their languages; a stop (which no word can be) begins each text and each piece."""
    low = pc.replace_substring_regex(pc.ascii_lower(batch.column("text")), r"[.,;:!?\n-\r]+", f" {_STOP} ")
    texts = pc.binary_join_element_wise(_STOP, low, " ")
    words = pc.ascii_split_whitespace(texts)
    flat, of = words.flatten(), pc.list_parent_indices(words)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), batch.column("lang").take(of.filter(full))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Array, pa.Array, int]]:
    """(words, languages, n) with about ``block`` words; the first n are this block's, the rest is what follows them."""
    words, langs, held = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            w, of = _words(batch.slice(lo, 256))
            words, langs, held = [*words, w], [*langs, of], held + len(w)
            if held < block:
                continue
            w, of = pa.concat_arrays(words), pa.concat_arrays(langs)
            while len(w) >= block:  # the last windows reach into three words of the next block
                yield w.slice(0, block), of.slice(0, block), block - 3
                w, of = w.slice(block - 3), of.slice(block - 3)
            words, langs, held = [w], [of], len(w)
    if held:
        yield pa.concat_arrays(words), pa.concat_arrays(langs), held


def _keyed(words: pa.Array, langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's number in the list of distinct "word, tab, language", -1 for a stop."""
    w, of = words.dictionary_encode(), langs.dictionary_encode()
    at, to = w.indices.to_numpy().astype(np.int64), of.indices.to_numpy()
    keys, number = np.unique(at * len(of.dictionary) + to, return_inverse=True)
    ws, ls = w.dictionary.to_pylist(), of.dictionary.to_pylist()
    names = [f"{ws[k // len(ls)]}\t{ls[k % len(ls)]}" for k in keys.tolist()]
    return np.where(at == pc.index(w.dictionary, _STOP).as_py(), -1, number), names


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """lang, word, n of words with at least ``least`` occurrences in their language; the empty word has all occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, positions in _blocks(batches, block):
            number, names = _keyed(words.slice(0, positions), langs.slice(0, positions))
            n = np.bincount(number[number >= 0], minlength=len(names))
            at = np.flatnonzero(n)
            pairs = [names[i].split("\t", 1) for i in at.tolist()]
            word, lang = pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())
            counted = pa.table({"lang": lang, "word": word, "n": pa.array(n[at], pa.int64())})
            total = counted.group_by("lang").aggregate([("n", "sum")]).rename_columns(["lang", "n"])
            total = total.append_column("word", pa.array([""] * total.num_rows, pa.string())).select(["lang", "word", "n"])
            yield from pa.concat_tables([counted, total]).combine_chunks().to_batches(1 << 16)

    sent = _texts(docs).mapInArrow(count, "lang string, word string, n bigint")
    counts = sent.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(counts.where((F.col("n") >= least) | (F.col("word") == "")), "words")


class Book:
    """Codes of frequent words: 1, 2, ... for those in the book, ``hot`` of them hot; none for words that can't be frequent."""

    def __init__(self, codes: dict[str, int], hot: int, bits: np.ndarray):
        self.codes, self.hot, self.bits = codes, hot, bits

    def code(self, key: str) -> int:
        """The word's code, 0 if it isn't frequent, -1 if it has to be written out."""
        known = self.codes.get(key)
        if known is not None:
            return known
        if not len(self.bits):
            return 0
        at = xxhash.xxh64_intdigest(key.encode(), 42) % FILTER
        return -int(self.bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1))


def code_book(words: DataFrame, coded: int = CODED) -> tuple[Book, DataFrame]:
    """The ``coded`` most frequent of ``words``, and as a table (code, lang, word).

    The other frequent words set bits of a filter of ``FILTER`` bits, so what is gathered is bounded for any corpus.
    """
    total = words.where("word = ''").agg(F.sum("n")).first()[0] or 0
    words = words.where("word <> ''")
    short = words.where(F.octet_length("word") + F.octet_length("lang") <= WORD_BYTES)
    top = short.orderBy(F.desc("n"), "lang", "word").limit(coded).toPandas()
    book = {f"{w}\t{x}": i + 1 for i, (x, w) in enumerate(zip(top["lang"], top["word"], strict=True))}
    bits = np.zeros(0, dtype=np.uint64)
    rows = [(i + 1, x, w) for i, (x, w) in enumerate(zip(top["lang"], top["word"], strict=True))]
    table = words.sparkSession.createDataFrame(rows, "code bigint, lang string, word string")
    if words.count() > len(book):
        others = words.join(F.broadcast(table), ["lang", "word"], "left_anti")
        place = F.pmod(F.xxhash64(F.concat_ws("\t", "word", "lang")), F.lit(FILTER))
        mask = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))")
        set_ = others.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(mask.alias("mask")).toPandas()
        bits = np.zeros(FILTER >> 6, dtype=np.uint64)
        bits[set_["at"].to_numpy()] = set_["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Book(book, int((top["n"] >= HOT * total).sum()), bits), table


def _leads(code: np.ndarray, positions: int) -> list[np.ndarray]:
    """The first ``positions`` codes with the three that follow each; past a 0 all is 0."""
    padded = np.append(code, [0, 0, 0])
    columns = [padded[:positions]]
    for lead in (1, 2, 3):
        columns.append(np.where(columns[-1] == 0, 0, padded[lead : lead + positions]))
    return columns


def _runs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with how often each comes."""
    by = np.lexsort(columns[::-1])
    columns = [c[by] for c in columns]
    new = np.zeros(len(by), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(by)))


def _coded_windows(words: pa.Array, langs: pa.Array, positions: int, book: Book) -> Iterator[pa.RecordBatch]:
    """(left, mid, w4, n): the block's windows of coded words, in order, so that neighbours compress.

    ``left`` is the first two codes, ``mid`` the third over a salt, which is 0 unless the first three words are hot.
    """
    number, names = _keyed(words, langs)
    code = np.array([max(book.code(k), 0) for k in names] + [0], dtype=np.int64)
    w1, w2, w3, w4 = _leads(code[number], positions)
    at = np.flatnonzero(w1)
    w1, w2, w3, w4 = w1[at], w2[at], w3[at], w4[at]
    hot = (np.maximum(np.maximum(w1, w2), w3) <= book.hot) & (w3 > 0)
    mid = w3 << SALT | np.where(hot, 1 + w4 % ((1 << SALT) - 1), 0)
    (left, right), n = _runs([w1 << 32 | w2, mid << 32 | w4])
    arrays = [pa.array(x, pa.int64()) for x in (left, right >> 32, right & 0xFFFFFFFF, n)]
    whole = pa.RecordBatch.from_arrays(arrays, ["left", "mid", "w4", "n"])
    for lo in range(0, len(n), 1 << 16):
        yield whole.slice(lo, 1 << 16)


def _written_windows(words: pa.Array, langs: pa.Array, positions: int, book: Book) -> Iterator[pa.RecordBatch]:
    """(lang, w1, w2, w3, w4, n): windows with a word that has no code but may be frequent; such words begin with a tab."""
    number, names = _keyed(words, langs)
    code = np.array([book.code(k) for k in names] + [0], dtype=np.int64)
    loose = code < 0
    code = np.where(code == 0, 0, np.arange(1, len(code) + 1))
    columns = _leads(code[number], positions)
    loose = np.append(False, loose)
    at = np.flatnonzero((columns[0] != 0) & np.logical_or.reduce([loose[c] for c in columns]))
    if not len(at):
        return
    columns, n = _runs([c[at] for c in columns])
    pairs = [k.split("\t", 1) for k in names]
    name = pa.array(["", *[f"\t{w}" if x else w for (w, _), x in zip(pairs, loose[1:], strict=False)]], pa.string())
    lang = pa.array(["", *[x for _, x in pairs]], pa.string()).take(pa.array(columns[0]))
    arrays = [lang, *[name.take(pa.array(c)) for c in columns], pa.array(n, pa.int64())]
    whole = pa.RecordBatch.from_arrays(arrays, ["lang", "w1", "w2", "w3", "w4", "n"])
    for lo in range(0, len(n), 1 << 16):
        yield whole.slice(lo, 1 << 16)


def _windows(docs: DataFrame, book: Book, make: Callable, schema: str, block: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, positions in _blocks(batches, block):
            yield from make(words, langs, positions, book)

    return _texts(docs).mapInArrow(cut, schema)


def _coded_counts(windows: DataFrame, least: int) -> DataFrame:
    """w1, w2, w3, w4, f: frequent phrases of coded words; what is past a phrase is null.

    Windows of the same three words lie together (but for hot ones, by salt), so four and three words are summed there.
    """
    dealt = windows.repartition("left", "mid")
    w3 = F.shiftright("mid", SALT)
    first = [F.shiftright("left", 32).alias("w1"), F.col("left").bitwiseAND(F.lit(0xFFFFFFFF)).alias("w2")]

    def often(word: Column) -> Column:  # not a test of the word alone, which would go below one reader's shuffle
        return F.coalesce(F.col("f") * (word > 0).cast("bigint"), F.lit(0)) >= least

    four = dealt.groupBy("left", "mid", "w4").agg(F.sum("n").alias("f")).where(often(F.col("w4")))
    # reads w4 so that both sums have the same columns shuffled, once
    three = dealt.groupBy("left", "mid").agg(F.sum(F.when(F.col("w4") >= 0, F.col("n"))).alias("f"))
    salted = F.col("mid").bitwiseAND(F.lit((1 << SALT) - 1)) > 0
    longer = three.where((F.col("f") >= least) | salted).groupBy("left", w3.alias("w3")).agg(F.sum("f").alias("f")).where(often(F.col("w3")))
    short = three.select(*first, "f").rollup("w1", "w2").agg(F.sum("f").alias("f"))
    short = short.where((F.col("f") >= least) & F.col("w1").isNotNull() & (F.coalesce("w2", F.lit(1)) > 0))
    found = four.select(*first, w3.alias("w3"), "w4", "f").unionByName(longer.select(*first, "w3", "f"), allowMissingColumns=True)
    return found.unionByName(short, allowMissingColumns=True)


def _written_counts(windows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f: frequent phrases that hold a word without a code."""
    four = windows.groupBy("lang", "w1", "w2", "w3", "w4").agg(F.sum("n").alias("f"))
    four = four.select(F.struct("lang", "w1").alias("w1"), "w2", "w3", "w4", "f")
    short = four.rollup("w1", "w2", "w3").agg(F.sum("f").alias("f")).where(F.col("w1").isNotNull())
    found = four.unionByName(short, allowMissingColumns=True).where(F.col("f") >= least)
    found = found.where("coalesce(w2, '-') <> '' and coalesce(w3, '-') <> '' and coalesce(w4, '-') <> ''")
    phrase = F.concat_ws(" ", "w1.w1", "w2", "w3", "w4")
    return found.where(phrase.contains("\t")).select("w1.lang", F.translate(phrase, "\t", "").alias("phrase"), "f")


def phrase_counts(docs: DataFrame, least: int = 30, coded: int = CODED, block: int = BLOCK) -> DataFrame:
    """lang, phrase, size, f: every phrase of 1 to 4 words with at least ``least`` occurrences in its language.

    Rows of ``size`` 0 hold the number of all word occurrences of a language.

    A first pass counts words, for codes: a word that isn't frequent can't be in a frequent phrase, so it ends a window
    as a piece's end does, and the most frequent ones get numbers, which makes a window two numbers. Of phrases only the
    longest windows are counted, a word and its three leads padded past the end, in each block and then in one shuffle by
    the first three words; ROLLUP sums the shorter prefixes. Frequent words beyond the book (``coded``) are written out, in windows of their own
    that are counted the same way; a phrase is counted there if it holds such a word, else with the coded ones.
    """
    words = word_counts(docs, least, block)
    book, table = code_book(words, coded)
    windows = _windows(docs, book, _coded_windows, "left bigint, mid bigint, w4 bigint, n bigint", block)
    found = stored(_coded_counts(windows, least), "coded")
    for i in range(1, 5):
        name = table.select(F.col("code").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))
        found = found.join(F.broadcast(name), f"w{i}", "left")
    named = [F.concat_ws(" ", *[f"word{i}" for i in range(1, 5)]).alias("phrase"), sum((F.col(f"w{i}").isNotNull().cast("int") for i in range(2, 5)), F.lit(1)).alias("size")]
    counts = found.select("lang", *named, "f").unionByName(words.where("word = ''").select("lang", F.lit("").alias("phrase"), F.lit(0).alias("size"), F.col("n").alias("f")))
    if len(book.bits):
        loose = _windows(docs, book, _written_windows, "lang string, w1 string, w2 string, w3 string, w4 string, n bigint", block)
        found = _written_counts(loose, least)
        counts = counts.unionByName(found.withColumn("size", F.size(F.split("phrase", " "))))
    return stored(counts, "phrases")


def _wide(n: str) -> Column:
    return F.col(n).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score for phrases of two words and more: the cut with the lowest floor(2000000 a / (l + r)).

    Sums and products are decimals of 38 digits. A part of a phrase occurs at least as often as the phrase, so its count
    is always in ``counts``.
    """
    words = F.split("phrase", " ")
    cuts = counts.where("size >= 2").select(
        "lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.withColumns(
        {"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")}
    )
    parts = counts.where("size between 1 and 3")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumns({"wide_a": _wide("a"), "both": _wide("l") + _wide("r")})
    cuts = cuts.withColumn("score", F.expr("2000000 * wide_a div both"))
    cut = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(cut).select("lang", "phrase", "size", "a", "cut.*")


def maximal(counts: DataFrame, phrases: DataFrame, share: int = 80) -> DataFrame:
    """``phrases`` (lang, phrase, a) without those inside a longer one of ``counts`` that occurs at least ``share`` % as often."""
    words = F.split("phrase", " ")
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    )))
    longer = counts.where("size >= 3").select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(100 * _wide("longer") < share * _wide("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, first: int = 2000, coded: int = CODED, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of each language of ``docs`` (lang, text).

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and
    tabs. Phrases are 2 to 4 words of a piece. Order: score, then a, falling, then the phrase's bytes. A null text is
    empty, a null language ``und``; empty texts add nothing. Repeated rows count each. A text of any length is counted
    in blocks. Other columns are not looked at; no rows give no rows, and so does a language without frequent phrases.
    """
    counts = phrase_counts(docs, least, coded, block)
    best = maximal(counts, scored(counts), share)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    best = best.where(F.col("rank") <= first).join(total, "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
