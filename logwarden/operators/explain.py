"""Word importance: how much a prediction loses without each word.

The importance of a word is the fall of the predicted class's probability when
the word is taken away. With a linear model over word counts the scores of the
shortened text follow from the full text's: taking a word away takes its own
contribution off each class score. What each word contributes is read off one
small table, a row of class weights per word hash, so a line is explained where
it is: no row per word, no shortened texts, no shuffle. ``explain_masked`` does
without the linearity, for other models.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import message
from logwarden.operators.learn import TextModel

MIN_IMPORTANCE = 0.001
#: Word hashes that a task keeps.
KEPT = 200_000
#: Words whose class scores are worked out at a time; a longer line is worked out alone.
AT_ONCE = 16_384
_WORDS = "array<struct<pos:int,word:string,importance:double>>"


def split_words(text: Column) -> Column:
    return F.filter(F.split(message(text), r"(?U)\s+"), lambda w: w != "")


def word_hash(word: bytes, seed: int = 42) -> int:
    """Murmur3 (32 bit, unsigned) of a word, as the featurizer takes it."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(word) & ~3
    for i in range(0, len(word), 4):
        k = int.from_bytes(word[i : i + 4], "little") * 0xCC9E2D51 & mask
        h ^= ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        if i < whole:
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(word)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


class WordWeights:
    """What a word adds to each class's score, by hash; the features are hashed, weighted word counts."""

    def __init__(self, model: TextModel):
        stages = {type(s).__name__: s for s in model.model.stages}
        if not {"HashingTF", "IDFModel", "LogisticRegressionModel"} <= set(stages):
            raise ValueError("not a linear model over hashed words; use explain_masked")
        linear = stages["LogisticRegressionModel"]
        self.table = (linear.coefficientMatrix.toArray() * stages["IDFModel"].idf.toArray()).T.copy()
        self.bias = linear.interceptVector.toArray()
        self._at: dict[str, int] = {}

    def rows(self, words: list[str]) -> np.ndarray:
        """A row of the table for each word."""
        at, size = self._at, len(self.table)
        for w in words:
            if w not in at:
                if len(at) >= KEPT:
                    at.clear()
                h = word_hash(w.encode())
                at[w] = (h - (1 << 32) if h >> 31 else h) % size
        return self.table[[at[w] if w in at else word_hash(w.encode()) % size for w in words]]

    def explain(self, lines: pa.ListArray, n: int | None) -> pa.StructArray:
        """Per line the best class (from 1), its probability and (pos, word, importance) of its words, or the ``n`` first.

        Works through about ``AT_ONCE`` words at a time, so that memory doesn't grow with a batch's words.
        """
        block = np.cumsum(lines.value_lengths().to_numpy()) // AT_ONCE
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lines)]
        return pa.concat_arrays([self._explain(lines.slice(lo, hi - lo), n) for lo, hi in zip(cut[:-1], cut[1:], strict=True)])

    def _explain(self, lines: pa.ListArray, n: int | None) -> pa.StructArray:
        flat = lines.flatten().dictionary_encode()
        size = lines.value_lengths().to_numpy()
        line = np.repeat(np.arange(len(lines)), size)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        words = flat.dictionary.to_pylist()
        own = (self.rows(words) if words else np.zeros((1, len(self.bias))))[flat.indices.to_numpy()]
        base = np.stack([np.bincount(line, own[:, c], len(lines)) for c in range(len(self.bias))], axis=1) + self.bias
        whole = _softmax(base)
        top = whole.argmax(axis=1)
        sure = whole[np.arange(len(lines)), top]
        without = _softmax(base[line] - own)[np.arange(len(line)), top[line]]
        drop = np.round(sure[line] - without, 4)
        order = np.arange(len(line))
        if n is not None:
            order = np.lexsort((pos, -np.abs(drop), line))
            order = order[(pos < n) & (np.abs(drop[order]) > MIN_IMPORTANCE)]  # sorted by line, pos is also the rank
        ends = np.searchsorted(line[order], np.arange(len(lines) + 1))
        values = [pa.array(pos[order], pa.int32()), flat.dictionary.take(flat.indices.take(pa.array(order))), pa.array(drop[order])]
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, ["pos", "word", "importance"]))
        return pa.StructArray.from_arrays([pa.array(top + 1, pa.int32()), pa.array(sure), found], ["at", "sure", "words"])


def _softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True, initial=-np.inf))
    return p / p.sum(axis=1, keepdims=True)


def explain_lines(df: DataFrame, model: TextModel, key: str = "log_id", text: str = "log_message", n: int | None = None) -> DataFrame:
    """``key, predicted_label, confidence, words``: one row per line, ``words`` an array of ``(pos, word, importance)``.

    With ``n`` the words are the n first by absolute importance that matter at all,
    a tie in text order; else all words in text order. A text of one word or none
    is not masked: it stands as one word of importance 1. Classes must have been
    learned from hashed word counts of the text.
    """
    shared = df.sparkSession.sparkContext.broadcast(WordWeights(model))

    def explain(lines: pa.Array) -> pa.Array:
        return shared.value.explain(lines, n)

    told = F.arrow_udf(explain, f"at int, sure double, words {_WORDS}")
    lines = df.select(key, F.col(text).alias("_full"), split_words(F.col(text)).alias("_w"))
    lines = lines.withColumn("_told", told("_w"))
    few = F.size("_w") <= 1
    alone = F.array(F.struct(F.lit(0).alias("pos"), F.col("_full").alias("word"), F.lit(1.0).alias("importance")))
    names = F.array(*[F.lit(c) for c in model.classes])
    sure = F.col("_told.sure")
    return lines.select(
        key, F.element_at(names, F.col("_told.at")).alias("predicted_label"),
        F.when(few, sure).otherwise(F.round(sure, 4)).alias("confidence"),
        F.when(few, alone.cast(_WORDS)).otherwise(F.col("_told.words")).alias("words"),
    )


def explain_words(df: DataFrame, model: TextModel, key: str = "log_id", text: str = "log_message") -> DataFrame:
    """``key, predicted_label, confidence, pos, word, importance`` for every word."""
    rows = explain_lines(df, model, key, text).select(key, "predicted_label", "confidence", F.explode("words").alias("w"))
    return rows.select(key, "predicted_label", "confidence", "w.pos", "w.word", "w.importance")


def _word_rows(df: DataFrame, key: str, drop: Column, word: Column) -> DataFrame:
    """Shape the result; a text of one word is not masked and keeps its exact confidence."""
    few = F.col("_n") <= 1
    return df.select(
        key, "predicted_label",
        F.when(few, F.col("confidence")).otherwise(F.round("confidence", 4)).alias("confidence"),
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(few, F.col("_full")).otherwise(word).alias("word"),
        F.when(few, F.lit(1.0)).otherwise(drop).alias("importance"),
    )


def explain_masked(
    df: DataFrame, predict: Callable[[DataFrame], DataFrame], classes: list[str], key: str = "log_id", text: str = "log_message"
) -> DataFrame:
    """The same for any model: ``predict`` adds ``probabilities`` to a table with ``log_message``.

    Each text is sent with and without each word in one table; the base
    prediction meets the masked ones on the key.
    """
    names = F.array(*[F.lit(c) for c in classes])
    base = predict(df.select(key, F.col(text).alias("log_message")))
    base = base.withColumn("_i", F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
    base = base.select(
        key, "log_message", "_i", F.element_at(names, F.col("_i")).alias("predicted_label"),
        F.element_at("probabilities", F.col("_i")).alias("confidence"), split_words(F.col("log_message")).alias("_w"),
    )
    cut = base.select("*", F.posexplode_outer("_w").alias("pos", "word")).withColumns(
        {
            "_full": F.col("log_message"),
            "_n": F.size("_w"),
            "log_message": F.array_join(F.filter("_w", lambda w, i: i != F.col("pos")), " "),
        }
    ).drop("_w")
    masked = predict(cut)
    drop = F.round(F.col("confidence") - F.element_at("probabilities", F.col("_i")), 4)
    return _word_rows(masked, key, drop, F.col("word"))


def top_words(words: DataFrame, key: str = "log_id", n: int = 10) -> DataFrame:
    """The n first of a table of words by absolute importance that matter at all; a tie keeps text order.

    For words of ``explain_masked``; ``explain_batch`` picks them without a shuffle.
    """
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("importance")), "pos")
    ranked = words.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.filter(F.abs("importance") > MIN_IMPORTANCE)


def explain_batch(df: DataFrame, model: TextModel, key: str = "log_id", n: int = 5, text: str = "log_message") -> DataFrame:
    """The n words that matter most of every line, ranked from 1."""
    rows = explain_lines(df, model, key, text, n).select(key, "predicted_label", "confidence", F.posexplode("words").alias("at", "w"))
    return rows.select(key, "predicted_label", "confidence", "w.pos", "w.word", "w.importance", (F.col("at") + 1).alias("rank"))
