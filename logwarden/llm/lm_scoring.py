"""Scores of whole texts by a causal self-attention model on subword ids (operator 5)."""

from __future__ import annotations

import math
import os
import pickle
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import drawn, utf8
from logwarden.llm.tokens import ranked, tokenizer_path
from logwarden.session import stored

VOCABULARY = "byte_bpe_50k.json"
#: Texts that training starts with, at most, those with the smallest hashes; of each a stretch of so many bytes. All texts follow.
SAMPLE, STRETCH = 6_000, 1_024
#: Ids of a context window, and how many of them only lead in: every window but a text's first scores what follows these.
CONTEXT, LEAD = 32, 8
#: Sizes: embedding, hidden layer, ids that are predicted one by one (in classes of equal number), other classes.
WIDTH, HIDDEN, FREQUENT, CLASSES, OTHER_CLASSES = 16, 32, 1024, 32, 16
STEPS, BATCH, RATE = 1500, 64, 0.02
#: Windows of a step, its rate at first, and steps whose windows are mixed, when all texts are gone through.
ALL_BATCH, ALL_RATE, MIXED = 512, 0.01, 8
#: Ids whose followers put ids into classes; ids that are put into classes by that, and how many of them are summed together.
HUBS, SORTED, ROWS_A_BLOCK = 128, 8192, 128
#: Words whose counts every task holds, the most frequent ones at most; the counts of all others are joined.
COMMON = 1 << 17
#: Logits stay within this of zero, so that sums need no shift and nothing underflows.
FLOOR = 30.0
#: Windows, and positions, that are worked on at a time when scoring, so that their arrays stay in the processor's cache.
SLICE, ROWS = 128, 4096
END = 50_256
#: Where the keys are, between the queries and the ones and values.
KEY = slice(WIDTH, 2 * WIDTH)
IDS = 50_257


def across(a: np.ndarray, b: np.ndarray, rows: int = 128) -> np.ndarray:
    """``a.T @ b``, so many rows at a time, as products over few rows are the faster ones."""
    whole = len(a) // rows * rows
    result = np.matmul(a[:whole].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, rows, b.shape[1])).sum(axis=0)
    return result + a[whole:].T @ b[whole:] if whole < len(a) else result


def _chosen(c: np.ndarray, column: np.ndarray, n: int = 0) -> np.ndarray:
    """Log probability of each row's ``column`` by the logits c; with n they become the gradient of the mean over n rows of its negative."""
    np.clip(c, -FLOOR, FLOOR, out=c)
    spot = np.arange(len(c)) * c.shape[1]
    spot += column
    logs = c.ravel().take(spot)
    np.exp(c, out=c)
    total = c @ np.ones(c.shape[1], c.dtype)
    logs -= np.log(total)
    if n:
        c *= (1 / (n * total))[:, None]
        c.ravel()[spot] -= c.dtype.type(1 / n)
    return logs.astype(float)


@dataclass
class Model:
    """One layer of causal self-attention; an id's probability is its class's times its own within the class.

    ``kind`` and ``place`` give each id's class and place. The first ``CLASSES`` classes hold the frequent ids, which are
    predicted from the context; in the others ids have the shares that the corpus counts give.
    """

    values: dict[str, np.ndarray]
    kind: np.ndarray
    place: np.ndarray
    within: np.ndarray  # log share of each id in its class

    def _inner(self) -> np.ndarray:
        """From an embedding and a one to the query, the key, a one and the value."""
        v = self.values
        inner = np.zeros((WIDTH + 1, 3 * WIDTH + 1), v["query"].dtype)
        inner[:WIDTH, :WIDTH], inner[:WIDTH, KEY], inner[:WIDTH, 2 * WIDTH + 1 :] = v["query"] / math.sqrt(WIDTH), v["key"], v["value"]
        inner[WIDTH, 2 * WIDTH] = 1
        return inner

    def _outer(self) -> np.ndarray:
        """From an embedding, a one and what attention brings to the hidden layer and a one."""
        v = self.values
        outer = np.zeros((2 * WIDTH + 1, HIDDEN + 1), v["near"].dtype)
        outer[:WIDTH, :HIDDEN], outer[WIDTH, :HIDDEN], outer[WIDTH + 1 :, :HIDDEN] = v["near"], v["bias"], v["far"]
        outer[WIDTH, HIDDEN] = 1
        return outer

    def _layer(self, ids: np.ndarray, skip: int = 0) -> dict[str, np.ndarray]:
        """ids: windows, positions. Everything up to the hidden layer, which the first ``skip`` positions only lead in to.

        The ones beside the values add the weights up; those beside the hidden layer bring in the biases of what follows.
        """
        v = self.values
        n, t = ids.shape
        x = np.empty((n, t, 2 * WIDTH + 1), v["embed"].dtype)
        np.add(v["embed"].take(ids, axis=0), v["position"][:t], out=x[:, :, :WIDTH])
        x[:, :, WIDTH] = 1
        all_ = (x.reshape(-1, 2 * WIDTH + 1)[:, : WIDTH + 1] @ self._inner()).reshape(n, t, -1)
        if skip:
            x = x[:, skip:].copy()
        a = np.matmul(all_[:, skip:, :WIDTH], all_[:, :, KEY].transpose(0, 2, 1))
        np.clip(a, -FLOOR, FLOOR, out=a)
        np.exp(a, out=a)
        a *= np.tri(t, dtype=a.dtype)[skip:]
        o = np.matmul(a, all_[:, :, 2 * WIDTH :])
        sums = o[:, :, :1]
        np.divide(o[:, :, 1:], sums, out=x[:, :, WIDTH + 1 :])
        h = x.reshape(-1, 2 * WIDTH + 1) @ self._outer()
        return {"x": x, "all": all_, "a": a, "sums": sums, "h": np.maximum(h, 0, out=h)}

    def logs(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target after hidden state h; with ``grads`` also the mean loss's gradient in h."""
        v, n = self.values, len(target)
        own = self.kind.take(target)
        order = np.argsort(own.astype(np.uint8), kind="stable")  # bytes are sorted by counting
        cut = np.append(0, np.cumsum(np.bincount(own, minlength=CLASSES)[:CLASSES]))
        outside = np.concatenate([v["class"], v["class_bias"][None]])
        inside = np.concatenate([v["member"], v["member_bias"][:, None]], axis=1)
        result, back = self.within.take(target), None
        if grads is not None:
            back, outside_grad, inside_grad = np.empty_like(h), np.zeros_like(outside), np.zeros_like(inside)
        for lo in range(0, n, ROWS):
            some = order[lo : lo + ROWS]
            mine, bounds = h.take(some, axis=0), np.clip(cut - lo, 0, len(some))
            c, w = mine @ outside, np.empty((bounds[-1], inside.shape[2]), h.dtype)
            parts = [(k, slice(bounds[k], bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds))]
            for k, rows in parts:
                np.matmul(mine[rows], inside[k], out=w[rows])
            mean = 0 if grads is None else n
            found = _chosen(c, own.take(some), mean)
            found[: len(w)] += _chosen(w, self.place.take(target.take(some[: len(w)])), mean)
            result[some] += found
            if grads is not None:
                outside_grad += across(mine, c)
                d, e = c @ outside.T, np.empty((len(w), h.shape[1]), h.dtype)
                for k, rows in parts:
                    inside_grad[k] += mine[rows].T @ w[rows]
                    np.matmul(w[rows], inside[k].T, out=e[rows])
                d[: len(w)] += e
                back[some] = d
        if grads is not None:
            grads["class"], grads["class_bias"] = outside_grad[:-1], outside_grad[-1]
            grads["member"], grads["member_bias"] = inside_grad[:, :-1], inside_grad[:, -1]
        return result, back

    def gradient(self, ids: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean loss over all positions, the different ids, and the loss's gradient by backpropagation, that of the embedding for these ids."""
        v, t = self.values, ids.shape[1]
        grads: dict[str, np.ndarray] = {}
        parts = [self._layer(ids[lo : lo + SLICE]) for lo in range(0, len(ids), SLICE)]
        h = np.concatenate([s["h"] for s in parts])
        logs, d = self.logs(h, target.ravel(), grads)
        d *= h > 0
        inner, outer = self._inner(), self._outer()
        inner_grad, outer_grad = np.zeros_like(inner), np.zeros_like(outer)
        dx, lo = np.empty((len(d), WIDTH), d.dtype), 0
        for s in parts:
            n, x, all_ = len(s["x"]), s["x"].reshape(-1, 2 * WIDTH + 1), s["all"]
            part = slice(lo, lo + n * t)
            lo += n * t
            outer_grad += across(x, d[part])
            g = (d[part] @ outer.T).reshape(n, t, -1)
            # beside the values' ones goes what makes the gradients of a position's weights add up to zero
            do = g[:, :, WIDTH:]
            do[:, :, 0] = -np.einsum("ntw,ntw->nt", do[:, :, 1:], s["x"][:, :, WIDTH + 1 :])
            do /= s["sums"]
            da = np.matmul(do, all_[:, :, 2 * WIDTH :].transpose(0, 2, 1))
            da *= s["a"]
            back = np.empty_like(all_)
            np.matmul(da, all_[:, :, KEY], out=back[:, :, :WIDTH])
            np.matmul(da.transpose(0, 2, 1), all_[:, :, :WIDTH], out=back[:, :, KEY])
            np.matmul(s["a"].transpose(0, 2, 1), do, out=back[:, :, 2 * WIDTH :])
            back = back.reshape(n * t, -1)
            inner_grad += across(x[:, : WIDTH + 1], back)
            np.matmul(back, inner[:WIDTH].T, out=dx[part])
            dx[part] += g.reshape(n * t, -1)[:, :WIDTH]
        grads["query"], grads["key"], grads["value"] = inner_grad[:WIDTH, :WIDTH] / math.sqrt(WIDTH), inner_grad[:WIDTH, KEY], inner_grad[:WIDTH, 2 * WIDTH + 1 :]
        grads["near"], grads["bias"], grads["far"] = outer_grad[:WIDTH, :HIDDEN], outer_grad[WIDTH, :HIDDEN], outer_grad[WIDTH + 1 :, :HIDDEN]
        grads["position"] = np.zeros_like(v["position"])
        grads["position"][:t] = (np.ones(len(ids), dx.dtype) @ dx.reshape(len(ids), -1)).reshape(t, WIDTH)
        order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")  # 16 bits are sorted by counting, too
        at = ids.ravel().take(order)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        grads["embed"] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
        return -float(logs.mean()), at[first], grads

    def score(self, texts: list[np.ndarray], at_once: int = 1024) -> np.ndarray:
        """log10 probability of each sequence of ids, each id scored once, given those before it in one context window."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        ids, sizes = np.concatenate([*texts, np.full(CONTEXT + 1, END)]), np.array([len(t) - 1 for t in texts])
        step = CONTEXT - LEAD
        many = np.maximum(-((LEAD - sizes) // step), 1)  # windows of each text
        text = np.repeat(np.arange(len(texts)), many)
        lo = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * step
        width = np.minimum(sizes[text] - lo, CONTEXT)
        order = np.lexsort((-width, lo == 0))  # windows that are led in come first, of both kinds the widest
        begin, lead = (np.cumsum(sizes + 1) - sizes - 1)[text] + lo, np.where(lo > 0, LEAD, 0)
        for k in range(0, len(order), at_once):
            part = order[k : k + at_once]
            self._add(total, ids, text[part], begin[part], lead[part], width[part])
        return total / math.log(10)

    def _add(self, total: np.ndarray, ids: np.ndarray, text: np.ndarray, begin: np.ndarray, lead: np.ndarray, width: np.ndarray) -> None:
        """Adds the scores of the windows of ``width`` ids from ``begin`` on to their texts' totals."""
        at = np.arange(width.max() + 1)
        data = ids[begin[:, None] + at]
        used = (at[:-1] >= lead[:, None]) & (at[:-1] < width[:, None])
        h = []
        for k in range(0, len(data), SLICE):
            part = slice(k, k + SLICE)
            skip = int(lead[part].min())
            some, here = self._layer(data[part, :-1], skip)["h"], used[part, skip:]
            h.append(some if here.all() else some[here.ravel()])
        h = np.concatenate(h)
        logs, _ = self.logs(h, data[:, 1:][used])
        total += np.bincount(np.repeat(text, used.sum(axis=1)), logs, len(total))


def leading(counts: np.ndarray) -> np.ndarray:
    """The ids that are put into classes by what they follow: the most frequent ones that occur."""
    order = np.argsort(-counts, kind="stable")
    return order[: max(min(int((counts > 0).sum()), SORTED), FREQUENT)]


class Followers:
    """How often each leading id follows each of the ``HUBS`` most frequent ones, one and two places behind it, as a flat table."""

    def __init__(self, counts: np.ndarray):
        seen = leading(counts)
        self.hub, self.row = np.full(IDS, -1), np.full(IDS, -1)
        self.hub[seen[:HUBS]] = np.arange(HUBS)
        self.row[seen] = np.arange(len(seen))
        self.table = np.zeros(len(seen) * 2 * HUBS, dtype=np.int64)

    def add(self, ids: np.ndarray) -> None:
        hub, row = self.hub[ids], self.row[ids]
        for gap in (1, 2):
            a, b = hub[:-gap], row[gap:]
            ok = (a >= 0) & (b >= 0)
            np.add.at(self.table, b[ok] * (2 * HUBS) + (gap - 1) * HUBS + a[ok], 1)


def classes(table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, place and log share of every id: classes of ids that follow like ids, halved again and again along the main direction.

    ``table``: that of ``Followers``; ``counts``: how often each id occurs. Both are counts of the whole corpus.
    """
    seen = leading(counts)
    table = table.reshape(len(seen), 2 * HUBS).astype(float)
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / max(table.sum(), 1)
    table = (table - expected) / np.sqrt(expected + 1)
    _, vectors = np.linalg.eigh(table.T @ table)
    points = table @ vectors[:, -12:]
    points /= np.sqrt((points**2).sum(axis=1, keepdims=True)) + 1e-9

    def halved(rows: np.ndarray, levels: int) -> list[np.ndarray]:
        if not levels:
            return [rows]
        p = points[rows]
        p = p - p.mean(axis=0) if len(p) else p
        _, w = np.linalg.eigh(p.T @ p)
        along = np.argsort(p @ w[:, -1], kind="stable")
        half = len(rows) // 2
        return halved(rows[along[:half]], levels - 1) + halved(rows[along[half:]], levels - 1)

    kind = np.full(IDS, CLASSES + OTHER_CLASSES, dtype=np.int64)  # the rarest ids
    place = np.zeros(IDS, dtype=np.int64)
    for k, rows in enumerate(halved(np.arange(FREQUENT), int(math.log2(CLASSES)))):
        kind[seen[rows]], place[seen[rows]] = k, np.arange(len(rows))
    for k, rows in enumerate(halved(np.arange(FREQUENT, len(seen)), int(math.log2(OTHER_CLASSES)))):
        kind[seen[rows]] = CLASSES + k
    share = counts + 0.5
    within = np.log(share / np.bincount(kind, share)[kind])
    within[kind < CLASSES] = 0
    return kind, place, within


class Learner:
    """Adam on the values of a model; an embedding moves only with its own id's steps."""

    def __init__(self, model: Model):
        self.model = model
        self.mean = {k: np.zeros_like(x) for k, x in model.values.items()}
        self.square = {k: np.zeros_like(x) for k, x in model.values.items()}
        self.steps = 0

    def step(self, windows: np.ndarray, rate: float) -> None:
        self.steps += 1
        step, values = self.steps, self.model.values
        _, at, grads = self.model.gradient(windows[:, :-1], windows[:, 1:])
        for k, g in grads.items():
            if k == "embed":
                m, s = self.mean[k][at], self.square[k][at]
                m += 0.1 * (g - m)
                s += 0.02 * (g * g - s)
                self.mean[k][at], self.square[k][at] = m, s
                values[k][at] -= (rate * m / (np.sqrt(s) + 1e-7)).astype(np.float32)
                continue
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            values[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-7)).astype(np.float32)


def train(windows: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 2, table: np.ndarray | None = None) -> Model:
    """A model from windows of CONTEXT + 1 ids and the corpus counts of all ids, by Adam; ``table``: the corpus's followers."""
    if table is None:
        followers = Followers(counts)
        for w in windows:
            followers.add(w)
        table = followers.table
    kind, place, within = classes(table, counts)
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float = 0.2) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    share = counts + 0.5
    by_class = np.bincount(kind, share, CLASSES + OTHER_CLASSES + 1) + 1
    member_bias = np.zeros((CLASSES, FREQUENT // CLASSES), np.float32)
    inside = kind < CLASSES
    member_bias[kind[inside], place[inside]] = np.log(share[inside] / by_class[kind[inside]])
    values = {
        "embed": draw(IDS, WIDTH, scale=0.5), "position": draw(CONTEXT, WIDTH),
        "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH),
        "near": draw(WIDTH, HIDDEN), "far": draw(WIDTH, HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
        "class": draw(HIDDEN, CLASSES + OTHER_CLASSES + 1), "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "member": draw(CLASSES, HIDDEN, FREQUENT // CLASSES, scale=0.1), "member_bias": member_bias,
    }
    model = Model(values, kind, place, within)
    if not len(windows):
        return model
    # ids that the sample doesn't have share one embedding
    sampled = np.unique(windows)
    common = values["embed"][sampled].mean(axis=0)
    rare = np.setdiff1d(np.arange(IDS), sampled)
    values["embed"][rare] = common
    learner = Learner(model)
    for step in range(1, steps + 1):
        rate = RATE * min(1.0, step / 20) * min(1.0, (steps - step + 1) / (steps * 0.5))
        learner.step(windows[rng.integers(0, len(windows), BATCH)], rate)
    return model


class Lesson:
    """Goes on with a model through streams of ids; each id is learned once, in windows without overlap."""

    def __init__(self, model: Model):
        self.learner, self.rng = Learner(model), np.random.default_rng(3)
        self.rest, self.held = [], 0
        self.weight = np.zeros(IDS)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held > MIXED * ALL_BATCH * CONTEXT:
            self._learn(False)

    def _learn(self, last: bool) -> None:
        ids = np.concatenate(self.rest)
        n = (len(ids) - 1) // CONTEXT
        windows = ids.take(self.rng.permutation(n)[:, None] * CONTEXT + np.arange(CONTEXT + 1))
        parts = [windows[lo : lo + ALL_BATCH] for lo in range(0, n, ALL_BATCH)]
        ids = ids[n * CONTEXT :]
        if last and len(ids) > 1:
            parts.append(ids[None])
            ids = ids[-1:]
        for part in parts:
            step = self.learner.steps
            share = part[:, 1:].size / (ALL_BATCH * CONTEXT)  # a small step's gradient is a rough one
            self.learner.step(part, ALL_RATE * min(1.0, (step + 1) / 20) / math.sqrt(1 + step / 100) * math.sqrt(share))
            self.weight += np.bincount(part[:, :-1].ravel(), minlength=IDS)
        self.rest, self.held = [ids], len(ids)

    def sums(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks, places in them and numbers: the values by how many ids they were learned from, then these weights.

        Each block holds ``ROWS_A_BLOCK`` embeddings, weighted by their own ids; block -1 all other values.
        """
        if self.held > 1:
            self._learn(True)
        total = self.weight.sum()
        if not total:
            return
        values = self.learner.model.values
        flat = np.concatenate([values[k].ravel() for k in sorted(values) if k != "embed"]).astype(float)
        yield -1, np.arange(len(flat) + 1), np.append(flat * total, total)
        at = np.flatnonzero(self.weight)
        for some in np.split(at, np.flatnonzero(np.diff(at // ROWS_A_BLOCK)) + 1):
            w = self.weight[some][:, None]
            x = np.concatenate([values["embed"][some] * w, w], axis=1)
            place = (some % ROWS_A_BLOCK)[:, None] * (WIDTH + 1) + np.arange(WIDTH + 1)
            yield int(some[0]) // ROWS_A_BLOCK, place.ravel(), x.ravel()


def merged(model: Model, sums: dict[int, np.ndarray]) -> Model:
    """``model`` with the weighted means of the values that the tasks have learned."""
    values = dict(model.values)
    if -1 in sums:
        flat, lo = sums[-1][:-1] / sums[-1][-1], 0
        for k in sorted(values):
            if k != "embed":
                values[k] = flat[lo : lo + values[k].size].reshape(values[k].shape).astype(np.float32)
                lo += values[k].size
    values["embed"] = values["embed"].copy()
    for block, x in sums.items():
        if block >= 0:
            x = x.reshape(ROWS_A_BLOCK, WIDTH + 1)
            at = np.flatnonzero(x[:, WIDTH])
            values["embed"][block * ROWS_A_BLOCK + at] = x[at, :WIDTH] / x[at, WIDTH:]
    return Model(values, model.kind, model.place, model.within)


BLOCKS = "block int, place binary, x binary"


def _blocks(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [(b, place.astype("<i4").tobytes(), x.astype("<f8").tobytes()) for b, place, x in found]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "place", "x"])


def summed(rows: DataFrame, size: Callable[[int], int]) -> dict[int, np.ndarray]:
    """The sums of the numbers ``x`` at each ``place`` of each block; a block of ``size(block)`` numbers is added up by one task."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block not in total:
                    total[block] = np.zeros(size(block))
                total[block][np.frombuffer(place, "<i4")] += np.frombuffer(x, "<f8")
        for block, x in total.items():
            at = np.flatnonzero(x)
            yield _blocks([(block, at, x[at])])

    result = {}
    for r in rows.repartition("block").mapInArrow(added, BLOCKS).collect():
        x = result[r.block] = np.zeros(size(r.block))
        x[np.frombuffer(r.place, "<i4")] = np.frombuffer(r.x, "<f8")
    return result


class Words(dict):
    """Ids of lower-cased words, each with a space in front, as little-endian 32-bit numbers; ``limit`` words are kept at most."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        self._encode = ranked(path if os.path.exists(path) else tokenizer_path(os.path.basename(path)))._core_bpe.encode_ordinary
        self._limit = limit

    def __missing__(self, word: bytes) -> bytes:
        ids = self._new(word)
        if len(word) <= 64 and self._limit:
            if len(self) >= self._limit:
                self.clear()
            self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        return array("I", self._encode(" " + word.decode("utf-8", "replace"))).tobytes()

    def text(self, words: list[bytes]) -> np.ndarray:
        """The ids of a text with an end before and after."""
        inner = np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u4")
        return np.concatenate([[END], inner, [END]]).astype(np.int64)


#: Marks the number of a word among ids.
NUMBER = 1 << 31


class NumberedWords(Words):
    """``Words`` with a word's number before its ids, so that one look gives both: its place in ``common`` from one on, else zero.

    The empty word is an end.
    """

    def __init__(self, path: str, common: dict[bytes, int]):
        super().__init__(path)
        self._numbers = {w: k for k, w in enumerate(common, 1)}
        self.logs = np.log10(np.array([0, *common.values()], dtype=float) + 1)  # by number

    def _new(self, word: bytes) -> bytes:
        ids = super()._new(word) if word else array("I", [END]).tobytes()
        return array("I", [NUMBER + self._numbers.get(word, 0)]).tobytes() + ids

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, and the words' numbers."""
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u4")
        ids = both < NUMBER
        return both[ids], both[~ids] - NUMBER


_WORKER: dict[str, NumberedWords] = {}


def worker_words(run: str, path: str, common: bytes) -> NumberedWords:
    """The words that a Python worker has met, over all its tasks of one run; ``common``: that dictionary, pickled."""
    if run not in _WORKER:
        _WORKER.clear()
        _WORKER[run] = NumberedWords(path, pickle.loads(common))
    return _WORKER[run]


def split(data: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, ASCII white space splits."""
    return data.lower().split()


def held_out(parts: int = 7, out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == out, F.lit(False))


def word_counts(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """word (binary), n over all texts of ``docs``; the end of a text is the empty word. A task holds ``held`` words at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for data in batch.column(0):
                counts.update(split(data.as_py()))
                counts[b""] += 1
                if len(counts) > held:
                    yield rows()
        if counts:
            yield rows()

    return docs.select(utf8("text").alias("data")).mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs in the corpus whose word counts are ``counts``; at most ``IDS`` numbers come back."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Words(path, 0), np.zeros(IDS)
        for f in frames:
            ids = [np.frombuffer(words[bytes(w)], dtype="<u4") if w else np.array([END]) for w in f["word"]]
            total += np.bincount(np.concatenate(ids).astype(np.int64), np.repeat(f["n"].to_numpy(), [len(i) for i in ids]), IDS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at].astype(np.int64)})

    rows = counts.mapInPandas(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    result = np.zeros(IDS)
    result[rows["id"].to_numpy(dtype=np.int64)] = rows["n"]
    return result


def common_words(counts: DataFrame, most: int = COMMON) -> pd.DataFrame:
    """The most frequent words with their counts, ``most`` at most: all words from the least count on for which so many suffice."""
    levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).toPandas()
    levels = levels.sort_values("level", ascending=False)
    fitting = levels[levels["words"].cumsum() <= most]
    least = int(fitting["least"].min()) if len(fitting) else -1
    return counts.where(F.col("n") >= least if least > 0 else F.lit(False)).toPandas()


def keep_memory() -> None:
    """Lets the C library keep memory that arrays give back, up to twice the block that is freed here.

    Else it goes back to the system at every step, which hands it out again cleared, page by page.
    """
    bytearray((32 << 20) - (1 << 16))


def _encoded(rows: DataFrame, counts: np.ndarray, common: dict[bytes, int], norm: float, path: str) -> DataFrame:
    """One pass over the texts of ``rows`` (doc_id, held_out, row, learned, data), whose result has rows of three kinds.

    Those with ``ids`` are texts (16-bit numbers, with an end): where ``row`` is not null with their tokens, how many of these are
    ``common`` and their base score. Those with a ``word`` tell how often a row has another word. Those with a ``block`` are
    ``Followers`` of the learned texts.
    """
    run, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast((counts, pickle.dumps(common)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, known = sent.value
        words, followers, blocks, fields = worker_words(run, path, known), Followers(frequency), ROWS_A_BLOCK * 2 * HUBS, []

        def found(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in fields], [name for name, _ in fields])

        for batch in batches:
            doc_id = ("doc_id", batch.schema.field("doc_id").type)
            fields = [doc_id, *ENCODED]
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, sizes, knowns, bases, rare = [], [], [], [], ([], [], [])
                for row, value in zip(part.column("row").to_pylist(), part.column("data"), strict=True):
                    w = [*split(value.as_py()), b""]
                    ids, numbers = words.numbered(w)
                    texts.append(ids)
                    sizes.append(len(w))
                    knowns.append(np.count_nonzero(numbers))
                    bases.append(words.logs.take(numbers).sum() - norm * len(w))
                    if row is not None and knowns[-1] < len(w):
                        others = Counter([w[i] for i in np.flatnonzero(numbers == 0)])
                        rare[0].extend([row] * len(others))
                        rare[1].extend(others.keys())
                        rare[2].extend(others.values())
                learned = [t for t, yes in zip(texts, part.column("learned").to_pylist(), strict=True) if yes]
                if learned:
                    followers.add(np.concatenate([[END], *learned], dtype=np.int64))
                yield found(
                    part.num_rows, **{k: part.column(k) for k in ("doc_id", "held_out", "row", "learned")},
                    n_tokens=pa.array(sizes, pa.int64()), known=pa.array(knowns, pa.int64()), base=pa.array(bases, pa.float64()),
                    ids=pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary()),
                )
                if rare[0]:
                    yield found(len(rare[0]), row=pa.array(rare[0], pa.int64()), word=pa.array(rare[1], pa.binary()), k=pa.array(rare[2], pa.int64()))
        at = np.flatnonzero(followers.table)
        if len(at):
            b = _blocks((int(some[0]) // blocks, some % blocks, followers.table[some]) for some in np.split(at, np.flatnonzero(np.diff(at // blocks)) + 1))
            yield found(b.num_rows, **dict(zip(b.schema.names, b.columns, strict=True)))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        encoded,
        f"doc_id {kind}, held_out boolean, row bigint, learned boolean, n_tokens bigint, known bigint, base double, ids binary, word binary, k bigint, " + BLOCKS,
    )


#: Columns of ``_encoded`` after doc_id.
ENCODED = [
    ("held_out", pa.bool_()), ("row", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
    ("ids", pa.binary()), ("word", pa.binary()), ("k", pa.int64()), ("block", pa.int32()), ("place", pa.binary()), ("x", pa.binary()),
]


def learn(rows: DataFrame, windows: np.ndarray, counts: np.ndarray) -> Model:
    """A model of all learned texts of ``rows`` (``_encoded``), whose ids' counts are ``counts``.

    It starts with ``windows``, some of the texts; then every task goes on from there through all its texts, and the means of
    what they have learned, weighted by the ids that they have learned it from, are the model.
    """
    size = ROWS_A_BLOCK * 2 * HUBS
    followers = summed(rows.where("block is not null").select("block", "place", "x"), lambda block: size)
    table = np.zeros(-(-len(leading(counts)) // ROWS_A_BLOCK) * size)
    for block, x in followers.items():
        table[block * size : (block + 1) * size] = x
    start = train(windows, counts, table=table[: len(leading(counts)) * 2 * HUBS])
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(start))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        lesson = Lesson(pickle.loads(sent.value))
        lesson.add(np.array([END]))
        for batch in batches:
            for ids in batch.column(0):
                lesson.add(np.frombuffer(ids.as_py(), "<u2").astype(np.int64))
        for found in lesson.sums():
            yield _blocks([found])

    others = sum(x.size for k, x in start.values.items() if k != "embed") + 1
    sums = summed(rows.where("learned and ids is not null").select("ids").mapInArrow(learned, BLOCKS), lambda block: others if block < 0 else ROWS_A_BLOCK * (WIDTH + 1))
    return merged(start, sums)


def score_documents(docs: DataFrame, training: DataFrame | Column, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    ``training`` are the rows that are learned from, whole and each once: words, ids and their followers are counted, and the
    model's other parameters are trained on all ids (``learn``). A condition on ``docs`` in its place means those rows of
    ``docs``, whose texts are then encoded once for both. Tokens are lower-cased words and one end; base_score is the
    add-one unigram score over them, score the model's log10 probability of the text's subword ids and its end, each
    scored once within overlapping windows. Null and empty texts are an end alone. Repeated rows stay; other columns are
    not looked at; no rows give no rows.

    The corpus's word counts are a table. The ``COMMON`` most frequent ones are with every task; the other words of the
    documents are joined with it, so no vocabulary is held whole anywhere.
    """
    file = path or tokenizer_path(VOCABULARY)
    data = utf8("text")
    both = isinstance(training, Column)
    rows = docs.select(
        "doc_id", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"),
        (F.coalesce(training, F.lit(False)) if both else F.lit(False)).alias("learned"), data.alias("data"),
    )
    if both:
        training = docs.where(training)
    else:
        only = {"doc_id": F.lit(None), "held_out": F.lit(None), "row": F.lit(None), "learned": F.lit(True), "data": data}
        rows = rows.union(training.select(*(c.cast(rows.schema[k].dataType).alias(k) for k, c in only.items())))
    counts = stored(word_counts(training), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = math.log10(n + v + 1)
    frequent = common_words(counts)
    known = {bytes(w): int(c) for w, c in zip(frequent["word"], frequent["n"], strict=True)}
    h = F.xxhash64(F.lit(29), "doc_id", "text")
    at = F.pmod(h, F.greatest(F.octet_length(data) - STRETCH, F.lit(0)) + 1).cast("int") + 1
    ends = counts.where(F.col("word") == F.lit(b"")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sample = drawn(training.select(h.alias("h"), F.substring(data, at, F.lit(STRETCH)).alias("data")), SAMPLE, ends).toPandas()
    words = Words(file)
    windows = [ids[lo : lo + CONTEXT + 1] for d in sample["data"] for ids in [words.text(split(bytes(d)))] for lo in range(0, len(ids) - CONTEXT, CONTEXT)]
    windows = np.array(windows, dtype=np.int64).reshape(-1, CONTEXT + 1)
    frequency = id_counts(counts, file)
    rows = stored(_encoded(rows, frequency, known, norm, file), "texts", "zstd")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(rows, windows, frequency)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        net = pickle.loads(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [np.concatenate([[END], np.frombuffer(ids.as_py(), "<u2")]) for ids in part.column("ids")]
                yield part.drop_columns(["ids"]).append_column("score", pa.array(net.score(texts), pa.float64()))

    texts = rows.where("ids is not null and row is not null").select("doc_id", "held_out", "row", "n_tokens", "known", "base", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = stored(texts.mapInArrow(scored, f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, score double"), "scores")
    others = rows.where("word is not null").select("row", "word", "k").join(counts, "word")
    others = others.groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("add"))
    return texts.join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score",
    )
