"""Language of whole texts by a bidirectional gated recurrent network over bytes (operator 4)."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import drawn, utf8

#: Texts that the network is trained on at most, those with the smallest hashes; of each a stretch of so many bytes.
SAMPLE, STRETCH = 4_000, 256
#: State size of each direction, bytes unrolled in training and in prediction, windows worked on at once.
STATE, UNROLL, WINDOW, AT_ONCE = 8, 64, 256, 2048
STEPS, BATCH, RATE = 350, 128, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_COUNTS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)], dtype=np.float32)


@dataclass
class Network:
    """Two gated recurrent layers, one reading forwards and one backwards, and a softmax at every byte.

    Gates are clipped lines instead of sigmoids and tanh, which costs a third of the time. Arrays have the direction first.
    """

    languages: list[str]
    table: np.ndarray  # 2, 256, 3 * state: what a byte adds to the update gate, reset gate and candidate
    inner: np.ndarray  # 2, 3 * state, state
    out: np.ndarray  # 2, languages, state
    bias: np.ndarray  # languages

    def _steps(self, data: np.ndarray, active: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
        """Per-direction logits (2, steps, languages, windows), the second direction in reading order; states for training.

        data: 2, steps, windows; active: windows at each step, the first so many ones, or None for all.
        """
        _, steps, windows = data.shape
        n = self.inner.shape[2]
        h = np.zeros((2, n, windows), np.float32)
        logits = np.zeros((2, steps, len(self.languages), windows), np.float32)
        kept = []
        for t in range(steps):
            w = windows if active is None else int(active[t])
            x = np.empty((2, 3 * n, w), np.float32)
            x[0] = self.table[0].take(data[0, t, :w], axis=0).T
            x[1] = self.table[1].take(data[1, t, :w], axis=0).T
            last = h[:, :, :w]
            g = np.matmul(self.inner, last)
            gates = x[:, : 2 * n]
            gates += g[:, : 2 * n]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            c = g[:, 2 * n :]
            raw = c.copy() if keep else None
            c *= gates[:, n:]
            c += x[:, 2 * n :]
            np.clip(c, -1, 1, out=c)
            new = last - c
            new *= gates[:, :n]
            new += c
            if keep:
                kept.append((last.copy(), gates, raw, c))
            if w == windows:
                h = new
            else:
                h[:, :, :w] = new
            np.matmul(self.out, new, out=logits[:, t, :, :w]) if w == windows else logits.__setitem__((slice(None), t, slice(None), slice(0, w)), np.matmul(self.out, new))
        return logits, kept

    def train_step(self, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions of equal windows, and gradients by backpropagation through time."""
        steps, windows = data.shape
        n = self.inner.shape[2]
        both = np.stack([data, data[::-1]])
        logits, kept = self._steps(both, None, True)
        z = logits[0] + logits[1][::-1] + self.bias[:, None]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        weight = 1.0 / (steps * windows)
        loss = -np.log(np.maximum(p[:, target, np.arange(windows)], 1e-9)).mean()
        p[:, target, np.arange(windows)] -= 1
        p *= weight
        d_table, d_inner, d_out = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.out)
        back = np.zeros((2, n, windows), np.float32)
        inner_t, out_t = self.inner.transpose(0, 2, 1), self.out.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            last, gates, raw, c = kept[t]
            u, r = gates[:, :n], gates[:, n:]
            h = (last - c) * u + c
            d = np.stack([p[t], p[steps - 1 - t]])
            d_out += np.matmul(d, h.transpose(0, 2, 1))
            back = back + np.matmul(out_t, d)
            d_c = back * (1 - u) * (np.abs(c) < 1)
            d_u = back * (last - c) * ((u > 0) & (u < 1)) * 0.25
            d_r = d_c * raw * ((r > 0) & (r < 1)) * 0.25
            d_x = np.concatenate([d_u, d_r, d_c], axis=1)
            d_g = np.concatenate([d_u, d_r, d_c * r], axis=1)
            d_inner += np.matmul(d_g, last.transpose(0, 2, 1))
            for k in range(2):
                np.add.at(d_table[k], both[k, t], d_x[k].T)
            back = back * u + np.matmul(inner_t, d_g)
        return float(loss), [d_table, d_inner, d_out, p.sum(axis=(0, 2))]

    def pooled(self, windows: list[bytes]) -> np.ndarray:
        """Per window the sum of its letters' probabilities of each language, and in the last column how many there are."""
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
        result = np.zeros((len(windows), len(self.languages) + 1))
        for lo in range(0, len(order), AT_ONCE):
            part = order[lo : lo + AT_ONCE]
            lengths = np.array([len(windows[i]) for i in part])
            steps = int(lengths[0])
            data = np.frombuffer(b"".join(windows[i].ljust(steps, b"\0") for i in part), np.uint8).reshape(len(part), steps).T.astype(np.intp)
            at = np.arange(steps)[:, None]
            mirror = np.maximum(lengths[None, :] - 1 - at, 0)
            both = np.stack([data, np.take_along_axis(data, mirror, axis=0)])
            active = (lengths[None, :] > at).sum(axis=1)
            logits, _ = self._steps(both, None if lengths[-1] == steps else active, False)
            if lengths[-1] == steps:
                z = logits[0] + logits[1][::-1]
            else:
                z = logits[0] + np.take_along_axis(logits[1], mirror[:, None, :], axis=0)
            z += self.bias[:, None]
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            counts = _COUNTS[data] * (lengths[None, :] > at)
            z *= (counts / z.sum(axis=1))[:, None, :]
            result[part, :-1] = z.sum(axis=0, dtype=np.float64).T
            result[part, -1] = counts.sum(axis=0)
        return result

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and the mean probability of it over the text's letters for each text; ``und`` and 1 without letters."""
        known = [t is not None and bool(_LETTER.search(t)) for t in texts]
        windows, owner = [], []
        for i, t in enumerate(texts):
            if known[i]:
                data = t.encode("utf-8", "replace")
                windows += [data[lo : lo + WINDOW] for lo in range(0, len(data), WINDOW)]
                owner += [i] * (len(windows) - len(owner))
        total = np.zeros((len(texts), len(self.languages) + 1))
        if windows:
            sums, owner = self.pooled(windows), np.array(owner)
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(owner, sums[:, k], len(texts))
        best = total[:, :-1].argmax(axis=1)
        score = total[np.arange(len(texts)), best] / np.maximum(total[:, -1], 1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(score, 0, 1), 1.0)


def train(stretches: list[bytes], languages: list[str], steps: int = STEPS, seed: int = 1) -> Network:
    """A network for the languages that occur, from stretches of text, by Adam over random windows."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    n = STATE
    net = Network(
        names,
        rng.normal(0, 0.4, (2, 256, 3 * n)).astype(np.float32),
        rng.normal(0, 0.4, (2, 3 * n, n)).astype(np.float32),
        rng.normal(0, 0.3, (2, len(names), n)).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    net.table[:, :, :n] += 2.0  # update gates begin nearly shut: the state lasts
    cuts = [(s[lo : lo + UNROLL], y) for s, y in zip(stretches, label, strict=True) for lo in range(0, max(len(s) - UNROLL, 0) + 1, UNROLL)]
    cuts = [(s, y) for s, y in cuts if len(s) == UNROLL]
    if not cuts or len(names) < 2:
        return net
    data = np.frombuffer(b"".join(s for s, _ in cuts), np.uint8).reshape(len(cuts), UNROLL).astype(np.intp)
    target = np.array([y for _, y in cuts])
    values = [net.table, net.inner, net.out, net.bias]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(cuts), BATCH)
        _, grads = net.train_step(np.ascontiguousarray(data[pick].T), target[pick])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = RATE * min(1.0, (steps - k + 1) / (steps * 0.4))
        for v, g, m, s in zip(values, grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id", parts: int = 3, out: int = 1) -> Column:
    """Whether a hash of the id keeps the document from being learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == out, F.lit(False))


def fit(docs: DataFrame, limit: int = SAMPLE) -> Network:
    """A network from at most ``limit`` rows of ``docs`` (doc_id, text, lang), chosen by a hash; null texts and langs are left out."""
    data = utf8("text")
    h = F.xxhash64(F.lit(23), "doc_id", "text")
    at = F.pmod(h, F.greatest(F.octet_length(data) - STRETCH, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where("text is not null and lang is not null").select("lang", h.alias("h"), F.substring(data, at, F.lit(STRETCH)).alias("data"))
    rows = drawn(rows, limit).toPandas()
    return train([bytes(x) for x in rows["data"]], rows["lang"].tolist())


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    Whole texts are read in windows of ``WINDOW`` bytes, every byte is labelled from both sides within its window, and the
    letters' probabilities are averaged over the document. Null texts and texts without a letter are ``und`` with score 1.
    No column but the text is used for a prediction. Repeated rows stay; other columns are not looked at; no rows give no
    rows. One pass without a shuffle; the network has a few thousand numbers.
    """
    sent = pickle.dumps(network)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = pickle.loads(sent)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if net.languages:
                    names, score = net.predict(part.column("text").to_pylist())
                else:
                    names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(labelled, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
