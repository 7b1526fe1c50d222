"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. In each window a gated recurrent layer
runs in either direction; their states at a byte give that byte's probabilities of every language.
A document's probability is the mean over all its bytes. The network is trained on the driver by
backpropagation through time on windows drawn from all places of a bounded, balanced sample of the
labelled documents outside the held-out fold; its tables (some 60 kB) go out with the tasks. Texts of
any length are labelled byte by byte, some thousand windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.quality_classifier import in_fold
from strataq.llm.textstats import unpacked
from strataq.storage import read_table

WINDOW = 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Beyond MAX_LANGS languages raise; beyond FEW the sample is dealt out among them, and training takes more steps.
MAX_LANGS, FEW = 1000, 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Input table, recurrent weights and output weights; the first axis of the former two is the direction."""

    langs: list[str]
    table: np.ndarray  # [2, 257, 3 * hidden]; byte 256 stands for no byte
    recur: np.ndarray  # [2, hidden, 3 * hidden]
    out: np.ndarray  # [2 * hidden + 1, langs]

    @staticmethod
    def start(langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(langs, f(2, 257, 3 * hidden, scale=0.3), f(2, hidden, 3 * hidden, scale=hidden**-0.5), f(2 * hidden + 1, len(langs), scale=0.1))

    def states(self, x: np.ndarray, size: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """States [places, windows, 2 * hidden] of windows of bytes [windows, places]; ``size`` where some are shorter."""
        b, t = x.shape
        h = self.recur.shape[1]
        out = np.empty((t, b, 2 * h), np.float32)
        for d in (0, 1):
            state = np.zeros((b, h), np.float32)
            for s in range(t) if d == 0 else range(t - 1, -1, -1):
                a = np.take(self.table[d], x[:, s], axis=0)
                g = state @ self.recur[d]
                gates = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                n = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
                new = n + z * (state - n)
                if size is not None:
                    new *= (s < size)[:, None]
                if trace is not None:
                    trace.append((d, s, state, z, r, n, g[:, 2 * h :]))
                state = new
                out[s, :, d * h : (d + 1) * h] = state
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.out[:-1] + self.out[-1]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes and its gradients, by backpropagation through time."""
        b, t = x.shape
        h = self.recur.shape[1]
        trace: list = []
        states = self.states(x, trace=trace)
        p = self.probabilities(states)
        loss = -float(np.log(p[:, np.arange(b), y] + 1e-9).mean())
        d_logit = p
        d_logit[:, np.arange(b), y] -= 1
        d_logit /= b * t
        flat = states.reshape(-1, 2 * h)
        d_out = np.vstack([flat.T @ d_logit.reshape(-1, p.shape[2]), d_logit.sum((0, 1))[None]])
        d_states = d_logit @ self.out[:-1].T
        d_table, d_recur = np.zeros_like(self.table), np.zeros_like(self.recur)
        carry = np.zeros((2, b, h), np.float32)
        d_in = np.empty((2, t, b, 3 * h), np.float32)
        for d, s, state, z, r, n, gn in reversed(trace):
            dh = d_states[s, :, d * h : (d + 1) * h] + carry[d]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            d_in[d, s] = np.concatenate([dz, dr, dn], axis=1)
            d_recur[d] += state.T @ dg
            carry[d] = dh * z + dg @ self.recur[d].T
        codes = x.T.reshape(-1)
        for d in (0, 1):
            for k in range(3 * h):
                d_table[d, :, k] = np.bincount(codes, weights=d_in[d, :, :, k].reshape(-1), minlength=257)
        return loss, [d_table, d_recur, d_out]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam with a rate that falls to a tenth."""
        rng = np.random.default_rng(seed)
        params = [self.table, self.recur, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(steps):
            some = rng.integers(0, len(x), min(batch, len(x)))
            _, grads = self.gradients(x[some], y[some])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step = rate * (1 - 0.9 * k / steps)
            for i, (p, g) in enumerate(zip(params, grads)):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p -= (step * (m[i] / (1 - 0.9 ** (k + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (k + 1))) + 1e-8)).astype(np.float32)

    def documents(self, data: np.ndarray, bounds: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Mean probabilities [documents, langs] over all bytes of the documents that ``bounds`` cuts ``data`` into; 0 for empty ones."""
        sizes = np.diff(bounds)
        windows = -(-sizes // WINDOW)
        chunk = max(1, chunk * FEW // max(FEW, len(self.langs)))
        owner = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = bounds[:-1][owner] + place * WINDOW
        length = np.minimum(WINDOW, bounds[1:][owner] - start)
        sums = np.zeros((len(sizes), len(self.langs)))
        full, part = np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)
        part = part[np.argsort(length[part], kind="stable")]
        for some in (full, part):
            for at in range(0, len(some), chunk):
                w = some[at : at + chunk]
                width = int(length[w].max())
                cols = np.arange(width)
                whole = length[w].min() == width
                inside = cols[None, :] < length[w][:, None]
                x = data[start[w][:, None] + np.where(inside, cols[None, :], 0)].astype(np.int64)
                if not whole:
                    x[~inside] = 256
                p = self.probabilities(self.states(x, None if whole else length[w]))
                if not whole:
                    p *= inside.T[:, :, None]
                # Windows of the same document add up.
                total = p.sum(0, dtype=np.float64)
                for k in range(total.shape[1]):
                    sums[:, k] += np.bincount(owner[w], weights=total[:, k], minlength=len(sizes))
        return sums / np.maximum(sizes, 1)[:, None]


def draw(docs: DataFrame, per_lang: int, windows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows of bytes and their labels: at most about ``per_lang`` documents a language
    (FEW times that in all), chosen by hash, and ``windows`` places of each, over its whole length."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    counts = [(r[0], r[1]) for r in known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()]
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: group them first")
    langs = sorted(k for k, _ in counts)
    if not langs:
        return [], np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    per_lang = min(per_lang, max(1, per_lang * FEW // len(langs)))
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts for v in (k, min(1_000_000, -(-1_000_000 * per_lang // n))))), F.col("lang"))
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000))
    some = known.where(chance < share).select("doc_id", "lang", F.col("text").cast("binary").alias("b"))
    last = F.greatest(F.octet_length("b") - WINDOW, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), last) + 1 for k in range(windows)]
    drawn = some.where(F.octet_length("b") > 0).select("doc_id", "lang", F.array(*(F.substr("b", p.cast("int"), F.lit(WINDOW)) for p in places)).alias("w"))
    rows = drawn.orderBy("doc_id").limit(2 * per_lang * max(FEW, len(langs))).collect()
    x = np.full((len(rows) * windows, WINDOW), 256, np.int64)
    y = np.zeros(len(x), np.int64)
    for i, r in enumerate(rows):
        for j, w in enumerate(r["w"]):
            x[i * windows + j, : len(w)] = np.frombuffer(bytes(w), np.uint8)
            y[i * windows + j] = langs.index(r["lang"])
    return langs, x, y


def fit(docs: DataFrame, per_lang: int = 1500, windows: int = 6, hidden: int = 8, steps: int = 400, batch: int = 256, seed: int = 7) -> Network | None:
    """A network trained on ``docs`` (doc_id, text, lang) outside the held-out fold; None without such rows."""
    langs, x, y = draw(docs, per_lang, windows)
    if not len(x):
        return None
    net = Network.start(langs, hidden, seed)
    net.train(x, y, steps * max(FEW, len(langs)) // FEW, batch, 0.02, seed)
    return net


def identify(docs: DataFrame, keep: list[Column], net: Network | None) -> DataFrame:
    """``keep``, lang_pred, score for every row of ``docs`` (text).

    Every byte of every text is labelled; equal texts get equal results. ``und`` with score 0 if the
    text is null, has no letter or nothing could be learned. A kept column named like a result gives
    way to it. Empty tables give no rows.
    """
    text = docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column("_text").to_pylist()
                speaks = [bool(LETTER.search(t)) for t in texts]
                raw = [t.encode() if ok else b"" for t, ok in zip(texts, speaks)]
                if net is None or not any(speaks):
                    lang, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
                else:
                    p = net.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
                    best = p.argmax(1)
                    lang = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), speaks)]
                    score = np.clip(np.where(speaks, p[np.arange(len(p)), best], 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(lang), pa.array(score, pa.float64())], names=["_row", "lang_pred", "score"])

    row = text.schema["_row"].dataType.simpleString()
    return unpacked(text.mapInArrow(run, f"_row {row}, lang_pred string, score double"), "lang_pred", "score", names=("lang_pred", "score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, [F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), 3, 1).alias("held_out")], fit(docs))
