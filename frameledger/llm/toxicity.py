"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs are words: a hashed word vector and the mean of hashed character n-gram vectors. The network reads
windows of LENGTH words that overlap by half and cover the whole text; a text's score is that of its
most toxic window. It is trained on window level with the text's label: in each round the windows
that the present network finds most toxic in each text stand for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bound_batches, frugal

#: Words in a window, step between windows, sizes of the hashed tables, of a vector and of the state.
LENGTH, STRIDE = 32, 16
WORDS, GRAMS, DIM, STATE = 1 << 13, 1 << 13, 8, 8
#: Bytes of a word, marked ends included, whose character 4-grams are read; the word itself is hashed whole.
#: Longer words are read in parts: between joining characters, then in pieces that share GRAM - 1 characters.
BYTES, GRAM = 24, 4
JOINED = re.compile("([!-/:-@\\[-`{-~\u200b-\u200d\u2060\ufeff]+)")
#: Documents of each class at most that the network is fitted on; the choice is by a hash of doc_id.
MOST_TRAINING = 900
#: Rounds of training, and passes over the chosen windows in each.
ROUNDS, PASSES = 4, 4
THRESHOLD = 0.7
EDGE = ".,;:!?\"'()[]{}*%$&#-"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each lower-cased word, and the buckets of its character n-grams; GRAMS stands for none."""
    bare = [w.strip(EDGE).encode() for w in words]
    bucket = np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) % WORDS
    marked = np.array([b"<" + w + b">" for w in bare], f"S{BYTES}")
    length = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    byte = marked.view(np.uint8).reshape(len(bare), BYTES).astype(np.uint32)
    slots = BYTES - GRAM + 1
    hashed = np.zeros((len(bare), slots), np.uint32)
    for i in range(GRAM):
        hashed = (hashed ^ byte[:, i : i + slots]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
    grams = ((hashed ^ (hashed >> np.uint32(15))) % GRAMS).astype(np.int16)
    grams[np.arange(slots)[None, :] >= np.maximum(1, length - GRAM + 1)[:, None]] = GRAMS
    return bucket, grams


def too_long(word: str) -> bool:
    return len(word) * 4 > BYTES - 2 and len(word.strip(EDGE).encode()) > BYTES - 2


def parts(word: str) -> list[str]:
    """A word that is too long as words that aren't, in which all its bytes and 4-grams lie."""
    out = []
    for run in filter(None, JOINED.split(word)):
        size = BYTES - 2 if run.isascii() else (BYTES - 2) // 4
        step = size - GRAM + 1
        out += [run[i : i + size] for i in range(0, max(1, len(run) - GRAM + 1), step)] if too_long(run) else [run]
    return out


class Vocabulary:
    """Distinct words and their features, in the order met."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.bucket = np.zeros(0, np.int64)
        self.grams = np.zeros((0, BYTES - GRAM + 1), np.int16)

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        if long := {w: parts(w) for w in set().union(*split) - self.code.keys() if too_long(w)}:
            split = [words if long.keys().isdisjoint(words) else [p for w in words for p in long.get(w, (w,))] for words in split]
        if new := sorted(set().union(*split) - self.code.keys()):  # the same order in every run
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            bucket, grams = features(new)
            self.bucket, self.grams = np.concatenate([self.bucket, bucket]), np.concatenate([self.grams, grams])
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []

    def inputs(self, p: dict[str, np.ndarray], words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Word vectors: the hashed word's, and the mean of its hashed n-grams'."""
        bucket, grams = self.bucket[words], self.grams[words]
        total = p["gram"][grams[:, 0]]
        for i in range(1, grams.shape[1]):
            total = total + p["gram"][grams[:, i]]
        return np.concatenate([p["word"][bucket], total / (grams < GRAMS).sum(1, keepdims=True, dtype=np.float32)], axis=1)


def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all windows of a text and their lengths. The last window ends with the text."""
    n = len(codes)
    if n <= LENGTH:
        out = np.zeros((1, LENGTH), np.int64)
        out[0, :n] = codes
        return out, np.array([n])
    start = np.append(np.arange(0, n - LENGTH, STRIDE), n - LENGTH)
    return codes[start[:, None] + np.arange(LENGTH)], np.full(len(start), LENGTH)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def run(p: dict, projected: np.ndarray, codes: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logit of each window. projected: (2, words, 3 * STATE), what each word adds to the gates of both directions."""
    size, steps = codes.shape
    h = np.zeros((2, size, STATE), np.float32)
    states = np.zeros((steps, 2, size, STATE), np.float32)
    full = bool((length == steps).all())
    trace = []
    for s in range(steps):
        places = (s, steps - 1 - s)
        gate = np.stack([projected[d][codes[:, t]] for d, t in enumerate(places)])
        mask = None if full else np.stack([(t < length)[:, None] for t in places])
        own = h @ p["recur"]
        zr = sigmoid(gate[..., : 2 * STATE] + own[..., : 2 * STATE])
        z, r = zr[..., :STATE], zr[..., STATE:]
        new = np.tanh(gate[..., 2 * STATE :] + r * own[..., 2 * STATE :])
        nxt = new + z * (h - new)
        if mask is not None:
            nxt = np.where(mask, nxt, h)
        if keep:
            trace.append((h, z, r, new, own[..., 2 * STATE :], mask))
        h = nxt
        for d, t in enumerate(places):
            states[t, d] = h[d]
    both = np.concatenate([states[:, 0], states[:, 1]], axis=2)
    attention = both @ p["attend"]
    if not full:
        attention = np.where(np.arange(steps)[:, None] < length[None, :], attention, np.float32(-1e9))
    weight = np.exp(attention - attention.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, both) * (length > 0)[:, None]
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (trace, both, weight, pooled)) if keep else logit


def backward(p: dict, kept: tuple, slope: np.ndarray, codes: np.ndarray, length: np.ndarray, vocabulary: int) -> dict[str, np.ndarray]:
    """Gradients given d loss / d logit."""
    trace, both, weight, pooled = kept
    steps, size = weight.shape
    slope = slope * (length > 0)
    grad = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
    d_pooled = slope[:, None] * p["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
    d_attention = weight * (d_weight - (weight * d_weight).sum(0))
    grad["attend"] = np.einsum("tb,tbh->h", d_attention, both)
    d_both = weight[..., None] * d_pooled + d_attention[..., None] * p["attend"]
    grad["recur"] = np.zeros_like(p["recur"])
    gates, words = ([], []), ([], [])
    dh = np.zeros((2, size, STATE), np.float32)
    for s in reversed(range(steps)):
        places = (s, steps - 1 - s)
        h, z, r, new, own, mask = trace[s]
        dh = dh + np.stack([d_both[places[0], :, :STATE], d_both[places[1], :, STATE:]])
        step = dh if mask is None else np.where(mask, dh, 0)
        d_new = step * (1 - z) * (1 - new**2)
        d_z = step * (h - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        d_own = np.concatenate([d_z, d_r, d_new * r], axis=2)
        d_gate = np.concatenate([d_z, d_r, d_new], axis=2)
        grad["recur"] += h.transpose(0, 2, 1) @ d_own
        dh = d_own @ p["recur"].transpose(0, 2, 1) + step * z + (0 if mask is None else np.where(mask, 0, dh))
        for d, t in enumerate(places):
            gates[d].append(d_gate[d])
            words[d].append(codes[:, t])
    grad["projected"] = np.stack([added(np.concatenate(words[d]), np.concatenate(gates[d]), vocabulary) for d in range(2)])
    return grad


def added(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their index."""
    return np.stack([np.bincount(at, rows[:, i], size) for i in range(rows.shape[1])], axis=1).astype(np.float32)


def project(p: dict, inputs: np.ndarray) -> np.ndarray:
    return np.stack([inputs @ p["gates"][d] + p["gate_bias"][d] for d in range(2)])


def log_odds(index: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of each bucket's presence in toxic against other texts; 0 where fewer than three texts have it."""
    count = np.zeros((2, size))
    for own, label in zip(index, labels, strict=True):
        count[int(label), own] += 1
    share = (count + 1) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 2)
    return np.where(count.sum(0) >= 3, np.log(share[1] / share[0]), 0).astype(np.float32)


def train(texts: list[str], labels: list[int], prior: float, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of a network fitted on whole texts. prior: share of toxic documents, to which the bias is set."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    vocabulary = Vocabulary()
    codes = vocabulary.codes(texts)
    normal = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    p = {
        "word": normal(WORDS, DIM, scale=0.05), "gram": normal(GRAMS + 1, DIM, scale=0.05), "gates": normal(2, 2 * DIM, 3 * STATE, scale=0.3), "gate_bias": np.zeros((2, 3 * STATE), np.float32),
        "recur": normal(2, STATE, 3 * STATE, scale=0.3), "attend": normal(2 * STATE, scale=0.3), "out": normal(2 * STATE, scale=0.3), "bias": np.zeros(1, np.float32),
    }
    seen = [np.unique(c) for c in codes]
    p["word"][:, 0] = 0.5 * log_odds([np.unique(vocabulary.bucket[c]) for c in seen], y, WORDS)
    p["gram"][:, 0] = 0.5 * log_odds([np.unique(vocabulary.grams[c]) for c in seen], y, GRAMS + 1)
    p["gram"][GRAMS] = 0
    pieces = [windows(c) for c in codes]
    all_codes, all_length = np.concatenate([c for c, _ in pieces]), np.concatenate([n for _, n in pieces])
    owner = np.repeat(np.arange(len(pieces)), [len(n) for _, n in pieces])
    first = vocabulary.inputs(p)
    score = np.sort((first[:, 0] + first[:, DIM])[all_codes] * (np.arange(LENGTH) < all_length[:, None]), axis=1)[:, -4:].sum(1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        order = np.lexsort((-score, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[place < 2]
        for _ in range(PASSES):
            for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 96)):
                step += 1
                own, at = np.unique(all_codes[batch], return_inverse=True)
                at = at.reshape(all_codes[batch].shape)
                grams = vocabulary.grams[own].astype(np.int64)
                x = vocabulary.inputs(p, own)
                projected = project(p, x)
                logit, kept = run(p, projected, at, all_length[batch], keep=True)
                target = y[owner[batch]]
                grad = backward(p, kept, ((sigmoid(logit) - target) / len(batch)).astype(np.float32), at, all_length[batch], len(own))
                d = grad.pop("projected")
                grad["gates"] = np.stack([x.T @ d[i] for i in range(2)])
                grad["gate_bias"] = d.sum(1)
                dx = d[0] @ p["gates"][0].T + d[1] @ p["gates"][1].T
                each = dx[:, DIM:] / (grams < GRAMS).sum(1, keepdims=True)
                grad["word"] = added(vocabulary.bucket[own], dx[:, :DIM], WORDS)
                grad["gram"] = added(grams.ravel(), np.repeat(each, grams.shape[1], axis=0), GRAMS + 1)
                grad["gram"][GRAMS] = 0
                rate = 0.01 * (1 - turn / (rounds + 1))
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.005 * (g * g - v)
                    p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
        projected = project(p, vocabulary.inputs(p))
        score = np.concatenate([run(p, projected, all_codes[i : i + 2048], all_length[i : i + 2048]) for i in range(0, len(owner), 2048)])
    share = float(y.mean())
    p["bias"] = p["bias"] + np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return p


class Scorer:
    """Scores texts; the projections of distinct words are kept up to a bound."""

    def __init__(self, parameters: dict[str, np.ndarray], most: int = 80_000):
        self.p, self.most = parameters, most
        self.clear()

    def clear(self) -> None:
        self.vocabulary = Vocabulary()
        self.projected = np.zeros((2, 1 << 12, 3 * STATE), np.float32)
        self.done = 0

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.vocabulary.bucket) > self.most:
            self.clear()
        pieces = [windows(c) for c in self.vocabulary.codes(texts)]
        known = len(self.vocabulary.bucket)
        if known > self.projected.shape[1]:
            wider = np.zeros((2, known + known // 4, 3 * STATE), np.float32)
            wider[:, : self.done] = self.projected[:, : self.done]
            self.projected = wider
        if known > self.done:
            self.projected[:, self.done : known] = project(self.p, self.vocabulary.inputs(self.p, slice(self.done, known)))
            self.done = known
        codes, length = (np.concatenate(x) for x in zip(*pieces, strict=True))
        owner = np.repeat(np.arange(len(pieces)), [len(n) for _, n in pieces])
        logit = np.empty(len(owner), np.float32)
        short = length < LENGTH
        for group in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(group), 2048):
                own = group[i : i + 2048]
                logit[own] = run(self.p, self.projected, codes[own], length[own])
        best = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(pieces))))
        return 1 / (1 + np.exp(-best.astype(np.float64)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | float:
    """A network fitted on at most MOST_TRAINING labelled documents of each class, none of them held out.

    Where one class has no document there is nothing to learn: the share of toxic labels is returned.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_TRAINING)
    chosen = pick(0).unionAll(pick(1))  # 2 * MOST_TRAINING rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in rows}) < 2:
        return prior if sum(counts.values()) else 0.0
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], prior)


def scorer(docs: DataFrame, labels: DataFrame):
    """A function from a text column to a score column, fitted on docs and labels."""
    model = fit(docs, labels)
    if isinstance(model, float):
        return lambda text: F.lit(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    bound_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(sent.value)
        for texts in batches:
            step = max(1, int(len(texts) * (2 << 20) / max(1, texts.nbytes)))
            parts = [own.score(texts.slice(i, step).to_pylist()) for i in range(0, len(texts), step)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from frugal(scored(batches))

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score from 0 to 1, predicted (1 if score >= THRESHOLD).

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1; the score is a function of
    the whole text alone. A document with several labels is toxic if one of them says so; null labels are
    ignored. A null text counts as empty and, like any text without words, scores what the bias gives.
    A null doc_id is not held out. Repeated rows each give a row; an empty table gives no rows; other
    columns have no effect. Without labels of both classes all scores are the share of toxic labels.
    """
    score = scorer(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
