"""Toxicity of whole texts by a small recurrent network over overlapping windows.

A word's input is its embedding, if it is in the vocabulary of the training sample, next to the mean of
the embeddings of its character trigrams. A gated recurrent network reads each window in both
directions, attention pools its states, and a logistic unit scores the window. A text's score is that
of its worst window, calibrated on the training texts. Training, by backpropagation and Adam in
numpy, takes a bounded sample of labelled texts; of a toxic text it takes the window that scores
highest so far, since only some of its words are to blame.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import Slice, slices, word_hashes, words
from tessella.session import discard, materialize

#: Bounds of the training sample: texts of each label, characters of all, and of one.
SAMPLE_TEXTS, SAMPLE_CHARS = 2000, 32_000_000
SAMPLE_LONGEST = 1_000_000
WINDOW, STRIDE = 24, 12
HIDDEN, EMBED = 8, 8
VOCABULARY, TRIGRAMS = 4096, 2048
#: Training texts that a vocabulary word is in, at least.
LEAST_TEXTS = 3
#: Passes over the sample, and steps, to make at least; steps without a better validation loss that end training.
EPOCHS, STEPS, PATIENCE = 8, 600, 150

_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tokens:
    """Words of some texts: distinct kinds with their trigrams, the kind of each word, text bounds."""

    kinds: np.ndarray  # hashes of distinct words
    trigrams: np.ndarray
    firsts: np.ndarray  # where each kind's trigrams begin
    inverse: np.ndarray
    bounds: np.ndarray


def tokenize(part: Slice) -> Tokens:
    found = words(part, _SOLID)
    hashes = word_hashes(part, found, lower=True)
    kinds, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = found.starts[first], found.ends[first]
    length = ends - starts
    firsts = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(firsts, length) + np.repeat(starts, length)
    byte = _FOLD[part.data]
    before = np.where(at == np.repeat(starts, length), 60, byte[at - 1]) if len(at) else at
    after = np.where(at + 1 == np.repeat(ends, length), 62, byte[np.minimum(at + 1, len(byte) - 1)]) if len(at) else at
    key = (before * 65599 + byte[at]) * 65599 + after if len(at) else at
    return Tokens(kinds, (key ^ (key >> 13)) % TRIGRAMS, firsts, inverse, found.bounds)


def merged(parts: list[Tokens]) -> Tokens:
    """The tokens of several slices as those of one."""
    kinds, first, back = np.unique(np.concatenate([p.kinds for p in parts]), return_index=True, return_inverse=True)
    trigrams = np.concatenate([p.trigrams for p in parts])
    length = np.concatenate([np.diff(np.append(p.firsts, len(p.trigrams))) for p in parts])
    begin = (np.cumsum(length) - length)[first]
    size = length[first]
    firsts = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(firsts, size) + np.repeat(begin, size)
    shift = np.cumsum([0] + [len(p.kinds) for p in parts])
    inverse = np.concatenate([back[p.inverse + d] for p, d in zip(parts, shift)])
    counts = np.concatenate([np.diff(p.bounds) for p in parts])
    return Tokens(kinds, trigrams[at], firsts, inverse, np.concatenate([[0], np.cumsum(counts)]))


def window_table(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window; a text without words has one empty window."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return bounds[:-1][text] + at, np.minimum(n[text] - at, WINDOW), text


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        h, g, d = HIDDEN, 3 * HIDDEN, 2 * EMBED
        self.vocabulary = vocabulary  # sorted hashes
        self.p = {
            "word": draw(len(vocabulary) + 1, EMBED) * 0.3, "char": draw(TRIGRAMS, EMBED) * 0.3,
            "Wf": draw(d, g), "Uf": draw(h, g), "bf": np.zeros(g, np.float32), "Wb": draw(d, g), "Ub": draw(h, g), "bb": np.zeros(g, np.float32),
            "v": draw(2 * h), "w": draw(2 * h), "b": np.full(1, -1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def word_index(self, kinds: np.ndarray) -> np.ndarray:
        unknown = len(self.vocabulary)
        if not unknown or not len(kinds):
            return np.full(len(kinds), unknown, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, kinds), unknown - 1)
        return np.where(self.vocabulary[at] == kinds, at, unknown)

    def inputs(self, t: Tokens) -> np.ndarray:
        """Input of each kind; the last row, of zeros, pads windows."""
        x = np.zeros((len(t.kinds) + 1, 2 * EMBED), np.float32)
        if len(t.kinds):
            x[:-1, :EMBED] = self.p["word"][self.word_index(t.kinds)]
            x[:-1, EMBED:] = np.add.reduceat(self.p["char"][t.trigrams], t.firsts) / np.diff(np.append(t.firsts, len(t.trigrams)))[:, None]
        return x

    def direction(self, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
        """States [step, window, hidden] of one direction; ``keep`` gets what the gradient needs."""
        steps, n = ids.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((steps, n, HIDDEN), np.float32)
        for s in range(steps - 1, -1, -1) if backward else range(steps):
            x, hu = projected[ids[s]], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = np.where(mask[s][:, None], c + z * (h - c), h)
            if keep is not None:
                keep.append((s, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = states[s] = new
        return states

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        both = []
        for k, backward in (("f", False), ("b", True)):
            tape: list | None = [] if keep is not None else None
            both.append(self.direction(x @ p[f"W{k}"] + p[f"b{k}"], ids, mask, p[f"U{k}"], backward, tape))
            if keep is not None:
                keep[k] = tape
        h = np.concatenate(both, axis=2)
        e = np.where(mask, h @ p["v"], -1e9)
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(h=h, a=a, pooled=pooled)
        return pooled @ p["w"] + p["b"][0]

    def logits(self, t: Tokens, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text) of every window."""
        first, n, text = window_table(t.bounds)
        x = self.inputs(t)
        inverse = np.append(t.inverse, len(t.kinds))
        out = np.zeros(len(first), np.float32)
        for k in range(0, len(first), step):
            at, mask = self.place(first[k : k + step], n[k : k + step])
            ids = inverse[np.where(mask, at, len(inverse) - 1)]
            out[k : k + step] = self.forward(x, ids, mask)
        return out, text

    @staticmethod
    def place(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(max(1, int(n.max(initial=1))))[:, None]
        return first + steps, steps < n

    def scores(self, t: Tokens) -> np.ndarray:
        logit, text = self.logits(t)
        worst = np.maximum.reduceat(logit, np.flatnonzero(np.append(True, text[1:] != text[:-1]))) if len(logit) else logit
        return _sigmoid(self.scale * worst.astype(np.float64) + self.shift)

    # training ----------------------------------------------------------------------------------
    def gradient(self, t: Tokens, x: np.ndarray, first: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        p = self.p
        at, mask = self.place(first, n)
        ids = np.append(t.inverse, len(t.kinds))[np.where(mask, at, len(t.inverse))]
        keep: dict = {}
        logit = self.forward(x, ids, mask, keep)
        prob = _sigmoid(logit)
        total = weight.sum()
        loss = float(-(weight * np.log(np.where(y == 1, prob, 1 - prob) + 1e-9)).sum() / total)
        d = ((prob - y) * weight / total).astype(np.float32)
        h, a = keep["h"], keep["a"]
        g = {"w": keep["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["w"]
        da = (h * dpool).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        dh_all = a[:, :, None] * dpool + de[:, :, None] * p["v"]
        g["v"] = np.einsum("snh,sn->h", h, de)
        dx = np.zeros_like(x)
        for k, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p[f"U{k}"]
            du = np.zeros_like(u)
            dproj = np.zeros((len(x), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(first), HIDDEN), np.float32)
            for s, before, z, r, c, hu in reversed(keep[k]):
                dh = dh + dh_all[s][:, part]
                live = mask[s][:, None]
                dn = np.where(live, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (before - c) * z * (1 - z)
                dr = dc * hu * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(dproj, ids[s], gates)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                du += before.T @ inner
                dh = np.where(live, dn * z, dh) + inner @ u.T
            g[f"U{k}"] = du
            g[f"W{k}"], g[f"b{k}"] = x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"W{k}"].T
        return loss, g | {"x": dx[:-1]}

    def fit(self, t: Tokens, y: np.ndarray, prior: float, seed: int = 2) -> None:
        """Learn from texts ``t`` with labels ``y``; ``prior`` is the share of label 1 among all texts.

        Every fifth text is held back. The parameters of the epoch with the least loss there stay, and the
        held-back texts calibrate the scores.
        """
        rng = np.random.default_rng(seed)
        learn = np.arange(len(y)) % 5 != 4
        if len(np.unique(y[learn])) < 2 or len(np.unique(y[~learn])) < 2:
            learn[:] = True
        check = ~learn if not learn.all() else learn
        first, n, text = window_table(t.bounds)
        place = self.word_index(t.kinds)
        lengths = np.diff(np.append(t.firsts, len(t.trigrams)))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, best, stale, epoch = 0, None, 0, 0
        share = y[learn].mean() if learn.any() else 0.5
        weights = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        hint = self._word_hints(t, y, learn)
        seeds = np.flatnonzero(place < len(self.vocabulary))
        known = np.full(len(hint), -1.0)
        known[seeds] = hint[seeds]
        logit = np.full(len(first), -9.0)
        for s in range(WINDOW):
            inside = s < n
            logit[inside] = np.maximum(logit[inside], known[t.inverse[first[inside] + s]])
        self.p["word"][place[seeds], 0] = np.clip(hint[seeds], -1, 3)
        mine = np.flatnonzero(learn[text])
        while (epoch < EPOCHS or step < STEPS) and len(mine):
            epoch, began = epoch + 1, step
            order = mine[np.lexsort((-(logit[mine] + rng.random(len(mine)) * 1e-3), text[mine]))]
            top = order[np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))]
            extra = rng.choice(mine, min(len(mine), 2 * len(y)), replace=False)
            chosen = rng.permutation(np.concatenate([top, extra[y[text[extra]] == 0]]))
            for k in range(0, len(chosen), 128):
                c = chosen[k : k + 128]
                kinds = np.unique(np.concatenate([t.inverse[f : f + m] for f, m in zip(first[c], n[c])]))
                small = self._cut(t, kinds, first[c], n[c], lengths)
                at = np.cumsum(n[c]) - n[c]
                _, g = self.gradient(small, self.inputs(small), at, n[c], y[text[c]].astype(np.float32), weights[text[c]].astype(np.float32))
                dx = g.pop("x")
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                np.add.at(g["word"], self.word_index(small.kinds), dx[:, :EMBED])
                sizes = np.diff(np.append(small.firsts, len(small.trigrams)))
                np.add.at(g["char"], small.trigrams, np.repeat(dx[:, EMBED:] / sizes[:, None], sizes, axis=0))
                step += 1
                for name, v in self.p.items():
                    grad = np.clip(g[name], -1, 1) + (1e-3 if v.ndim == 2 else 1e-5) * v / len(y)
                    m, q = moments[name]
                    m += 0.1 * (grad - m)
                    q += 0.01 * (grad * grad - q)
                    v -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
            logit = self.logits(t)[0]
            loss = self._calibrate(logit, text, y, check, prior)
            if best is None or loss < best[0] - 1e-4:
                best, stale = (loss, {k: v.copy() for k, v in self.p.items()}, self.scale, self.shift), 0
            else:
                stale += step - began
                if stale >= PATIENCE and step >= STEPS // 3:
                    break
        if best:
            _, self.p, self.scale, self.shift = best

    def _cut(self, t: Tokens, kinds: np.ndarray, first: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> Tokens:
        size = lengths[kinds]
        firsts = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(firsts, size) + np.repeat(t.firsts[kinds], size)
        tokens = np.concatenate([t.inverse[f : f + m] for f, m in zip(first, n)] or [np.zeros(0, np.int64)])
        return Tokens(t.kinds[kinds], t.trigrams[at] if len(at) else t.trigrams[:0], firsts, np.searchsorted(kinds, tokens), np.zeros(1, np.int64))

    @staticmethod
    def _word_hints(t: Tokens, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Shrunken log odds of each kind between texts of label 1 and 0."""
        text = np.repeat(np.arange(len(y)), np.diff(t.bounds))
        pair = np.unique(text * (len(t.kinds) + 1) + t.inverse)
        text, kind = pair // (len(t.kinds) + 1), pair % (len(t.kinds) + 1)
        kind, label = kind[use[text]], y[text[use[text]]]
        one = np.bincount(kind[label == 1], minlength=len(t.kinds))
        zero = np.bincount(kind[label == 0], minlength=len(t.kinds))
        odds = np.log((one + 0.5) / (y[use].sum() + 1)) - np.log((zero + 0.5) / ((1 - y[use]).sum() + 1))
        return odds * (one + zero) / (one + zero + 8)

    def _calibrate(self, logit: np.ndarray, text: np.ndarray, y: np.ndarray, use: np.ndarray, prior: float) -> float:
        """Fit scale and shift of the texts' worst windows by damped Newton steps; the loss reached."""
        worst = np.maximum.reduceat(logit, np.flatnonzero(np.append(True, text[1:] != text[:-1]))).astype(np.float64)[use]
        y = y[use]
        ones = y.mean() if len(y) else 0
        if not 0 < ones < 1:
            self.scale, self.shift = 1.0, 0.0
            return 0.0
        weight = np.where(y == 1, prior / ones, (1 - prior) / (1 - ones))
        design = np.stack([worst, np.ones(len(worst))], 1)
        centre = np.array([1.0, 0.0])

        def loss(theta: np.ndarray) -> float:
            prob = _sigmoid(design @ theta)
            fit = -(weight * np.log(np.where(y == 1, prob, 1 - prob) + 1e-12)).sum()
            return float((fit + 0.05 * ((theta - centre) ** 2).sum()) / weight.sum())

        theta, now = centre, loss(centre)
        for _ in range(30):
            prob = _sigmoid(design @ theta)
            grad = design.T @ (weight * (prob - y)) + 0.1 * (theta - centre)
            hess = (design * (weight * prob * (1 - prob))[:, None]).T @ design + 0.1 * np.eye(2)
            move = np.linalg.solve(hess, grad)
            while (then := loss(theta - move)) > now and np.abs(move).max() > 1e-6:
                move /= 2
            if then >= now - 1e-9:
                break
            theta, now = theta - move, then
        self.scale, self.shift = max(float(theta[0]), 0.05), float(theta[1])
        return now


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network from labelled documents, trained in one task; its weights alone come back.

    The sample is the ``SAMPLE_TEXTS`` texts of each label with the lowest hashes of their ids, without those
    of more than ``SAMPLE_LONGEST`` characters, and of these each that still fits into ``SAMPLE_CHARS``
    characters in all. Rows with a null id, text or label are left out; repeated ids count as toxic if
    one of them is. Without any labelled text, the network stays as it was drawn; equal tables give
    equal networks.
    """
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    lab = lab.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("id", F.lit(11)))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = min(max(counts.get(1, 0) / max(sum(counts.values()), 1), 0.01), 0.99)
    # twice the sample, as some labels may have no text; at most 4 * SAMPLE_TEXTS rows of numbers are broadcast
    near = lab.where("y = 1").orderBy("h", "id").limit(2 * SAMPLE_TEXTS).union(lab.where("y = 0").orderBy("h", "id").limit(2 * SAMPLE_TEXTS))
    usable = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= SAMPLE_LONGEST))
    found = materialize(usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(near), "id"))
    texts = found.where("y = 1").orderBy("h", "id").limit(SAMPLE_TEXTS).union(found.where("y = 0").orderBy("h", "id").limit(SAMPLE_TEXTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, y, total = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if total + len(text) <= SAMPLE_CHARS:
                    taken.append(text)
                    y.append(label)
                    total += len(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(pa.array(taken, pa.large_string()), np.array(y, np.int64), prior))])], ["net"])

    one = texts.repartition(1).sortWithinPartitions("h", "id", "text").select("text", "y")
    rows = one.mapInArrow(run, "net binary").collect()
    discard(found)
    return pickle.loads(rows[0]["net"]) if rows else Network(np.zeros(0, np.uint64))


def _fitted(texts: pa.Array, y: np.ndarray, prior: float) -> Network:
    if not len(y):
        return Network(np.zeros(0, np.uint64))
    t = merged([tokenize(part) for part in slices(texts)])
    text = np.repeat(np.arange(len(y)), np.diff(t.bounds))
    pair = np.unique(t.inverse * (len(y) + 1) + text)
    in_texts = np.bincount(pair // (len(y) + 1), minlength=len(t.kinds))
    order = np.lexsort((t.kinds, -in_texts))[:VOCABULARY]
    net = Network(np.sort(t.kinds[order[in_texts[order] >= LEAST_TEXTS]]))
    net.fit(t, y, prior)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, replacing a column of that name; null and empty texts get one too."""
    spread = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array(np.concatenate([spread.value.scores(tokenize(part)) for part in slices(texts)] or [np.zeros(0)]), pa.float64())

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text_col)))
