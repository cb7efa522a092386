"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and its neighbours'; the chain adds a score for each pair of
neighbouring labels. The field is fitted to labelled documents, each line taking its document's label. A document's
quality is the mean of its lines' forward-backward marginals, weighted by length, and calibrated to a probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import _FACTORS, Words, _splitmix, encoded, map_texts, prepare, text_batches
from .training import fit_logistic, labelled_sample, sigmoid

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "bracket": b"()[]{}/\\=_@~^+"}
_TABLES = {}
for _name, _members in _CLASSES.items():
    _TABLES[_name] = np.zeros(256, np.int64)
    _TABLES[_name][list(_members)] = 1
#: Own features of a line; the shares are of its bytes, echo and twin of its words and of earlier lines.
OWN = (*_CLASSES, "wide", "words", "length", "word_size", "echo", "twin", "first")
NEIGHBOUR = (0, 2, 3, 6, 10, 11)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, weight, own)`` for every line with a word: index of its text, bytes, features."""
    words = Words(texts)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(OWN)))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offset = np.cumsum(lengths + 1) - lengths - 1
    line = np.searchsorted(ends, words.place + offset[words.doc])
    used, first, count = np.unique(line, return_index=True, return_counts=True)
    end = ends[used]
    begin = np.where(used > 0, ends[used - 1] + 1, 0)
    size = end - begin
    doc = words.doc[first]
    columns = []
    for table in _TABLES.values():
        total = np.concatenate([[0], np.cumsum(table[buf])])
        columns.append((total[end] - total[begin]) / size)
    total = np.concatenate([[0], np.cumsum(buf > 127, dtype=np.int64)])
    columns.append((total[end] - total[begin]) / size)
    nth = np.arange(len(line)) - np.repeat(first, count)
    same = np.zeros(len(line), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (nth[1:] > 0)
    echo = np.add.reduceat(same.astype(np.int64), first)
    name = _splitmix(np.add.reduceat(words.hash * _FACTORS[nth % len(_FACTORS)], first) + count.astype(np.uint64))
    order = np.lexsort([np.arange(len(name)), name, doc])
    twin = np.zeros(len(name), bool)
    twin[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    start = np.concatenate([[True], doc[1:] != doc[:-1]])
    columns += [np.log1p(count), np.log1p(size), size / count, echo / count, twin, start]
    own = np.column_stack(columns).astype(float)
    own[:, 9] = np.log(np.clip(own[:, 9], 1, 1000))
    return doc, size.astype(float), own


def with_neighbours(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zero at the ends of a text), and a constant."""
    n = len(doc)
    near = own[:, NEIGHBOUR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    if n > 1:
        joined = doc[1:] == doc[:-1]
        before[1:][joined] = near[:-1][joined]
        after[:-1][joined] = near[1:][joined]
    return np.column_stack([own, before, after, np.ones(n)])


def marginals(unary: np.ndarray, doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts of a batch at once. ``unary``: score of the good label of each line (the bad
    label's is zero); ``pair``: 2 x 2 scores of neighbours. Returns the marginal of good for each line and, summed over
    all neighbours, the expected count of each pair."""
    n = len(unary)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if n else np.zeros(1, np.int64)
    begin, size = edge[:-1], np.diff(edge)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    score = np.column_stack([np.zeros(n), unary])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        k = alive[t]
        at = begin[:k] + t
        if t == 0:
            forward[at] = score[at]
        else:
            a = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(a[:, :1] + pair[0], a[:, 1:] + pair[1])
        forward[at] -= forward[at].max(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        at = begin[:k] + t
        b = backward[at + 1] + score[at + 1]
        backward[at] = np.logaddexp(pair[:, 0] + b[:, :1], pair[:, 1] + b[:, 1:])
        backward[at] -= backward[at].max(axis=1, keepdims=True)
    total = forward + backward
    good = sigmoid(total[:, 1] - total[:, 0])
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n > 1 else np.zeros(0, np.int64)
    joint = forward[inner][:, :, None] + pair[None] + (backward[inner + 1] + score[inner + 1])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return good, joint.sum(axis=0)


class Field:
    """Fitted weights: standardisation, unary weights, pair scores, calibration."""

    def __init__(self, mean, std, unary, pair, calibration):
        self.mean, self.std, self.unary, self.pair, self.calibration = mean, std, unary, pair, calibration

    def document_means(self, doc: np.ndarray, weight: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """The length-weighted mean and the least marginal of each text, as log odds; a text without lines is bad."""
        if not len(doc):
            return np.full((n, 2), -4.0)
        x = (with_neighbours(doc, own) - self.mean) / self.std
        good, _ = marginals(x @ self.unary, doc, self.pair)
        total = np.bincount(doc, weight, n)
        mean = np.bincount(doc, weight * good, n) / np.maximum(total, 1)
        low = np.ones(n)
        np.minimum.at(low, doc, good)
        out = np.clip(np.column_stack([mean, low]), 0.018, 0.982)
        out[total == 0] = 0.018
        return np.log(out / (1 - out))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        means = self.document_means(*line_features(texts), len(texts))
        return sigmoid(means @ self.calibration[:-1] + self.calibration[-1])


def fit_field(doc: np.ndarray, weight: np.ndarray, own: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam. ``y``: label of each text. A line weighs the same in every text; texts of one label
    weigh as much as those of the other."""
    x = with_neighbours(doc, own) if len(doc) else np.zeros((0, len(OWN) + 2 * len(NEIGHBOUR) + 1))
    mean, std = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    mean[-1], std[-1] = 0.0, 1.0
    field = Field(mean, std, np.zeros(x.shape[1]), np.zeros((2, 2)), np.array([1.0, 0.0, 0.0]))
    if not len(x) or y.min() == y.max():
        return field
    x -= mean
    x /= std
    z, label = x, y[doc]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    per_line = 0.5 / share[label] / np.bincount(doc, minlength=len(y))[doc]
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), 1)
    lines = len(z)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, joint = marginals(z @ theta[:-4], doc, theta[-4:].reshape(2, 2))
        grad = np.append(z.T @ ((good - label) * per_line) / len(y), (joint - seen).reshape(-1) / lines) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.unary, field.pair = theta[:-4], np.clip(theta[-4:].reshape(2, 2), -3, 3)
    field.calibration = fit_logistic(field.document_means(doc, weight, own, len(y)), y.astype(float))
    return field


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_lines: int = 200) -> Field:
    """Fit on at most ``max_rows`` labelled documents that aren't held out. Of each, the features of at most ``max_lines`` lines
    in a row, from a place that its id's hash picks, come to the driver: ``max_rows`` * ``max_lines`` lines of 56 bytes at most. The fit needs about 500 bytes a line: half a
    gigabyte for the million lines that the defaults allow."""

    def run(batches):
        for frame in batches:
            doc, weight, own = line_features(encoded(frame["text"]))
            edge = np.searchsorted(doc, np.arange(len(frame) + 1))
            packed = np.column_stack([weight, own]).astype(np.float32)
            first = edge[:-1] + [int(_splitmix(np.array([d], np.uint64))[0]) % max(1, n - max_lines + 1) for d, n in zip(frame["doc_id"].to_numpy(np.int64).view(np.uint64), np.diff(edge).tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": [packed[a : min(a + max_lines, b)].tobytes() for a, b in zip(first, edge[1:], strict=True)]})

    found = labelled_sample(docs, labels, "quality", max_rows).mapInPandas(run, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: r.doc_id)
    parts = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, len(OWN) + 1) for r in found]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rows = np.concatenate([*parts, np.zeros((0, len(OWN) + 1), np.float32)]).astype(float)
    return fit_field(doc, rows[:, 0], rows[:, 1:], np.array([r.y for r in found], np.int64))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, 0 to 1. Null texts and texts without a word score as one bad line would."""
    prepare(docs.sparkSession)
    field = fit_quality(docs, labels, max_rows)

    def run(batches):
        for frame in text_batches(batches):
            yield frame[["doc_id", "no_id"]].assign(score=field.scores(encoded(frame["text"])))

    return map_texts(docs, run, "score double", id_col, text_col)
