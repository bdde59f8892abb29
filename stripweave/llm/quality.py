"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its characters and words and of the lines before and after it. The field labels lines good or bad;
a document's quality is the mean of its lines' marginals of being good, weighted by line length. Only documents are labelled, so
training starts from every line having its document's label and then lets lines of bad documents that look good become so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripweave.llm.common import append_columns, fold, fresh, labelled_sample

PER_LABEL = 2000
#: Labelled texts of more lines are not in the sample, so that the numbers that come to the driver are bounded.
MOST_LINES = 400
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
OWN = 13
CHUNK = 1 << 18


@cache
def _classes() -> np.ndarray:
    """For each code point, bits: upper, lower, digit, space, sentence mark, symbol, bar, exclamation. Made once in each worker."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(len(out)):
        s = chr(c)
        out[c] = s.isupper() | s.islower() << 1 | s.isdigit() << 2 | s.isspace() << 3 | (s in ".,;:?'\"()-") << 4
        out[c] |= (not s.isalnum() and not s.isspace() and s not in ".,;:?'\"()-!|") << 5 | (s == "|") << 6 | (s == "!") << 7
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of all texts, one after the other: features (own, mean of the two neighbours', their places), lengths, and
    lines per text. A text has one line at least; work goes in chunks of bounded size."""
    own, lengths, counts = [], [], np.array([t.count("\n") + 1 for t in texts], np.int64)
    lines = [line for t in texts for line in t.split("\n")]
    k = 0
    while k < len(lines):
        end, size = k, 0
        while end < len(lines) and (end == k or size + len(lines[end]) < CHUNK):
            size += len(lines[end]) + 1
            end += 1
        own.append(_own(lines[k:end]))
        lengths.append(np.array([len(x) for x in lines[k:end]], np.int64))
        k = end
    x, length = (np.concatenate(own), np.concatenate(lengths)) if lines else (np.zeros((0, OWN)), np.zeros(0, np.int64))
    ends = np.cumsum(counts)
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if len(x):
        first[ends - counts] = True
        last[ends - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = x[first], x[last]
    return np.column_stack([x, (before + after) / 2, first, last, np.ones(len(x))]), length, counts


def _own(lines: list[str]) -> np.ndarray:
    text = "\n".join(lines) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _classes()[codes]
    size = np.array([len(x) for x in lines])
    starts = np.cumsum(size + 1) - size - 1
    n = [np.add.reduceat(kinds >> b & 1, starts, dtype=np.int64) for b in range(8)]
    upper, lower, digit, space, mark, symbol, bar, exclaim = n
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    chars, w = np.maximum(size, 1), np.maximum(n_words, 1)
    ends = np.array([x[-1:] in (".", "?", "!") for x in lines])
    return np.column_stack([
        np.log1p(size) / 8, upper / np.maximum(upper + lower, 1), (upper > 0.6 * (upper + lower)) & (upper > 3), np.minimum(3 * symbol / w, 1), np.minimum(bar / w, 1), np.minimum(exclaim / w, 1),
        digit / chars, mark / chars, np.minimum((size - space + 1) / w / 10, 2), distinct / w, (distinct < 0.3 * n_words) & (n_words > 7), ends, size == 0,
    ]).astype(np.float64)


@dataclass
class Field:
    """Weights of being good, log weights of label pairs, and the score at which documents count as good."""

    weights: np.ndarray
    pairs: np.ndarray
    cut: float = 0.5


def marginals(field: Field, x: np.ndarray, counts: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(good) of every line by the forward-backward algorithm, all documents side by side; and the expected label pairs."""
    good = x @ field.weights
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    steps = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # documents with more than t lines
    emit = np.column_stack([np.zeros(len(good)), good])
    emit = np.exp(emit - emit.max(1, keepdims=True))
    move = np.exp(field.pairs - field.pairs.max())
    forward, scale = np.empty_like(emit), None
    for t in range(steps):
        at = starts[: alive[t]] + t
        scale = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        forward[at] = scale / scale.sum(1, keepdims=True)
    out = forward.copy()
    back = np.ones((len(counts), 2))
    expected = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        if t + 1 < steps and alive[t + 1]:
            m = alive[t + 1]
            follow = emit[starts[:m] + t + 1] * back[:m]
            if want_pairs:
                joint = forward[starts[:m] + t][:, :, None] * move[None] * follow[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            value = follow @ move.T
            back[:m] = value / value.sum(1, keepdims=True)
        both = forward[at] * back[:n]
        out[at] = both / both.sum(1, keepdims=True)
    return out[:, 1], expected if want_pairs else None


def train(x: np.ndarray, counts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 3, steps: int = 80) -> Field:
    """Gradient ascent (Adam) on the likelihood, with lines relabelled between rounds."""
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(counts) or len(set(labels.tolist())) < 2:
        if len(counts):
            field.weights[-1] = 4.0 if labels[0] else -4.0
        else:
            field.cut = THRESHOLD  # leaves the score of 0.5 as it is
        return field
    doc = np.repeat(np.arange(len(counts)), counts)
    y = labels[doc].astype(float)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    # Both labels and all documents weigh the same, however many lines they have.
    share = np.bincount(labels, minlength=2)
    for k in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for t in range(1, steps + 1):
            p, expected = marginals(field, x, counts, True)
            g = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(x) - 1e-4 * np.concatenate([field.weights, field.pairs.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            field.weights = field.weights + step[:-4]
            field.pairs = field.pairs + step[-4:].reshape(2, 2)
        p, _ = marginals(field, x, counts)
        if k < rounds - 1:
            turned = (labels[doc] == 0) & (p > 0.5)
            bad_left = np.bincount(doc[(labels[doc] == 0) & ~turned], minlength=len(counts))
            y = np.where(labels[doc] == 1, 1.0, np.where(turned & (bad_left[doc] > 0), 1.0, 0.0))
    score = document_scores(p, lengths, counts)
    cuts = np.unique(np.concatenate([[0.02, 0.98], np.quantile(score, np.linspace(0.001, 0.999, 400))]))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    loss = [(score[labels == 1] < c).sum() / share[1] + (score[labels == 0] >= c).sum() / share[0] for c in cuts]
    best = np.flatnonzero(np.isclose(loss, min(loss)))
    field.cut = float(np.clip(cuts[best[len(best) // 2]], 0.02, 0.98))
    return field


def document_scores(p: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals, weighted by length plus 1."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(p * (lengths + 1), starts) / np.add.reduceat(lengths + 1, starts) if len(counts) else np.zeros(0)


def calibrated(field: Field, score: np.ndarray) -> np.ndarray:
    """The scale bent so that the cut learned from the labels lies at the threshold."""
    return np.where(score < field.cut, THRESHOLD * score / field.cut, THRESHOLD + (1 - THRESHOLD) * (score - field.cut) / (1 - field.cut))


def fit(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, per_label: int = PER_LABEL, most_lines: int = MOST_LINES) -> Field:
    """A field from at most ``per_label`` labelled documents of each label, whole texts of at most ``most_lines`` lines. Features are made on the executors; one
    bounded table of numbers comes to the driver. Without labels every score is 0.5, below the threshold."""
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT if usable is None else usable
    sample = labelled_sample(docs, labels, "quality", usable, per_label).filter(F.regexp_count("text", F.lit("\n")) < most_lines)

    def run(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            x, length, _ = line_features([t])
            rows.append(np.column_stack([length, x]).astype("<f4").tobytes())
        return [pa.array(rows, pa.binary())]

    rows = append_columns(sample, "text", run, [T.StructField("features", T.BinaryType())]).select("doc_id", "label", "features").toPandas()
    rows = rows.sort_values("doc_id")
    width = 2 * OWN + 4
    parts = [np.frombuffer(bytes(b), "<f4").reshape(-1, width).astype(np.float64) for b in rows["features"]]
    whole = np.concatenate(parts) if parts else np.zeros((0, width))
    return train(whole[:, 1:], np.array([len(p) for p in parts], np.int64), whole[:, 0], rows["label"].to_numpy(dtype=np.int64))


def score_documents(docs: DataFrame, field: Field, *, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the quality of each whole text, 0 to 1, after its own columns. Null and empty texts are one empty line. Repeated rows are
    scored alike, texts of any length whole; an empty table gives no rows. A column of ``docs`` with the new one's name goes."""

    def run(texts: list[str]) -> list[pa.Array]:
        out, k = [], 0
        while k < len(texts):
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) < 4 * CHUNK):
                size += len(texts[end])
                end += 1
            x, lengths, counts = line_features(texts[k:end])
            p, _ = marginals(field, x, counts)
            out.append(calibrated(field, document_scores(p, lengths, counts)))
            k = end
        return [pa.array(np.clip(np.concatenate(out), 0, 1) if out else [], pa.float64())]

    return append_columns(docs, text, run, [T.StructField(name, T.DoubleType())])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row."""
    field = fit(docs, labels)
    rows = score_documents(docs.select("doc_id", "text"), field)
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose quality is at the threshold or above, with their own columns, whatever their names."""
    name = fresh(docs, "quality")
    rows = score_documents(docs, fit(docs, labels), name=name)
    return rows.filter(F.col(name) >= THRESHOLD).drop(name)
