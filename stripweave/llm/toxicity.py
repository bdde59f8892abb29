"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Terms are words and the beginnings of words: all of them that a bounded labelled sample holds. A term weighs by its frequency in the text, by its rarity in all
documents, and by how surely its shares in the two labels differ, never 0. The index holds the sample's vectors by term, with the
largest weight in each block of examples: blocks are visited by falling bound, and the search ends when no block can hold a nearer example.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripweave.llm.common import append_columns, fold, fresh, labelled_sample

PER_LABEL = 500
#: Labelled texts of more characters are not in the sample, so that what it holds is bounded.
LONGEST = 200_000
NEIGHBOURS = 15
BLOCK = 64
#: Texts whose products with the examples are worked out together.
BATCH = 32
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: A term whose shares in the labels differ by so many standard errors has half of its full weight; the least share of it that any term has.
TELLING, LEAST = 5.0, 0.01
PREFIXES = (5, 6)
WORD = re.compile(r"[^\W\d_]+")
BETWEEN = re.compile(r"[\W\d_]+")


def word_terms(word: str) -> list[str]:
    """A word's terms: itself, and its first letters with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Terms:
    """The sample's terms by number. They are found in a text by one pass of an automaton over its words, each between spaces; a worker holds one automaton, that of the
    terms last asked for, however many copies of these it got."""

    held: ClassVar[tuple[str, ahocorasick.Automaton | None]] = ("", None)

    def __init__(self, names: list[str]):
        self.names = names
        self.key = uuid.uuid4().hex

    def __len__(self) -> int:
        return len(self.names)

    def _built(self) -> ahocorasick.Automaton:
        if Terms.held[0] != self.key:
            Terms.held = ("", None)
            automaton = ahocorasick.Automaton()
            for k, t in enumerate(self.names):
                automaton.add_word(f" {t[:-1]}" if t.endswith("*") else f" {t} ", k)
            automaton.make_automaton()
            Terms.held = (self.key, automaton)
        return Terms.held[1]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, rising, and how often each is in it."""
        if not self.names:
            return np.zeros(0, np.int64), np.zeros(0)
        met = np.array([k for _, k in self._built().iter(BETWEEN.sub(" ", f" {text.lower()} "))], np.int64)
        return np.unique(met, return_counts=True)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of n, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Unit vectors of examples by term. A cell is what a term has in a block of examples: its postings and the largest of their weights. Terms of at least an eighth of the
    examples are rows over all of them, so that their part of every inner product is one product of a vector and a matrix."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        often = np.bincount(term, minlength=n_terms) * 8 >= max(self.n, 8)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n))
        own = often[term]
        self.rows[self.row[term[own]], example[own]] = weight[own]
        term, weight, example = term[~own], weight[~own], example[~own]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        cell, start = np.unique(term[order] * max(self.blocks, 1) + self.example // BLOCK, return_index=True)
        self.start = np.append(start, len(order))
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.block = (cell % max(self.blocks, 1)).astype(np.int32)
        self.first = np.searchsorted(cell, np.arange(n_terms + 1) * max(self.blocks, 1))

    def _known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What frequent terms add to the inner products of some vectors with all examples: one product of matrices."""
        wide = np.zeros((len(vectors), len(self.rows)))
        for k, (t, w) in enumerate(vectors):
            row = self.row[t]
            wide[k, row[row >= 0]] = w[row >= 0]
        out = np.zeros((len(vectors), self.blocks * BLOCK))
        out[:, : self.n] = wide @ self.rows
        return out

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of a few vectors the k examples of the largest cosine above 0, largest first, ties to the smaller number: exact. First the blocks with the largest bounds
        are read, then all whose bound is not below the k-th cosine found in these."""
        if not self.n or not vectors:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        known = self._known(vectors)
        width = known.shape[1]
        rare = [self.row[t] < 0 for t, _ in vectors]
        terms, weights = (np.concatenate([v[j][r] for v, r in zip(vectors, rare, strict=True)]) for j in (0, 1))
        n = self.first[terms + 1] - self.first[terms]
        cells, weights = _spread(self.first[terms], n), np.repeat(weights, n)
        asker = np.repeat(np.repeat(np.arange(len(vectors)), [int(r.sum()) for r in rare]), n)
        place = asker * self.blocks + self.block[cells]
        bound = np.bincount(place, weights * self.most[cells], len(vectors) * self.blocks).reshape(-1, self.blocks) + known.reshape(len(vectors), -1, BLOCK).max(2)

        def scores(blocks: np.ndarray) -> np.ndarray:
            """Inner products with the examples of each vector's own blocks, 0 elsewhere."""
            own = blocks.ravel()[place]
            met = cells[own]
            size = self.start[met + 1] - self.start[met]
            at = _spread(self.start[met], size)
            out = np.bincount(np.repeat(asker[own] * width, size) + self.example[at], np.repeat(weights[own], size) * self.weight[at], known.size).reshape(known.shape)
            out = out + np.where(np.repeat(blocks, BLOCK, axis=1), known, 0)
            if without is not None:
                out[np.arange(len(out)), without] = 0
            return out

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :4], True, axis=1)
        found = scores(first & (bound > 0))
        kth = min(k, width)
        least = np.partition(found, width - kth, axis=1)[:, width - kth]
        more = ~first & (bound > 0) & (bound >= least[:, None] - 1e-12)
        if more.any():
            found += scores(more)
            least = np.partition(found, width - kth, axis=1)[:, width - kth]
        out = []
        for score, floor in zip(found, least.tolist(), strict=True):
            hits = np.flatnonzero(score >= floor - 1e-12) if floor > 0 else np.flatnonzero(score > 0)
            top = hits[np.lexsort((hits, -score[hits].round(12)))[:k]]
            out.append((top, score[top]))
        return out


@dataclass
class Model:
    terms: Terms
    rarity: np.ndarray  # of each term in all documents, times how telling it is
    index: Index
    ids: np.ndarray
    labels: np.ndarray
    share: np.ndarray  # what an example of each label stands for, so that votes are as in all labelled documents
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def vector(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.rarity[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic votes, each example weighing by its squared cosine and what it stands for; the prior has a small voice. With the examples and their cosines."""
        out = []
        for n, s in self.index.nearest(vectors, NEIGHBOURS, without):
            voice = s * s * self.share[self.labels[n]]
            out.append(((float((voice * self.labels[n]).sum()) + 0.25 * self.prior) / (float(voice.sum()) + 0.25), n, s))
        return out

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.offset))))


def _platt(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels to the votes' log odds, by damped Newton steps; the slope is kept positive."""
    v = np.clip(votes, 1e-4, 1 - 1e-4)
    x = np.column_stack([np.log(v / (1 - v)), np.ones(len(v))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (weight * (labels - p)) - 1e-2 * (b - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b + step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 0.05), float(b[1])


def _term_rows(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, labels = [], []
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                own = {t for w in set(words(text)) for t in word_terms(w)}
                terms += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])

    return sample.select("text", "label").mapInArrow(run, "term string, label int")


def weigh_terms(sample: DataFrame, sizes: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """All terms of the sample, and how telling each is, from LEAST to 1: z * z / (z * z + TELLING * TELLING) for labels whose shares differ by z standard errors."""
    n0, n1 = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    seen = _term_rows(sample).groupBy("term").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    p = (F.col("n1") + F.col("n0")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-9)
    rows = seen.select("term", (z * z).alias("zz")).toArrow()
    order = np.argsort(rows["term"].to_numpy(), kind="stable")
    zz = rows["zz"].to_numpy()[order]
    return rows["term"].take(pa.array(order)).to_pylist(), np.maximum(zz / (zz + TELLING * TELLING), LEAST)


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents; tasks send one row of sums each."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, n = np.zeros(len(own), np.int64), 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                total[own.counts(text)[0]] += 1
                n += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *met.tolist()], pa.int32()), pa.array([n, *total[met].tolist()], pa.int64())], ["term", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(len(terms), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, per_label: int = PER_LABEL, longest: int = LONGEST) -> Model:
    """A model of at most ``per_label`` examples of each label, of at most ``longest`` characters each: these bounds hold at any size of the input, and
    nothing larger comes to the driver. Document frequencies are those of all documents. Without labels every document gets the prior 0."""
    usable = fold(F.col("doc_id"), FOLDS) != HELD_OUT if usable is None else usable
    sample = labelled_sample(docs, labels, "toxic", usable, per_label).filter(F.length("text") <= longest).persist()
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    every = {r.label: r.n for r in labels.filter(F.col("toxic").isin(0, 1) & usable).groupBy(F.col("toxic").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    names, telling = weigh_terms(sample, sizes)
    terms = Terms(names)
    examples = sorted(sample.select("doc_id", "label", "text").collect(), key=lambda r: r.doc_id)
    sample.unpersist()
    df, n = document_frequencies(docs, terms)
    total = sum(every.values())
    share = np.array([every.get(k, 0) / max(sizes.get(k, 0), 1) for k in (0, 1)])
    share = share / max(share.max(), 1e-9)
    y = np.array([r.label for r in examples], np.int64)
    rarity = (np.log((n + 1) / (df + 1)) + 1) * telling
    model = Model(terms, rarity, Index([], len(df)), np.array([r.doc_id for r in examples], np.int64), y, share, every.get(1, 0) / total if total else 0.0)
    vectors = [model.vector(*terms.counts(r.text)) for r in examples]
    model.index = Index(vectors, len(df))
    if len(set(y.tolist())) == 2:
        places = range(0, len(vectors), BATCH)
        votes = np.array([v[0] for k in places for v in model.votes(vectors[k : k + BATCH], list(range(k, min(k + BATCH, len(vectors)))))])
        model.slope, model.offset = _platt(votes, y, model.share[y])
    return model


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", name: str = "toxicity", evidence: str = "evidence") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1, and its nearest examples, after its own columns. A text without any
    term of the sample, such as an empty or null one, gets the prior's score and no evidence. Repeated rows are scored alike, texts of any length whole; an empty
    table gives no rows. Columns of ``docs`` named like the new ones go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(texts: list[str]) -> list[pa.Array]:
        m, scores, found = shared.value, [], []
        for first in range(0, len(texts), BATCH):
            vectors = [m.vector(*m.terms.counts(t)) for t in texts[first : first + BATCH]]
            for vote, n, s in m.votes(vectors):
                scores.append(m.calibrated(vote))
                found.append([{"doc_id": int(m.ids[k]), "label": int(m.labels[k]), "cosine": float(c)} for k, c in zip(n[:3].tolist(), s[:3].tolist(), strict=True)])
        return [pa.array(scores, pa.float64()), pa.array(found, kind)]

    return append_columns(docs, text, run, [T.StructField(name, T.DoubleType()), T.StructField(evidence, EVIDENCE)])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence``, one row per input row."""
    rows = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    predicted = F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0)
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns, whatever their names."""
    name, evidence = fresh(docs, "toxicity"), fresh(docs, "evidence")
    rows = score_documents(docs, fit(docs, labels), name=name, evidence=evidence)
    return rows.filter(F.col(name) < THRESHOLD).drop(name, evidence)
