"""Toxicity as a severity grade from cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k) with theta ascending and one weight vector w for every threshold. x is
sparse: which of a hashed vocabulary's words and beginnings of words a text has. The model is fitted on a bounded
sample of labelled rows (SAMPLE_ROWS, smallest hashes of doc_id; of rows that share an id the smallest text), features
chosen by chi-squared (LEAST_CHI or more) among those in at least MIN_ROWS sampled rows. Labels say toxic or not; a
toxic row's grade is 1, or 2 where it has more of the words that mark toxic rows than the toxic rows' median. The
output is the expected severity, sum of P(grade > k).

Null text counts as empty: severity is that of no words. Labels with null toxic or without a document are not
fitted on; without labels of both kinds nothing is toxic and severity is 0. Repeated rows score alike. Other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import in_slices, table, texts_as_bytes

SAMPLE_ROWS = 8_000
FEATURES = 4_096
LEAST_CHI = 15.0
MIN_ROWS = 3
DECAY = 0.2  # of all weights, over the number of rows: few labels are held to small weights
GRADES = 3
WORDS_HELD = 100_000
BEGINNINGS = (3, 4, 5, 6)
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def feature(word: bytes) -> list[int]:
    """The hashed vocabulary's keys, of 32 bits, of a word and of its beginnings, its case and outer marks aside."""
    w = word.strip(_EDGE).decode("utf-8", "replace").lower()
    return [zlib.crc32(x.encode()) for x in (w, *(w[:n] + "~" for n in BEGINNINGS if len(w) > n))]


class Features:
    """Keys of a text's words, those met often kept; without those that a model has no weight for."""

    def __init__(self, known: dict[int, int] | None = None) -> None:
        self.known, self.held = known, {}

    def __call__(self, text: bytes) -> set[int]:
        words, held = set(text.split()), self.held
        try:
            return set().union(*map(held.__getitem__, words))
        except KeyError:
            if len(held) > WORDS_HELD:
                held.clear()
            for w in words:
                if w not in held:
                    f = feature(w)
                    held[w] = tuple(f) if self.known is None else tuple(self.known[x] for x in f if x in self.known)
            return set().union(*map(held.__getitem__, words))


@dataclass
class Model:
    places: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    theta: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def index(self) -> dict[int, int]:
        return {p: i for i, p in enumerate(self.places.tolist())}

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row and threshold."""
        up = 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -60, 60)))
        return np.where(np.isposinf(self.theta)[None, :], 0.0, up)


def _rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate(lists) if lists else np.empty(0, np.uint32)


def fit(lists: list[np.ndarray], toxic: np.ndarray, epochs: int = 400, rate: float = 0.1, decay: float = DECAY) -> Model:
    """The ordinal model of rows given by their words' keys."""
    if not len(lists) or toxic.all() or not toxic.any():
        return Model()
    row, col = _rows(lists)
    n, pos = len(lists), int(toxic.sum())
    keys, seen = np.unique(col, return_counts=True)
    keys = keys[seen >= MIN_ROWS]
    if not len(keys):
        return Model()
    at = np.minimum(np.searchsorted(keys, col), len(keys) - 1).astype(np.int32)
    often = keys[at] == col
    row, col = row[often], at[often]
    df = np.bincount(col, minlength=len(keys)).astype(float)
    hit = np.bincount(col, weights=toxic[row], minlength=len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (hit * (n - pos - df + hit) - (pos - hit) * (df - hit)) ** 2 / (pos * (n - pos) * df * (n - df))
    chi[~(chi >= LEAST_CHI)] = 0
    places = np.sort(np.argsort(-chi, kind="stable")[: min(FEATURES, int((chi > 0).sum()))])
    model = Model(keys[places])
    known = np.full(len(keys), -1, np.int64)
    known[places] = np.arange(len(places))
    known = known[col]
    row, col = row[known >= 0], known[known >= 0]
    lift = (hit[places] / pos + 1e-4) / ((df - hit)[places] / (n - pos) + 1e-4)
    marks = np.bincount(row, weights=(lift > 4)[col], minlength=n)
    grade = np.where(toxic, 1 + (marks > np.median(marks[toxic])), 0)
    # Adam on the mean negative log likelihood; theta ascends by a positive step
    k = GRADES - 1
    w, t = np.zeros(len(places)), np.array([1.0, 0.0])
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, epochs + 1):
        theta = np.array([t[0], t[0] + np.exp(t[1])])
        score = np.bincount(row, weights=w[col], minlength=n)
        up = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta[None] - score[:, None], -60, 60))), np.zeros((n, 1))])
        p = np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-12)
        slope = up * (1 - up)
        a, b = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        gs = -(a - b) / p / n  # by score; a threshold's slope is the opposite
        gt = np.array([(np.where(grade == j + 1, a, 0) - np.where(grade == j, b, 0)) @ (1 / p) / n for j in range(k)])
        g = [np.bincount(col, weights=gs[row], minlength=len(w)) + decay / n * w, np.array([gt.sum(), gt[1] * np.exp(t[1])])]
        for i, x in enumerate((w, t)):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.weights, model.theta = w, np.array([t[0], t[0] + np.exp(t[1])])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled documents; only their features reach the driver."""
    sample = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("toxic", pa.bool_()), ("words", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in in_slices(it):
            words = [np.array(sorted(features(t)), "<u4").tobytes() for t in texts_as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], schema=schema)

    picked = texts.join(F.broadcast(sample), "doc_id")  # at most `rows` rows of two values
    picked = picked.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    got = sorted((bool(r["toxic"]), bytes(r["words"])) for r in picked.mapInArrow(run, "toxic boolean, words binary").collect())
    return fit([np.frombuffer(w, "<u4") for _, w in got], np.array([t for t, _ in got], bool))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.index())
        weights = model.weights.tolist()
        for b in in_slices(it):
            score = np.array([math.fsum(map(weights.__getitem__, features(t))) for t in texts_as_bytes(b.column(1))], float)
            up = model.above(score)
            p = -np.diff(np.hstack([np.ones((len(up), 1)), up, np.zeros((len(up), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (up.sum(1), up[:, 0], p.argmax(1).astype(np.int32), up[:, 0] > 0.5))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose P(grade > 0) is at most one half."""
    out = docs.schema
    cols = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.index())
        weights = model.weights.tolist()
        at = cols.index("text")
        for b in in_slices(it):
            score = np.array([math.fsum(map(weights.__getitem__, features(t))) for t in texts_as_bytes(b.column(at))], float)
            yield b.filter(pa.array(model.above(score)[:, 0] <= 0.5))

    return docs.mapInArrow(run, out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
