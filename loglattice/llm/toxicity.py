"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w x - c_k): one weight for each feature, shared by the
ordered thresholds c_1 < c_2 < ... A text's features are its distinct words and
their beginnings of three to six letters, as present or absent; the score is the
expected severity, the sum of P(grade > k).

The classifier is fitted on a bounded sample of labelled rows (``positives`` and
``negatives``, the least by a hash of doc_id). Features that too few positive
rows of the sample have are left out, then those whose presence does not tell
the classes apart (log-likelihood ratio). Labels of 0 and 1 say only whether a
text is toxic; positive rows are then graded 1 to 3 by how many of the telling
features they have. Labels with more grades are taken as they are.

Prediction is one narrow pass over whole texts.

Defined results: a null or empty text has severity 0 and grade 0; labels that
are null, or have no document, are not learned from; without any positive or
any negative row every text has severity 0; repeated rows give repeated results;
further columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import BoundedMemo, durable, keep_rows, text_slices, worker_state

#: The rows that the classifier is fitted on, at most.
POSITIVES, NEGATIVES = 3000, 12_000
#: Features that are weighed at most, and how many of them may tell the classes apart by chance.
CANDIDATES, CHANCE = 60_000, 0.5
#: Penalties on weights: on their squares, and on their sizes for each root of a positive row.
GRADES, RIDGE, LASSO = 3, 0.003, 0.017
REJECT = 0.5
BEGINNINGS = (3, 4, 5, 6)
LENGTHS = [f"#{n}" for n in range(32)]

_WORD = re.compile(r"\w+")


def features(chunk: str) -> list[str]:
    """The features of a stretch of lower-case text without blanks."""
    found = []
    for word in _WORD.findall(chunk):
        found.append(word)
        found += [word[:n] + "*" for n in BEGINNINGS if len(word) > n]
    return found


def length_feature(chunks: set[str]) -> str:
    """A text's length class: what is telling in a short text may be chance in a long one."""
    return f"#{len(chunks).bit_length()}"


@dataclass
class Model:
    """Weights by feature, and the thresholds in order."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, score: float) -> tuple[float, int]:
        """Expected severity, and how many thresholds are more likely passed than not."""
        passed = [1 / (1 + math.exp(min(500.0, c - score))) for c in self.thresholds]
        return sum(passed), sum(p >= 0.5 for p in passed)


class Scorer:
    """Scores texts by a model; keeps what each stretch of text has."""

    def __init__(self, model: Model):
        self.model = model
        self.number = {f: i for i, f in enumerate(model.weights)}
        self.weight = list(model.weights.values())
        self.memo = BoundedMemo(300_000)

    def _compute(self, chunks: list[str]) -> list[tuple[int, ...]]:
        number = self.number
        return [tuple([number[f] for f in features(chunk) if f in number]) for chunk in chunks]

    def score(self, texts: list[str | None]) -> list[tuple[float, int]]:
        split = [set((text or "").lower().split()) for text in texts]
        self.memo.admit(set().union(*split), self._compute)
        get, weight, out = self.memo.young.__getitem__, self.weight, []
        for chunks in split:
            present: set[int] = set()
            present.update(*filter(None, map(get, chunks)))
            present.update(filter(None.__ne__, [self.number.get(length_feature(chunks))]))
            out.append(self.model.severity(math.fsum(weight[i] for i in present)) if chunks else (0.0, 0))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int) -> DataFrame:
    """(text, grade) of the sample; its rows are bounded by the two numbers."""
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("grade"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("grade")]
    chosen = [given.where(cond).orderBy(*by_hash).limit(n) for cond, n in (("grade > 0", positives), ("grade <= 0", negatives))]
    ids = dict(sorted((row.doc_id, max(0, row.grade)) for part in chosen for row in part.collect()))
    known = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, grade int")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(text.join(F.broadcast(known), "doc_id").select("doc_id", "text", "grade"))  # bounded by the two numbers


def text_features(text: str | None) -> set[str]:
    chunks = set((text or "").lower().split())
    return {f for chunk in chunks for f in features(chunk)} | {length_feature(chunks)}


def _texts(batch: pa.RecordBatch) -> Iterator[set[str]]:
    return (text_features(text) for _, texts in text_slices(batch.column(0)) for text in texts)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()
    for batch in batches:
        for present in _texts(batch):
            count.update(present)
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["feature", "n"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """The model of ``labels`` (doc_id, label) over ``docs`` (doc_id, text)."""
    sample = labelled_sample(docs, labels, label, positives, negatives)
    n_pos = sample.where("grade > 0").count()
    least = 3 if n_pos >= 100 else 2
    counted = sample.where("grade > 0").select("text").repartition(8).mapInArrow(count_features, "feature string, n long")
    top = counted.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(CANDIDATES)
    candidates = {row.feature: row.n for row in top.collect()}
    names = list(candidates)
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def count_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value, Counter()
        for batch in batches:
            for found in _texts(batch):
                count.update(known[f] for f in found if f in known)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], ["i", "n"])

    others = sample.where("grade <= 0").select("text").repartition(8).mapInArrow(count_known, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    negative = np.zeros(len(names))
    for row in others.collect():
        negative[row.i] = row.n
    n_neg = sample.where("grade <= 0").count()
    telling = [names[i] for i in telling_features(np.array(list(candidates.values()), float), negative, n_pos, n_neg)]
    telling = [f for f in telling if f[0] != "#"] + LENGTHS
    number = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(telling)})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            rows = [np.array(sorted(known[f] for f in found if f in known), np.int32).tobytes() for found in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["present", "grade", "doc_id"])

    rows = sample.select("text", "grade", "doc_id").mapInArrow(present, "present binary, grade int, doc_id long").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.present)))
    return fit_rows(telling, [np.frombuffer(row.present, np.int32) for row in rows], np.array([row.grade for row in rows], np.int64))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Dunning's statistic for the presence of a feature in either class."""

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    share = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a * share) + part(b, n_b * share) + part(n_a - a, n_a * (1 - share)) + part(n_b - b, n_b * (1 - share)))


def telling_features(a: np.ndarray, b: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The places of features that ``a`` positive and ``b`` negative rows have, and that tell the two apart."""
    if not n_pos or not n_neg:
        return np.zeros(0, np.int64)
    least = NormalDist().inv_cdf(1 - CHANCE / (2 * max(1, len(a)))) ** 2
    return np.flatnonzero((likelihood_ratio(a, b, n_pos, n_neg) >= least) & (a / n_pos > 4 * b / n_neg))


def fit_rows(names: list[str], rows: list[np.ndarray], grades: np.ndarray, steps: int = 400) -> Model:
    """Grade binary labels by the number of features, and fit weights and thresholds."""
    positive = grades > 0
    if not positive.any() or positive.all():
        return Model({}, [1e9] * GRADES)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows)
    if grades.max() == 1:
        word = np.array([n[0] != "#" for n in names])[column]
        amount = np.bincount(row[word], minlength=len(rows))
        cuts = np.quantile(amount[positive], [k / GRADES for k in range(1, GRADES)])
        grades = np.where(positive, 1 + (amount[:, None] > cuts).sum(axis=1), 0)
    most = int(grades.max())
    free = np.array([n[0] == "#" for n in names])
    weights, thresholds = fit_cumulative(row, column, grades, len(names), most, steps, free=free)
    return Model(dict(zip(names, weights.tolist(), strict=True)), thresholds.tolist())


def fit_cumulative(row: np.ndarray, column: np.ndarray, grades: np.ndarray, width: int, most: int, steps: int, ridge: float = RIDGE, lasso: float = LASSO, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge, by Adam; thresholds are a first one and positive gaps.

    Weights are at least 0 but for the ``free`` ones: every other feature was
    chosen as one of toxic rows, and nothing else should clear a text.
    """
    params = np.r_[np.zeros(width), 1.0, np.zeros(most - 1)]
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(grades)
    free = np.zeros(width, bool) if free is None else free
    pull = np.where(free, 0.0, lasso * math.sqrt(np.count_nonzero(grades)))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, steps + 1):
        weights, raw = params[:width], params[width:]
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.r_[0.0, np.cumsum(gaps)]
        score = np.bincount(row, weights[column], minlength=n)
        passed = np.c_[np.ones(n), sigmoid(score[:, None] - cuts), np.zeros(n)]
        chance = np.maximum(passed[np.arange(n), grades] - passed[np.arange(n), grades + 1], 1e-9)
        slope = passed * (1 - passed)
        at, over = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = (at - over) / chance
        by_cut = np.zeros(most)
        np.add.at(by_cut, grades[grades > 0] - 1, -(at / chance)[grades > 0])
        np.add.at(by_cut, grades[grades < most], (over / chance)[grades < most])
        gradient = np.r_[np.bincount(column, by_score[row], minlength=width) - ridge * weights - pull, by_cut.sum(), np.cumsum(by_cut[::-1])[::-1][1:] * gaps]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 if step < steps * 3 // 4 else 0.02
        params = params + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        params[:width] = np.where(free, params[:width], np.maximum(params[:width], 0))
    raw = params[width:]
    return params[:width], raw[0] + np.r_[0.0, np.cumsum(np.exp(raw[1:]))]


def scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model; made once a worker."""
    return worker_state(("toxicity", shared.id), lambda: Scorer(shared.value))


class SharedModel:
    """A model by broadcast, with a name that workers keep their memos under."""

    def __init__(self, spark, model):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    @property
    def value(self):
        return self.broadcast.value


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, grade and toxic of each row of ``docs`` (doc_id, text)."""
    shared = SharedModel(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        for batch in batches:
            found = [x for _, texts in text_slices(batch.column(1)) for x in own.score(texts)]
            severity = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array([g for _, g in found], pa.int32()), pa.array([s >= REJECT for s in severity], pa.bool_())], ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, "doc_id long, expected_severity double, grade int, toxic boolean")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose expected severity is below the limit."""
    shared = SharedModel(docs.sparkSession, model)
    return keep_rows(docs, lambda: lambda texts: [s < REJECT for s, _ in scorer(shared).score(texts)])
