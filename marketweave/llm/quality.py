"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a vector of statistics, transformed towards bell shapes (logarithms of
counts, square roots of shares). The statistics of a text of m words are drawn to the mean of class 1
as if it had DAMPING more words of that kind: a few words are weak evidence. Each class has its mean and a covariance shrunk towards the pooled
diagonal; the driver keeps the Cholesky factors of the two small matrices. The score of a text is
the logistic of the difference of the Mahalanobis log-densities, tempered by ``temperature`` because
the statistics of one text are not independent observations.

The moments are sums over all labelled rows of the training folds, added up by Spark; nothing but
two d x d matrices reaches the driver. Labels, language, source and ids are no inputs of a score.

Edge cases: null and empty texts have statistics (all zero) and get a score; an id with several
labels takes their majority, a tie takes no part; a class without rows gives the score 0.5 times
what the prior says, that is the share of class 1 (0.5 if there are no labels at all); other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import fold_of, plain_texts, spool, text_rows

N_FEATURES = 20
DAMPING = 10
_WORDISH = np.zeros(256, dtype=bool)
_WORDISH[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    m = len(words)
    bins = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = int(bins[_WORDISH].sum())
    upper = int(bins[0x41:0x5B].sum())
    digits = int(bins[0x30:0x3A].sum())
    stops = int(bins[0x2E] + bins[0x2C])
    lines = int(bins[0x0A]) + 1
    marks = n - letters - digits - stops - int(bins[0x20] + bins[0x0A])
    counts: dict[str, int] = {}
    same = longest = run = bare = shout = tail = 0
    before = None
    for w in words:
        counts[w] = counts.get(w, 0) + 1
        if w == before:
            same += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
        before = w
        if not w.isalpha():
            last = w[-1]
            if not last.isalnum() and last not in ".,":
                tail += 1
            if len(w) == 1:
                bare += 1
        if w.isupper() and len(w) > 2:
            shout += 1
    top = max(counts.values())
    share = bins[bins > 0] / n
    kept = [x for x in text.split("\n") if x]
    packed = len(zlib.compress(data, 1))
    root = np.sqrt
    return [
        float(x)
        for x in (
            np.log1p(m), np.log1p(lines), np.log(letters / m + 0.1), root(upper / n), root(digits / n), root(marks / n), root(stops / n),
            np.log(len(counts) / m), np.log(top / m), np.log1p(longest), root(same / m), root(bare / m), root(shout / m), root(tail / m),
            float(-(share * np.log(share)).sum()), root(1 - len(set(kept)) / max(len(kept), 1)), np.log(packed / n), root(int(bins[0x7C]) / n),
            np.log1p(m / lines), root(int(bins[0x21]) / n),
        )
    ]


def _vectors(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in plain_texts(batch.column(1))], schema.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), x], schema=schema)

    return run


def damped(x: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """The vectors drawn to the typical one by their number of words, which itself stays."""
    m = np.expm1(x[:, :1])
    out = typical + (x - typical) * (m / (m + DAMPING))
    out[:, 0] = x[:, 0]
    return out


def _moments(typical: np.ndarray):
    schema = pa.schema([("quality", pa.int32()), ("at", pa.int32()), ("part", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums of 1, x and x x' per class: 2 (d + 1)^2 rows a partition at most."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist()).reshape(-1, N_FEATURES)
            for label in set(labels.tolist()):
                part = damped(x[labels == label], typical)
                part = np.column_stack((np.ones(len(part)), part))
                sums[label] = sums.get(label, 0) + part.T @ part
        for label, s in sums.items():
            arrays = [np.full(s.size, label, np.int32), np.arange(s.size, dtype=np.int32), s.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], schema=schema)

    return run


class Discriminant:
    """Two Gaussian densities with shrunk covariances, kept as Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], typical: np.ndarray, shrinkage: float, temperature: float):
        self.typical, self.temperature = typical, temperature
        self.counts = {k: float(sums[k][0, 0]) if k in sums else 0.0 for k in (0, 1)}
        self.ready = min(self.counts.values()) > 1
        if not self.ready:
            return
        total = sum(sums.values())
        n = total[0, 0]
        self.center = total[0, 1:] / n
        pooled = total[1:, 1:] / n - np.outer(self.center, self.center)
        # a statistic that hardly varies among the labelled texts must not decide alone
        self.scale = np.maximum(np.sqrt(np.maximum(np.diag(pooled), 0)), 0.05)
        self.means, self.factors, self.logdets = {}, {}, {}
        for k, s in sums.items():
            mean = s[0, 1:] / s[0, 0]
            cov = (s[1:, 1:] / s[0, 0] - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            cov = (1 - shrinkage) * cov + shrinkage * np.eye(len(mean)) * max(np.trace(cov) / len(mean), 1e-6)
            factor = np.linalg.cholesky(cov)
            self.means[k] = (mean - self.center) / self.scale
            self.factors[k] = np.linalg.inv(factor)
            self.logdets[k] = 2 * float(np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        n = self.counts[0] + self.counts[1]
        if not self.ready or not len(x):
            return np.full(len(x), self.counts[1] / n if n else 0.5)
        z = (damped(x, self.typical) - self.center) / self.scale
        log = {k: -0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.logdets[k] for k in (0, 1)}
        diff = (log[1] - log[0]) / self.temperature + np.log(self.counts[1] / self.counts[0])
        return 1 / (1 + np.exp(-np.clip(diff, -500, 500)))


def vectors(documents: DataFrame) -> DataFrame:
    docs = text_rows(documents, "doc_id", "text")
    schema = documents.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>").schema
    return docs.mapInArrow(_vectors(to_arrow_schema(schema)), schema)


def fit(rows: DataFrame, labels: DataFrame, shrinkage: float = 0.05, temperature: float = 4.0) -> Discriminant:
    """rows: doc_id and x of the documents that may be learned from, all of which are used."""
    votes = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("share")).where("share <> 0.5")
    known = spool(rows.join(votes, "doc_id").select(F.round("share").cast("int").alias("quality"), "x"), "labelled")
    means = known.where("quality = 1").agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(N_FEATURES)]).first()
    typical = np.array([v or 0.0 for v in means])
    summed = known.mapInArrow(_moments(typical), "quality int, at int, part double").groupBy("quality", "at").agg(F.sum("part").alias("s"))
    d = N_FEATURES + 1
    sums: dict[int, np.ndarray] = {}
    for r in summed.collect():  # 2 x 441 numbers
        sums.setdefault(r["quality"], np.zeros(d * d))[r["at"]] = r["s"]
    return Discriminant({k: s.reshape(d, d) for k, s in sums.items()}, typical, shrinkage, temperature)


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; the held-out fold is not learned from."""
    rows = spool(vectors(documents), "statistics")
    model = documents.sparkSession.sparkContext.broadcast(fit(rows.where(fold_of("doc_id", folds) != held_out), labels))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.array(x.tolist()).reshape(-1, N_FEATURES)))

    out = rows.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    rows = vectors(documents).where(fold_of("doc_id", folds) != held_out)
    model = documents.sparkSession.sparkContext.broadcast(fit(rows, labels))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in plain_texts(batch.column(at))]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.value.scores(x) >= threshold, pa.bool_()))

    return text_rows(documents, "*").mapInArrow(run, documents.schema)
