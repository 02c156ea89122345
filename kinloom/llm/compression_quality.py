"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are trained on texts labelled good and bad. A text
is compressed whole with either and with none. The normalised differences of
these sizes, each the difference over the sum, say which class it resembles; a
logistic curve over them, fitted on labelled texts that no dictionary saw,
turns that into a score.

The fit takes at most `sample` labelled rows of each class, chosen by a hash of
doc_id: a bounded sample whatever the corpus. Every text is scored whole.

Defined results: a null text counts as empty and scores like any text, from
sizes of frames without content. Labels that are null are not learned from;
with one class only, every score is that class's share. A doc_id with both
labels counts as bad, one with several texts is learned from by the least text.
Rows are scored one by one. Extra columns of `fit` are ignored, `score` keeps
them but for `text`, `score` and `predicted`. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches

LEVEL, DICTIONARY_BYTES = 3, 112_640


class Model:
    """Dictionaries and the fitted curve; picklable."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.weights, self.share = good, bad, None, 0.5
        self.mean = self.scale = None
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False)
            self._made = (make(self.good), make(self.bad), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        return self._made

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Normalised differences of sizes: good against bad, either against no dictionary, and that against the text; squares and products."""
        g, b, plain = self._compressors()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([(len(g.compress(r)), len(b.compress(r)), len(plain.compress(r)), len(r)) for r in raw], float).reshape(-1, 4)
        sg, sb, sp, n = sizes.T
        over = lambda a, b: (a - b) / (a + b)
        x = np.stack([over(sb, sg), over(sp, sg), over(sp, sb), over(n, sp)], 1)
        return np.concatenate([x, x**2, x[:, :3] * x[:, 3:]], 1)

    def fit_curve(self, texts: list[str], good: np.ndarray) -> None:
        x, y = self.features(texts), good.astype(float)
        self.share = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        w = np.zeros(z.shape[1])
        for _ in range(60):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (y - p) - 0.5 * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def prior(self, good: int, bad: int, good_seen: int, bad_seen: int) -> None:
        """Moves the curve from the sample's share of classes to that of all labelled rows."""
        if self.weights is not None and min(good, bad, good_seen, bad_seen) > 0:
            self.weights[-1] += np.log(good / bad) - np.log(good_seen / bad_seen)
        elif good + bad:
            self.share = good / (good + bad)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = self.features(texts)
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its raw content is a dictionary as well
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model:
    """Trains on at most `sample` labelled rows a class: even ones for dictionaries, odd ones for the curve."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("good"))
    # Ids alone decide who is taken; texts are fetched for those few rows, which are at most 2 * sample.
    rows = known.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "good", F.xxhash64("doc_id").alias("h"))
    chosen = [r for k in (1, 0) for r in rows.where(F.col("good") == k).orderBy("h", "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["good"], r["h"]) for r in chosen], rows.schema)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "good", "h").agg(F.min("text").alias("text"))
    found = sorted(texts.select("h", "doc_id", "good", "text").collect())
    taken = {k: [r for r in found if r["good"] == k] for k in (1, 0)}
    model = Model(*(_dictionary([r["text"] for i, r in enumerate(taken[k]) if i % 2 == 0]) for k in (1, 0)))
    rest = [(r["text"], k) for k in (1, 0) for i, r in enumerate(taken[k]) if i % 2]
    model.fit_curve([t for t, _ in rest], np.array([k for _, k in rest]))
    n = {k: v for k, v in rows.groupBy("good").count().collect()}
    model.prior(n.get(1, 0), n.get(0, 0), sum(k for _, k in rest), sum(1 - k for _, k in rest))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; other columns of `docs` but text are kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c == "text" or c.lower() not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    kept = [f for f in docs.schema.fields if f.name != "text"]
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(where).to_pylist())
            own = [(c, n) for k, (c, n) in enumerate(zip(batch.columns, batch.schema.names)) if k != where]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in own), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*(n for _, n in own), "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
