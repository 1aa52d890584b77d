"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the average of the vectors of its character n-grams (inside word boundaries),
hashed to buckets; a two-class softmax reads the average. Vectors and softmax are trained
together in numpy on a bounded sample of labelled texts. As the score is linear in the
average, a trained model is one number per bucket, and scoring a text is one lookup per
n-gram. Misspellings keep most n-grams of the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import mix, pieces

SIZES = (3, 4, 5)
BUCKET_BITS = 17
DIMENSIONS = 12
EPOCHS, MOST_EPOCHS = 8, 32
RATE = 0.25
SAMPLE = 4_500  # labelled texts used for training, at most; a third toxic
NEUTRAL = 10  # n-grams without any weight that every average starts from, for short texts
CUT = 0.7
PIECE_CHARS = 250_000  # of texts scored at once
STEP = np.uint64(0xA0761D6478BD642F)
_EDGE = np.uint64(1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each behind an edge mark, and the offsets.

    Everything but letters, digits and what lies beyond ASCII is an edge mark.
    """
    joined = "\n" + "\n".join(t.lower() for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", errors="surrogatepass"), dtype="<u4").astype(np.uint64)
    word = (codes >= 128) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    return np.where(word, codes, _EDGE), np.concatenate(([0], np.cumsum(lengths)))


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the bucket at each code point, whether an n-gram begins there, and
    the texts' offsets."""
    codes, offsets = _codes(texts)
    edges = np.concatenate(([0], np.cumsum(codes == _EDGE)))
    hashed = codes
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            return
        hashed = hashed[: len(codes) - n + 1] * STEP + codes[n - 1 :]
        if n in SIZES:
            m = len(hashed)
            inside = edges[n - 1 : n - 1 + m] == edges[1 : 1 + m]  # no edge but at either end
            yield (mix(hashed) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), inside, np.minimum(offsets, m)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = [b[inside] for b, inside, _ in buckets([text])]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


@dataclass
class Model:
    weights: np.ndarray  # float64 per bucket
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic class of each text; a text without n-grams has that of
        the bias alone."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, inside, offsets in buckets(texts):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[bucket] * inside)))
            total += sums[offsets[1:]] - sums[offsets[:-1]]
            many = np.concatenate(([0], np.cumsum(inside)))
            count += many[offsets[1:]] - many[offsets[:-1]]
        return 1 / (1 + np.exp(-(total / (count + NEUTRAL) + self.bias)))


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Adagrad over single texts, for the vectors and the softmax together."""
    size = 1 << BUCKET_BITS
    if not len(labels) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    squares = np.full(size, 1e-8, np.float32)
    softmax = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias, softmax_squares = np.zeros(2, np.float32), np.full((2, DIMENSIONS), 1e-4, np.float32)
    # fewer texts are passed more often, for the same number of steps
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-EPOCHS * SAMPLE // max(len(labels), 1))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(labels)):
            found, counts = features[i]
            if not len(found):
                continue
            share = (counts / (counts.sum() + NEUTRAL)).astype(np.float32)
            rows = vectors[found]
            mean = share @ rows
            logits = softmax @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            pull = error @ softmax
            squares[found] += share * share * (pull @ pull) / DIMENSIONS
            vectors[found] = rows - (rate * share / np.sqrt(squares[found]))[:, None] * pull
            slope = np.outer(error, mean)
            softmax_squares += slope * slope
            softmax -= rate * slope / np.sqrt(softmax_squares)
            bias -= 0.05 * rate * error
    return Model((vectors @ (softmax[1] - softmax[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of its values, without Python numbers."""
    out = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled texts (a third of them toxic where there
    are enough), chosen by a hash of their ids among those not held out.

    Labels that are null or belong to no document are left out; of several labels of one
    document the largest counts, and of several texts of one document the smallest. Features
    are counted where the texts lie; a text sends two numbers per distinct bucket.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    share = {0: sample - sample // 3, 1: sample // 3}
    chosen = [known.filter(F.col("toxic") == y).orderBy(order).limit(n) for y, n in share.items()]
    picked = chosen[0].union(chosen[1])  # at most ``sample`` rows of two numbers: fit to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [counted(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                    pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                ],
                names=["doc_id", "toxic", "buckets", "counts"],
            )

    rows = texts.mapInArrow(run, "doc_id long, toxic int, buckets array<int>, counts array<int>").toArrow()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    features = list(zip(_lists(rows.column("buckets")), _lists(rows.column("counts")), strict=True))
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i], features[i][0].tobytes()))
    return train([features[i] for i in by_id], toxic[by_id].astype(np.int64) if len(ids) else np.zeros(0, np.int64))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus the score (0 to 1) of every whole text; a null text counts as empty.

    Row-local; repeated rows stay rows. The model (about a megabyte, whatever the data)
    is broadcast. A column of ``docs`` named as the score is replaced.
    """
    kept = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        plain = [t or "" for t in texts]
        parts = [shared.value.scores(plain[s]) for s in pieces(np.array([len(t) for t in plain]), PIECE_CHARS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return kept.withColumn(score_col, score(text_col))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
