"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; all rows that are not held out are unlabelled web text in which good and bad are
mixed. The class prior is estimated from how a first positive-against-unlabelled model ranks the rows that it was not fitted to:
above some score almost only good texts are left, and there the share of unlabelled to positive rows is the prior. A linear model
then minimises the non-negative unbiased risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  under the logistic loss; where the
part for negatives falls below zero, a step goes back up on that part alone.

Features of a whole text: rates of surface counts, and frequencies of hashed word endings. No identifier, source, language or
label is among them. They are computed once and written. Of the labelled rows at most ``positives`` (a parameter; chosen by a hash
of doc_id, from rows that are not held out) reach the driver. Of the unlabelled rows ``first`` do, to start the descent on; the sums of
all later steps, of the scaling and of the prior are made over all rows, by the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.quality_rules import measure
from quarry.llm.shared import Scratch, map_rows

HASHED = 256
DENSE = 18
SIZE = DENSE + HASHED
#: Sums travel in whole parts of one, so that they do not depend on the order in which they are added.
PARTS = 1 << 20
#: The prior's estimate comes from above; one that is a little too large calls bad texts good, one that is too small does no harm.
SLACK = 0.99


@lru_cache(maxsize=50_000)
def _slot(ending: bytes) -> int:
    return zlib.crc32(ending) % HASHED


def features(text: str | None) -> np.ndarray:
    """float32 features of one text; of null or empty ones all zero but the constant."""
    out = np.zeros(DENSE + HASHED, np.float32)
    m = measure(text)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_letters, n_upper, n_bangs, n_ends, n_bare = m
    n = max(1, n_words)
    upper = n_upper / max(1, n_letters)
    out[:DENSE] = (1, *(min(1.0, 4 * rate) for rate in (n_symbols / n, n_dup_lines / max(1, n_lines), n_repeat / n, upper, n_bangs / n, n_bare / n)), np.log1p(n_words) / 5, min(word_chars / n, 40) / 5, min(n_symbols / n, 5), n_dup_lines / max(1, n_lines), n_repeat / n, upper, min(n_bangs / n, 5), n_ends / n, n_bare / n, min(n / max(1, n_lines), 100) / 20, n_letters / max(1, word_chars))
    if n_words:
        for ending, k in Counter(w[-2:] for w in text.encode("utf-8", "surrogatepass").split()).items():
            out[DENSE + _slot(ending)] += k
        out[DENSE:] = np.sqrt(out[DENSE:] / n_words)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descend(gradient, w: np.ndarray, steps: int, rate: float, memory: float = 0.99, decay: float = 1e-3) -> np.ndarray:
    """Adam with a falling rate; the best point that it met. ``gradient`` gives (objective, direction)."""
    m, v = np.zeros(len(w)), np.zeros(len(w))
    best = (np.inf, w)
    for t in range(1, steps + 1):
        value, g = gradient(w)
        value, g = value + decay / 2 * float(w @ w), g + decay * w
        if value < best[0]:
            best = (value, w.copy())
        m, v = 0.9 * m + 0.1 * g, memory * v + (1 - memory) * g * g
        w = w - rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - memory**t)) + 1e-8)
    return best[1]


def _sums(rows: DataFrame, width: int, part) -> np.ndarray:
    """The sum over all rows (column x) of the ``width`` numbers that ``part`` makes of a matrix of features."""
    import pyarrow as pa

    def run(batches):
        total, any_rows = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                total, any_rows = total + part(matrix(batch.column(0))), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.rint(total * PARTS).astype(np.int64))], names=["at", "v"])

    out = np.zeros(width)
    for r in rows.select("x").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["at"]] = float(r["v"]) / PARTS
    return out


def matrix(column) -> np.ndarray:
    """Rows of features from an Arrow array of binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float32)


def losses(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[rows, sum of the loss of calling them negative, its gradient] of a matrix of features."""
    z = x @ w.astype(x.dtype)
    return np.concatenate([[len(z), np.logaddexp(0, z.astype(np.float64)).sum()], (x.T @ _sigmoid(z)).astype(np.float64)])


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(risk, its part for negatives, direction of the step), given ``losses`` of the unlabelled rows."""
    z = positive @ w
    s, n = _sigmoid(z), unlabelled[0]
    gain, loss = np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean()
    negative = unlabelled[1] / n - prior * loss
    down = unlabelled[2:] / n - prior * (positive.T @ s) / len(z)
    step = -down if negative < 0 else down - prior * (positive.T @ (1 - s)) / len(z)
    return float(prior * gain + max(0.0, negative)), float(negative), step


def class_prior(positive: np.ndarray, rows: DataFrame, scale: np.ndarray, steps: int = 24) -> float:
    """Share of positives among the unlabelled rows (columns x and even): even rows fit, odd rows count."""
    p, p2 = positive[::2], positive[1::2]
    even, odd = rows.where("even"), rows.where("not even")
    if not len(p2) or even.isEmpty() or odd.isEmpty():
        return 0.5

    def gradient(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = _sums(even, SIZE + 2, lambda x: losses(x / scale, w))
        z = p @ w
        return float(np.logaddexp(0, -z).mean() + got[1] / got[0]), got[2:] / got[0] - (p.T @ (1 - _sigmoid(z))) / len(p)

    w = _descend(gradient, np.zeros(SIZE), steps, 0.05)
    a = np.sort(p2 @ w)
    cuts = np.quantile(a, np.linspace(0, 0.75, 76))  # at least a quarter of the positives above the cut
    above = _sums(odd, len(cuts) + 1, lambda x: np.array([len(x), *((x / scale @ w.astype(np.float32))[:, None] >= cuts).sum(axis=0)], float))
    of_positive = 1 - np.searchsorted(a, cuts) / len(a)
    return float(min(0.99, max(0.01, SLACK * (above[1:] / above[0] / of_positive).min())))


def fit(positive: np.ndarray, rows: DataFrame, scale: np.ndarray, prior: float, steps: int = 24, first: np.ndarray | None = None) -> np.ndarray:
    """Weights over the scaled features that minimise the non-negative risk. ``first``: some of the unlabelled rows, on which the
    descent starts; its last ``steps`` go over all rows each."""

    def gradient(sums) -> tuple:
        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            value, _, step = risk(positive, sums(w), prior, w)
            return value, step

        return at

    w = np.zeros(SIZE)
    if first is not None and len(first):
        w = _descend(gradient(lambda w: losses(first, w)), w, 400, 0.05, 0.999)
    return _descend(gradient(lambda w: _sums(rows, SIZE + 2, lambda x: losses(x / scale, w))), w, steps, 0.02)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def with_features(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The columns of ``carry`` and x, the features as 16-bit floats."""
    return map_rows(docs, text, [("x", T.BinaryType())], lambda ts: [[features(t).astype(np.float16).tobytes() for t in ts]], carry)


def train(featured: DataFrame, labels: DataFrame, doc_id: str, positives: int = 4000, first: int = 8000) -> tuple[np.ndarray | None, float]:
    """(weights with scaling folded in, prior) from a written table with columns doc_id and x. (None, 0.5) without trusted positives
    or without rows to learn from.

    Of several labels of one doc_id the lowest counts; labels without doc_id or quality are ignored; of several rows with one
    doc_id all are unlabelled rows, and one, with the least features, a positive. ``first``: rows that the descent starts on.
    """
    plain = featured.select(F.col(doc_id).alias("doc_id"), "x").where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("even", F.xxhash64("doc_id") % 2 == 0)
    trusted = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    drawn = plain.select("doc_id").distinct().join(trusted, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    found = plain.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    if not found:
        return None, 0.5
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    x = np.array([np.frombuffer(r.x, np.float16) for r in found], np.float64)
    sums = _sums(plain, 2 * SIZE + 1, lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0)]))
    mean, square = sums[1 : SIZE + 1] / sums[0], sums[SIZE + 1 :] / sums[0]
    spread = np.sqrt(np.maximum(0, square - mean**2)) + 1e-2
    spread[DENSE:] *= 3  # surface rates before endings
    scale = spread.astype(np.float32)
    prior = class_prior(x / spread, plain, scale)
    some = plain.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(first).select("x").collect()
    start = np.array([np.frombuffer(r.x, np.float16) for r in some], np.float64) / spread
    return fit(x / spread, plain, scale, prior, first=start) / spread, prior


def scored(featured: DataFrame, weights: np.ndarray | None, name: str = "score") -> DataFrame:
    """featured with the score instead of x."""
    carry = [c for c in featured.columns if c != "x"]
    schema = T.StructType([*featured.select(*carry).schema.fields, T.StructField(name, T.DoubleType())])
    n = len(carry)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(n)).astype(np.float64)
            z = np.zeros(len(x)) if weights is None else (x * weights).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(_sigmoid(z))], names=schema.names)

    return featured.select(*carry, "x").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, null, empty and repeated ones included (null scores as the empty text;
    a null doc_id is never held out nor learned from). Other columns are ignored; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "classifier")
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    featured = scratch.keep(with_features(plain, "__t", ["__id"]))
    weights, _ = train(featured, labels, "__id")
    return scored(featured, weights).select(F.col("__id").alias(doc_id), held_out("__id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that are predicted good, unchanged."""
    scratch = scratch or Scratch(docs.sparkSession, "classifier-keep")
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    featured = scratch.keep(with_features(plain.withColumn("__t", F.col(f"d{names.index(text)}")), "__t", plain.columns))
    weights, _ = train(featured, labels, f"d{names.index(doc_id)}")
    return scored(featured, weights, "__score").where(F.col("__score") >= threshold).select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(names)])
