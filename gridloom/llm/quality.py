"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

Every word occurrence of a text is a feature of value 1/words in one of ``BUCKETS`` hashed slots;
statistics of the bytes and words fill further slots.  All pairs of features interact through rank
``RANK`` factors; with the sum-of-squares identity a score costs one pass over the words:
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.

The model is fitted on a bounded sample: the ``TRAIN_ROWS`` labelled documents with the smallest
hash of their id, among those that are admitted; of several rows with one id the text of least hash counts.  Scores use the text alone.

Edge cases: null and empty texts are scored from zero statistics; a null label is no label, the
smallest of several labels of a document counts; without labelled rows every score is 0.5; repeated
rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm import tokens as T

BUCKETS, RANK, TRAIN_ROWS, EPOCHS, THRESHOLD = 8192, 8, 6000, 12, 0.3
_CLASSES = 12
_CLASS = np.full(256, 10, np.int64)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\v\f\r", 3), (b"\n", 4), (b".,;:'\"-?()", 5), (b"!", 6), (b"#", 7), (b"$%&*", 8), (b"|", 9)):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 11
STATS = _CLASSES + 6


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each document, statistics per document)."""
    w = T.words_of(col)
    buckets = (w.hashes >> T.U64(51)).astype(np.int64) % BUCKETS
    stats = np.zeros((w.n_docs, STATS))
    for i in range(w.n_docs):
        text = w.data[w.doc_bytes[i] : w.doc_bytes[i + 1]]
        h = w.hashes[w.first[i] : w.first[i + 1]]
        if not len(text):
            continue
        stats[i, :_CLASSES] = np.bincount(_CLASS[text], minlength=_CLASSES) / len(text)
        n = max(len(h), 1)
        stats[i, _CLASSES:] = (np.log1p(len(h)), len(text) / n / 10, len(np.unique(h)) / n, (h[1:] == h[:-1]).sum() / n, (h[2:] == h[:-2]).sum() / n, np.log1p(len(text)))
    return buckets, w.first, stats


class Machine:
    """Parameters: bias, weights and factors of the buckets and then the statistics, and the statistics' scale."""

    def __init__(self, bias, weights, factors, mean, scale):
        self.bias, self.mean, self.scale = bias, mean, scale
        self.weights, self.factors = weights, factors
        self.table = np.c_[factors[:BUCKETS], weights[:BUCKETS], (factors[:BUCKETS] ** 2).sum(axis=1)].astype(np.float32)

    def score(self, buckets: np.ndarray, first: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        total = np.zeros((len(n), RANK + 2))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(self.table[buckets], first[:-1][some], axis=0)
        x = 1.0 / np.maximum(n, 1)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        v, w = self.factors[BUCKETS:], self.weights[BUCKETS:]
        s = total[:, :RANK] * x[:, None] + z @ v
        q = total[:, RANK + 1] * x * x + (z * z) @ (v * v).sum(axis=1)
        y = self.bias + total[:, RANK] * x + z @ w + ((s * s).sum(axis=1) - q) / 2
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """Adam on the logistic loss; rows: (buckets, counts, statistics, label)."""
    size = BUCKETS + STATS
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size), rng.normal(0, 0.05, (size, RANK)), 0.0
    if not rows:
        return Machine(0.0, w, np.zeros((size, RANK)), np.zeros(STATS), np.ones(STATS))
    stats, y = np.stack([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    z = np.clip((stats - mean) / scale, -6, 6)
    params, lr = [w, v], 0.01
    first, second, step, mb, sb = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), 128):
            part = order[a : a + 128]
            idx = np.concatenate([np.concatenate([rows[i][0], np.arange(BUCKETS, size)]) for i in part]).astype(np.int64)
            val = np.concatenate([np.concatenate([rows[i][1] / max(rows[i][1].sum(), 1), z[i]]) for i in part])
            sq = np.concatenate([np.concatenate([rows[i][1] / max(rows[i][1].sum(), 1) ** 2, z[i] ** 2]) for i in part])
            n = np.array([len(rows[i][0]) + STATS for i in part])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            doc = np.repeat(np.arange(len(part)), n)
            s = np.add.reduceat(val[:, None] * v[idx], at, axis=0)
            q = np.add.reduceat(sq[:, None] * v[idx] ** 2, at, axis=0)
            out = bias + np.add.reduceat(val * w[idx], at) + (s * s - q).sum(axis=1) / 2
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
            gw = np.bincount(idx, val * g[doc], size) + 1e-5 * w
            gv = np.stack([np.bincount(idx, g[doc] * (val * s[doc, f] - sq * v[idx, f]), size) for f in range(RANK)], axis=1) + 1e-5 * v
            step += 1
            for p, m1, m2, grad in zip(params, first, second, (gw, gv), strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                p -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
            bias -= lr * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return Machine(bias, w, v, mean, scale)


def _lists(col: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in col]


def train(docs: DataFrame, labels: DataFrame, admitted, train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``train_rows`` labelled documents (``admitted``: condition on doc_id)."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & admitted)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(train_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by train_rows
    # one text for each id, however many rows have it
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("quality", "least.text")
    schema = pa.schema([("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64())), ("quality", pa.int32())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                b, first, stats = features(batch.column("text"))
                uc = [np.unique(b[first[i] : first[i + 1]], return_counts=True) for i in range(len(stats))]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in uc], schema.types[0]), pa.array([c for _, c in uc], schema.types[1]), pa.array(list(stats), schema.types[2]), batch.column("quality").cast(pa.int32())], schema=schema)

    rows = chosen.select("text", "quality").mapInArrow(run, "buckets array<int>, counts array<int>, stats array<double>, quality int").toArrow().combine_chunks()
    got = list(zip(*(_lists(rows.column(c), t) for c, t in (("buckets", np.int64), ("counts", float), ("stats", float))), rows.column("quality").to_pylist(), strict=True))
    got.sort(key=lambda r: (r[3], len(r[0]), r[2].tobytes(), r[0].tobytes(), r[1].tobytes()))  # the same model in any order of rows
    return fit(got)


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` of scores; the model is a broadcast of fixed size (under 1 MB)."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    out = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, text):
                s = held.value.score(*features(batch.column(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, out)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    scored = score(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
