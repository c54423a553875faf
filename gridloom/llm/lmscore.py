"""Masked pseudo-likelihood: a bidirectional window network scores every word from both sides.

Vocabulary: words of the whole corpus are counted by Spark; the ``HEAD`` most frequent get ids by
rank, all others one of ``TAIL`` hashed ids, and within its id each has its share of the id's count:
P(word) = P(id) * n(word) / (n(id) + 1), so the model of rare words grows with the vocabulary.  Counts of
rare words stay distributed and meet the texts' rare words in one join on hash.  The network averages context embeddings (``REACH``
words on each side, never the word itself) through tanh and predicts the word's branch in a tree of ``SIDE``
branches at each of ``DEPTH`` levels (ids by rank, so that branches hold words of like frequency), so that a word
costs three small softmaxes.  It starts from the corpus' unigram frequencies.  Every task trains on all documents of its partition, and the parameters
are averaged, weighted by words, over ``ROUNDS`` rounds; parameters and model have a fixed size.  As
each task trains its own copy, scores depend a little on how the rows lie in partitions.

A document's score is the sum over its words of log P(word | its neighbours).

Edge cases: words that the corpus lacks count as seen once; null and empty texts have no words and the sum 0, mean null; an empty corpus gives a
uniform model and no rows; repeated rows score alike; ties in frequency go by word hash; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T
from gridloom.llm.store import cut

SIDE, DEPTH, HEAD, WIDTH, REACH, ROUNDS, BATCH, AVERAGERS = 16, 3, 3072, 16, 2, 2, 8192, 16
SIZE = SIDE**DEPTH
TAIL, PAD = SIZE - HEAD, SIZE
SHAPES = {"embed": (SIZE + 1, WIDTH), **{f"tree{d}": (SIDE ** (d + 1), WIDTH + 1) for d in range(DEPTH)}}


class Vocabulary:
    """Ids of words.  ``mass``: occurrences of each tail id; ``rare``: hash, n of tail words seen twice or more (a DataFrame)."""

    def __init__(self, hashes: np.ndarray, mass: np.ndarray | None = None, rare: DataFrame | None = None):
        self.mass, self.rare = np.zeros(TAIL) if mass is None else mass, rare
        self.rank = np.argsort(hashes, kind="stable").astype(np.int64)
        self.sorted = hashes[self.rank]

    def ids(self, h: np.ndarray) -> np.ndarray:
        tail = HEAD + (h >> T.U64(40)).astype(np.int64) % TAIL
        if not len(self.sorted):
            return tail
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.rank[at], tail)

    def local(self) -> Vocabulary:
        """Without the DataFrame, for tasks."""
        out = Vocabulary(np.zeros(0, T.U64), self.mass)
        out.rank, out.sorted = self.rank, self.sorted
        return out


class Network:
    """Parameters by name (see SHAPES), float32; the last column of each level of the tree is a bias."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.1, s).astype(np.float32) if k == "embed" else np.zeros(s, np.float32) for k, s in SHAPES.items()}
        for d in range(DEPTH):
            c = (counts + 0.5).reshape(SIDE ** (d + 1), -1).sum(axis=1).reshape(-1, SIDE)
            p[f"tree{d}"][:, WIDTH] = np.log(c / c.sum(axis=1, keepdims=True)).ravel()
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        p, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            p[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
        return cls(p)

    def _forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of words by branch, their ids, hidden states and a 1) of a padded run."""
        e = self.p["embed"][ids]
        h = np.zeros((len(ids), WIDTH + 1), np.float32)
        for j in range(1, REACH + 1):
            h[j:, :WIDTH] += e[:-j]
            h[:-j, :WIDTH] += e[j:]
        at = np.flatnonzero(ids[REACH:-REACH] != PAD) + REACH
        at = at[np.argsort((ids[at] // SIDE).astype(np.uint8), kind="stable")]  # a radix sort; SIZE / SIDE <= 256
        h = h[at]
        np.tanh(h, out=h)
        h[:, WIDTH] = 1
        return at, ids[at], h

    def _levels(self, w: np.ndarray, h: np.ndarray):
        """Of each level of the tree, for words sorted by branch: (name, rows of each node on it, logits, branch taken)."""
        for d in range(DEPTH):
            below = SIDE ** (DEPTH - 1 - d)
            node = w // (below * SIDE)
            ends = np.searchsorted(node, np.arange(SIDE**d + 1)).tolist()
            nodes = [(k, slice(ends[k], ends[k + 1])) for k in range(SIDE**d) if ends[k] < ends[k + 1]]
            weights, z = self.p[f"tree{d}"].reshape(-1, SIDE, WIDTH + 1), np.empty((len(w), SIDE), np.float32)
            for k, rows in nodes:
                np.dot(h[rows], weights[k].T, out=z[rows])
            yield f"tree{d}", nodes, z, w // below % SIDE

    def log_prob(self, ids: np.ndarray) -> np.ndarray:
        """log P(id | its neighbours) at every place of a padded run (see :func:`padded`), 0 at PAD."""
        out = np.zeros(len(ids))
        for part, a in _parts(ids, BATCH):
            at, w, h = self._forward(part)
            row, total = np.arange(len(w)), np.zeros(len(w))
            for _, _, z, branch in self._levels(w, h):
                total += z[row, branch] - _lse(z)
            out[a + at] = total
        return out

    def train(self, ids: np.ndarray, seen: dict, batch: int = BATCH, lr: float = 0.12) -> None:
        """One pass of Adagrad over a padded run; ``seen`` keeps the squared gradients."""
        for part, _ in _parts(ids, batch):
            at, w, h = self._forward(part)
            n = len(w)
            if not n:
                continue
            row, dh, more, grads = np.arange(n), np.zeros_like(h), np.empty_like(h), {}
            for name, nodes, z, branch in self._levels(w, h):
                g = _softmax(z)
                g[row, branch] -= 1
                weights, gw = self.p[name].reshape(-1, SIDE, WIDTH + 1), np.zeros((len(self.p[name]) // SIDE, SIDE, WIDTH + 1), np.float32)
                for k, rows in nodes:
                    np.dot(g[rows].T, h[rows], out=gw[k])
                    np.dot(g[rows], weights[k], out=more[rows])
                dh += more
                grads[name] = gw.reshape(SHAPES[name])
            dh *= 1 - h * h
            back = np.zeros((len(part), WIDTH), np.float32)
            back[at] = dh[:, :WIDTH]
            ge = np.zeros_like(back)  # a place feeds the words around it
            for j in range(1, REACH + 1):
                ge[j:] += back[:-j]
                ge[:-j] += back[j:]
            slot = part[:, None] * WIDTH + np.arange(WIDTH)
            grads["embed"] = np.bincount(slot.ravel(), ge.ravel(), (SIZE + 1) * WIDTH).astype(np.float32).reshape(SHAPES["embed"])
            for k, grad in grads.items():
                if k not in seen:
                    seen[k] = np.full(SHAPES[k], 1e-6, np.float32)
                grad /= n
                seen[k] += grad * grad
                grad *= np.float32(lr)
                grad /= np.sqrt(seen[k])
                self.p[k] -= grad


def _parts(ids: np.ndarray, size: int):
    """Pieces of about ``size`` places with REACH more on each side, and where they begin; they own their inner places."""
    for a in range(REACH, len(ids) - REACH, size):
        z = min(a + size, len(ids) - REACH)
        yield ids[a - REACH : z + REACH], a - REACH


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - top) and top: one for all rows if they are near each other, else by row."""
    low, top = z.min(), z.max()
    if top - low > 60:
        top = z.max(axis=1)[:, None]
    return np.exp(np.subtract(z, top, out=z), out=z), top


def _softmax(z: np.ndarray) -> np.ndarray:
    e, _ = _exp(z)
    e /= (e @ np.ones(e.shape[1], np.float32))[:, None]
    return e


def _lse(z: np.ndarray) -> np.ndarray:
    e, top = _exp(z)
    return np.ravel(top) + np.log(e @ np.ones(e.shape[1], np.float32))


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place): the words of all documents with REACH times PAD before, between and after them, and each word's place.

    ``first``: the first word of each document, and the number of words.
    """
    place = np.arange(len(ids)) + REACH * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    run = np.full(len(ids) + REACH * len(first), PAD, np.int32)
    run[place] = ids
    return run, place


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, n: how often each word occurs in all texts."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text", 16 << 20):
                h, n = np.unique(T.words_of(batch.column("text")).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus (column text)."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs))
    top = [(r["hash"], r["n"]) for r in counts.orderBy(F.desc("n"), "hash").limit(HEAD).collect()]  # at most HEAD rows
    hashes = np.array([h for h, _ in top], np.int64).view(np.uint64)
    head = spark.createDataFrame([(h,) for h, _ in top], "hash long")
    tail = counts.join(F.broadcast(head), "hash", "left_anti")
    mass = np.zeros(TAIL)
    for slot, n in tail.groupBy(F.pmod(F.shiftrightunsigned("hash", 40), F.lit(TAIL)).alias("slot")).agg(F.sum("n")).collect():  # at most TAIL rows
        mass[slot] = n
    vocabulary = Vocabulary(hashes, mass, tail.filter("n > 1"))
    freq = np.zeros(SIZE)
    freq[: len(top)] = [n for _, n in top]
    freq[HEAD:] = mass
    net = Network.start(freq)
    schema = pa.schema([("n", pa.int64()), ("flat", pa.binary())])
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((vocabulary.local(), net.flat()))

        def learn(batches, held=held):
            voc, flat = held.value
            own, seen, n = Network.of(flat.copy()), {}, 0
            for whole in batches:
                for batch in T.slices(whole, "text"):
                    w = T.words_of(batch.column("text"))
                    ids = voc.ids(w.hashes)
                    own.train(padded(ids, w.first)[0], seen)
                    n += len(ids)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.flat().astype(np.float32).tobytes()], pa.binary())], schema=schema)

        def average(batches):
            n, total = 0, 0.0
            for batch in batches:
                for k, flat in zip(batch.column("n").to_pylist(), batch.column("flat").to_pylist(), strict=True):
                    n, total = n + k, total + k * np.frombuffer(flat, np.float32).astype(np.float64)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], schema=schema)

        parts = docs.select("text").mapInArrow(learn, "n long, flat binary").repartition(AVERAGERS).mapInArrow(average, "n long, flat binary").collect()
        if not parts:
            break
        n = sum(r["n"] for r in parts)
        flats = sorted((r["n"], bytes(r["flat"])) for r in parts)
        net = Network.of(sum(k / n * np.frombuffer(f, np.float32).astype(np.float64) for k, f in flats))
    return vocabulary, net


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_words, log_prob (sum) and mean_log_prob of each text."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.local(), net.flat()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("part", pa.float64()), ("tail", pa.list_(pa.int64()))])

    def run(batches):
        voc, flat = held.value
        own = Network.of(flat)
        for whole in batches:
            for batch in T.slices(whole, "text"):
                w = T.words_of(batch.column("text"))
                ids, doc, n = voc.ids(w.hashes), T.doc_of_word(w), np.diff(w.first)
                run_, place = padded(ids, w.first)
                total = np.bincount(doc, own.log_prob(run_)[place], w.n_docs)
                rare = ids >= HEAD
                total -= np.bincount(doc[rare], np.log(voc.mass[ids[rare] - HEAD] + 1), w.n_docs)
                first = np.concatenate([[0], np.cumsum(rare)])[w.first]
                tail = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(w.hashes[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64()), tail], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, part double, tail array<long>")
    if vocabulary.rare is None:
        sums = rows.select("doc_id", "n_words", F.col("part").alias("log_prob"))
    else:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        more = rows.select("row", F.explode("tail").alias("hash")).join(vocabulary.rare, "hash").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        sums = rows.join(more, "row", "left").select("doc_id", "n_words", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    return sums.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *fit(docs.select("text")))
