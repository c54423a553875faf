"""Exact top-k by exhaustive term-at-a-time accumulation.

Every component x of a vector becomes floor(``SCALE`` * x); a vector is a sparse row of (term, weight) pairs, a term being a
component's place.  Candidates are dealt by hash into blocks of about ``BLOCK`` rows; a task turns its block into postings, for
each term the slots that hold it and their weights, and takes the queries ``QUERIES`` at a time: for each term in turn the
queries' weights scatter the term's postings into one dense array of integer scores a query.  A partition of each array
selects its k best, and the blocks' winners are merged by one ranking a query.  Nothing is skipped, so the result is exact.

Queries travel in groups of about ``GROUP`` rows: a task meets one block with one group, and candidates are
shipped once for each group, queries once for each block.  Work is queries x candidates x terms by definition.

Accumulators are as narrow as the largest possible score allows: 32 or 64 bits, else whole numbers of any size
(then scores beyond a long are cut to its range after ranking).

Edge cases: rows without a vec_id and vectors that are null or hold a null or non-finite component take no part; zero and empty
vectors take part with scores of 0; a component that a shorter vector lacks counts as 0; repeated rows (id and vector)
count once; a query's vec_id with several vectors asks with each of them, and the best score for a candidate counts, a candidate vec_id with several
vectors has the best of its scores; no row of the query's own vec_id is a candidate; ties go to the smaller vec_id; fewer than k candidates
give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import cut

SCALE, BLOCK, GROUP, QUERIES = 1024, 16384, 16384, 64
SLACK = 1 << 16  # scores of a tie's key are spread over so many slots
HITS = "query_id long, vec_id long, high string, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("high", pa.string()), ("score", pa.int64())])
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the distinct rows that take part."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & good).select(F.col("vec_id").cast("long"), e.alias("embedding")).dropDuplicates()


def sparse_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the nonzero quantised components of a list column; weights as int64, or whole objects if too large."""
    lengths = np.diff(col.offsets.to_numpy())
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(col)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(values) and np.abs(values).max() >= 2.0**50:  # beyond: whole already, and the product with SCALE might not be finite
        weight = np.array([int(v) * SCALE if abs(v) >= 2.0**50 else int(np.floor(SCALE * v)) for v in values.tolist()], object)
    else:
        weight = np.floor(SCALE * values).astype(np.int64)
    some = np.flatnonzero(weight != 0)
    return row[some], term[some], weight[some]


def _largest(row: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """The largest weight and the largest number of terms of a row."""
    return (int(np.abs(weight).max()), int(np.bincount(row).max())) if len(row) else (0, 0)


class Postings:
    """The inverted lists of a block of candidates; slots are in the order of vec_id."""

    def __init__(self, ids: np.ndarray, col: pa.Array):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        row, term, weight = sparse_rows(col)
        slot = np.empty(len(ids), np.int64)
        slot[order] = np.arange(len(ids))
        row = slot[row]
        by = np.lexsort((row, term))
        self.slots, self.weights = row[by], weight[by]
        self.first = np.searchsorted(term[by], np.arange((int(term.max()) if len(term) else -1) + 2))
        self.weight, self.terms = _largest(row, weight)

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Integer scores (n, slots) of ``n`` queries given as sparse rows."""
        top, terms = _largest(row, weight)
        bound = top * self.weight * min(terms, self.terms)
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
        out = np.zeros((n, len(self.ids)), kind)
        by = np.lexsort((row, term))
        row, term, weight = row[by], term[by], weight[by].astype(kind)
        held = self.weights.astype(kind)
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else []
        for a, z in zip(at, [*at[1:], len(term)], strict=True):
            t = term[a]
            if t + 1 >= len(self.first):
                break
            p, q = self.first[t], self.first[t + 1]
            if q - p == len(self.ids):  # a full list needs no scatter
                for r, w in zip(row[a:z], weight[a:z], strict=True):
                    out[r] += w * held[p:q]
            elif q > p:
                slots = self.slots[p:q]
                for r, w in zip(row[a:z], weight[a:z], strict=True):
                    out[r][slots] += w * held[p:q]
        return out

    def best(self, score: np.ndarray, own: int, k: int) -> np.ndarray:
        """Slots of the k best scores of one query, of equal ones those of the smallest ids; ``own`` is no candidate."""
        lo, hi = np.searchsorted(self.ids, [own, own], "left")[0], np.searchsorted(self.ids, own, "right")
        slots = np.concatenate([np.arange(lo), np.arange(hi, len(score))]) if hi > lo else np.arange(len(score))
        s = score[slots]
        if len(s) > k and score.dtype != object:
            least = np.partition(s, len(s) - k)[len(s) - k]
            over, tied = np.flatnonzero(s > least), np.flatnonzero(s == least)
            return slots[np.concatenate([over, tied[: k - len(over)]])]
        return slots[np.lexsort((slots, -s))[:k]] if score.dtype != object else slots[sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]]


def _hits(block: Postings, queries: pa.Table, k: int) -> pa.RecordBatch:
    """The k best candidates of each query in a block."""
    who, what, scores = [], [], []
    n = queries.num_rows
    for a in range(0, n, QUERIES):
        part = queries.slice(a, QUERIES).combine_chunks()
        ids = part.column("vec_id").to_numpy()
        found = block.scores(len(ids), *sparse_rows(part.column("embedding").combine_chunks()))
        for own, s in zip(ids.tolist(), found, strict=True):
            # an id that has several vectors here keeps its best one, so more than k slots may be needed
            wide = k
            while True:
                slots = block.best(s, own, wide)
                if len(slots) < wide or len(np.unique(block.ids[slots])) >= k:
                    break
                wide *= 2
            who.append(np.full(len(slots), own))
            what.append(block.ids[slots])
            scores.extend(s[slots].tolist())
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    # "high" orders scores that no long holds
    high = [None if _LEAST <= x <= _MOST else f"{'+' if x > 0 else '-'}{abs(x):0200d}" for x in scores]
    return pa.RecordBatch.from_arrays([pa.array(cat(who), pa.int64()), pa.array(cat(what), pa.int64()), pa.array(high, pa.string()), pa.array([min(max(x, _LEAST), _MOST) for x in scores], pa.int64())], schema=_HITS)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row of ``vectors`` (vec_id, embedding) with ``is_query``."""
    rows = cut(usable(vectors).withColumn("asks", is_query))
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asking // group))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("vec_id", "embedding", deal(1, blocks).alias("block"), every(groups).alias("grp"))
    right = rows.filter("asks").select("vec_id", "embedding", every(blocks).alias("block"), deal(2, groups).alias("grp"))

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _HITS.empty_table()
        held = Postings(candidates.column("vec_id").to_numpy(), candidates.column("embedding").combine_chunks())
        return pa.Table.from_batches([_hits(held, queries, k)])

    hits = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(run, HITS)
    return merged(hits, k)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """The k best of all blocks' hits, one for each candidate vec_id."""
    # positive giants, then longs, then negative giants: '+' before null before '-' is spelled out as a number
    side = F.when(F.col("high").startswith("+"), 2).when(F.col("high").isNull(), 1).otherwise(0)
    size = F.when(F.col("high").startswith("-"), F.translate("high", "-0123456789", " 9876543210")).otherwise(F.coalesce("high", F.lit("")))
    best = hits.groupBy("query_id", "vec_id").agg(F.max(F.struct(side.alias("side"), size.alias("size"), "score")).alias("top"))
    by = W.partitionBy("query_id").orderBy(F.desc("top"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("top.score").alias("score"))


def op12_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, row_number() OVER () AS r, w FROM v),
p AS (SELECT vec_id, r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r AS cr, sum(q.w * c.w) AS score
    FROM p q JOIN p c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
a AS (SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(s.score, 0)) AS score
    FROM t q JOIN t c ON q.vec_id <> c.vec_id LEFT JOIN s ON s.qr = q.r AND s.cr = c.r WHERE q.vec_id % 100 = 0 GROUP BY ALL),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM a)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 10
"""
