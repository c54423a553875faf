"""Substring deduplication by De Bruijn compaction.

Edges are all windows of ``K`` consecutive words.  Consecutive edges of a text with the same
minimiser - the least hash among the edge's ``G``-word substrings - travel together as one super-edge
(anchor, content hash, source coordinates), about one row per 14 words.  Equal edges have equal
minimisers, so Spark finds repeats anchor by anchor: super-edges that occur twice as a whole, and,
where an anchor has different super-edges, the repeated single edges within them.

Repeated super-edges are the arcs of a De Bruijn graph whose nodes are (K-1)-word boundaries.  Where a
boundary has one arc in and one arc out, the arcs join a path; pointer-doubling joins give each arc
its path and its offset there.  Occurrences of a path are put together by document and by source
coordinate minus offset; a long span stands if its arcs lie end to end in the source, else its arcs
count one by one.  Words under repeated edges are removed in the end.

Arcs are identified by two 64-bit hashes.  Per-key work is combined before shuffles, and joins on a
frequent arc have its occurrences on one side only.

Edge cases: null and empty texts have no words; texts below K words lose nothing; a window that
repeats within its own document counts; repeated rows remove each other's windows; a null doc_id is
kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T
from gridloom.llm.store import cut, release

K, G = 35, 8
ARC = "anchor long, arc long, head long, tail long, id long, th long, start int, n int, inner boolean"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width] for every full window."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Edges:
    """Edges (K-word windows) of a string column: word table, first word of each edge, edge hash, minimiser."""

    def __init__(self, col: pa.Array, k: int = K, g: int = G):
        w = self.words = T.words_of(col)
        doc = self.doc_of = T.doc_of_word(w)
        h = T.window_hashes(w.hashes, k)
        low = _sliding_min(T.window_hashes(w.hashes, g, seed=2), k - g + 1) if len(h) else h
        ok = np.flatnonzero(doc[k - 1 :] == doc[: len(h)]) if len(h) else np.zeros(0, np.int64)
        self.at, self.hash, self.anchor, self.doc = ok, h[ok], low[ok], doc[ok]
        self.start = ok - w.first[self.doc]  # word number in its document

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first edge, number of edges) of each super-edge."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(new)
        return at, np.diff(np.concatenate([at, [len(self.at)]]))


def arcs(docs: DataFrame, k: int = K, g: int = G, full: bool = True) -> DataFrame:
    """Super-edges of all texts (columns of ARC); ``inner``: an edge repeats within the super-edge.

    Without ``full``, head, tail and inner are left empty for uses that only place known arcs.
    """
    types = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.bool_()]
    names = ["anchor", "arc", "head", "tail", "id", "th", "start", "n", "inner"]

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                e = Edges(batch.column("text"), k, g)
                at, n = e.runs()
                node = T.window_hashes(e.words.hashes, k - 1, seed=3) if full else None
                pw, inv = T.powers(T._Q, len(e.words.hashes) + 1)
                acc = np.zeros(len(e.words.hashes) + 1, T.U64)
                np.cumsum(T.mix(e.words.hashes + T.U64(7)) * pw[: len(e.words.hashes)], out=acc[1:])
                a = e.at[at]
                z = a + n + k - 1
                arc = T.mix((acc[z] - acc[a]) * inv[a] + n.astype(T.U64))
                inner, head, tail = np.zeros(len(at), bool), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                if full and len(a):
                    run_of = np.repeat(np.arange(len(at)), n)
                    order = np.lexsort((e.hash, run_of))
                    twice = (e.hash[order][1:] == e.hash[order][:-1]) & (run_of[order][1:] == run_of[order][:-1])
                    inner[run_of[order][1:][twice]] = True
                    head, tail = node[a], node[z - k + 1]
                rows = pa.array(e.doc[at])
                cols = [pa.array(x.view(np.int64)) for x in (e.anchor[at], arc, head, tail)]
                cols += [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(e.start[at], pa.int32()), pa.array(n, pa.int32()), pa.array(inner)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, ARC)


def paths(repeated: DataFrame) -> DataFrame:
    """(anchor, arc, path, offset): the nonbranching path of every repeated arc and its offset there, in edges.

    ``repeated``: distinct arcs (anchor, arc, head, tail, n).
    """
    a = cut(repeated.select(F.xxhash64("anchor", "arc").alias("aid"), "anchor", "arc", "head", "tail", "n"))
    ins = a.groupBy("tail").agg(F.count(F.lit(1)).alias("c"), F.first("aid").alias("prev"), F.first("n").alias("step")).filter("c = 1")
    outs = a.groupBy("head").agg(F.count(F.lit(1)).alias("c"), F.first("aid").alias("aid")).filter("c = 1")
    plain = outs.join(ins.select(F.col("tail").alias("head"), "prev", "step"), "head").filter("prev <> aid").select("aid", "prev", "step")
    p = a.select("aid").join(plain, "aid", "left").select("aid", F.coalesce("prev", "aid").alias("ptr"), F.coalesce("step", F.lit(0)).cast("long").alias("off"))
    p, before = cut(p), None
    while True:
        up = p.select(F.col("aid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("off").alias("off2"))
        q = cut(p.join(up, "ptr").select("aid", F.col("ptr2").alias("ptr"), (F.col("off") + F.col("off2")).alias("off"), (F.col("ptr") != F.col("ptr2")).alias("moved")))
        moved = q.agg(F.count_if("moved")).first()[0]
        if moved == 0 or moved == before:  # what still moves as much as before runs in circles
            break
        p, before = q.drop("moved"), moved
        release(p.sparkSession)
    done = q.select("aid", F.when(F.col("moved"), F.col("aid")).otherwise(F.col("ptr")).alias("path"), F.when(F.col("moved"), 0).otherwise(F.col("off")).alias("offset"))
    return a.select("aid", "anchor", "arc").join(done, "aid").drop("aid")


def single_edges(mixed: DataFrame, docs: DataFrame, k: int = K, g: int = G) -> DataFrame:
    """(anchor, edge, id, th, start, sole) of the edges in super-edges ``mixed`` (id, th, start, n, sole)."""
    lists = mixed.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "sole")).alias("runs"))
    schema = pa.schema([("anchor", pa.int64()), ("edge", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("sole", pa.bool_())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                e = Edges(batch.column("text"), k, g)
                first = np.searchsorted(e.doc, np.arange(batch.num_rows + 1))
                at, sole = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for i, runs in enumerate(batch.column("runs").to_pylist()):
                    for r in runs:
                        at.append(np.arange(first[i] + r["start"], first[i] + r["start"] + r["n"]))
                        sole.append(np.full(r["n"], r["sole"]))
                at, sole = np.concatenate(at), np.concatenate(sole)
                rows = pa.array(e.doc[at])
                cols = [pa.array(e.anchor[at].view(np.int64)), pa.array(e.hash[at].view(np.int64)), batch.column("id").take(rows), batch.column("th").take(rows), pa.array(e.start[at], pa.int32()), pa.array(sole)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.join(lists, ["id", "th"]).select("id", "th", "text", "runs").mapInArrow(run, "anchor long, edge long, id long, th long, start int, sole boolean")


def repeated_spans(keyed: DataFrame, k: int = K, g: int = G) -> DataFrame:
    """(id, th, start, n): spans of ``n`` repeated edges from word ``start`` in each text of ``keyed`` (id, th, text)."""
    spark = keyed.sparkSession
    every = arcs(keyed, k, g)
    at = F.min(F.struct("id", "th", "start", "n")).alias("rep")
    u = every.groupBy("anchor", "arc").agg(F.count(F.lit(1)).alias("c"), F.max("inner").alias("inner"), at, F.first("head").alias("head"), F.first("tail").alias("tail"))
    v = u.groupBy("anchor").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("any_inner")).filter("total > 1 or any_inner")
    found = cut(u.join(v.select("anchor", "kinds"), "anchor").filter("c > 1 or kinds > 1 or inner"))
    release(spark)
    # arcs that occur as a whole, on their paths
    whole = found.filter("c > 1").select("anchor", "arc", "head", "tail", F.col("rep.n").alias("n"))
    placed = arcs(keyed, k, g, full=False).select("anchor", "arc", "id", "th", "start", "n").join(paths(whole), ["anchor", "arc"])
    spot = (F.col("start") - F.col("offset")).alias("origin")
    spans = placed.select("id", "th", "path", spot, F.col("start").cast("long"), F.col("n").cast("long")).groupBy("id", "th", "path", "origin")
    spans = spans.agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("z"), F.sum("n").alias("sum"), F.collect_set(F.struct("start", "n")).alias("parts"))
    one = F.array(F.struct(F.col("a").alias("start"), (F.col("z") - F.col("a")).alias("n")))
    spans = spans.select("id", "th", F.explode(F.when(F.col("sum") == F.col("z") - F.col("a"), one).otherwise(F.col("parts"))).alias("s")).select("id", "th", "s.start", "s.n")
    spans = cut(spans)
    release(spark)
    # single edges where super-edges differ
    mixed = found.filter("kinds > 1 or inner").select("rep.*", (F.col("c") == 1).alias("sole"))
    edges = cut(single_edges(mixed, keyed, k, g))
    release(spark)
    # cut, so that the join's large side is dealt by itself and a frequent edge's rows can be split
    again = cut(edges.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    single = edges.filter("sole").join(again, ["anchor", "edge"]).select("id", "th", F.col("start").cast("long"), F.lit(1).cast("long").alias("n"))
    return spans.unionByName(single)


def dedup(docs: DataFrame, k: int = K, g: int = G) -> DataFrame:
    """doc_id, n_words, n_removed and kept text of every row of ``docs`` (doc_id, text): without words under repeated windows."""
    own = F.col("doc_id").cast("long")  # spans follow from the text, so that a null may share its id with 0
    keyed = docs.select(F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"), own.alias("doc_id"))
    spans = repeated_spans(keyed.drop("doc_id"), k, g).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                w = T.words_of(batch.column("text"))
                kept, removed = [], []
                for i, spans in enumerate(batch.column("spans").to_pylist()):
                    a, z = w.first[i], w.first[i + 1]
                    gone = np.zeros(z - a + 1, np.int64)
                    for s in spans or ():
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + k - 1] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    removed.append(len(keep) - int(keep.sum()))
                    kept.append(b" ".join([w.data[x:y].tobytes() for x, y in zip(w.starts[a:z][keep], w.ends[a:z][keep], strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return keyed.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op8_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: the words under repeated windows, by the windows as strings
OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS a FROM d WHERE len(w) >= 35),
h AS (SELECT r, a, array_to_string(w[a:a + 34], ' ') AS k FROM s),
g AS (SELECT DISTINCT r, unnest(range(a, a + 35)) AS i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
x AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
t AS (SELECT x.r, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g ON g.r = x.r AND g.i = x.i GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r
"""
