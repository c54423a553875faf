"""Near-duplicates by BagMinHash.

A text's bag holds its five-word shingles with their counts.  A count is discretised into the unit
intervals' dyadic hierarchy [0,1), [1,2), [2,4), [4,8) ...; each (shingle, interval) has a Poisson
process whose rate is the interval's width, and every point carries a register and a height in its
interval, split off by the same hash.  Points above the count are thinned out.  A register's value is
its first point, so two bags agree in a register with the probability of their weighted Jaccard
similarity.  All processes of a text are followed up to one time that fills all registers (longer
for the few texts where it does not), which keeps the work near ``REGISTERS * log REGISTERS`` points
a text besides one draw per shingle.

``BANDS`` bands of ``ROWS`` registers make candidates: exact copies are one node; in every bucket the
smallest node is compared with all others, which emits no pairs within a group.  Similarities are
exact multiset overlaps of the texts (``SIMILAR`` or more).  Where a bucket still spans several components
after that, all its members' signatures are compared inside tasks, whichever node was its smallest: two of
different components that agree in ``TIED`` of the registers tie these components into a group (at a
similarity of 0.8 fewer agree with a probability of 1e-7).  All nodes outside a group's largest component
then meet the whole group by exact overlap.  Both comparisons go in blocks of ``SIGNATURES`` or ``CHUNK`` rows, so that a
bucket or group of any size is dealt over many tasks, and only links that join components leave a task.  Their work is
quadratic in the nodes of one bucket or group outside its largest component.

Edge cases: null texts are empty; texts without words are copies of each other; texts below five words
have themselves as only shingle; repeated rows and doc_ids are separate rows of a class; a class is
named by its smallest doc_id (null only where all are null); of rows with equal id and text the least in
all columns is kept by :func:`keep_one`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T
from gridloom.llm.graph import components
from gridloom.llm.store import cut, release

SHINGLE, REGISTERS, BANDS, ROWS, SIMILAR = 5, 128, 32, 4, 0.8
TIED = 0.6  # of the registers, five standard deviations below SIMILAR
HUB_ROWS, CHUNK, SIGNATURES, SALTS = 512, 1024, 512, 16
SLICE = 1 << 20  # bytes of text that a task turns into arrays at a time
U = T.U64


def _sequence(h: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    pw, inv = T.powers(T._Q, len(h) + 1)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(T.mix(h + U(seed)) * pw[: len(h)], out=acc[1:])
    return T.mix((acc[first[1:]] - acc[first[:-1]]) * inv[first[:-1]] + np.diff(first).astype(U) * U(0x9E3779B97F4A7C15))


def bags(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key bytes as two columns, document of each element, element hash, count); elements sorted by document and hash."""
    w = T.words_of(col)
    key = np.stack([_sequence(w.hashes, w.first, 1), _sequence(w.hashes, w.first, 2)], axis=1)
    doc = T.doc_of_word(w)
    h = T.window_hashes(w.hashes, SHINGLE)
    ok = doc[SHINGLE - 1 :] == doc[: len(h)] if len(h) else np.zeros(0, bool)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    doc, h = np.concatenate([doc[: len(h)][ok], short]), np.concatenate([h[ok], key[short, 0]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key, doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The winning point of every register, (n_docs, m); rows of documents without elements stay 0."""
    sig = np.zeros((n_docs, m), U)
    total = np.bincount(doc, count, n_docs)
    todo = total > 0
    limit = np.where(todo, m * (np.log(m) + 3.0) / np.maximum(total, 1), 0)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    while todo.any():
        pick = todo[doc]
        d0, h0, c0, l0 = doc[pick], h[pick], count[pick], levels[pick]
        best = np.full(n_docs * m, np.inf)
        win = np.zeros(n_docs * m, U)
        for level in range(int(l0.max())):
            on = l0 > level
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            d, c = d0[on], c0[on]
            state = T.mix(h0[on] + U((level + 1) * 0xA0761D6478BD642F % (1 << 64)))
            t, stop = np.zeros(len(d)), limit[d]
            while len(d):
                state = T.mix(state + U(0xE7037ED1A0B428DB))
                t = t - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                live = t <= stop
                d, c, state, t, stop = d[live], c[live], state[live], t[live], stop[live]
                point = T.mix(state ^ U(0x8EBC6AF09C88C6E3))
                reg = (point % U(m)).astype(np.int64)
                keep = np.ones(len(d), bool) if width == 1 else low + ((point >> U(40)).astype(np.float64) * 2.0**-24 * width).astype(np.int64) < c
                slot = d[keep] * m + reg[keep]
                np.minimum.at(best, slot, t[keep])
                won = best[slot] == t[keep]
                win[slot[won]] = point[keep][won]
        best = best.reshape(n_docs, m)
        full = todo & np.isfinite(best).all(axis=1)
        sig[full] = win.reshape(n_docs, m)[full]
        todo &= ~full
        limit *= 2
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), U)
    for b in range(BANDS):
        k = np.full(len(sig), (b + 1) * 0x589965CC75374CC3 % (1 << 64), U)
        for r in range(ROWS):
            k = T.mix(k ^ sig[:, b * ROWS + r]) * U(0xFF51AFD7ED558CCD)
        out[:, b] = T.mix(k)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), key (of the word sequence), bands and sig (null without words) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text", SLICE):
                key, doc, h, count = bags(batch.column("text"))
                n = batch.num_rows
                sig = signatures(doc, h, count, n)
                some = np.zeros(n, bool)
                some[doc] = True
                bands = band_keys(sig).view(np.int64)
                low = (sig & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([k.tobytes() for k in key], pa.binary()), pa.array([b if s else None for b, s in zip(bands, some, strict=True)], schema.types[3]), pa.array([x.tobytes() if s else None for x, s in zip(low, some, strict=True)], pa.binary())], schema=schema)

    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return d.mapInArrow(run, "doc_id long, th long, key binary, bands array<long>, sig binary")


def stars(nodes: DataFrame, chunk: int | None = None) -> DataFrame:
    """(bucket, part, hub, node): all members of buckets of two and more, with the smallest; parts have ``chunk`` rows."""
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("hub", pa.int64()), ("node", pa.int64())])
    chunk = chunk or CHUNK

    def run(batches):
        bucket, hub, seen = None, 0, 0  # of the last row
        for batch in batches:
            b, n = (batch.column(c).to_numpy() for c in ("bucket", "node"))
            if not len(b):
                continue
            new = np.ones(len(b), bool)
            new[1:] = b[1:] != b[:-1]
            new[0] = bucket is None or b[0] != bucket
            at = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            hubs = np.where(at >= 0, n[np.maximum(at, 0)], hub)
            nth = np.where(at >= 0, np.arange(len(b)) - at, np.arange(len(b)) + seen)
            keep = ~new
            keep[:-1] |= ~new[1:]
            if not new[0] and seen == 1:  # the bucket's first row ended the last batch
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([0], pa.int32()), pa.array([hub]), pa.array([hub])], schema=schema)
            bucket, hub, seen = int(b[-1]), int(hubs[-1]), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(b[keep]), pa.array(nth[keep] // chunk, pa.int32()), pa.array(hubs[keep]), pa.array(n[keep])], schema=schema)

    d = nodes.filter(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("bucket"))
    return d.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "bucket long, part int, hub long, node long")


REP = ("rep_none", "rep_id", "rep_th")


def _rep():
    """Columns that name a row of documents: whether its doc_id is null, the doc_id, the text's hash."""
    own = F.col("doc_id").cast("long")
    return own.isNull().alias("rep_none"), F.coalesce(own, F.lit(0)).alias("rep_id"), F.xxhash64("text").alias("rep_th")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The (hub, node) pairs whose texts' bags overlap by ``similar`` or more; each node's text travels once per hub."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / float(HUB_ROWS)).cast("int").alias("salts"))
    hubs = sizes.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(sizes, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    want = members.unionByName(hubs).join(nodes.select("node", *REP), "node")
    rows = want.join(docs.select(*_rep(), "text"), list(REP)).select("hub", "salt", "node", "text")
    schema = pa.schema([("hub", pa.int64()), ("node", pa.int64())])

    def run(batches):
        mine, values, counts = None, None, None
        for whole in batches:
            for batch in T.slices(whole, "text", SLICE):
                key, doc, h, count = bags(batch.column("text"))
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                out = []
                for i, (hub, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                    s = slice(first[i], first[i + 1])
                    if hub == node:
                        mine, values, counts = hub, h[s].copy(), count[s].copy()
                    elif hub == mine and len(values) and first[i + 1] > first[i]:
                        at = np.minimum(np.searchsorted(values, h[s]), len(values) - 1)
                        both = np.where(values[at] == h[s], np.minimum(counts[at], count[s]), 0).sum()
                        if both >= similar * (counts.sum() + count[s].sum() - both):
                            out.append((hub, node))
                cols = list(zip(*out, strict=True)) if out else [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    placed = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", (F.col("node") != F.col("hub")), "node")
    return placed.select("hub", "node", "text").mapInArrow(run, "hub long, node long")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (``key``, node, minor, cm, cx) in blocks (i, j) of their key, where ``left`` rows meet ``right`` rows.

    ``cm`` and ``cx``: chunks of minor and of other rows, both 0 for a key that is one block.  Minor rows meet all, others only minor ones.
    """
    nth = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    g = rows.withColumn("mine", F.when(F.col("minor"), nth("cm")).otherwise(F.col("cm") + nth("cx")).cast("int"))
    last = F.when(F.col("minor"), F.col("cm") + F.col("cx") - 1).otherwise(F.col("cm") - 1)
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))))
    one = F.col("cm") + F.col("cx") == 0
    return g.select(
        key, "node", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(one, F.col("minor")).otherwise(F.col("mine") <= F.col("other")).alias("left"), (one | (F.col("mine") >= F.col("other"))).alias("right"),
        *[c for c in rows.columns if c not in (key, "node", "label", "minor", "cm", "cx")],
    )


def _chunks(minor, major, chunk: int):
    """cm and cx (see :func:`_blocks`) from the numbers of rows."""
    whole = minor + major <= chunk
    return [F.when(whole, 0).otherwise(F.ceil(n / float(chunk))).cast("int").alias(c) for n, c in ((minor, "cm"), (major, "cx"))]


def _salted(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row a key), where a key may hold most rows of ``big``; ``by`` spreads them."""
    every = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), by), F.lit(SALTS)).cast("int")).join(every, [key, "salt"]).drop("salt")


class _Links:
    """Joins labels; says whether a link was needed."""

    def __init__(self):
        self.up = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
        return p != q


def ties(star: DataFrame, labels: DataFrame, nodes: DataFrame, tied: float = TIED, chunk: int | None = None) -> DataFrame:
    """(a, b): labels of components with members of one bucket that agree in ``tied`` of the registers; enough to join all such."""
    chunk = chunk or SIGNATURES
    s = star.select("bucket", "part", "node").join(labels, "node", "left").select("bucket", "part", "node", F.coalesce("label", "node").alias("label"))
    by = s.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.max("part").alias("p"))
    wide = by.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.max("p").alias("p"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wide = wide.select("bucket", F.col("most.label").alias("major"), *_chunks(F.col("all") - F.col("most.c"), F.col("most.c"), chunk), F.explode(F.sequence(F.lit(0), F.col("p"))).alias("part"))
    mixed = s.join(wide, ["bucket", "part"]).withColumn("minor", F.col("label") != F.col("major")).drop("major", "part")
    rows = _blocks(mixed.join(nodes.select("node", "sig"), "node"), "bucket")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    need = int(np.ceil(tied * REGISTERS))

    def compare(block, known, out):
        left, right, label, sig = block
        x, y = sig[left], sig[right]
        own, other = label[left], label[right]
        step = max(1, (1 << 24) // max(1, y.size))
        for k in range(0, len(x), step):
            near = (x[k : k + step, None, :] == y[None, :, :]).sum(axis=2, dtype=np.int16) >= need
            near &= own[k : k + step, None] != other[None, :]
            for p, q in zip(*np.nonzero(near), strict=True):
                if known.join(int(own[k + p]), int(other[q])):
                    out.append((int(own[k + p]), int(other[q])))

    def run(batches):
        known, out, held, on = _Links(), [], [], None

        def close():
            compare([np.concatenate(z) for z in zip(*held, strict=True)], known, out)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            left, right = (b.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            label, sig = b.column("label").to_numpy(), np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            at = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *at], [*at, len(key)], strict=True):
                if held and on != tuple(key[a]):
                    close()
                on = tuple(key[a])
                held.append((left[a:z], right[a:z], label[a:z], sig[a:z]))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)

    placed = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.select("bucket", "i", "j", "left", "right", "label", "sig").mapInArrow(run, "a long, b long")


def groups(tied: DataFrame, labels: DataFrame, nodes: DataFrame, checked: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """(grp, node, label, minor, cm, cx): nodes of components that are tied; ``minor``: not in the group's largest component.

    ``checked``: (hub, node), the smaller first, that are known not to be similar unless linked; groups of no more than such a pair are left out.
    """
    part = components(tied)
    part = part.union(part.select("label", "label").distinct()).toDF("label", "grp")
    member = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    part = part.join(member.groupBy("label").agg(F.count(F.lit(1)).alias("c")), "label")
    top = part.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"))
    if checked is not None:
        two = part.join(top.filter("all = 2").select("grp"), "grp").groupBy("grp").agg(F.min("label").alias("hub"), F.max("label").alias("node"))
        top = top.join(two.join(checked, ["hub", "node"], "left_semi").select("grp"), "grp", "left_anti")
    top = top.select("grp", F.col("most.label").alias("major"), *_chunks(F.col("all") - F.col("most.c"), F.col("most.c"), chunk or CHUNK))
    part = _salted(part.select("label", "grp"), top, "grp", "label").withColumn("minor", F.col("label") != F.col("major")).drop("major")
    return _salted(member, part, "label", "node").select("grp", "node", "label", "minor", "cm", "cx")


def settle(group: DataFrame, nodes: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(hub, node): links that join different components of a group, a spanning set of them per block.

    Overlaps are exact, as products of 0/1 matrices of (shingle, occurrence), and stay inside the task.
    """
    want = _blocks(group, "grp")
    one = group.select("node").join(nodes.select("node", *REP), "node").join(docs.select(*_rep(), "text"), list(REP)).select("node", "text").dropDuplicates(["node"])
    rows = want.join(one, "node")
    schema = pa.schema([("hub", pa.int64()), ("node", pa.int64())])

    def compare(block):
        """Spanning links between components of one block; block: (left, right, node, label, elements, occurrences)."""
        node, label = np.array([b[2] for b in block]), np.array([b[3] for b in block])
        rows_of = np.repeat(np.arange(len(block)), [len(b[4]) for b in block])
        h, k = np.concatenate([b[4] for b in block]), np.concatenate([b[5] for b in block])
        total = np.bincount(rows_of, k, len(block)).astype(np.int64)
        rep = np.repeat(np.arange(len(h)), k)  # one feature per occurrence of a shingle
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
        feature = T.mix(h[rep] + nth.astype(U) * U(0x9FB21C651E98DF25))
        _, inverse, often = np.unique(feature, return_inverse=True, return_counts=True)
        new = np.cumsum(often > 1) - 1
        keep = often[inverse] > 1
        r, f = rows_of[rep][keep], new[inverse[keep]]
        order = np.argsort(f, kind="stable")
        r, f = r[order], f[order]
        left, right = (np.flatnonzero([b[x] for b in block]) for x in (0, 1))
        both = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, int(new[-1]) + 1 if len(new) else 0, 4096):
            lo, hi = np.searchsorted(f, [a, a + 4096])
            m = np.zeros((len(block), 4096), np.float32)
            m[r[lo:hi], f[lo:hi] - a] = 1
            both += m[left] @ m[right].T
        near = (both >= similar * (total[left][:, None] + total[right][None, :] - both) - 1e-6) & (both > 0) & (label[left][:, None] != label[right][None, :])
        known = _Links()
        for x in np.flatnonzero(near.any(axis=1)):
            y = right[near[x]]
            _, first = np.unique(label[y], return_index=True)
            for z in y[first]:
                if known.join(int(label[left[x]]), int(label[z])):
                    yield int(node[left[x]]), int(node[z])

    def run(batches):
        on, block, out = None, [], []
        for whole in batches:
            for batch in T.slices(whole, "text", SLICE):
                _, doc, h, count = bags(batch.column("text"))
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                cols = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "left", "right", "node", "label")]
                for x, (grp, i, j, left, right, node, label) in enumerate(zip(*cols, strict=True)):
                    if on != (grp, i, j):
                        out.extend(compare(block) if block else ())
                        on, block = (grp, i, j), []
                    s = slice(first[x], first[x + 1])
                    block.append((left, right, node, label, h[s].copy(), count[s].copy()))
        out.extend(compare(block) if block else ())
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)

    placed = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    return placed.select("grp", "i", "j", "left", "right", "node", "label", "text").mapInArrow(run, "hub long, node long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, th and key of every row; key, class_none, class_id, class_th and class_size of every distinct text."""
    sketch = cut(sketches(docs))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("rep_none"), F.coalesce("doc_id", F.lit(0)).alias("rep_id"), F.col("th").alias("rep_th")))
    nodes = sketch.groupBy("key").agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "key", *[f"rep.{c}" for c in REP], "copies", "bands", "sig"))
    star = cut(stars(nodes))
    checked = star.filter("node <> hub").select("hub", "node").distinct()
    edges = cut(verify(checked, nodes, docs))
    release(docs.sparkSession)
    labels = components(edges)
    tied = cut(ties(star, labels, nodes))
    if not tied.isEmpty():
        labels = components(edges.union(cut(settle(cut(groups(tied, labels, nodes, checked)), nodes, docs))))
    release(docs.sparkSession)
    n = nodes.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("comp"), *REP, "copies")
    by = n.groupBy("comp").agg(F.min(F.struct(*REP)).alias("best"), F.sum("copies").alias("class_size"))
    by = by.select("comp", *[F.col(f"best.{c}").alias(c.replace("rep", "class")) for c in REP], "class_size")
    return sketch.select("doc_id", "th", "key"), _salted(n.select("key", "comp"), by, "comp", "key").drop("comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and class_size of every row of ``docs`` (doc_id, text)."""
    rows, named = classes(docs)
    named = named.select("key", F.when(~F.col("class_none"), F.col("class_id")).alias("class_id"), "class_size")
    return _salted(rows.withColumn("by", F.xxhash64("doc_id", "th")), named, "key", "by").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class: that of the smallest doc_id, text hash, and then of the least columns."""
    _, named = classes(docs)
    own = ("__none", "__id", "__th")
    best = named.select(*[F.col(c).alias(n) for c, n in zip(("class_none", "class_id", "class_th"), own, strict=True)]).distinct()
    keyed = docs.withColumns(dict(zip(own, _rep(), strict=True))).join(best, list(own), "left_semi")
    rest = [c for c in docs.columns if c != "text"]
    least = keyed.groupBy(*own).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest], "text")).alias("__row"))
    return least.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: classes by all pairs that share a shingle, and the closure of their links; for small tables
OP10_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT min(r) AS r, w FROM d GROUP BY w),
s AS (SELECT r, array_to_string(w[a:a + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS a FROM n WHERE len(w) > 0)),
b AS (SELECT r, k, count(*) AS c FROM s GROUP BY r, k),
z AS (SELECT r, sum(c) AS z FROM b GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS shared FROM b x JOIN b y ON x.k = y.k AND x.r < y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z u ON u.r = a JOIN z v ON v.r = b WHERE shared >= 0.8 * (u.z + v.z - shared)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT r, r AS t FROM n UNION SELECT walk.r, link.b FROM walk JOIN link ON link.a = walk.t),
c AS (SELECT r, min(t) AS c FROM walk GROUP BY r),
m AS (SELECT d.doc_id, c.c FROM d JOIN n ON n.w = d.w JOIN c ON c.r = n.r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, count(*) OVER (PARTITION BY c) AS class_size FROM m
"""
