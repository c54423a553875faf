"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: runs of letters and digits, ASCII lower case; numbers, units after a
number, and capitalised words inside a sentence turn into typed placeholders (runs of one
placeholder count once).  Windows of ``WINDOW`` template tokens with ``LITERAL`` words at least that
are no placeholders are hash-joined with the benchmark's.  Windows of plain words (values kept, ASCII case
folded) are joined in the same way, so that verbatim items need no literal words and letter case or missing
stops do not matter.  In a third typing a word that starts a sentence is a name too, if the same text has it
capitalised inside a sentence and never in lower case.  For each (document, item) matching windows
form alignments, one for each place where the item occurs (and one of all together), and a leak needs one
that passes.  Its slots are aligned: most values are equal, or a value that fills several slots must meet one
partner there, in either direction (``CONSISTENT`` of the slots), so re-parameterised questions are
caught and accidental templates are not.  A document leaks an item if ``COVERAGE`` of the item's windows match, or ``LONG`` windows do.

The benchmark's windows are broadcast in blocks of ``MAX_WINDOWS`` at most (16 MB of hashes for each typing); a
larger benchmark takes one pass over the documents per block, and an item never spans blocks.

Hits of a template that many items or many places of a text share are counted in arrays first; positions are
compared only for (document, item) pairs that share windows enough, as diagonal stretches, of which equal ones are judged once.

Edge cases: null or empty texts match nothing; items with fewer than ``WINDOW`` tokens have one
window of their whole length; an item without enough literal words is matched by its plain words only; items of equal
text are all reported; repeated rows are reported one by one, a null doc_id as null; an item that occurs several times
in a text is one row; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T

WINDOW, LITERAL, COVERAGE, LONG, CONSISTENT, MAX_WINDOWS = 8, 5, 0.5, 12, 0.8, 2_000_000
UNITS = "mg g kg mm cm m km ml l in ft yd mi oz lb lbs mph kmh second seconds minute minutes hour hours day days week weeks month months year years mile miles meter meters metre metres foot feet inch inches pound pounds gram grams liter liters litre litres dollar dollars cent cents euro euros percent degree degrees".split()
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
TYPINGS = ("template", "names", "plain")
_MARKS = T.mix(np.arange(1, 5, dtype=T.U64) * T.U64(0x1234567890ABCDEF | 1))


def _unit_hashes() -> np.ndarray:
    return np.sort(T.words_of(pa.array([" ".join(UNITS)]), lower=True, separator=_NOT_ALNUM).hashes)


def _recurring(word: np.ndarray, capital: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Positions of sentence-initial capitalised words that are capitalised inside a sentence of their text, never lower case."""
    at = np.flatnonzero(capital & fresh)
    at = at[np.isin(word[at], word[capital & ~fresh])]
    if not len(at):
        return at
    some = np.unique(word[at])
    lower = word[~capital]
    near = np.minimum(np.searchsorted(some, lower), len(some) - 1)
    return at[~np.isin(word[at], lower[some[near] == lower])]


class Templates:
    """Tokens of a string column in one of ``TYPINGS``: hash, kind, slot value, and each text's first token."""

    def __init__(self, col: pa.Array, typing: str = "template"):
        w = T.words_of(col, lower=True, separator=_NOT_ALNUM)
        n = len(w.hashes)
        doc = T.doc_of_word(w)
        kind = np.zeros(n, np.int8)
        if typing == "plain":
            keep = np.ones(n, bool)
        elif n:
            b0 = w.data[w.starts]
            b1 = w.data[np.minimum(w.starts + 1, len(w.data) - 1)]
            kind[(b0 >= 48) & (b0 <= 57)] = NUMBER
            first = np.ones(n, bool)
            first[1:] = doc[1:] != doc[:-1]
            stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])
            fresh = first.copy()
            fresh[1:] |= stops[w.starts[1:]] > stops[w.ends[:-1]]
            capital = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E))
            kind[capital & ~fresh] = NAME
            if typing == "names":
                kind[_recurring(T.mix(w.hashes + doc.astype(T.U64) * T.U64(0x9E3779B97F4A7C15)), capital, fresh)] = NAME
            units = _unit_hashes()
            at = np.minimum(np.searchsorted(units, w.hashes), len(units) - 1)
            after = np.zeros(n, bool)
            after[1:] = (kind[:-1] == NUMBER) & ~first[1:]
            kind[after & (units[at] == w.hashes)] = UNIT
            keep = np.ones(n, bool)
            keep[1:] = (kind[1:] == WORD) | (kind[1:] != kind[:-1]) | first[1:]
        else:
            keep = np.zeros(0, bool)
        self.kind, self.value, self.doc = kind[keep], w.hashes[keep], doc[keep]
        self.hash = np.where(self.kind == WORD, self.value, _MARKS[self.kind])
        self.first = np.searchsorted(self.doc, np.arange(w.n_docs + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of all windows of WINDOW tokens in one text with enough literal words."""
        h = T.window_hashes(self.hash, WINDOW)
        if not len(h):
            return np.zeros(0, np.int64), h
        literal = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        ok = (self.doc[WINDOW - 1 :] == self.doc[: len(h)]) & (literal[WINDOW:] - literal[: len(h)] >= LITERAL)
        at = np.flatnonzero(ok)
        return at, h[at]


class Benchmark:
    """A block of items in every typing."""

    def __init__(self, items: list[tuple[int, str]]):
        self.indexes = [Index(items, typing) for typing in TYPINGS]


class Index:
    """A block of items in one typing: window hashes in order, where they are, and each item's tokens."""

    def __init__(self, items: list[tuple[int, str]], typing: str):
        self.typing = typing
        self.ids = [i for i, _ in items]
        t = self.t = Templates(pa.array([x for _, x in items], pa.string()), typing)
        at, h = t.windows()
        short = [i for i in range(len(items)) if 0 < t.first[i + 1] - t.first[i] < WINDOW]
        self.short = {}  # whole texts below WINDOW tokens: (item, hash of the values) by length and hash
        for i in short:
            a, z = t.first[i], t.first[i + 1]
            if (t.kind[a:z] == WORD).sum() >= min(LITERAL, z - a):
                h_, v = (T.window_hashes(x[a:z], int(z - a))[0] for x in (t.hash, t.value))
                self.short.setdefault(int(z - a), defaultdict(list))[int(h_)].append((i, v))
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.total = np.bincount(t.doc[at], minlength=len(items))
        order = np.lexsort((h, t.doc[at]))
        self._hash, self._where, self._first = h[order], at[order], np.concatenate([[0], np.cumsum(self.total)])

    def of_item(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes of one item in order, and where they are."""
        s = slice(self._first[i], self._first[i + 1])
        return self._hash[s], self._where[s]


def _consistent(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether values that fill several slots meet one partner in ``CONSISTENT`` of them, on both sides."""
    if not len(x):
        return True
    both, c = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    for side in both:
        _, which = np.unique(side, return_inverse=True)
        often, best = np.bincount(which, c), np.zeros(which.max() + 1)
        np.maximum.at(best, which, c)
        again = often > 1
        if best[again].sum() < CONSISTENT * often[again].sum():
            return False
    return True


def _segments(at: np.ndarray, h: np.ndarray, own: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text position, item position, windows) of the maximal diagonal stretches on which a text and an item match, ordered by place.

    ``at``, ``h``: a text's hits; ``own``, ``where``: an item's hashes in order and their places.  Matching positions are made in pieces of a few million
    and leave as stretches, so that a text and an item that both repeat themselves cost array work and no list of their product.
    """
    x, y = (np.searchsorted(own, h, side) for side in ("left", "right"))
    ends, parts, k = np.cumsum(y - x), [], 0
    while k < len(h):
        z = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 22), "right")), k + 1)
        n = (y - x)[k:z]
        d, b = np.repeat(at[k:z], n), where[_spread(x[k:z], n)]
        order = np.lexsort((d, d - b))
        d, b = d[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(d - b) != 0) | (np.diff(d) != 1)]))
        parts.append((d[first], b[first], np.diff(np.concatenate([first, [len(d)]]))))
        k = z
    d, b, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((d, d - b))
    d, b, n = d[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(d - b) != 0) | (d[1:] != d[:-1] + n[:-1])]))  # stretches that pieces have cut
    d, b, n = d[first], b[first], np.add.reduceat(n, first)
    order = np.lexsort((b, d))
    return d[order], b[order], n[order]


def _alignments(d: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Stretches by occurrence: runs along one offset, which edits may shift by less than a window; ascending chains of
    runs (an occurrence with longer insertions); and all together."""
    runs, ends = [], {}  # ends: offset -> the run that ended there last
    d0, b0, last = d.tolist(), b.tolist(), (n - 1).tolist()
    for i, (p, q, m) in enumerate(zip(d0, b0, last, strict=True)):
        offset, run = p - q, None
        for s in range(WINDOW):
            for o in (offset,) if not s else (offset - s, offset + s):
                old = ends.get(o)
                if old is not None and old[1] < p and old[2] < q:
                    run = ends.pop(o)[0]
                    break
            if run is not None:
                break
        if run is None:
            runs.append(run := [])
        run.append(i)
        ends[offset] = (run, p + m, q + m)
    chains: list[list[int]] = []
    for run in runs:
        if chains and d0[chains[-1][-1]] + last[chains[-1][-1]] < d0[run[0]] and b0[chains[-1][-1]] + last[chains[-1][-1]] < b0[run[0]]:
            chains[-1].extend(run)
        else:
            chains.append(list(run))
    return [*runs, *(c for c in chains if len(c) > 1), list(range(len(d0)))]


def leaks(col: pa.Array, bench: Benchmark) -> list[tuple[int, int, int, float, bool]]:
    """(row, item, windows, coverage, exact) of each leak in a string column; the first typing that finds it counts windows."""
    out = {}
    for index in bench.indexes:
        for row, item, n, share, exact in _leaks(col, index):
            had = out.get((row, item))
            out[row, item] = (row, item, n, share, exact) if had is None else (*had[:4], had[4] or exact)
    return sorted(out.values())


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... (n[i] numbers) for every i."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _possible(row: np.ndarray, h: np.ndarray, bench: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) pairs whose shared windows suffice, wherever they lie; each window of a text meets an item once."""
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    row, h = row[order][new], h[order][new]
    lo, hi = (np.searchsorted(bench.hashes, h, side) for side in ("left", "right"))
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(h):  # whole texts, about 4 M hits at a time and no more than the benchmark has for one text
        z = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22))), at + 1)
        z = int(np.searchsorted(row, row[z - 1], "right"))
        n = (hi - lo)[at:z]
        key = np.repeat(row[at:z], n) * len(bench.ids) + bench.t.doc[bench.at[_spread(lo[at:z], n)]]
        key, n = np.unique(key, return_counts=True)
        r, i = key // len(bench.ids), key % len(bench.ids)
        ok = (n >= LONG) | (n >= COVERAGE * bench.total[i])
        rows.append(r[ok])
        items.append(i[ok])
        at = z
    return np.concatenate(rows), np.concatenate(items)


def _leaks(col: pa.Array, bench: Index) -> list[tuple[int, int, int, float, bool]]:
    t, out = Templates(col, bench.typing), {}
    at, h = t.windows()
    if len(bench.hashes) and len(h):
        lo = np.searchsorted(bench.hashes, h)
        hit = np.flatnonzero(bench.hashes[np.minimum(lo, len(bench.hashes) - 1)] == h)
        at, h = at[hit], h[hit]
        row = t.doc[at]
        for r, item in zip(*_possible(row, h, bench), strict=True):
            a, z = np.searchsorted(row, (r, r + 1))
            best = _judge(_segments(at[a:z], h[a:z], *bench.of_item(item)), t, bench, item)
            if best:
                out[int(r), bench.ids[item]] = best
    for size, table in bench.short.items():
        hs, vs = T.window_hashes(t.hash, size), T.window_hashes(t.value, size)
        if not len(hs):
            continue
        k = np.flatnonzero(np.isin(hs, np.array(list(table), dtype=np.uint64)) & (t.doc[size - 1 :] == t.doc[: len(hs)]))
        found = np.unique(np.stack([t.doc[k].astype(T.U64), hs[k], vs[k]]), axis=1)  # equal places of a text count once
        for r, word, value in zip(*found, strict=True):
            for item, own in table[int(word)]:
                key = (int(r), bench.ids[item])
                out[key] = (1, 1.0, bool(value == own) or (out[key][2] if key in out else False))
    return sorted((*key, *x) for key, x in out.items())


def _judge(stretches: tuple[np.ndarray, np.ndarray, np.ndarray], t: Templates, bench: Index, item: int) -> tuple[int, float, bool] | None:
    """(windows, coverage, exact) of the best alignment of a text's and an item's matching stretches that passes."""
    d, b, n = stretches
    total, passed, seen = int(bench.total[item]), [], set()
    for some in _alignments(d, b, n):
        p, q, m = d[some], b[some], n[some]
        if len(some) == 1:
            windows = int(m[0])
        else:
            windows = len(np.unique(_spread(q, m)))
        share = windows / total
        if share < COVERAGE and windows < LONG:
            continue
        size = m + WINDOW - 1
        x, y = _spread(p, size), _spread(q, size)
        same = (q.tobytes(), m.tobytes(), (p - q - (p - q)[0]).tobytes(), t.value[x].tobytes())
        if same in seen:  # equal places of a text count once
            continue
        seen.add(same)
        slot = t.kind[x] != WORD
        x, y = x[slot], y[slot]
        if len(some) > 1 and len(x):
            x, y = np.unique(np.stack([x, y]), axis=1)
        x, y = t.value[x], bench.t.value[y]
        equal = x == y
        if len(x) and equal.sum() < CONSISTENT * len(x) and not _consistent(x, y):
            continue
        passed.append((windows, float(share), bool(equal.all())))
        if windows == total and passed[-1][2]:  # nothing can be better
            break
    return (*max(passed)[:2], any(x[2] for x in passed)) if passed else None


def _blocks(benchmark: DataFrame, max_windows: int):
    """Items in blocks whose windows stay below ``max_windows`` (bounded driver memory: one block at a time)."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        size = len(r["text"]) // 2 + 1
        if block and n + size > max_windows:
            yield block
            block, n = [], 0
        block.append((r["item_id"], r["text"]))
        n += size
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, exact: one row for each leaked item of a document."""
    spark, out = docs.sparkSession, None
    ddl = "doc_id long, item_id long, n_windows long, coverage double, exact boolean"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())])
    for block in _blocks(benchmark, max_windows):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            bench = Benchmark(held.value)
            for whole in batches:
                for batch in T.slices(whole, "text"):
                    ids = batch.column("doc_id")
                    rows = leaks(batch.column("text"), bench)
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(schema)[1:], strict=True))], schema=schema)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ddl)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without the documents that leak an item; the texts are never shuffled."""
    for block in _blocks(benchmark, max_windows):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            bench = Benchmark(held.value)
            for whole in batches:
                for batch in T.slices(whole, "text"):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[r[0] for r in leaks(batch.column("text"), bench)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
