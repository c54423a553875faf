"""Sets of aligned maps (member, pos, value): similarity, decomposition, leave-one-out, parcels, resampling.

Quantities over pairs of members come from Gram matrices by tiles: a task owns one pair of blocks of members and multiplies
dense slices of their maps, and one row per pair of members leaves it; k members make k(k-1)/2 pairs, which is the result's own size.
Blocks of narrow maps are held whole, so that they grow with the members and each map is shipped a bounded number of times.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.num import clamp, div, finite, is_finite, pearson, rounded, rounded_array
from gridloom.operators.order import quantiles, quantiles_by, with_quantiles, with_totals
from gridloom.rng import draw_at, low_product, mulberry32, random_index, shuffled



def zscore_members(d: DataFrame) -> DataFrame:
    """z-score of each member over its finite cells (n - 1); NULL where sd is not above 0."""
    x, m, s = finite("value"), F.col("__m"), F.col("__s")
    e = with_totals(d, "member", __m=F.avg(x), __s=F.stddev_samp(x))
    return e.withColumn("value", F.when(s > 0, (x - m) / F.when(s > 0, s))).drop("__m", "__s")


def standardize(d: DataFrame) -> DataFrame:
    """Population z-score, so that the squares of a member sum to its number of cells; an error for constant or missing cells."""
    m, s = F.col("__m"), F.col("__s")
    ok = (s > 0) & is_finite("value")
    e = with_totals(d, "member", __m=F.avg("value"), __s=F.stddev_pop("value"))
    return e.withColumn("value", F.when(ok, (F.col("value") - m) / F.when(ok, s)).otherwise(F.raise_error(F.lit("constant or missing member")).cast("double"))).drop("__m", "__s")


def robust_z(d: DataFrame, by: str | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD), 0 where the MAD is 0."""
    if by is None:
        e = d.withColumn("med", F.lit(quantiles(d, "value", [0.5])[0]).cast("double")).withColumn("dev", F.abs(F.col("value") - F.col("med")))
        e = e.withColumn("mad", F.lit(quantiles(e, "dev", [0.5])[0]).cast("double"))
    else:
        e = with_quantiles(d, by, "value", [0.5], "med").withColumn("med", F.col("med")[0]).withColumn("dev", F.abs(F.col("value") - F.col("med")))
        e = with_quantiles(e, by, "dev", [0.5], "mad").withColumn("mad", F.col("mad")[0])
    return e.withColumn("value", F.when(F.col("mad") > 0, (F.col("value") - F.col("med")) / F.when(F.col("mad") > 0, 1.4826 * F.col("mad"))).otherwise(0.0)).drop("med", "dev", "mad")


def loo_similarity(d: DataFrame) -> DataFrame:
    """(member, r, rms): Pearson correlation with, and root mean square distance to, the mean of the others."""
    n, s, x = F.col("__n"), F.col("__s"), F.col("x")
    e = with_totals(d.withColumn("x", finite("value")), "pos", __n=F.count(x), __s=F.sum(x))
    e = e.withColumn("other", F.when(n > 1, (s - x) / F.when(n > 1, n - 1)))
    return e.groupBy("member").agg(pearson("x", "other").alias("r"), F.sqrt(F.avg((F.col("x") - F.col("other")) * (F.col("x") - F.col("other")))).alias("rms"))


_MOMENTS = ("n", "sx", "sy", "sxy", "sxx", "syy")
_PAIR = ("n", "mx", "my", "cxy", "cxx", "cyy")
BLOCK, SLICE, RUN = 1024, 2048, 32  # members of a block, positions of a dense piece, pieces whose sums a task adds up
PACK, STRIPE = 256, 64  # positions of a row that is shipped, members whose pairs leave a task at a time
HELD = 1 << 21  # cells of a block whose maps, of one piece, a task holds whole


def _tile_sums(x: np.ndarray, y: np.ndarray, sums: np.ndarray | None) -> np.ndarray:
    """Sums of n, x, y, xy, xx, yy over positions for all pairs of rows of two matrices (NaN: missing), added to ``sums``."""
    on, to = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
    x, y = np.nan_to_num(x, nan=0.0), np.nan_to_num(y, nan=0.0)
    if sums is None:
        sums = np.zeros((6, len(x), len(y)))
    for n, (p, q) in enumerate(((on, to), (x, to), (on, y), (x, y), (x * x, to), (on, y * y))):
        sums[n] += p @ q.T
    return sums


class _Tile:
    """Moments of the pairs of two blocks of members over one run of positions."""

    def __init__(self, same: bool):
        self.same, self.sums = same, None
        self.members = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.shift: dict[int, float] = {}  # each member's first value, from which sums are taken

    def add(self, member: np.ndarray, pos: np.ndarray, value: np.ndarray, side: list[np.ndarray]) -> None:
        """A slice of positions: its rows as dense matrices, one product."""
        where = np.unique(pos, return_inverse=True)[1]
        who, first = np.unique(member, return_index=True)
        for m, v in zip(who.tolist(), value[first].tolist(), strict=True):
            self.shift.setdefault(m, v)
        value = value - np.array([self.shift[m] for m in who.tolist()])[np.searchsorted(who, member)]
        wide, dense = int(where.max()) + 1, []
        for n in range(2):
            mine = side[n]
            every = np.union1d(self.members[n], member[mine])
            if self.sums is not None and len(every) > len(self.members[n]):
                shape = list(self.sums.shape)
                shape[n + 1] = len(every)
                grown = np.zeros(shape)
                grown[(slice(None),) + (slice(None),) * n + (np.searchsorted(every, self.members[n]),)] = self.sums
                self.sums = grown
            self.members[n] = every
            x = np.full((len(every), wide), np.nan)
            x[np.searchsorted(every, member[mine]), where[mine]] = value[mine]
            dense.append(x)
        self.sums = _tile_sums(*dense, self.sums)

    def rows(self):
        """a < b, n, means and centred moments of the pairs that share positions, in stripes of members."""
        for low in range(0, len(self.members[0]), STRIPE):
            yield self._stripe(self.members[0][low : low + STRIPE], self.sums[:, low : low + STRIPE])

    def _stripe(self, left: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        base = [np.array([self.shift[m] for m in who.tolist()]) for who in (left, self.members[1])]
        return _moments(left, self.members[1], base, sums, self.same)


def _moments(left: np.ndarray, right: np.ndarray, base: list[np.ndarray], sums: np.ndarray, same: bool) -> list[np.ndarray]:
    """a < b, n, means and centred moments of the pairs that share positions, from sums over values less ``base``."""
    i, j = np.nonzero((sums[0] > 0) & (left[:, None] < right[None, :] if same else left[:, None] != right[None, :]))
    n, sx, sy, sxy, sxx, syy = sums[:, i, j]
    centred = lambda raw, p, q: raw - p * q / n
    clean = lambda c, raw: np.where(c > 1e-13 * raw, c, 0.0)
    a, b = left[i], right[j]
    x = [base[0][i] + sx / n, clean(centred(sxx, sx, sx), sxx)]
    y = [base[1][j] + sy / n, clean(centred(syy, sy, sy), syy)]
    turn = a > b
    pick = lambda p, q: np.where(turn, q, p)
    return [pick(a, b), pick(b, a), n, pick(x[0], y[0]), pick(y[0], x[0]), centred(sxy, sx, sy), pick(x[1], y[1]), pick(y[1], x[1])]


def _correlation(n, cxy, cxx, cyy, least: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(r, where it is not defined) of centred moments that broadcast."""
    scale = cxx * cyy
    ok = (n >= least) & (scale > 0)
    r = np.divide(cxy, np.sqrt(scale, where=ok, out=np.ones_like(scale)))
    return (r if digits is None else rounded_array(r, digits)), ~ok


class _Whole:
    """Pairs of two blocks of members whose maps are held whole."""

    def __init__(self, member: np.ndarray, pos: np.ndarray, value: np.ndarray, side: list[np.ndarray], same: bool):
        self.same, where = same, np.unique(pos, return_inverse=True)[1]
        self.members, self.base, self.maps = [], [], []
        for mine in side[:1] if same else side:
            every, row = np.unique(member[mine], return_inverse=True)
            x = np.full((len(every), int(where.max()) + 1 if len(where) else 0), np.nan)
            x[row, where[mine]] = value[mine]
            base = x[np.arange(len(every)), np.isfinite(x).argmax(axis=1)] if len(every) else np.zeros(0)
            self.members.append(every)
            self.base.append(base)
            self.maps.append(x - base[:, None])
        if same:
            self.members, self.base, self.maps = self.members * 2, self.base * 2, self.maps * 2
        self.full = all(np.isfinite(x).all() for x in self.maps)

    def _cuts(self):
        """Stripes of members against runs of others, without those that hold no pair a < b."""
        left, right = self.members
        for low in range(0, len(left), STRIPE):
            for at in range(0, len(right), BLOCK):
                if not self.same or right[at : at + BLOCK][-1] > left[low]:
                    yield slice(low, low + STRIPE), slice(at, at + BLOCK)

    def rows(self):
        for p, q in self._cuts():
            sums = _tile_sums(self.maps[0][p], self.maps[1][q], None)
            yield _moments(self.members[0][p], self.members[1][q], [self.base[0][p], self.base[1][q]], sums, self.same)

    def correlations(self, least: int, digits: int | None):
        """a < b, r and where it is not defined; maps without missing cells need one product a pair."""
        if not self.full:
            for a, b, n, _, _, cxy, cxx, cyy in self.rows():
                yield [a, b, *_correlation(n, cxy, cxx, cyy, least, digits)]
            return
        centred = [x - x.mean(axis=1, keepdims=True) for x in self.maps]
        spread = [np.where(c > 1e-13 * raw, c, 0.0) for c, raw in (((z * z).sum(axis=1), (x * x).sum(axis=1)) for x, z in zip(self.maps, centred, strict=True))]
        for p, q in self._cuts():
            left, right = self.members[0][p][:, None], self.members[1][q][None, :]
            r, lost = _correlation(centred[0].shape[1], centred[0][p] @ centred[1][q].T, spread[0][p][:, None], spread[1][q][None, :], least, digits)
            cols = [np.minimum(left, right), np.maximum(left, right), r, lost]
            pick = left < right if self.same else slice(None)
            yield [c[pick].ravel() for c in cols]


def pair_moments(d: DataFrame, by: str | None = None, members: int | None = None, block: int | None = None) -> DataFrame:
    """([by,] a, b, n, mx, my, cxy, cxx, cyy): counts, means and centred moments of member pairs a < b over cells finite in both.

    ``d``: (member, pos, value[, by]), one row per member and position, all but values whole numbers.  ``members``: how many
    there are, if known.  The members are dealt into blocks of about ``block``; a task owns one pair of blocks over one run of positions and multiplies dense
    slices of them, so its memory is bounded by two blocks whatever the number of members, who are shipped once for each block, ``PACK`` positions a row.
    Maps of at most ``SLICE`` positions are held whole, in blocks of up to ``HELD`` cells: as many blocks as make tiles for all tasks.
    Pairs leave the tasks as they are; only those of several runs of positions are shuffled to be merged.
    """
    return _pairs(d, by, members, block)


def _pairs(d: DataFrame, by: str | None, members: int | None, block: int | None, least: int | None = None, digits: int | None = None) -> DataFrame:
    """:func:`pair_moments`; with ``least`` (a, b, r), made in the tasks unless there are several runs of positions."""
    keys = [by] if by else []
    ends = [F.min("pos"), F.max("pos")]
    low, high, *count = d.agg(*ends, *([F.count_distinct("member")] if members is None else [])).first()
    members = count[0] if count else members
    one = low is None or low // (SLICE * RUN) == high // (SLICE * RUN)
    span = 1 if low is None else high - low + 1
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = span <= SLICE
    most, groups = (max(BLOCK, HELD // span), max(12, math.ceil(math.sqrt(2 * tasks)))) if whole else (BLOCK, 12)
    block = block or min(most, max(256, -(-members // groups)))  # tiles for many tasks
    blocks = max(1, -(-members // block))
    names = [*keys, "i", "j", "run"]
    made = least is not None and one and whole
    schema = pa.schema([(c, pa.int64()) for c in (*keys, "a", "b")] + [(c, pa.float64()) for c in (("r",) if made else _PAIR)])

    def run(batches):
        on, part, held, tile = None, None, [], None

        def taken():
            cells = [np.concatenate(z) for z in zip(*held, strict=True)]
            held.clear()
            return *cells[:3], cells[3:]

        def add():
            tile.add(*taken())

        def pairs():
            if not whole:
                yield from tile.rows()
                return
            both = _Whole(*taken(), on[-3] == on[-2])
            if not made:
                yield from both.rows()
                return
            for a, b, r, lost in both.correlations(least, digits):
                yield [a, b, pa.array(r, mask=lost)]

        def close():
            for cols in pairs():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), k), pa.int64()) for k in on[: len(keys)]] + [pa.array(c, f.type) for c, f in zip(cols, list(schema)[len(keys) :], strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*names, "piece")], axis=1)
            member, left, right = (b.column(c).to_numpy(zero_copy_only=False) for c in ("member", "left", "right"))
            pos, value = (b.column(c).flatten().to_numpy() for c in ("pos", "value"))
            n = b.column("pos").value_lengths().to_numpy()
            cell = np.concatenate([[0], np.cumsum(n)])
            at = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *at], [*at, len(key)], strict=True):
                here = tuple(key[a].tolist())
                if held and not whole and (here[:-1] != on or here[-1] != part):
                    add()
                if on is not None and here[:-1] != on:
                    yield from close()
                if on is None or here[:-1] != on:
                    on = here[:-1]
                    tile = _Tile(on[-3] == on[-2])
                part = here[-1]
                held.append((np.repeat(member[a:z], n[a:z]), pos[cell[a] : cell[z]], value[cell[a] : cell[z]], np.repeat(left[a:z], n[a:z]), np.repeat(right[a:z], n[a:z])))
        if held and not whole:
            add()
        if on is not None:
            yield from close()

    rows = d.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("member").cast("long").alias("member"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")).filter(is_finite("value"))
    packed = [*keys, "member", "run", "piece", F.floor(F.col("pos") / PACK)]
    rows = rows.withColumns({"piece": F.floor(F.col("pos") / SLICE), "run": F.floor(F.col("pos") / (SLICE * RUN))})
    rows = rows.groupBy(*packed).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    rows = rows.select(*keys, "member", "run", "piece", F.col("cells.pos").alias("pos"), F.col("cells.value").alias("value"), F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select(*names, "piece", "member", "pos", "value", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"))
    # tiles are small to ship and long to multiply, so tasks are not joined by what they read, and few share one
    few = [min(blocks * (blocks + 1), 4 * tasks)] if one and not keys else []
    dealt = rows.repartition(*few, *names).sortWithinPartitions(*names, "piece")
    part = dealt.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema))
    part = part if one else _merged(part, [*keys, "a", "b"])
    if least is None or made:
        return part
    n, cxy, cxx, cyy = (F.col(c) for c in ("n", "cxy", "cxx", "cyy"))
    ok = (n >= least) & (cxx > 0) & (cyy > 0)
    r = F.when(ok, cxy / F.sqrt(F.when(ok, cxx * cyy)))
    return part.select("a", "b", (r if digits is None else rounded(r, digits)).alias("r"))


def _merged(part: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of parts (runs of positions, few for each pair) merged from their means, which keeps their digits."""

    def both(s, t):
        n = s["n"] + t["n"]
        dx, dy = t["mx"] - s["mx"], t["my"] - s["my"]
        w = s["n"] * t["n"] / n
        return F.struct(n.alias("n"), (s["mx"] + dx * t["n"] / n).alias("mx"), (s["my"] + dy * t["n"] / n).alias("my"), (s["cxy"] + t["cxy"] + dx * dy * w).alias("cxy"), (s["cxx"] + t["cxx"] + dx * dx * w).alias("cxx"), (s["cyy"] + t["cyy"] + dy * dy * w).alias("cyy"))

    parts = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_PAIR))).alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), F.get("parts", F.lit(0)), both)
    return parts.select(*keys, whole.alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in _PAIR])


def gram(d: DataFrame, by: str | None = None, members: int | None = None, block: int | None = None) -> DataFrame:
    """([by,] a, b, n, sx, sy, sxy, sxx, syy): sums over the cells that are finite in both members of a pair a < b."""
    n, mx, my, cxy, cxx, cyy = (F.col(c) for c in _PAIR)
    keys = [by] if by else []
    sums = {"n": n, "sx": n * mx, "sy": n * my, "sxy": cxy + n * mx * my, "sxx": cxx + n * mx * mx, "syy": cyy + n * my * my}
    return pair_moments(d, by, members, block).select(*keys, "a", "b", *[c.alias(k) for k, c in sums.items()])


def correlation_matrix(d: DataFrame, least: int = 3, members: int | None = None, block: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, r) for members a < b over pairwise finite cells, rounded to ``digits`` if given; NULL below ``least`` of them or without variance."""
    kind = d.schema["member"].dataType
    return _pairs(d, None, members, block, least, digits).select(F.col("a").cast(kind), F.col("b").cast(kind), "r")


def snap(r: Column) -> Column:
    """+-1 within 1e-12; an error beyond 1 + 1e-9."""
    return F.when(F.abs(r) > 1 + 1e-9, F.raise_error(F.lit("correlation above 1")).cast("double")).when(F.abs(F.abs(r) - 1) < 1e-12, F.signum(r)).otherwise(clamp(r, -1.0, 1.0))


def basis(d: DataFrame, coverage: float = 0.9, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(excluded, support, pairs): similarity of members on their common support.

    Members leave as all-missing, low-coverage (below ``coverage`` of the median), constant, or - until
    nothing changes - constant on the support.  pairs: a, b, r, distance 1 - r.
    """
    x = finite("value")
    m = d.groupBy("member").agg(F.count(x).alias("n"), F.var_pop(x).alias("v"))
    cells = d.filter(is_finite("value")).select("pos").distinct().agg(F.lit(None).cast(d.schema["member"].dataType).alias("member"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("v"))
    m = m.union(cells).collect()  # one row a member, fewer than the result's pairs, and one for the cells
    whole = next(z["n"] for z in m if z["member"] is None)
    m = [z for z in m if z["member"] is not None]
    med = float(np.median([z["n"] for z in m if z["n"]] or [0]))
    why = {z["member"]: "all-missing" if not z["n"] else "low-coverage" if z["n"] < coverage * med else "constant" if z["v"] == 0 else None for z in m}
    while True:
        kept = [k for k, reason in why.items() if reason is None]
        inside = d.filter(F.col("member").isin(kept) & is_finite("value"))
        support = inside.groupBy("pos").agg(F.count_distinct("member").alias("c")).filter(F.col("c") == len(kept)).select("pos")
        if all(z["n"] == whole for z in m if why[z["member"]] is None):  # every cell is on the support, and variances are known
            on, seen = inside, [z for z in m if why[z["member"]] is None]
            break
        on = inside.join(support, "pos", "left_semi")
        seen = on.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("v")).collect()
        flat = {z["member"]: "constant-on-support" for z in seen if z["v"] == 0}
        if not flat:
            break
        why |= flat
    if not seen or seen[0]["n"] < least:  # every kept member has all of the support
        raise ValueError("the common support is too small")
    r = correlation_matrix(on, members=len(seen)).withColumn("r", snap(F.col("r"))).withColumn("distance", 1 - F.col("r"))
    excluded = [(k, reason) for k, reason in why.items() if reason]
    rows = d.sparkSession.createDataFrame(excluded, f"member {d.schema['member'].dataType.simpleString()}, reason string")
    return rows, support, r


def basis_r(r: DataFrame, a: int, b: int) -> DataFrame:
    """The similarity of two members; no row if one is excluded."""
    return r.filter((F.col("a") == min(a, b)) & (F.col("b") == max(a, b))).select("r")


#: fixed values of the 32-bit FNV-1a hash
FNV_START, FNV_PRIME, SAMPLE = 0x811C9DC5, 0x01000193, 4096


def float_bits(v: Column) -> Column:
    """The 32 bits of a value as a single-precision number, as a long; all NaNs alike."""
    v = v.cast("float").cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(F.when(a > 0, a)))
    e = F.when(a < F.pow(F.lit(2.0), guess), guess - 1).when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    low = F.greatest(e, F.lit(-126))  # below it numbers have no leading one
    part = F.round(a / F.pow(F.lit(2.0), low) * (1 << 23)).cast("long")
    size = F.when(a == 0, F.lit(0)).when(e < -126, part).otherwise((low + 126) * (1 << 23) + part).cast("long")
    negative = (v < 0) | ((v == 0) & v.cast("string").startswith("-"))
    bits = size + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0))
    return F.when(F.isnan(v), F.lit(0x7FC00000)).when(a == float("inf"), F.lit(0x7F800000) + F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))).otherwise(bits)


def fnv(words: Column) -> Column:
    """FNV-1a folded over an array of 32-bit words, as 8 hexadecimal digits."""
    h = F.aggregate(words, F.lit(FNV_START).cast("long"), lambda h, w: low_product(h.bitwiseXOR(w), F.lit(FNV_PRIME).cast("long")))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def fingerprint(d: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(member, key): a content hash of each map: its length, then the float bits of a strided sample of its cells in order.

    Maps above 2 * ``sample`` cells are sampled before anything is shuffled, from a cell that differs by member; cells are numbered 0, 1, ... without gaps.
    """
    n = d.groupBy("member").agg(F.count(F.lit(1)).alias("cells")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("cells") / sample)))
    some = d.join(n, "member").filter(F.col("pos") % F.col("step") == F.pmod("member", F.col("step")))
    taken = some.select("member", "cells", F.struct("pos", float_bits(F.col("value")).alias("w")).alias("x")).groupBy("member", "cells").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return taken.select("member", fnv(F.concat(F.array("cells"), F.transform("xs", lambda x: x["w"]))).alias("key"))


def pair_contributions(z: DataFrame, a: int, b: int, n: int) -> DataFrame:
    """(pos, c): the terms z_a z_b / n of population z-scores, which sum to r."""
    x, y = (z.filter(F.col("member") == m).select("pos", F.col("value").alias(c)) for m, c in ((a, "x"), (b, "y")))
    return x.join(y, "pos").select("pos", (F.col("x") * F.col("y") / n).alias("c"))


def sum_over(terms: DataFrame, c: str = "c") -> DataFrame:
    return terms.agg(F.sum(c).alias("total"), F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)).alias("positive"), F.sum(F.when(F.col(c) < 0, F.col(c)).otherwise(0.0)).alias("negative"))


def dispersion(z: DataFrame, n: int) -> DataFrame:
    """(pos, d): (k^2 / 2n) var_pop over members; the terms sum to the sum of all pair distances."""
    k = F.count("value")
    return z.groupBy("pos").agg((k * k / (2.0 * n) * F.var_pop("value")).alias("d"))


def focused(z: DataFrame, member: int, n: int) -> DataFrame:
    """(pos, own, baseline): a member's mean distance to the others split into its own offset from their mean and their spread."""
    mine = F.max(F.when(F.col("member") == member, F.col("value")))
    others = F.when(F.col("member") != member, F.col("value"))
    d = z.groupBy("pos").agg(mine.alias("x"), F.avg(others).alias("m"), F.var_pop(others).alias("v"))
    return d.select("pos", ((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")) / (2.0 * n)).alias("own"), (F.col("v") / (2.0 * n)).alias("baseline"))


def focused_all(z: DataFrame, n: int) -> DataFrame:
    """(member, pos, term) of all members at once from each cell's moments: k members cost one pass, not k."""
    x, k = F.col("value"), F.col("__k")
    m, q = (F.col("__s") - x) / (k - 1), (F.col("__ss") - x * x) / (k - 1)
    return with_totals(z, "pos", __k=F.count(x), __s=F.sum(x), __ss=F.sum(x * x)).select("member", "pos", (((F.col("value") - m) * (F.col("value") - m) + q - m * m) / (2.0 * n)).alias("term"))


def group_terms(z: DataFrame, a: Column, b: Column, n: int) -> DataFrame:
    """(pos, between, within_a, within_b) for disjoint groups."""
    x, y = F.when(a, F.col("value")), F.when(b, F.col("value"))
    return z.groupBy("pos").agg((F.pow(F.avg(x) - F.avg(y), F.lit(2.0)) / (2.0 * n)).alias("between"), (F.var_pop(x) / (2.0 * n)).alias("within_a"), (F.var_pop(y) / (2.0 * n)).alias("within_b"))


def noise_floor(d: DataFrame, k: int, n: int) -> DataFrame:
    """(pos, floor): ((k - 1) / 2n) sum se^2 / sd^2 of beta; missing se count as the member's mean."""
    ok = is_finite("se")
    se2 = F.when(ok, F.col("se") * F.col("se"))
    filled = F.coalesce(se2, F.avg(se2).over(W.partitionBy("member")))
    return d.withColumn("f", div(filled, F.var_pop("beta").over(W.partitionBy("member")))).groupBy("pos").agg((F.sum("f") * (k - 1) / (2.0 * n)).alias("floor"))


def corrected_r(r: Column, rho_a: Column, rho_b: Column, least: float = 0.1) -> Column:
    """r / sqrt(rho_a rho_b) within [-1, 1], NULL below the least reliability."""
    ok = (rho_a >= least) & (rho_b >= least)
    return F.when(ok, clamp(r / F.sqrt(F.when(ok, rho_a * rho_b)), -1.0, 1.0))


def noise_dissimilarity(rho_a: Column, rho_b: Column) -> Column:
    return 1 - F.sqrt(F.greatest(rho_a * rho_b, F.lit(0.0)))


def parcel_moments(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, a, b, n, sx, sy, sxy, sxx, syy) of member pairs a < b per parcel: the Gram matrix in blocks."""
    kinds = {"label": labels.schema["label"].dataType, "a": (k := z.schema["member"].dataType), "b": k, "n": "long"}
    return gram(z.join(labels, "pos"), "label").withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def r_of_moments(n, sx, sy, sxy, sxx, syy) -> Column:
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (vx > 1e-12) & (vy > 1e-12)
    return F.when(ok, (sxy - sx * sy / n) / F.sqrt(F.when(ok, vx * vy)))


def moment_distances(moments: DataFrame, weights: DataFrame | None = None, by: str = "label") -> DataFrame:
    """(a, b, distance) of the total moments; with ``weights`` (by, rep, w) per replicate; NULL where a member is constant."""
    if weights is None:
        d = moments.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
        return d.select("a", "b", (1 - r_of_moments(*[F.col(c) for c in _MOMENTS])).alias("distance"))
    d = moments.join(weights, by).groupBy("rep", "a", "b").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in _MOMENTS])
    return d.select("rep", "a", "b", (1 - r_of_moments(*[F.col(c) for c in _MOMENTS])).alias("distance"))


def parcel_influence(moments: DataFrame) -> DataFrame:
    """(label, a, b, full, reduced): distances without each parcel, by subtracting its moments from the window totals."""
    w = W.partitionBy("a", "b")
    t = moments.withColumns({f"t_{c}": F.sum(c).over(w) for c in _MOMENTS})
    full = 1 - r_of_moments(*[F.col(f"t_{c}") for c in _MOMENTS])
    less = [F.col(f"t_{c}") - F.col(c) for c in _MOMENTS]
    n = F.when(less[0] > 0, less[0])
    return t.select("label", "a", "b", full.alias("full"), (1 - r_of_moments(n, *less[1:])).alias("reduced"))


def influence_summary(influence: DataFrame) -> DataFrame:
    """Per parcel: Mantel correlation of reduced and full distances, and their mean absolute change."""
    return influence.groupBy("label").agg(pearson("full", "reduced").alias("mantel"), F.avg(F.abs(F.col("full") - F.col("reduced"))).alias("change"))


def bootstrap_weights(spark, blocks: int, reps: int, seed: int = 1) -> DataFrame:
    """(label, rep, w): multinomial block counts, one seeded stream per replicate."""
    rows = []
    for r in range(reps):
        draw, count = mulberry32(seed + r), [0] * blocks
        for _ in range(blocks):
            count[random_index(draw, blocks)] += 1
        rows += [(b, r, c) for b, c in enumerate(count)]
    return spark.createDataFrame(rows, "label int, rep int, w int")


def random_splits(spark, members: list[int], na: int, nb: int, reps: int, seed: int = 1) -> DataFrame:
    """(rep, member, side): seeded disjoint splits of the members."""
    rows = []
    for r in range(reps):
        order = shuffled(mulberry32(seed + r), members)
        rows += [(r, m, "a") for m in order[:na]] + [(r, m, "b") for m in order[na : na + nb]]
    return spark.createDataFrame(rows, "rep int, member long, side string")


def split_reference(z: DataFrame, splits: DataFrame, labels: DataFrame, n: int, top: int = 3) -> DataFrame:
    """(rep, share): the top parcels' part of the between term under each random split."""
    d = z.join(F.broadcast(splits), "member").groupBy("rep", "pos").agg(F.avg(F.when(F.col("side") == "a", F.col("value"))).alias("x"), F.avg(F.when(F.col("side") == "b", F.col("value"))).alias("y"))
    p = d.join(labels, "pos").groupBy("rep", "label").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / (2.0 * n)).alias("sum"))
    w = W.partitionBy("rep")
    p = p.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("sum"), "label")), "total": F.sum("sum").over(w)})
    return p.filter(F.col("rank") <= top).groupBy("rep").agg((F.sum("sum") / F.first("total")).alias("share"))


def noise_member(z: DataFrame, seed: int = 1) -> DataFrame:
    """The set with one more member of seeded Gaussian noise: the cell at ``pos`` takes the generator's draws 2 pos and 2 pos + 1 (Box-Muller)."""
    u, v = (draw_at(F.lit(seed), F.col("pos") * 2 + n) for n in (0, 1))
    g = F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * math.pi * v)
    top = z.agg(F.max("member").alias("m")).select("m").scalar()
    return z.select("member", "pos", "value").unionByName(z.select("pos").distinct().select((top + 1).alias("member"), "pos", g.alias("value")))


def concentration(sums: DataFrame, top: int) -> DataFrame:
    """The ``top`` parcels by sum (ties by label): their share of the sum and of the cells."""
    total, cells = (sums.agg(F.sum(c).alias("t")).select("t").scalar() for c in ("sum", "n"))
    best = sums.orderBy(F.desc("sum"), "label").limit(top)
    return best.agg((F.sum("sum") / total).alias("top_share"), (F.sum("n") / cells).alias("size_share"))


def focused_excess(shares: DataFrame, member: int) -> DataFrame:
    """Per parcel: a member's share over the median share, with its competition rank (missing last, ties by label)."""
    med = shares.groupBy("label").agg(F.percentile("share", F.lit(0.5)).alias("med"))
    d = shares.filter(F.col("member") == member).join(med, "label").withColumn("excess", div(F.col("share"), F.col("med")))
    return d.select("label", "share", "excess", F.rank().over(W.orderBy(F.desc_nulls_last("excess"))).alias("rank"))


def smoothing_effect(raw: DataFrame, smooth: DataFrame, t: float) -> DataFrame:
    """Medians over members: retention of top-1% peaks and of extent, and disagreement of supra-threshold cells."""
    j = raw.select("member", "pos", F.col("value").alias("x")).join(smooth.select("member", "pos", F.col("value").alias("y")), ["member", "pos"])
    ax, ay = F.abs("x"), F.abs("y")
    j = j.withColumns({"ax": ax, "ay": ay})
    top = quantiles_by(j, "member", ["ax", "ay"], [0.99]).groupBy("member").agg(*[F.max(F.when(F.col("name") == f"a{c}", F.col("q")[0])).alias(f"q{c}") for c in "xy"])
    d = j.groupBy("member").agg(
        div(F.count_if(ay >= t), F.count_if(ax >= t)).alias("extent"), (F.count_if((ax >= t) != (ay >= t)) / F.count(F.lit(1))).alias("disagree")
    )
    d = d.join(top, "member").withColumn("peak", div(F.col("qy"), F.col("qx")))
    return d.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("peak", "extent", "disagree")])


def neighbours(dist: DataFrame, k: int) -> DataFrame:
    """(i, j, rank) of the k nearest of each i, with all ties within 1e-9 of the k-th; competition ranks."""
    both = dist.select("i", "j", "d").union(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    w = W.partitionBy("i").orderBy("d", "j")
    new = (F.col("d") - F.lag("d").over(w)) > 1e-9
    d = both.withColumn("n", F.row_number().over(w)).withColumn("head", F.when(F.coalesce(new, F.lit(True)), F.col("n")))
    d = d.withColumn("rank", F.last("head", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.filter(F.col("rank") <= k).select("i", "j", F.col("rank").cast("int").alias("rank"))


def neighbour_preservation(source: DataFrame, embedded: DataFrame, k: int = 3) -> DataFrame:
    """(i, kept): share of source neighbours that are neighbours in the embedding, ties included."""
    e = neighbours(embedded, k).select("i", "j", F.lit(1).alias("hit"))
    return neighbours(source, k).join(e, ["i", "j"], "left").groupBy("i").agg((F.count("hit") / F.count(F.lit(1))).alias("kept"))


def stress_shares(d: DataFrame) -> DataFrame:
    """(i, share): half of each pair's squared residual (d, disparity) to either end, normalised."""
    r = (F.col("d") - F.col("disparity")) * (F.col("d") - F.col("disparity")) / 2
    e = d.select(F.explode(F.array("i", "j")).alias("i"), r.alias("r")).groupBy("i").agg(F.sum("r").alias("r"))
    return e.select("i", div(F.col("r"), F.sum("r").over(W.partitionBy()), 0.0).alias("share"))


def ellipse(points: DataFrame, by: str, chi2: float = 2.279) -> DataFrame:
    """68% covariance ellipse of points (x, y) per group: centre, half axes, angle."""
    d = points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    mid, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    return d.select(by, "cx", "cy", F.sqrt(chi2 * (mid + gap)).alias("major"), F.sqrt(chi2 * F.greatest(mid - gap, F.lit(0.0))).alias("minor"), (F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2).alias("angle"))


def procrustes(pairs_: DataFrame, scale: bool = True, reflection: bool = True) -> tuple[dict, DataFrame]:
    """2-D similarity from (x, y) to (u, v): one aggregate of sums, a closed form, and a projection."""
    s = pairs_.agg(*[F.avg(c).alias(c) for c in "xyuv"], *[F.covar_pop(a, b).alias(a + b) for a in "xy" for b in "uv"], (F.var_pop("x") + F.var_pop("y")).alias("sx")).first()
    import math

    def turn(sign):
        c, t = s["xu"] + sign * s["yv"], s["xv"] - sign * s["yu"]
        return math.hypot(c, t), math.atan2(t, c)

    (p, a), (q, b) = turn(1), turn(-1)
    flip = reflection and q > p + 1e-15
    gain, angle, sign = (q, b, -1) if flip else (p, a, 1)
    k = gain / s["sx"] if scale and s["sx"] > 0 else 1.0
    m = [[k * math.cos(angle), -sign * k * math.sin(angle)], [k * math.sin(angle), sign * k * math.cos(angle)]]
    x, y = F.col("x") - s["x"], F.col("y") - s["y"]
    out = pairs_.withColumns({"x2": m[0][0] * x + m[0][1] * y + s["u"], "y2": m[1][0] * x + m[1][1] * y + s["v"]})
    return {"matrix": m, "scale": k, "reflected": flip, "angle": angle}, out


def kde2d(points: DataFrame, xs: list[float], ys: list[float], hx: float, hy: float) -> DataFrame:
    """(gx, gy, density): Gaussian density of points (x, y) on a fixed grid, one partial aggregate per grid cell."""
    import math

    cells = F.array(*[F.struct(F.lit(float(x)).alias("gx"), F.lit(float(y)).alias("gy")) for y in ys for x in xs])
    d = points.select("x", "y", F.explode(cells).alias("g"))
    q = F.pow((F.col("x") - F.col("g.gx")) / hx, F.lit(2.0)) + F.pow((F.col("y") - F.col("g.gy")) / hy, F.lit(2.0))
    return d.groupBy("g").agg((F.avg(F.exp(-q / 2)) / (2 * math.pi * hx * hy)).alias("density")).select("g.gx", "g.gy", "density")


def scott_bandwidth(points: DataFrame, c: str) -> DataFrame:
    """sd * n^(-1/6), the two-dimensional rule."""
    return points.agg((F.stddev_samp(c) * F.pow(F.count(c).cast("double"), F.lit(-1 / 6))).alias("h"))


def density_levels(cells: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, level): the highest-density threshold that holds each fraction of the mass."""
    w = W.orderBy(F.desc("density")).rowsBetween(W.unboundedPreceding, 0)
    d = cells.withColumns({"cum": F.sum("density").over(w), "total": F.sum("density").over(W.partitionBy())})
    d = d.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return d.filter(F.col("cum") >= F.col("fraction") * F.col("total")).groupBy("fraction").agg(F.max("density").alias("level"))
