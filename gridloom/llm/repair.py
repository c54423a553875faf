"""Conversation structure repair on a suffix-shared automaton.

A turn's symbol says its role's initial and fault; a conversation's symbols in order are its signature.  The
distinct signatures of the whole table are range-partitioned by their reversal and walked in that order, so
that signatures with a common end share the nodes of that end: each suffix is one node of the minimal acyclic
automaton, made once (again only where a partition begins).  A node holds the cost-to-go and the best next
edit for each state of the grammar ``(s?(ua)+)?``; best edits of one node and state differ in their first letter, so the
ASCII-least of the cheapest audits takes the least letter at each step and no audits are compared.  Nodes with equal
relative costs are one class, computed once.  A signature's audit is read off its path, joined
back to all conversations that have it, and applied to their texts as these stream by in order.

Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for blank and duplicate turns), Insert an
empty user or assistant turn 5; a truncated turn that stays adds 5.

Edge cases: a null role or text is one space (a blank text; a role outside the grammar, like any whose first letter is
none of s, u and a, which must be reroled or deleted); turns go by number, nulls first, then role, then MD5 of the text; repeated
rows are turns of their own, all but the first of them duplicates; a null conv_id is a conversation; a conversation of any length
takes one character a turn in memory (as its audit does in the result) besides one text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import cut

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
MUST = "-"  # the symbol of a turn that has to go; others: s, u, a, x (another role), in capitals if truncated
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a turn of a given initial, and the only turn that may be put in at a state
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60


def _settle(base: list[int]) -> list[int]:
    """Costs with insertions: at most two in a row ever help."""
    cost = list(base)
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return cost


class Automaton:
    """Classes of nodes by relative cost-to-go: ``step`` puts a symbol before a class, ``edits`` are its best next edits."""

    def __init__(self):
        self.classes: dict[tuple, int] = {}
        self.costs: list[tuple] = []
        self.edits: list[tuple] = []
        self.made: dict[tuple, tuple[int, int]] = {}
        end = _settle([0 if s in (START, ASSISTANT) else _NEVER for s in range(4)])
        self.end = self._class(end, tuple(("", s) if s in (START, ASSISTANT) else ("I", NEXT[s]) for s in range(4)))[0]

    def _class(self, cost: list[int], edits: tuple) -> tuple[int, int]:
        low = min(cost)
        key = (tuple(c - low for c in cost), edits)
        if key not in self.classes:
            self.classes[key] = len(self.costs)
            self.costs.append(key[0])
            self.edits.append(edits)
        return self.classes[key], low

    def step(self, symbol: str, after: int) -> tuple[int, int]:
        """(class, cost added to the lowest) of a turn's node before a node of class ``after``."""
        if (symbol, after) not in self.made:
            rest, initial = self.costs[after], symbol.lower()
            stay = CUT if symbol.isupper() else 0
            ways = []
            for s in range(4):
                way = {"D": (DELETE + rest[s], s)}
                if symbol != MUST:
                    if (s, initial) in STEP:
                        way["K"] = (KEEP + stay + rest[STEP[s, initial]], STEP[s, initial])
                    way["R"] = (REROLE + stay + rest[NEXT[s]], NEXT[s])
                ways.append(way)
            cost = _settle([min(c for c, _ in w.values()) for w in ways])
            edits = []
            for s, way in enumerate(ways):
                way["I"] = (INSERT + cost[NEXT[s]], NEXT[s])
                letter = min(x for x, (c, _) in way.items() if c == cost[s])
                edits.append((letter, way[letter][1]))
            self.made[symbol, after] = self._class(cost, tuple(edits))
        return self.made[symbol, after]

    def audit(self, path: list[int]) -> str:
        """The best edits along node classes from the first turn to the end."""
        out, state, at = [], START, 0
        while True:
            letter, state = self.edits[path[at]][state]
            if not letter:
                return "".join(out)
            out.append(letter)
            at += letter != "I"


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str, int]]:
    """(signature, cost, audit, new nodes) of signatures that come ordered by their reversal."""
    auto = Automaton()
    last, nodes, cost = "", [auto.end], [0]  # of the suffixes of ``last``, the shortest first
    for s in signatures:
        flipped = s[::-1]
        n, most = 0, min(len(last), len(flipped))
        while n < most and last[n] == flipped[n]:
            n += 1
        del nodes[n + 1 :], cost[n + 1 :]
        for symbol in flipped[n:]:
            node, low = auto.step(symbol, nodes[-1])
            nodes.append(node)
            cost.append(cost[-1] + low)
        last = flipped
        yield s, cost[-1] + auto.costs[nodes[-1]][START], auto.audit(nodes[::-1]), len(flipped) - n


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that CRC-32 of ``conv_id:turn`` deals out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    d = d.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return d.drop("col")


def _keys() -> list[Column]:
    return [F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")]


def _turns(conversations: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    d = conversations.select(*_keys(), F.col("turn").cast("long"), said("role"), said("text"))
    return d.withColumn("digest", F.unhex(F.md5("text")))


ORDER = ("turn", "role", "digest")  # ascending, nulls first
_REPORT = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("signature", pa.string())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")])
REPORT = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'long'}" for f in _REPORT)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures and counts of conversations whose distinct turns come in order."""
    on, out = None, []
    symbols: list[str] = []
    turns = blank = duplicate = truncated = illegal = 0
    least = most = before = None

    def close():
        gaps = most - least + 1 - turns if turns else 0
        out.append((*on, "".join(symbols), gaps, blank, duplicate, truncated, illegal))

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_REPORT)], schema=_REPORT)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("none", "conv", "turn", "initial", "fault", "again", "copies")]
        for none, conv, turn, initial, fault, again, copies in zip(*cols, strict=True):
            if on != (none, conv):
                if on is not None:
                    close()
                on, symbols, turns, blank, duplicate, truncated, illegal, least, most, before = (none, conv), [], 0, 0, 0, 0, 0, None, None, None
            if turn is not None and turn != most:
                turns, least, most = turns + 1, turn if least is None else least, turn
            illegal += (before is not None and before + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
            before = initial
            letter = initial if initial in ("s", "u", "a") else "x"
            if fault == "blank":
                blank += copies
                symbols.append(MUST * copies)
                continue
            first = not again
            duplicate += copies - first
            if first:
                truncated += fault == "truncated"
                symbols.append(letter.upper() if fault == "truncated" else letter)
            symbols.append(MUST * (copies - first))
        if len(out) > 2000:
            yield emit()
            out = []
    if on is not None:
        close()
    yield emit()


def signatures(turns: DataFrame) -> DataFrame:
    """none, conv, signature and counts of faults of every conversation; texts stay behind, 16 bytes of each travel."""
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    own = ["none", "conv", "role", "digest"]
    d = turns.select("none", "conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    d = d.groupBy(*own, "turn", "initial", "fault").agg(F.count(F.lit(1)).alias("copies"))
    # nulls come first: the earliest turn of each (role, text) is null if there is one
    first = d.groupBy(*own).agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("first"))
    d = d.join(first, own).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first")
    d = d.repartition("none", "conv").sortWithinPartitions("none", "conv", *ORDER)
    return d.select("none", "conv", "turn", "initial", "fault", "again", "copies").mapInArrow(_read, REPORT)


def audits(signature: DataFrame) -> DataFrame:
    """signature, cost, audit, nodes (made for it) of distinct signatures, by the shared automaton."""
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("nodes", pa.int64())])

    def run(batches):
        def flow():
            for b in batches:
                yield from b.column("signature").to_pylist()

        rows, size = [], 0
        for r in solve(flow()):
            rows.append(r)
            size += len(r[0]) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    d = signature.select("signature").distinct().withColumn("flipped", F.reverse("signature"))
    d = d.repartitionByRange("flipped").sortWithinPartitions("flipped")
    return d.select("signature").mapInArrow(run, "signature string, cost long, audit string, nodes long")


def plan(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """none, conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``everyone`` (default: of the rows)."""
    found = cut(signatures(_turns(conversations)))
    solved = found.join(audits(found), "signature").drop("signature", "nodes")
    ids = (conversations if everyone is None else everyone).select(*_keys()).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(solved, ["none", "conv"], "left").select("none", "conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("open", plan row), then ("turn", role, text, edit) for each turn that the audit leaves, of each conversation in order."""
    audit, at, state = "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield "turn", NAMES[state], "", "I"

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            r = dict(zip(batch.schema.names, row, strict=True))
            if r["audit"] is not None:
                yield from inserted()
                audit, at, state = r["audit"], 0, START
                yield "open", r
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = STEP[state, r["role"][0]]
                yield "turn", r["role"], r["text"], edit
            elif edit == "R":
                state = NEXT[state]
                yield "turn", NAMES[state], r["text"], edit
    yield from inserted()


def _placed(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans, each followed by its conversation's turns in order, in the same task."""
    rows = plans.unionByName(_turns(conversations), allowMissingColumns=True)
    rows = rows.repartition("none", "conv").sortWithinPartitions("none", "conv", F.col("audit").isNull(), *ORDER)
    return rows.drop("digest", "turn")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, nth, role, text, edit (K, R or I) of the turns of every repaired conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        conv, nth, rows, size = None, 0, [], 0
        for kind, *x in _edited(batches):
            if kind == "open":
                conv, nth = None if x[0]["none"] else x[0]["conv"], 0
                continue
            rows.append((conv, nth, *x))
            nth, size = nth + 1, size + len(x[1]) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _placed(conversations, plan(conversations)).mapInArrow(run, "conv_id long, nth long, role string, text string, edit string")


_OUT = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
OUT = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _OUT)


def report(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """The plan of every conversation with the digest of its repaired turns."""

    def run(batches):
        on, digest, begun, rows = None, None, False, []

        def close():
            rows.append({**{c: on[c] for c in _OUT.names if c in on}, "conv_id": None if on["none"] else on["conv"], "repaired_sha256": digest.hexdigest()})

        for kind, *x in _edited(batches):
            if kind == "open":
                if on is not None:
                    close()
                on, digest, begun = x[0], hashlib.sha256(), False
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, _OUT)
                    rows = []
            else:
                digest.update((f"\n{x[0]}:{x[1]}" if begun else f"{x[0]}:{x[1]}").encode())
                begun = True
        if on is not None:
            close()
        yield pa.RecordBatch.from_pylist(rows, _OUT)

    return _placed(conversations, plan(conversations, everyone)).mapInArrow(run, OUT)


def op11_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damage(rows), rows)


#: costs to go from the last turn to the first, then the least cheapest edit at each step
OP11_SQL = r"""
WITH RECURSIVE bit AS (SELECT range AS b, 0 AS i, range AS c FROM range(256) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bit WHERE i = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 20 AS k FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE k <> 0),
num AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM dam),
ord AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY n) AS again FROM num),
row AS (SELECT *, left(role, 1) AS ini, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY n) AS before FROM ord),
size AS (SELECT g, any_value(conv_id) AS conv_id, max(n) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM row GROUP BY g),
-- states: start, after system, after user, after assistant; the costs from turn n on
togo AS (SELECT g, n + 1 AS n, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM size
    UNION ALL
    SELECT g, n, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2)
    FROM (SELECT t.g, r.n,
        least(2 + c0, m + CASE ini WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 1 + c2 END, m + 1 + c2) AS b0, least(2 + c1, m + CASE ini WHEN 'u' THEN 0 ELSE 1 END + c2) AS b1,
        least(2 + c2, m + CASE ini WHEN 'a' THEN 0 ELSE 1 END + c3) AS b2, least(2 + c3, m + CASE ini WHEN 'u' THEN 0 ELSE 1 END + c2) AS b3
        FROM togo t JOIN (SELECT *, CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS m FROM row) r ON r.g = t.g AND r.n = t.n - 1)),
cost AS MATERIALIZED (SELECT g, n, [c0, c1, c2, c3] AS c FROM togo),
walk AS (SELECT g, 1::BIGINT AS n, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM size
    UNION ALL
    SELECT g, CASE WHEN e = 'I' THEN n ELSE n + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN keep ELSE step END, audit || e,
        CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE step WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
    FROM (SELECT w.*, role, text, keep, step,
        CASE WHEN r.n IS NULL THEN CASE WHEN s IN (0, 3) THEN '' ELSE 'I' END
            WHEN c.c[s + 1] = 2 + d.c[s + 1] THEN 'D' WHEN c.c[s + 1] = 5 + c.c[step + 1] THEN 'I' WHEN keep IS NOT NULL AND c.c[s + 1] = m + d.c[keep + 1] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT *, CASE s WHEN 2 THEN 3 ELSE 2 END AS step FROM walk) w JOIN cost c ON c.g = w.g AND c.n = w.n LEFT JOIN cost d ON d.g = w.g AND d.n = w.n + 1
        LEFT JOIN (SELECT *, CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS m FROM row) r ON r.g = w.g AND r.n = w.n,
        LATERAL (SELECT CASE WHEN s = 0 AND ini = 's' THEN 1 WHEN s IN (0, 1, 3) AND ini = 'u' THEN 2 WHEN s = 2 AND ini = 'a' THEN 3 END AS keep))
    WHERE e <> ''),
done AS (SELECT w.g, audit, said FROM walk w JOIN size z ON z.g = w.g WHERE w.n = z.n + 1 AND w.s IN (0, 3)),
full_ AS (SELECT z.*, audit, said, c.c[1] AS cost FROM size z JOIN done d ON d.g = z.g JOIN cost c ON c.g = z.g AND c.n = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN full_ f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
