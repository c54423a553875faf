"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans are those of four fixed patterns (email, ip, card, phone).  Bootstrapping: every
identifier-like token (a run with a digit, ``MIN_ID`` characters or more) is an instance, the two
words before it are its lexical pattern.  Every base span is one instance, after the two words before it;
these and long hexadecimal keys are seeds.  Spark scores the bipartite graph of patterns and instances in rounds: a pattern's
confidence is the mean confidence of its occurrences, damped by ``DAMPING`` pseudo-occurrences; an
unseen instance gets the noisy-or of its patterns'.  Patterns with ``CONFIDENT`` confidence and
``SUPPORT`` distinct seeds or instances discovered by other patterns before then mark every identifier-like token after them as kind ``id``; hexadecimal
keys are kind ``secret``.  Base spans are kept whatever the method adds.

Only occurrences of identifier-like tokens are shuffled, never texts.  Accepted patterns are broadcast
up to ``MAX_PATTERNS`` hashes (a few MB); beyond, each document gets its own accepted patterns by joins.

Edge cases: null text is empty; spans are code points, ends exclusive; a pattern's words count whole, whatever their
length and the blanks between; without two words before it (of more than punctuation) an occurrence has no pattern;
an instance counts once for a pattern, so that repeated rows are no further evidence, and they are annotated
alike; an empty table gives no rows; other columns are carried through masking untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import tokens as T
from gridloom.llm.store import cut

KINDS = ("email", "ip", "card", "phone")
MIN_ID, ROUNDS, DAMPING, CONFIDENT, SUPPORT, MAX_PATTERNS = 5, 3, 2.0, 0.6, 5, 200_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|=~"
_KEY = re.compile(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}")
_BLANK = frozenset(" \t\n\v\f\r")
_STRIP = _EDGE.replace("=", "")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each @ takes the local run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    out = [("email", a, z) for a, z in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of identifier-like tokens; the pattern is the two words before, lower case without punctuation."""
    out = []
    for m in _TOKEN.finditer(text):
        core = m[0].strip(_EDGE)
        start = m.start() + m[0].find(core)
        if len(core) >= MIN_ID and _DIGIT.search(core):
            out.append((start, start + len(core), _pattern(text, m.start())))
    return out


def _token_start(text: str, at: int, floor: int = 0) -> int:
    """Where the characters right before ``at`` that are no blanks begin, ``floor`` at least."""
    while at > floor and text[at - 1] not in _BLANK:
        at -= 1
    return at


def _pattern(text: str, at: int) -> str:
    """The two whole words before ``at``, however far back; empty where there are fewer."""
    words = []
    for _ in range(2):
        while at > 0 and text[at - 1] in _BLANK:
            at -= 1
        start = _token_start(text, at)
        words.append(text[start:at].strip(_STRIP).lower())
        at = start
    return " ".join(reversed(words)) if all(words) else ""


def pattern_hash(pattern: str) -> int:
    return int.from_bytes(hashlib.blake2b(pattern.encode(), digest_size=8).digest(), "little", signed=True)


def _inside(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    i = bisect.bisect_right(spans, (start, 1 << 62)) - 1
    return any(a < end and start < z for a, z in spans[max(i, 0) : i + 2])


def occurrences(docs: DataFrame) -> DataFrame:
    """doc, pattern, instance, seed: the pattern-instance graph's edges over all texts (hashes only)."""
    schema = pa.schema([("doc", pa.int64()), ("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_())])

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    base = sorted((a, z) for _, a, z in base_spans(text))
                    found = [(a, z, p, _KEY.fullmatch(text, a, z) is not None) for a, z, p in candidates(text) if not _inside(base, a, z)]
                    end = 0
                    for a, z in base:
                        if a >= end:  # else its context is another span
                            found.append((a, z, _pattern(text, _token_start(text, a, end)), True))
                        end = max(end, z)
                    rows += [(doc, pattern_hash(p), pattern_hash(text[a:z]), seed) for a, z, p, seed in found if p]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    keyed = docs.select(F.xxhash64("text").alias("doc"), "text")
    return keyed.mapInArrow(run, "doc long, pattern long, instance long, seed boolean")


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence of the patterns that may discover identifiers."""
    graph = cut(edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce(F.col("conf"), F.lit(0.0)))
    known = None
    for _ in range(rounds):
        g = graph.withColumn("conf", F.lit(0.0)) if known is None else graph.join(known, "instance", "left")
        # an instance counts once: a number repeated in copies is no more evidence
        patterns = g.groupBy("pattern").agg((F.sum(score) / (F.count(F.lit(1)) + DAMPING)).alias("confidence"), F.count_if(F.col("seed") | (F.coalesce(F.col("conf"), F.lit(0.0)) >= CONFIDENT)).alias("support"))
        strong = patterns.filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT))
        none = F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9)))
        known = graph.filter(~F.col("seed")).join(strong, "pattern").groupBy("instance").agg((F.lit(1.0) - F.exp(F.sum(none))).alias("conf"))
    return cut(strong.select("pattern", "confidence"))


def added_spans(text: str, base: list[tuple[str, int, int]], accepted) -> list[tuple[str, int, int]]:
    """Spans beyond the base: hexadecimal keys and what follows an accepted pattern."""
    taken, out = sorted((a, z) for _, a, z in base), []
    for a, z, p in candidates(text):
        if _inside(taken, a, z):
            continue
        if _KEY.fullmatch(text, a, z):
            out.append(("secret", a, z))
        elif p and pattern_hash(p) in accepted:
            out.append(("id", a, z))
    return sorted(out)


def _apply(docs: DataFrame, patterns: DataFrame, each, schema: pa.Schema, ddl, max_patterns: int) -> DataFrame:
    """``each(batch, sets)`` over ``docs``; ``sets[i]`` are the accepted patterns for row i."""
    if patterns.count() <= max_patterns:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in patterns.select("pattern").collect()))  # at most max_patterns

        def run(batches):
            for whole in batches:
                for batch in T.slices(whole, "text"):
                    yield each(batch, [held.value] * batch.num_rows)

        return docs.mapInArrow(run, ddl)
    own = occurrences(docs).join(patterns.select("pattern"), "pattern", "left_semi").groupBy("doc").agg(F.collect_set("pattern").alias("__accepted"))
    joined = docs.withColumn("__doc", F.xxhash64("text")).join(own.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")

    def run_joined(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                sets = [frozenset(x or ()) for x in batch.column("__accepted").to_pylist()]
                yield each(batch.select([n for n in batch.schema.names if n != "__accepted"]), sets)

    return joined.mapInArrow(run_joined, ddl)


def annotate(docs: DataFrame, patterns: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans with their numbers (added, all), of every text."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])

    def each(batch, sets):
        rows = []
        for doc, text, accepted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), sets, strict=True):
            base = base_spans(text or "")
            more = added_spans(text or "", base, accepted)
            said = [",".join(f"{k}:{a}:{z}" for k, a, z in s) for s in (base, base + more)]
            rows.append({"doc_id": doc, **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}, "base_sha256": hashlib.sha256(said[0].encode()).hexdigest(), "spans": said[1], "n_added": len(more), "n_spans": len(base) + len(more)})
        return pa.RecordBatch.from_pylist(rows, schema)

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return _apply(docs.select(F.col("doc_id").cast("long"), "text"), patterns, each, schema, ddl, max_patterns)


def mask(docs: DataFrame, patterns: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets (overlaps: one mark)."""

    def each(batch, sets):
        out = []
        for text, accepted in zip(batch.column("text").to_pylist(), sets, strict=True):
            base = base_spans(text or "")
            parts, at = [], 0
            for kind, a, z in sorted(base + added_spans(text or "", base, accepted), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [text[at:a], f"<{kind}>"]
                at = max(at, z)
            out.append(text if not parts else "".join(parts) + text[at:])
        i = batch.schema.get_field_index("text")
        return batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return _apply(docs, patterns, each, None, docs.schema, max_patterns)


def find_patterns(docs: DataFrame) -> DataFrame:
    return confident_patterns(occurrences(docs))


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return annotate(docs, find_patterns(docs))
