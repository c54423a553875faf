"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share ``share`` times all words; a target stops at ``max_epochs`` times its
source's size and the excess goes to the others by weight.  Selection: complete
epochs take every document; what is left of a target goes to the documents with
the smallest exponential keys ``-ln(u) / weight``, whole documents only, so that
a source misses its target by half of one document at most.  The weight of a document
is its probability of good quality, by a model of the text's structure that is fitted to all labelled rows
with aggregates (:func:`quality_weight`).

Edge cases: null text has size 0 and is never taken by the fractional part; null
sources form one source; repeated rows draw the same key and count one by one, ties of keys go by
doc_id and size; documents without a label weigh by their structure alone;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import cut
from gridloom.operators.order import ranked, running

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "0123456789#$%&*|<>{}[]=_~^/@+"
MAX_BROADCAST_SOURCES = 50_000  # a few MB; with more sources the targets are joined by a shuffle


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def structure(text: Column, size: Column) -> dict[str, Column]:
    """Structure of a text as numbers: mean word length, share of digits and symbols, stops per word, log of the size."""
    text, words = F.coalesce(text, F.lit("")), F.greatest(size, F.lit(1))
    chars = F.length(text)
    without = lambda drop: (chars - F.length(F.translate(text, drop, ""))).cast("double")
    return {"f0": chars / words, "f1": without(SYMBOLS) / F.greatest(chars, F.lit(1)), "f2": without(".!?") / words, "f3": F.ln(F.lit(1.0) + size)}


def quality_weight(docs: DataFrame, labels: DataFrame) -> Column:
    """0.1 to 1: 0.1 + 0.9 P(quality = 1) by a Gaussian naive Bayes model of the columns ``f0`` to ``f3``.

    Its moments are aggregates over all rows of ``docs`` (id, f0, ...) that ``labels`` (doc_id, quality) knows; the
    smallest of several labels counts.  Without two labelled rows of either class all weights are 1.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).alias("good"))
    rows, model, odds = docs.join(known, "id"), [], F.lit(0.0)
    for good, g in ((True, "g"), (False, "b")):
        here = F.col("good") if good else ~F.col("good")
        model.append(F.count_if(here).alias(f"{g}n"))
        for i in range(4):
            x = F.when(here, F.col(f"f{i}"))
            model += [F.avg(x).alias(f"{g}m{i}"), (F.var_pop(x) + 1e-4).alias(f"{g}v{i}")]
    m = rows.agg(F.struct(*model).alias("m")).scalar()
    odds = F.ln(m["gn"].cast("double") / m["bn"])
    for i in range(4):
        x = F.col(f"f{i}")
        far = {g: (x - m[f"{g}m{i}"]) * (x - m[f"{g}m{i}"]) / m[f"{g}v{i}"] for g in "gb"}
        odds = odds + (F.ln(m[f"bv{i}"] / m[f"gv{i}"]) + far["b"] - far["g"]) / 2.0
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    return F.when((m["gn"] >= 2) & (m["bn"] >= 2), F.lit(0.1) + F.lit(0.9) * p).otherwise(F.lit(1.0))


def targets(per_source: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(skey, source_size, n_docs) -> with target and full epochs; one row per source.

    Sources fill to their caps in the order of cap by weight, as long as the level of what is left reaches it.
    """
    if not (whole := per_source.agg(F.sum("source_size")).first()[0]):
        whole = 0
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = ranked(per_source, [F.col("source").asc_nulls_last()], "nth").withColumn("w", F.get(pattern, F.pmod("nth", F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    s = cut(running(s, [F.col("ratio"), F.col("nth")], {"cap_before": F.col("cap"), "w_before": F.col("w")}))
    all_w = s.agg(F.sum("w")).first()[0] or 0.0
    s = s.withColumn("level", (F.lit(float(whole) * float(share)) - F.col("cap_before")) / (F.lit(all_w) - F.col("w_before")))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = s.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(level or 0.0) * F.col("w")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    return s.withColumn("epochs", full).select("skey", "source_size", "n_docs", "target", "epochs")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_epochs: int = 2, seed: int = 17, weight: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): one row per document with its size, its source's size and target, and the words taken.

    ``weight``: a positive quality weight; else :func:`quality_weight` learned from ``labels``; else all weigh alike.
    All rows are put in one order of (source, key) by ranges, so a source of any size and any weights sorts in many tasks; only
    sums per range are prefix-summed.  ``keep``: columns of ``docs`` to carry.
    """
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    d = docs.select(*carried, F.col("doc_id").alias("id"), "source", "text", size_of(F.col("text")).alias("size"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    d = d.withColumns(structure(F.col("text"), F.col("size"))).drop("text") if weight is None and labels is not None else d.drop("text")
    d = d.withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    d = cut(d).withColumn("row", F.monotonically_increasing_id())  # a few numbers a document: the texts are read once
    if weight is None and labels is not None:
        d = d.withColumn("weight", quality_weight(d, labels))
    digest = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    d = d.withColumn("key", -F.ln(u) / F.greatest(F.col("weight"), F.lit(1e-6))).drop("weight", "f0", "f1", "f2", "f3")
    per_source = d.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # sources lie end to end in one order of all rows, so a running total less what earlier sources hold is a source's own
    plan = cut(running(targets(per_source, share, weights, max_epochs), [F.col("skey")], {"base": F.col("source_size")}))
    small = plan.count() <= MAX_BROADCAST_SOURCES
    order = [F.col(c) for c in ("skey", "key", "id", "size", "row")]  # "row" splits repeated rows, which may be many
    d = running(d.drop("source"), order, {"before": F.col("size")}).drop("row")
    d = d.join(F.broadcast(plan) if small else plan, "skey")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = ((F.col("before") - F.col("base") + F.col("size") / 2.0) <= rest) & (F.col("size") > 0)
    copies = (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("long")
    d = d.withColumn("copies", copies)
    return d.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("copies")


_MOMENTS = ", ".join(f"avg(f{i}) FILTER (WHERE {c}) AS {g}m{i}, var_pop(f{i}) FILTER (WHERE {c}) + 1e-4::DOUBLE AS {g}v{i}" for g, c in (("g", "good"), ("b", "NOT good")) for i in range(4))
_ODDS = " + ".join(f"(ln(bv{i} / gv{i}) + (f{i} - bm{i}) * (f{i} - bm{i}) / bv{i} - (f{i} - gm{i}) * (f{i} - gm{i}) / gv{i}) / 2" for i in range(4))
OP9_SQL = rf"""
WITH c AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
d AS (SELECT doc_id, source, size, length(t)::DOUBLE / greatest(size, 1) AS f0,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::DOUBLE / greatest(length(t), 1) AS f1,
    (length(t) - length(translate(t, '.!?', '')))::DOUBLE / greatest(size, 1) AS f2, ln(1.0::DOUBLE + size) AS f3 FROM c),
x AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
y AS (SELECT count(*) FILTER (WHERE good) AS gn, count(*) FILTER (WHERE NOT good) AS bn, {_MOMENTS} FROM d JOIN x USING (doc_id)),
q AS (SELECT d.*, CASE WHEN gn >= 2 AND bn >= 2 THEN 0.1::DOUBLE + 0.9::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE,
    ln(gn::DOUBLE / bn) + {_ODDS})))) ELSE 1.0::DOUBLE END AS weight FROM d, y),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS key FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM k GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
    FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN ratio <= lev THEN NULL ELSE lev END) OVER () AS top FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= lev THEN cap ELSE top * w END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
    CAST((epochs + CASE WHEN size > 0 AND run - size + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""
