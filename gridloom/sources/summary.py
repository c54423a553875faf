"""Stored summary tables: reserved columns, nine interval kinds, row rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.num import is_finite
from gridloom.sources.delimited import read_text

#: fixed values of the table profile: (statistics, level, label) of each interval kind
KINDS = {
    "none": (("mean", "median", "custom"), None, "No interval"),
    "sd": (("mean",), None, "± SD"),
    "se": (("mean",), None, "± SE"),
    "ci_normal": (("mean", "custom"), "confidence", "{percent}% CI (normal)"),
    "ci_t": (("mean", "custom"), "confidence", "{percent}% CI (t)"),
    "quantile_range": (("mean", "median"), "central_mass", "{percent}% quantile range"),
    "wsci_cm": (("mean",), "confidence", "{percent}% within-subject CI (Cousineau–Morey)"),
    "heuristic_se": (("mean",), "calibration", "Heuristic band ({percent}% calibration; not a CI)"),
    "custom": (("mean", "median", "custom"), None, "{definition}"),
}
NUMBERS = ("estimate", "lower", "upper", "interval_level", "df", "n", "sd", "se", "mean_voxel_se")
TEXTS = ("interval_kind", "method", "interval_reason", "interval_definition", "original_kind")
REQUIRED = ("estimate", "lower", "upper", "interval_kind")
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: accepted names of other writers
ALIASES = {"estimate": ("value", "mean"), "lower": ("lwr", "conf.low", "conf_low"), "upper": ("upr", "conf.high", "conf_high"), "interval_level": ("conf_level", "level")}
LEGACY_KINDS = {"ci": "ci_t", "within": "wsci_cm", "range": "quantile_range"}


def with_reserved(d: DataFrame) -> DataFrame:
    """All reserved columns, null where absent."""
    return d.withColumns({c: F.lit(None).cast("double" if c in NUMBERS else "string") for c in (*NUMBERS, *TEXTS) if c not in d.columns})


def rules(statistic: str = "mean") -> list[tuple[str, Column]]:
    """(message, condition that breaks it) for every row rule."""
    c = F.col
    kind, lo, hi, est = c("interval_kind"), c("lower"), c("upper"), c("estimate")
    levels = [k for k, v in KINDS.items() if v[1]]
    fit = [k for k, v in KINDS.items() if statistic in v[0]]
    level = c("interval_level")
    blank = lambda x: x.isNull() | ~x.rlike(r"\S")
    out = [(f"{n} must be finite", c(n).isNotNull() & ~is_finite(n)) for n in NUMBERS]
    out += [(f"{n} must not be blank", c(n).isNotNull() & ~c(n).rlike(r"\S")) for n in TEXTS[1:]]
    out += [
        ("unknown interval kind", kind.isNull() | ~kind.isin(list(KINDS))),
        ("the interval kind needs a level", kind.isin(levels) & level.isNull()),
        ("the level must lie between 0 and 1", kind.isin(levels) & ~((level > 0) & (level < 1))),
        ("the interval kind takes no level", ~kind.isin(levels) & level.isNotNull()),
        ("kind none has no bounds", (kind == "none") & (lo.isNotNull() | hi.isNotNull())),
        ("both bounds or neither", lo.isNull() != hi.isNull()),
        ("bounds need an estimate", lo.isNotNull() & est.isNull()),
        ("lower exceeds upper", lo > hi),
        ("an interval without bounds needs a reason", ~kind.isin("none", "custom") & lo.isNull() & blank(c("interval_reason"))),
        ("custom needs a definition", (kind == "custom") & blank(c("interval_definition"))),
        ("custom needs bounds", (kind == "custom") & lo.isNull()),
        ("bounds of this kind need df above 0", kind.isin("ci_t", "wsci_cm") & lo.isNotNull() & ~(F.coalesce(c("df"), F.lit(0.0)) > 0)),
        ("df must be positive", c("df") <= 0),
        ("n must be a whole number from 0", (c("n") < 0) | (c("n") != F.floor("n"))),
        *[(f"{n} must not be negative", c(n) < 0) for n in ("sd", "se", "mean_voxel_se")],
        ("heuristic_se keeps its input in mean_voxel_se", (kind == "heuristic_se") & c("se").isNotNull()),
        ("original_kind belongs to custom rows", (kind != "custom") & c("original_kind").isNotNull()),
        ("the kind does not fit the statistic", kind.isin(list(KINDS)) & ~kind.isin(fit)),
    ]
    return out


def problems(d: DataFrame, statistic: str = "mean") -> DataFrame:
    """``d`` with an array of the messages of broken rules (empty where the row is valid)."""
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for msg, bad in rules(statistic)]
    return with_reserved(d).withColumn("problems", F.array_compact(F.array(*marks)))


def read_summary(spark: SparkSession, path: str, fmt: str = "csv", statistic: str = "mean") -> DataFrame:
    """A stored table: reserved numbers typed by a strict pattern, all else text; an error if any row is invalid."""
    d = read_text(spark, path, "\t" if fmt == "tsv" else ",")
    if any(not c for c in d.columns) or any(c not in d.columns for c in REQUIRED):
        raise ValueError("summary columns are missing or unnamed")
    own = [F.col(f"`{c}`") for c in d.columns]
    num = lambda c: F.when(F.col(c).isNull() | F.col(c).rlike(NUMBER), F.col(c).try_cast("double")).otherwise(F.raise_error(F.lit(f"invalid number in {c}")).cast("double"))
    d = problems(d.select(*[num(c).alias(c) if c in NUMBERS else F.col(f"`{c}`").alias(c) for c in d.columns]), statistic)
    if bad := d.filter(F.size("problems") > 0).select("problems").first():
        raise ValueError("; ".join(bad[0]))
    return d.select(*own)


def import_rows(d: DataFrame) -> DataFrame:
    """Rows of other writers: aliases filled in (an error where two differ), old kinds renamed, unknown kinds kept as custom."""
    for name, others in ALIASES.items():
        cols = [F.col(f"`{c}`").try_cast("double") for c in (name, *others) if c in d.columns]
        if not cols:
            continue
        value = F.coalesce(*cols)
        clash = F.lit(False)
        for x in cols:
            clash = clash | (x.isNotNull() & (x != value))
        d = d.withColumn(f"__{name}", F.when(clash, F.raise_error(F.lit(f"conflicting values for {name}")).cast("double")).otherwise(value))
        d = d.drop(*[c for c in (name, *others) if c in d.columns]).withColumnRenamed(f"__{name}", name)
    d = with_reserved(d)
    kind = F.col("interval_kind")
    table = F.create_map(*[F.lit(x) for kv in LEGACY_KINDS.items() for x in kv])
    new = F.when(kind.isNull(), "none").when(kind.isin(list(KINDS)), kind).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("custom")))
    odd = (new == "custom") & (F.coalesce(kind, F.lit("custom")) != "custom")
    return d.withColumns({"interval_kind": new, "original_kind": F.when(odd, kind).otherwise(F.col("original_kind")), "interval_definition": F.when(odd & F.col("interval_definition").isNull(), F.concat(F.lit("imported: "), kind)).otherwise(F.col("interval_definition"))})


def to_text(d: DataFrame, fmt: str = "csv") -> DataFrame:
    """(line) of each row with shortest round-trip decimals, null empty, "" quoted; an error for NaN or infinities."""
    sep = "\t" if fmt == "tsv" else ","

    def cell(f) -> Column:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            return F.when(c.isNull(), "").when(is_finite(c), F.regexp_replace(c.cast("string"), r"\.0$", "")).otherwise(F.raise_error(F.lit("not a finite number")).cast("string"))
        s = c.cast("string")
        return F.when(s.isNull(), "").when((s == "") | s.rlike(f'["\\n\\r{sep}]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return d.select(F.concat_ws(sep, *[cell(f) for f in d.schema.fields]).alias("line"))


def validate_descriptor(x: dict, version: str = "0.1.0") -> None:
    """The description of stored tables: version, and per table its path, format, statistic, counting unit, design and plot."""
    if not isinstance(x, dict) or set(x) - {"version", "tables"} or x.get("version") != version or not x.get("tables"):
        raise ValueError("not a summary descriptor of this version")
    for name, t in x["tables"].items():
        if set(t) - {"table", "statistic", "counting_unit", "unit", "definition", "design", "plot", "extensions"}:
            raise ValueError(f"{name}: unknown key")
        p = t.get("table", {}).get("path", "")
        if not p or p.startswith("/") or ":" in p or "\\" in p or ".." in p.split("/"):
            raise ValueError(f"{name}: the path must be relative and inside the package")
        if t["table"].get("format") not in ("csv", "tsv") or t.get("statistic") not in ("mean", "median", "custom") or not str(t.get("counting_unit", "")).strip():
            raise ValueError(f"{name}: format, statistic or counting unit")
        if t["statistic"] == "custom" and not str(t.get("definition", "")).strip():
            raise ValueError(f"{name}: a custom statistic needs a definition")
        if (plot := t.get("plot")) is not None and plot.get("mark") not in ("point", "line", "interval"):
            raise ValueError(f"{name}: mark must be point, line or interval")
        if (d := t.get("design")) is not None and (not d.get("subject") or not isinstance(d.get("within"), dict) or not isinstance(d.get("between"), list)):
            raise ValueError(f"{name}: design needs subject, within and between")
        if any(not k.startswith("x-") for k in t.get("extensions", {})):
            raise ValueError(f"{name}: extension keys begin with x-")
