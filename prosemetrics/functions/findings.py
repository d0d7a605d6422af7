"""The finding record, its severity scale, and per-document ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"

# The severity scale, gravest first.
SEVERITIES = ("error", "likely", "review", "info")

FINDING = (
    "struct<id:string,analyzer:string,category:string,severity:string,"
    "confidence:double,message:string,suggestion:string,evidence:string,"
    "line:int,column:int,start:int,end:int,profile:string,meta:map<string,int>>"
)
FINDING_FIELDS = (
    ("id", "string"),
    ("analyzer", "string"),
    ("category", "string"),
    ("severity", "string"),
    ("confidence", "double"),
    ("message", "string"),
    ("suggestion", "string"),
    ("evidence", "string"),
    ("line", "int"),
    ("column", "int"),
    ("start", "int"),
    ("end", "int"),
    ("profile", "string"),
    ("meta", "map<string,int>"),
)
_DEFAULTS = {"confidence": 1.0, "suggestion": "", "evidence": ""}


def action_confidence_of(action: str) -> tuple[str, float]:
    """Severity and confidence of a marker level."""
    return ("review", 0.6) if action == "review" else ("likely", 0.8)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(**fields) -> Column:
    """Build one finding; plain Python values become literals."""
    unknown = set(fields) - {name for name, _ in FINDING_FIELDS}
    if unknown:
        raise TypeError(f"unknown finding fields: {sorted(unknown)}")
    return F.struct(
        *[
            _col(fields.get(name, _DEFAULTS.get(name))).cast(kind).alias(name)
            for name, kind in FINDING_FIELDS
        ]
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def one_if(condition: Column, item: Column) -> Column:
    """One-element array when the condition holds, else an empty one."""
    return F.when(condition, F.array(item)).otherwise(no_findings())


def severity_rank(severity: Column) -> Column:
    """0 for the gravest level; null for a value outside the scale."""
    rank = F.when(severity == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(severity == name, i)
    return rank


def ordered(findings: Column) -> Column:
    """Order by severity, line (missing first) and id; ties keep their order.

    The map field is not orderable, so positions are sorted, not the records.
    """
    keys = F.transform(
        findings,
        lambda f, i: F.struct(
            severity_rank(f["severity"]).alias("rank"),
            F.coalesce(f["line"], F.lit(0)).alias("line"),
            f["id"].alias("id"),
            i.alias("pos"),
        ),
    )
    return F.transform(F.sort_array(keys), lambda k: F.get(findings, k["pos"]))


def compact_json(f: Column) -> Column:
    """JSON of a finding without null, empty-string and empty-map fields.

    Severity and numeric zero stay.
    """
    kept = []
    for name, kind in FINDING_FIELDS:
        value = f[name]
        if name != "severity" and kind == "string":
            value = F.nullif(value, F.lit(""))
        if kind.startswith("map"):
            value = F.when(F.size(value) > 0, value)
        kept.append(value.alias(name))
    return F.to_json(F.struct(*kept))


def is_valid(f: Column) -> Column:
    """Severity on the scale and confidence within [0, 1]."""
    return F.coalesce(
        f["severity"].isin(*SEVERITIES) & f["confidence"].between(0.0, 1.0), F.lit(False)
    )


def quarantine(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a flat findings table into valid rows and rejected rows."""
    row = F.struct(*[F.col(name) for name, _ in FINDING_FIELDS])
    return findings.where(is_valid(row)), findings.where(~is_valid(row))


def checked(f: Column) -> Column:
    """The finding itself; a bad one fails the job with its id."""
    return F.when(is_valid(f), f).otherwise(
        F.raise_error(F.concat(F.lit("bad severity or confidence in finding "), f["id"])).cast(
            FINDING
        )
    )


def flat(docs: DataFrame, findings: Column, *keys: str) -> DataFrame:
    """One row per finding; ``keys`` (default ``doc_id``) stay beside it.

    The outer form with a later filter is deliberate: for a plain explode the
    optimizer adds a size check under it, which evaluates the array twice.
    """
    keys = keys or ("doc_id",)
    return (
        docs.select(*keys, F.explode_outer(findings).alias("f"))
        .where(F.col("f").isNotNull())
        .select(*keys, "f.*")
    )


def packed(findings: DataFrame) -> Column:
    """Struct of the finding columns of a flat findings table."""
    return F.struct(*[F.col(name) for name, _ in FINDING_FIELDS])
