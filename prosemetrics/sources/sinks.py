"""Writers for reports and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prosemetrics.functions.findings import SEVERITIES
from prosemetrics.operators.reporting import report_json


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON report per line, one line per document."""
    report_json(reports).select("report").write.mode(mode).text(path)


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Flat findings, one folder per analyzer, so readers can prune.

    Returned is how many findings of each severity were written.  They are counted while they are
    written: no second pass over the findings or the texts behind them.
    """
    seen = Observation()
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    findings.observe(seen, *counts).write.mode(mode).partitionBy("analyzer").parquet(path)
    return {s: seen.get[s] or 0 for s in SEVERITIES}


def exit_code(counts: dict[str, int], fail_on: str = "error") -> int:
    """The gate over a whole run, from the counts of :func:`write_findings`."""
    if fail_on not in SEVERITIES:
        raise ValueError(f"fail_on must be one of {SEVERITIES}")
    return int(any(counts[s] for s in SEVERITIES[: SEVERITIES.index(fail_on) + 1]))
