"""JSON stores and sinks: findings as JSON lines, baselines, marks, reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.sources.pointer import Pointer

VERSION = "v1:"
FINDING = ("rule_id", "severity", "path", "line", "field", "message", "evidence", "suggested_action", "source_rule", "target", "resolved_to", "collision_members", "fingerprint")
MARK = "id string, kind string, path string, anchor string, quote string, reason string, body string, at timestamp, resolved timestamp"


def json_line(*columns: str) -> Column:
    """One object, keys in the given order, null fields left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, in their order."""
    own = [c for c in FINDING if c in findings.columns]
    findings.select(json_line(*own).alias("value")).write.mode("overwrite").text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of an earlier run; a line that is no finding, or of another version, fails the read."""
    rows = spark.read.schema("rule_id string, fingerprint string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull() | F.col("fingerprint").isNull() | ~F.col("fingerprint").startswith(VERSION)
    return rows.select(F.when(bad, F.raise_error(F.lit("a line of the baseline is no finding of this version"))).otherwise(F.col("fingerprint")).alias("fingerprint"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """A store of marks; malformed files fail the read."""
    return spark.read.schema(MARK).option("mode", "FAILFAST").json(path)


class MarkStore:
    """Versions of a store of marks in directories behind a pointer."""

    def __init__(self, spark: SparkSession, root: str, limit: int = 5000):
        self.spark, self.root, self.limit = spark, root, limit
        self.pointer = Pointer(spark, f"{root}/current")

    def _version(self) -> int:
        return int(self.pointer.read() or 0)

    def read(self) -> DataFrame:
        n = self._version()
        return read_marks(self.spark, f"{self.root}/v{n:06d}") if n else self.spark.createDataFrame([], MARK)

    def write(self, marks: DataFrame) -> None:
        if (n := marks.count()) > self.limit:
            raise ValueError(f"a store holds {self.limit} marks at most, not {n}")
        version = self._version() + 1
        marks.write.mode("overwrite").json(f"{self.root}/v{version:06d}")
        self.pointer.write(str(version))


def sealed(payload: str, contract: bytes, read_contract) -> str:
    """The payload, unless the contract changed while it was made."""
    if hashlib.sha256(read_contract()).digest() != hashlib.sha256(contract).digest():
        raise PermissionError("the contract changed; nothing is given out")
    return payload


def report(totals: DataFrame, scoreboard: DataFrame, leverage: DataFrame, markdown: bool = False) -> str:
    """A triage report from the small aggregated tables (a row a domain; the five widest targets)."""
    t = totals.first()
    head = f"{t.errors} errors, {t.warns} warnings, {t.hidden} hidden ({t.planned} planned, {t.external} external)"
    rows = [(r.domain, r.errors, r.warns) for r in scoreboard.orderBy(F.desc("errors"), F.desc("warns"), "domain").collect()]
    top = [(r.target, r.n, ", ".join(r.domains)) for r in leverage.orderBy(F.desc("n"), "key").limit(5).collect()]
    if not markdown:
        return "\n".join([head, *(f"  {d}: {e} errors, {w} warnings" for d, e, w in rows), *(f"  {x} is named {n} times ({d})" for x, n, d in top)])
    table = ["| domain | errors | warnings |", "|-|-|-|", *(f"| {d} | {e} | {w} |" for d, e, w in rows)]
    return "\n".join([f"**{head}**", "", *table, "", *(f"- `{x}`: {n} ({d})" for x, n, d in top)])


def wire(row: dict) -> str:
    """One JSON object, for coverage and lookups."""
    return json.dumps(row, ensure_ascii=False, separators=(",", ":"))
