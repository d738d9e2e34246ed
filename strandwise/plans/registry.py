"""How a query and its checking SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapt import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Register a function of the canonical tables as query ``name``; ``sql`` is its check, over the tables in ``needs``."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql, *needs)
        return build

    return add


def r(x: str, digits: int = 6) -> str:
    """Rounding in checking SQL, as functions.records.rounded does it."""
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


#: Aligned blocks of the test reads by their kind of CIGAR, independent of a CIGAR parser: (read_start, ref_start, blen).
BLOCKS = """
blocks AS (
  SELECT idx, 0 AS read_start, pos AS ref_start, len AS blen FROM reads WHERE ck IN (0, 5)
  UNION ALL SELECT idx, 0, pos, len // 2 FROM reads WHERE ck IN (1, 2, 6, 7)
  UNION ALL SELECT idx, CASE WHEN ck = 2 THEN len // 2 + 3 ELSE len // 2 END, pos + len // 2 + CASE ck WHEN 1 THEN 5 WHEN 6 THEN 100 WHEN 7 THEN 2 ELSE 0 END, CASE WHEN ck = 2 THEN len - len // 2 - 3 ELSE len - len // 2 END FROM reads WHERE ck IN (1, 2, 6, 7)
  UNION ALL SELECT idx, 4, pos, len - 4 FROM reads WHERE ck = 3
  UNION ALL SELECT idx, 0, pos, len - 4 FROM reads WHERE ck = 4)"""

#: Lengths on the reference, clips and ends of the test reads.
ENDS = """
ends AS (SELECT *, pos + len - 1 + CASE ck WHEN 1 THEN 5 WHEN 2 THEN -3 WHEN 3 THEN -4 WHEN 4 THEN -4 WHEN 6 THEN 100 WHEN 7 THEN 2 ELSE 0 END AS stop,
  CASE ck WHEN 3 THEN 4 WHEN 5 THEN 5 ELSE 0 END AS lead, CASE ck WHEN 4 THEN 4 ELSE 0 END AS trail,
  len - CASE WHEN ck IN (3, 4) THEN 4 WHEN ck = 2 THEN 3 ELSE 0 END AS aligned FROM reads)"""
