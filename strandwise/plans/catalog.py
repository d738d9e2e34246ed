"""All queries of the engine: importing the query modules registers them."""

from __future__ import annotations

from . import q_annotation, q_duplicates, q_intervals, q_pileup, q_qc, q_records, q_rewrite, q_streaming, q_summaries, q_variants  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
