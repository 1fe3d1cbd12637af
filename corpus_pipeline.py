"""The corpus pipeline; it is written in barloom.llm.pipeline."""

from barloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
