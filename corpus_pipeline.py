"""The corpus pipeline of murmuration.llm, at the place where it is looked for."""

from murmuration.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
