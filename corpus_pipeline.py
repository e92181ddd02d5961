"""The corpus pipeline, registered as query pipeline; its stages stand in millrace.llm.pipeline."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
