"""A training-data pipeline; its stages and their SQL are in skein.llm.pipeline."""

from skein.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
