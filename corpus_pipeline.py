"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding. Its stages are in pressroom/llm/pipeline.py."""

from pressroom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
