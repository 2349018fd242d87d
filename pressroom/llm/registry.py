"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_decontamination
from .hard_negatives import op13_hard_negatives
from .line_dedup import op1_line_dedup
from .lm_scoring import OP10_SQL, op10_lm_scoring
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import op9_near_dedup
from .packing import op11_packing
from .pii import op6_pii
from .pipeline import run
from .quality_fm import op2_quality_fm
from .quality_rules import op5_quality_rules
from .sharding import op3_sharding
from .toxicity import op4_toxicity
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_fm, op3_sharding, op4_toxicity, op5_quality_rules, op6_pii, op7_mixing, op8_decontamination, op9_near_dedup, op10_lm_scoring, op11_packing, op12_whitening, op13_hard_negatives)} | {"pipeline": run}
ORACLES = {"op7_mixing": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_lm_scoring": OP10_SQL}
