"""Read, status, metric, layout and verification operators over element DataFrames."""

from unionlog.operators.layout import generation_layout  # noqa: F401
from unionlog.operators.metrics import claimed_slots, dedup_ratio, nearest_rank  # noqa: F401
from unionlog.operators.sets import absent, contains, distinct_union, emit_status, insert_status, known  # noqa: F401
from unionlog.operators.verify import chain_gaps, monotone_losses, union_oracle  # noqa: F401
