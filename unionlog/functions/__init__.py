"""Column expressions over elements, records and segment names."""

from unionlog.functions.elements import (  # noqa: F401
    FNV_BASIS,
    FNV_PRIME,
    align_up,
    element_of,
    fingerprint,
    home_slot,
    oversize,
    record_bytes,
    segment_file_bytes,
    unsigned,
    used_fingerprint,
)
from unionlog.functions.names import parse_segment_name, shard_suffix, valid_app_id, valid_app_id_value  # noqa: F401
