from statepath.sources.driver_tables import (
    ACTION_CODES,
    SEGMENT_REWARDS,
    event_end_states,
    event_steps,
    order_steps,
)
from statepath.sources.tables import (
    Model,
    read_model,
    read_table,
    scan_end_states,
    scan_steps,
    write_model,
)

__all__ = [
    "ACTION_CODES",
    "Model",
    "SEGMENT_REWARDS",
    "event_end_states",
    "event_steps",
    "order_steps",
    "read_model",
    "read_table",
    "scan_end_states",
    "scan_steps",
    "write_model",
]
