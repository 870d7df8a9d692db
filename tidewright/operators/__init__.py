"""Event-time operators on DataFrames."""

from tidewright.operators.asof import asof_join, snapshot
from tidewright.operators.offsets import with_offsets
from tidewright.operators.top import top_changes
from tidewright.operators.watermark import drop_late

__all__ = ["asof_join", "drop_late", "snapshot", "top_changes", "with_offsets"]
