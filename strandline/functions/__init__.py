"""Column helpers."""

from .scalars import all_finite, nested_close, numeric_stem, natural_key, q
from .statmaps import constant_stats, flatten_stats, shift_stats

__all__ = ["all_finite", "constant_stats", "flatten_stats", "natural_key", "nested_close", "numeric_stem", "q", "shift_stats"]
