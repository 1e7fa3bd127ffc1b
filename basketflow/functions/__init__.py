from basketflow.functions.activity import is_kind, percent, reads, tally, tumbling
from basketflow.functions.money import (
    cents,
    exact_mean,
    exact_sum,
    merged_parts,
    money_parts,
    parts_mean,
    parts_sum,
)

__all__ = [
    "cents", "exact_mean", "exact_sum", "is_kind", "merged_parts", "money_parts", "parts_mean",
    "parts_sum", "percent", "reads", "tally", "tumbling",
]
