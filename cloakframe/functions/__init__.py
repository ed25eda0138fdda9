from .numeric import (
    class_id,
    euclidean_norm,
    hundredths,
    likeness_cap,
    order_key,
    round_half_up,
    tie_key,
)

__all__ = [
    "class_id",
    "euclidean_norm",
    "hundredths",
    "likeness_cap",
    "order_key",
    "round_half_up",
    "tie_key",
]
