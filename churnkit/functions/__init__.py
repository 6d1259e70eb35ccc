"""Column-level building blocks (Catalyst expressions only)."""

from churnkit.functions.numeric import (  # noqa: F401
    clip, half_even, parse_number, sigmoid, to_int_trunc,
)
