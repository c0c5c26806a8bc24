"""Arrow batches in slices, as the core has them."""

from __future__ import annotations

from tessella.functions.batches import SLICE_BYTES, SLICE_ROWS, sliced

__all__ = ["SLICE_BYTES", "SLICE_ROWS", "sliced"]
