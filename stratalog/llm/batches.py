"""What the operators that run Python over Arrow batches share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def tidy(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same batches; after each, Arrow's unused memory goes back to the system, as Python workers outlive their tasks."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
