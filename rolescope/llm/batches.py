"""Bounded slices of Arrow batches, so that a worker's memory follows the slice and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters of text that a worker turns into Python objects at once; a longer text stands alone.
SLICE_CHARS = 2_000_000


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(keys, texts) of a two-column stream, in slices of about ``limit`` characters."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 16
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts
