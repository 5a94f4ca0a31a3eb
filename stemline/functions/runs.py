"""The rows of a partition, in runs of bounded length or of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def chunks(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.Table]:
    """The rows of a partition in runs of bounded length."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, bound - n)
            held.append(take)
            n += take.num_rows
            b = b.slice(take.num_rows)
            if n == bound:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[pa.Table]:
    """The rows of a partition, sorted by key, in runs that hold whole groups."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        rest = t
        if t.num_rows >= least:
            k = t.column(key).to_numpy()
            upto = int(np.searchsorted(k, k[-1]))
            if upto:
                yield t.slice(0, upto).combine_chunks()
                rest = t.slice(upto)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
