"""Arrow batches of a sorted partition, cut at group borders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def borders(*keys: np.ndarray) -> np.ndarray:
    """Positions where any key changes, with 0 and the length at the ends."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def whole_groups(batches: Iterator[pd.DataFrame], columns: Sequence[str],
                 keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns as arrays holding complete groups only. Rows of a group are adjacent; the group at
    the end of a batch is held back until the next batch shows where it ends."""
    held: dict[str, np.ndarray] | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        cols = {k: pdf[k].to_numpy() for k in columns}
        if held is not None:
            cols = {k: np.concatenate([held[k], cols[k]]) for k in columns}
        last = int(borders(*(cols[k] for k in keys))[-2])
        held = {k: cols[k][last:] for k in columns}
        if last:
            yield {k: cols[k][:last] for k in columns}
    if held is not None:
        yield held
