"""Blocks of a cell's rows compared inside tasks, several cells to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import chunked_pairs

#: Rows that a group of blocks is aimed at, and the fewest groups.
GROUP_ROWS, GROUPS = 1 << 17, 64


def each_block(members: DataFrame, cell: str, home: str, size: int, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, salt: str, cells: int | None = None) -> DataFrame:
    """``compare(home rows, member rows)`` for every block of every cell with a home row and another row.

    Cells above ``size`` rows are cut in chunks, so that every pair of a home row and a member meets in exactly one block.
    Blocks are dealt by hash to groups of about ``GROUP_ROWS`` rows, as many as the rows counted need, so that a group stays
    in memory however large the table is. ``cells``: how many there are, if that is known; a small table of them is broadcast.
    """
    blocks, total = chunked_pairs(members, cell, home, size, F.xxhash64(F.col(salt), F.lit(17)), cells)
    columns = blocks.columns

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        done = [compare(part[part["_left"]], part[~part["_left"]]) for _, part in _blocks(frame, cell)]
        done = [d for d in done if len(d)]
        return pd.concat(done) if done else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    group = F.pmod(F.xxhash64(cell, "_i", "_j"), F.lit(max(GROUPS, -(-total // GROUP_ROWS))))
    return blocks.withColumn("_task", group).groupBy("_task").applyInPandas(lambda key, frame: run(key, frame[columns]), schema)


def _blocks(frame: pd.DataFrame, cell: str) -> Iterator[tuple[int, pd.DataFrame]]:
    keys = frame[[cell, "_i", "_j"]].to_numpy()
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield a, frame.iloc[order[a:b]]
