"""How many edges meet each edge, from nodes' lists of edge numbers: lists are dealt to groups of edges, unions are counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A group's lists hold about so many entries, each counted once for every edge of the group that it meets.
GROUP = 1 << 23
#: Ranges of edge numbers that are weighed.
BUCKETS = 4096


def group_starts(weights: dict[int, int], width: int) -> np.ndarray:
    """First edge number of each group. Neighbouring buckets of ``width`` numbers are joined up to ``GROUP``, heavier ones
    are cut into equal parts."""
    starts, held = [0], 0
    for b in sorted(weights):
        w, first = weights[b], b * width
        if held and held + w > GROUP:
            starts.append(first)
            held = 0
        parts = min(width, -(-w // GROUP))
        starts += [first + width * i // parts for i in range(1, parts)]
        held += w // parts
    return np.array(starts, np.int64)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, length of each list)."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the entries of lists that start and are as long as said."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def dealt_lists(starts: np.ndarray, hubs: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(g, ids): each list once for each group that it has edges of, hubs aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few lists at a time, as one may go to many groups
            for at in range(0, batch.num_rows, 1000):
                lists = batch.column("ids").slice(at, 1000)
                ids, sizes = _flat(lists)
                row = np.repeat(np.arange(len(sizes)), sizes)
                group = np.searchsorted(starts, ids, "right") - 1
                kept = ~np.isin(ids, hubs)
                pairs = np.unique(row[kept] * len(starts) + group[kept])
                for some in np.array_split(pairs, len(pairs) // 10_000 + 1):
                    yield pa.RecordBatch.from_arrays([pa.array((some % len(starts)).astype(np.int32)), lists.take(pa.array(some // len(starts)))], ["g", "ids"])

    return run


def counted_lists(starts: np.ndarray, hubs: list[int]) -> Callable[[pa.Table], pa.Table]:
    """(_id, n_neighbours) of one group's edges, hubs aside."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        parts = [_flat(c) for c in table.column("ids").chunks]
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = np.cumsum(sizes) - sizes
        named, local = np.unique(ids, return_inverse=True)
        own = (ids >= starts[g]) & ~np.isin(ids, hubs)
        if g + 1 < len(starts):
            own &= ids < starts[g + 1]
        at = np.flatnonzero(own)
        row = np.searchsorted(first, at, "right") - 1
        order = np.argsort(ids[at], kind="stable")
        edges, begins = np.unique(ids[at][order], return_index=True)
        marks, counts = np.zeros(len(named), bool), []
        for rows in np.split(row[order], begins[1:]):
            met = local[_gathered(first[rows], sizes[rows])]
            marks[met] = True
            counts.append(int(np.count_nonzero(marks)) - 1)
            marks[met] = False
        return pa.table({"_id": pa.array(edges.astype(np.int32)), "n_neighbours": pa.array(counts, pa.int64())})

    return run
