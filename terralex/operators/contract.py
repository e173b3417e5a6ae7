"""Union of sets over Arrow batches of edges: connected components of what one task holds at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges that a task holds at a time.
CHUNK = 1 << 20


def _ranks(values: pa.Array) -> np.ndarray:
    """Dense ranks of the values in Spark's order; nulls come first."""
    if pa.types.is_struct(values.type):
        # fields one after another, each pair of ranks made dense again
        ranks = values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(values.type.num_fields):
            own = _ranks(pc.struct_field(values, [i]))
            ranks = np.unique(ranks * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
        return ranks
    if pa.types.is_floating(values.type):
        values = pc.add(values, pa.scalar(0.0, values.type))  # no negative zero
    held = values.dictionary_encode()
    order = pc.array_sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    codes = pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(codes < 0, 0, place[codes]) if len(order) else np.zeros(len(values), np.int64)


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of 0 to n - 1 over the edges (a, b): labels sink along edges and are
    shortened, in a number of rounds that grows with the logarithm of n."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
        open_ = label[a] != label[b]
        a, b = label[a[open_]], label[b[open_]]
    return label


def _stars(table: pa.Table) -> pa.RecordBatch:
    """Edges from each node of a chunk to the least one that it reaches there."""
    kind = table.schema.field("a").type
    ends = [table.column(c).combine_chunks() for c in ("a", "b")]
    nodes = pa.concat_arrays([e if isinstance(e, pa.Array) else pa.concat_arrays(e.chunks) for e in ends])
    known, first, codes = np.unique(_ranks(nodes), return_index=True, return_inverse=True)
    m = len(codes) // 2
    root = least_reached(codes[:m], codes[m:], len(known))
    moved = np.flatnonzero(root != np.arange(len(known)))
    take = lambda at: nodes.take(pa.array(first[at])).cast(kind)
    return pa.RecordBatch.from_arrays([take(moved), take(root[moved])], names=["a", "b"])


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: edges (a, b) in, stars around the least nodes of every ``CHUNK`` edges out. What hangs together
    does so still, and no node is named more than once a chunk as an edge's first."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, CHUNK - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == CHUNK:
                yield _stars(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield _stars(pa.Table.from_batches(held))
