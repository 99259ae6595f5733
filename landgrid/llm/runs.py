"""Runs of equal keys in a sorted stream, in constant memory whatever the length of a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def head_of_runs(batches: Iterator[pa.RecordBatch], key: str, carry: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict[str, np.ndarray]]]:
    """For batches sorted by ``key``: each batch, whether a row begins a run, and per row the ``carry``
    columns of the first row of its run, also where the run began in an earlier batch."""
    last_key, last = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        begins[0] = last_key is None or keys[0] != last_key
        at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
        heads = {}
        for name in carry:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            heads[name] = np.where(at >= 0, values[np.maximum(at, 0)], last.get(name, values[0]))
        last_key, last = keys[-1], {name: heads[name][-1] for name in carry}
        yield batch, begins, heads


def shared_runs(batches: Iterator[pa.RecordBatch], key: str, owner: str) -> Iterator[pa.RecordBatch]:
    """For batches sorted by ``key`` and ``owner``: the rows of runs that have more than one owner, with the
    columns of the run's first row as ``head_*``. Only rows of one owner are ever held back."""
    held: list[pa.RecordBatch] = []
    last_key, head, open_ = None, None, False

    def with_head(batch: pa.RecordBatch, columns: list[np.ndarray]) -> pa.RecordBatch:
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*names, *(f"head_{n}" for n in names)])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            held, last_key = [], None
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        names = batch.schema.names
        keys, owners = values[names.index(key)], values[names.index(owner)]
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        joins = last_key is not None and keys[0] == last_key
        begins[0] = not joins
        run = np.cumsum(begins) - (0 if joins else 1)
        at = np.flatnonzero(begins)
        if joins:
            heads = [np.concatenate([[h], v[at]]).astype(v.dtype) for h, v in zip(head, values)]
        else:
            heads = [v[at] for v in values]
        first_owner = heads[names.index(owner)]
        several = np.zeros(len(first_owner), bool)
        several[run[owners != first_owner[run]]] = True
        if joins:
            several[0] |= open_
        tail = run == len(first_owner) - 1
        if not several[-1]:
            held = [batch.filter(pa.array(tail))]
        keep = several[run]
        if keep.any():
            yield with_head(batch.filter(pa.array(keep)), [h[run[keep]] for h in heads])
        last_key, head, open_ = keys[-1], [h[-1] for h in heads], bool(several[-1])
