"""State machines over the ordered rows of a key, where one key may fill many tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .places import shared_checkpoints

State = Any  # what JSON can hold
Step = Callable[..., tuple[State, tuple]]


def _walk(batches: Iterator[pa.RecordBatch], key: str, reads: list[str], start: State, entries: dict[int, str], step: Step) -> Iterator[tuple[pa.RecordBatch, list[tuple], int, State]]:
    """Each batch with its rows' outputs, its range and the state after it; a range's first key begins with the range's entry."""
    part, last, state = None, None, start
    for b in batches:
        outputs = []
        for p, k, *values in zip(b.column("_part").to_pylist(), b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in reads)):
            if p != part:
                part, last, state = p, k, json.loads(entries[p]) if p in entries else start
            elif k != last:
                last, state = k, start
            state, out = step(state, *values)
            outputs.append(out)
        yield b, outputs, part, state


def ordered_scan(rows: DataFrame, key: str, order: list[str], reads: list[str], start: State, step: Step, outputs: str) -> DataFrame:
    """rows with the outputs (a DDL string) of `step(state, *reads) -> (state, outputs)`, walked by each key's `order` from `start`.

    Rows are range-sorted by key and order, so a long key is cut into ranges. Ranges whose last key goes on in the next
    one are run for the state they hand over: at first all at once, each from `start` or the state guessed for it, then
    only those whose entry turned out to be another. A run is kept by its entry, so a state that no longer depends on
    the entry ends the chain at once; a machine that never forgets needs a round for each range of its key. Results
    equal one walk over the key. The driver holds a few states a range. A null key is a key; ties in `order` keep
    the place they were written with; an empty table gives an empty one."""
    shared_checkpoints(rows.sparkSession)
    added = T._parse_datatype_string(outputs).fields
    # a second sort could break ties in another way, so the sorted ranges are written once
    held = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    ends = held.groupBy("_part").agg(F.min(F.struct(key)).alias("lo"), F.max(F.struct(key)).alias("hi")).orderBy("_part").collect()
    follows = {b["_part"] for a, b in pairwise(ends) if a["hi"] == b["lo"]}
    hands_on = {a["_part"] for a, b in pairwise(ends) if a["hi"] == b["lo"]}
    fresh = json.dumps(start)

    def exits(entries: dict[int, str]) -> dict[int, str]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            final = {}
            for _, _, part, state in _walk(batches, key, reads, start, entries, step):
                if part is not None:
                    final[part] = json.dumps(state)
            yield pa.RecordBatch.from_arrays([pa.array(list(final), pa.int32()), pa.array(list(final.values()), pa.string())], ["part", "state"])

        asked = held.where(F.col("_part").isin(list(entries))).select("_part", *dict.fromkeys([key, *reads]))
        return {r.part: r.state for r in asked.mapInArrow(run, "part int, state string").collect()}

    known: dict[tuple[int, str], str] = {}
    guess: dict[int, str] = {}
    while True:
        entries, todo, carried = {}, {}, fresh
        for e in ends:
            p = e["_part"]
            entries[p] = carried if p in follows else fresh
            if p in hands_on:
                own = entries[p] if e["lo"] == e["hi"] else fresh
                if (p, own) not in known:
                    todo[p] = own
                carried = known.get((p, own), guess.get(p, fresh))
        if not todo:
            break
        for p, state in exits(todo).items():
            known[p, todo[p]] = guess[p] = state
    entries = {p: s for p, s in entries.items() if s != fresh}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b, out, _, _ in _walk(batches, key, reads, start, entries, step):
            columns = zip(*out) if out else [()] * len(added)
            made = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *[f.name for f in added]])

    return held.mapInArrow(emit, T.StructType([*held.schema.fields, *added])).drop("_part")
