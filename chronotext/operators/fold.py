"""Steps that depend on earlier decisions of their source: rows stream through a small state, in order, batch by batch.

Rows are dealt out by source and sorted within partitions (externally, if need be), so neither a source nor a partition is
ever held: what a step keeps is its state, and time grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Types that folds give back.
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def ordered_fold(rows: DataFrame, order: list[str], step: Callable[[], tuple[Callable, Callable]], schema: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, and the columns of ``schema``) from the rows of each source, or each part of one, in the order of ``order``.

    ``step`` makes the two functions of a part: one takes the values of a row but for those that name the part and gives the
    rows that it settles, the other gives what is left at the end.  The other columns of ``rows`` go to the first in their order.
    """
    key = ["source_id", *parts]
    fields = [c for c in rows.columns if c not in key]
    whole = [f"source_id {rows.schema['source_id'].dataType.simpleString()}", *schema.split(", ")]
    names, types = [f.split()[0] for f in whole], [ARROW[f.split()[1]] for f in whole]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)

    def run(batches):
        now = add = end = None
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in (*key, *fields)]
            for part, values in zip(zip(*columns[: len(key)], strict=True), zip(*columns[len(key) :], strict=True), strict=True):
                if end is None or part != now:
                    if end is not None:
                        out.extend((now[0], *x) for x in end())
                    now, (add, end) = part, step()
                out.extend((now[0], *x) for x in add(*values))
            yield batch(out)
        if end is not None:
            yield batch([(now[0], *x) for x in end()])

    return rows.select(*key, *fields).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, ", ".join(whole))
