"""Bounded heaps of the best rows of many queries: kept in each task, merged between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tasks whose heaps meet in the first of two merges, so no group of the second one has a row for each task and place.
FAN_IN = 64
LEAST = np.iinfo(np.int64).min


class Heaps:
    """The ``k`` best (score, id) of each of ``m`` queries: highest score first, then smallest id, missing ids last.

    Takes room for m * k rows whatever is offered.
    """

    def __init__(self, m: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((m, k), np.int64), np.zeros((m, k), np.int64)
        self.missing, self.empty = np.zeros((m, k), bool), np.ones((m, k), bool)
        #: The score below which nothing can enter a heap any more.
        self.floor = np.full(m, LEAST)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Parallel arrays; those of a query may come in any order."""
        if not len(query):
            return
        touched, at = np.unique(query, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        score, ids, missing = (np.concatenate([new, old[touched].ravel()]) for new, old in ((score, self.score), (ids, self.id), (missing, self.missing)))
        empty = np.concatenate([np.zeros(len(query), bool), self.empty[touched].ravel()])
        order = np.lexsort((ids, missing, -score, empty, at))
        starts = np.searchsorted(at[order], np.arange(len(touched)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched], self.missing[touched], self.empty[touched] = score[best], ids[best], missing[best], empty[best]
        self.floor[touched] = np.where(self.empty[touched, -1], LEAST, self.score[touched, -1])

    def rows(self, names: list[str]) -> pa.RecordBatch:
        """(query, score, id) of all that is held, with columns of these names."""
        q, place = np.nonzero(~self.empty)
        ids = pa.array(self.id[q, place], mask=self.missing[q, place])
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(self.score[q, place]), ids], names=names)


def merged(heaps: DataFrame, query: str, score: str, row: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query, with ``rank`` from 1, of ``heaps``, of which a query has at most ``k`` rows in each partition.

    The heaps of FAN_IN tasks are merged first, then what is left of them.  ``rank`` must be no column of ``heaps``.
    """
    order = [F.desc(score), F.asc_nulls_last(row)]
    some = heaps.withColumn("_part", F.spark_partition_id())
    for part in ([F.floor(F.col("_part") / FAN_IN)], []):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(query, *part).orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("_part")
