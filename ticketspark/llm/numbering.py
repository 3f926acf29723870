"""Places of rows in an order, without a window over a whole table or a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import keep


def _nth(group: str):
    """Number the rows of each group within a sorted partition from 0."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(group).to_pandas().to_numpy()
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            if values[0] == last:
                nth[: first[1] if len(first) > 1 else n] += seen
            last, seen = values[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(nth.astype(np.int64))], [*batch.schema.names, "__part", "__nth"])

    return number


def placed(df: DataFrame, group: str, order: list[Column], tag: str = "placed") -> DataFrame:
    """df with __place, each row's place from 0 within its group by order, and __of, the group's rows.

    group has no nulls. Rows are dealt by ranges of group and order, each range
    numbers its own, and the sizes of a group's earlier ranges are added, so
    neither a large group nor the table passes through one task. order should
    part all rows but those that are the same throughout.
    """
    by = [F.col(group), *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__nth", LongType())])
    rows = keep(ranged.mapInArrow(_nth(group), schema), tag)
    sizes = rows.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    # a row for each group and range
    whole = Window.partitionBy(group)
    starts = sizes.select(group, "__part", (F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("__of"))
    return rows.join(starts, [group, "__part"]).withColumn("__place", F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")
