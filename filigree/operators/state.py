"""Tables between the steps of iterative operators: written into the shared folder, and deleted when no step needs them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filigree.operators.graph import shared_folder


#: Rows that a task writes at least, where a bound of them is known.
TASK_ROWS = 250_000


def written(df: DataFrame, name: str, where: Column | None = None, rows: int | None = None, by: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read again: its plan is cut, and it survives lost executors. counted() tells the
    number of its rows, or of those where a condition holds, which is counted as they are written. A bound of its rows,
    where one is known, keeps small tables from being dealt over as many tasks as large ones. Those that read some values of the column by alone
    read only these rows' files."""
    spark, seen = df.sparkSession, Observation()
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    df = df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("n"))
    path = f"{shared_folder(spark.sparkContext)}/filigree-steps/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at, out._counted = path, seen.get["n"]
    return out


def counted(table: DataFrame) -> int:
    """What written() has counted."""
    return table._counted


def reading(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads a table that written() may have returned: discard() of df deletes that."""
    if at := getattr(table, "_written_at", None):
        df._written_at = at
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() returned, or that those of reading() read; others, and None, are left alone."""
    for table in tables:
        if at := getattr(table, "_written_at", None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of a growing list that are read as they are; more become one.
TABLES = 16


def gathered(tables: list[DataFrame], new: DataFrame, name: str, rows: int | None = None) -> list[DataFrame]:
    """The list with new, its tables written as one where they are many: plans stay short however many steps there are."""
    tables = [*tables, new]
    if len(tables) <= TABLES:
        return tables
    whole = written(reduce(DataFrame.unionByName, tables), name, rows=rows)
    discard(*tables)
    return [whole]
