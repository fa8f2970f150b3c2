"""What several operators share: characters, tables, rows in and out of Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfgauge.sources.shared_tables import store

#: The white space that separates words: space, and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole(text: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def numbered(df: DataFrame, name: str, number: str = "row") -> DataFrame:
    """``df`` as a written table whose rows have a number of their own.

    The number holds after any retry, since it is read back and never made again.
    """
    return store(df.withColumn(number, F.monotonically_increasing_id()), name)


def from_files(df: DataFrame) -> bool:
    """Whether the rows of ``df`` can tell the file they were read from."""
    try:
        df.metadataColumn("_metadata")
    except AnalysisException:
        return False
    return True


def in_order(df: DataFrame, *columns: Column, files: bool = False) -> DataFrame:
    """``columns`` of ``df`` with ``file``, ``run`` and ``task``, which rise in the order of its rows.

    With ``files`` that is the order in which the files were written that ``df`` reads: by
    part number, then by place in the file, however Spark deals the files to tasks and
    whatever rows and columns are left out since. Otherwise it is that of the partitions.
    Rows with equal values of the three are in one partition, in the order they come.
    """
    task = F.spark_partition_id().cast("long").alias("task")
    if not files:
        return df.select(*columns, F.lit("").alias("file"), F.lit(0).cast("long").alias("run"), task)
    place = df.metadataColumn("_metadata")
    part = F.lpad(F.regexp_extract(place["file_name"], r"^part-(\d+)", 1), 20, "0")
    start = place["file_block_start"].alias("run")
    return df.select(*columns, F.concat(part, place["file_path"]).alias("file"), start, task)


def pieces(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 256) -> Iterator[list[list]]:
    """Columns as Python lists, few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(name)).to_pylist() for name in names]


def map_rows(
    df: DataFrame, schema: str, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]
) -> DataFrame:
    """``mapInArrow`` by a function from a partition's batches to row tuples of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _rows_out(rows_of(batches), arrow), schema)


def _rows_out(
    rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, bound: int = 1 << 23
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, or about ``bound`` characters, from tuples."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(value) for value in row if isinstance(value, (str, bytes)))
        if len(held) >= size or weight >= bound:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
