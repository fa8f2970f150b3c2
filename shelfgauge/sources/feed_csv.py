"""Reading, checking, cleaning and writing supplier feeds."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfgauge.functions import strip
from shelfgauge.schema import MODEL_COLUMNS, NA_TOKENS, REQUIRED_COLUMNS
from shelfgauge.sources.shared_tables import drop_folder, move_only_part
from shelfgauge.sources.split_csv import records

#: Column for the text of records that do not fit the header.
RECORD = "__record"

#: CSV dialect of a feed: quotes are doubled, not backslash-escaped. A quoted
#: cell may hold line breaks, so a file is one unit of work.
READ_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "mode": "PERMISSIVE",
    "encoding": "UTF-8",
    # every file's header is compared with the first one's
    "enforceSchema": "false",
    "columnNameOfCorruptRecord": RECORD,
    # with it, Spark does not see how many cells a record has
    "columnPruning": "false",
}

#: Blank and null cells are written as nothing between two commas.
WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def normalise_header(name: str, position: int = -1) -> str:
    """Trimmed, lower-case, blanks as underscores; a nameless column gets a numbered name."""
    if name == f"_c{position}":
        name = f"Unnamed: {position}"
    return name.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    names = [normalise_header(name, at) for at, name in enumerate(df.columns)]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"Repeated columns: {', '.join(repeated)}")
    return df.toDF(*names)


def column_status(df: DataFrame) -> dict[str, bool]:
    """Which contract columns the frame has. Looks at the schema only."""
    return {name: name in df.columns for name in REQUIRED_COLUMNS}


def require_columns(df: DataFrame) -> DataFrame:
    missing = [name for name, found in column_status(df).items() if not found]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def _clean_cell(df: DataFrame, name: str) -> Column:
    cell = F.col(f"`{name}`")
    kind = df.schema[name].dataType.typeName()
    if kind in ("float", "double"):
        cell = F.when(~F.isnan(cell), cell)
    if kind != "string":
        cell = cell.cast("string")
    # The token test sees the raw cell: " NA " is text, "NA" is not.
    return strip(F.when(~cell.isin(*NA_TOKENS), cell)).alias(name)


def clean_feed(df: DataFrame) -> DataFrame:
    """Null the missing-value tokens, then trim every cell; one projection over all columns."""
    return df.select([_clean_cell(df, name) for name in df.columns])


def conform(df: DataFrame) -> DataFrame:
    """Header names, required columns and cells of any frame, as :func:`read_feed` leaves them."""
    return clean_feed(require_columns(normalise_headers(df)))


def _header(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[str | None]:
    """The cells of one file's first record; null for a nameless column."""
    row = spark.read.options(**{**options, "header": "false"}).csv(path).first()
    if row is None:
        raise ValueError(f"No header in {path}")
    cells = list(row)
    if cells[0]:
        cells[0] = cells[0].removeprefix("\ufeff") or None
    return cells


def _compare_headers(spark: SparkSession, path: str | list[str]) -> None:
    """Refuse files whose first lines differ; reads the first block of each file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    firsts = lines.where("block = 0").groupBy("file").agg(F.first("value").alias("header"))
    headers = firsts.select(F.regexp_replace("header", "^\ufeff|\r$", "").alias("header"))
    if len(found := headers.distinct().limit(2).collect()) > 1:
        raise ValueError(f"Files with different headers: {found[0].header!r}, {found[1].header!r}")


def _cells(record: Column) -> Column:
    """How many cells a CSV record has: commas outside of quoted cells, and one."""
    bare = F.regexp_replace(record, r'(^|,)"(?:[^"]|"")*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _surplus(raw: DataFrame) -> Column:
    """Whether a record that does not fit the header has more cells than it.

    Spark hands over the text of records with fewer or more cells; fewer are read as
    nulls. It does so only to queries that look at a cell as well, as the last test does.
    """
    first, n_columns = F.col(f"`{raw.columns[0]}`"), len(raw.columns) - 1
    record = F.col(RECORD)
    return (_cells(record) > n_columns) & (F.length(F.concat_ws("", first, record)) > 0)


def refuse_surplus(raw: DataFrame) -> DataFrame:
    """``raw`` without its record column; the run stops at a record with surplus cells."""
    message = F.concat(F.lit("More cells than the header has: "), F.substring(RECORD, 1, 300))
    stop = F.when(_surplus(raw), F.raise_error(message).cast("boolean"))
    return raw.where(F.coalesce(stop, F.lit(True))).drop(RECORD)


def _raw_feed(spark: SparkSession, path: str | list[str], line_breaks_in_cells: bool) -> DataFrame:
    """The cells as they are, and the text of records that do not fit the header."""
    options = {**READ_OPTIONS, "multiLine": str(line_breaks_in_cells).lower()}
    header = _header(spark, path, options)
    named = [name for name in header if name]
    if len({name.lower() for name in named}) < len(header):
        # Spark cannot tell nameless or repeated columns apart, so it does not compare these.
        _compare_headers(spark, path)
        options["enforceSchema"] = "true"
    fields = [T.StructField(f"c{at}" if options["enforceSchema"] == "true" else name, T.StringType()) for at, name in enumerate(header)]
    schema = T.StructType([*fields, T.StructField(RECORD, T.StringType())])
    raw = spark.read.options(**options).schema(schema).csv(path)
    names = [name or f"_c{at}" for at, name in enumerate(header)]
    seen = [name.lower() for name in names]
    names = [f"{n}{at}" if seen.count(n.lower()) > 1 else n for at, n in enumerate(names)]
    return raw.toDF(*names, RECORD)


def _split_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Like :func:`_raw_feed`, with large files read by many tasks whatever their cells hold."""
    found = records(spark, path)
    heads = found.where("head").select("record").distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"No header in {path}")
    if len(heads) > 1:
        raise ValueError(f"Files with different headers: {heads[0].record!r}, {heads[1].record!r}")
    header = next(csv.reader(io.StringIO(heads[0].record, newline="")))
    names = [name or f"_c{at}" for at, name in enumerate(header)]
    cells = ", ".join(f"c{at} string" for at in range(len(names)))
    parsed = F.from_csv("record", f"{cells}, {RECORD} string", {**READ_OPTIONS, "header": "false"})
    raw = found.where("not head").select(parsed.alias("cells")).select("cells.*")
    seen = [name.lower() for name in names]
    names = [f"{n}{at}" if seen.count(n.lower()) > 1 else n for at, n in enumerate(names)]
    return raw.toDF(*names, RECORD)


def read_feed(
    spark: SparkSession, path: str | list[str], *, line_breaks_in_cells: bool = True, split: bool = False
) -> DataFrame:
    """Read CSV feeds as text.

    Files read together must have the same header; a file that differs stops the run
    instead of being read into the wrong columns. Read such files apart and union
    them by name. A record with more cells than the header stops the run, too, since its
    cells may be shifted (see :func:`surplus_rows`); missing cells at its end are null.

    ``line_breaks_in_cells=False`` lets Spark split large files between tasks. Use it
    for feeds known to keep each product on one line; otherwise a file is one task,
    and the work is spread over the files.

    ``split=True`` reads large files with many tasks although cells hold line breaks,
    which then stay as they were. It reads the files twice and writes the records once,
    at the call (see :mod:`shelfgauge.sources.split_csv`).
    """
    raw = _split_feed(spark, path) if split else _raw_feed(spark, path, line_breaks_in_cells)
    return conform(refuse_surplus(raw))


def surplus_rows(
    spark: SparkSession, path: str | list[str], *, line_breaks_in_cells: bool = True
) -> DataFrame:
    """``file, record`` of the records that make :func:`read_feed` stop."""
    raw = _raw_feed(spark, path, line_breaks_in_cells)
    return raw.where(_surplus(raw)).select(
        F.input_file_name().alias("file"), F.col(RECORD).alias("record")
    )


def export_columns(df: DataFrame) -> DataFrame:
    """The feed's own columns first, the model columns after them in contract order."""
    own = [name for name in df.columns if name not in MODEL_COLUMNS]
    added = [name for name in MODEL_COLUMNS if name in df.columns]
    return df.select(*[f"`{name}`" for name in own + added])


def _lines(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    """``line`` and what sorts it: the header first, then rows by ``order``, ties by their text."""
    df = export_columns(df)
    header = io.StringIO()
    csv.writer(header, lineterminator="").writerow(df.columns)
    keys = [(F.col(f"`{key}`") if isinstance(key, str) else key).alias(f"k{at}") for at, key in enumerate(order)]
    text = F.to_csv(F.struct(*[f"`{name}`" for name in df.columns]), WRITE_OPTIONS).alias("line")
    body = df.select(F.lit(1).alias("part"), *keys, text)
    nothing = [F.lit(None).cast(body.schema[f"k{at}"].dataType).alias(f"k{at}") for at in range(len(keys))]
    first = df.sparkSession.range(1).select(F.lit(0).alias("part"), *nothing, F.lit(header.getvalue()).alias("line"))
    return first.unionByName(body), [F.col("part"), *[F.col(f"k{at}").asc_nulls_last() for at in range(len(keys))], F.col("line")]


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column] = ("product_id",), *, mode: str = "errorifexists") -> None:
    """Write one CSV in order as part files: put end to end by name, they are the file.

    Only the first part has a header. ``order`` has column names, nulls last. Spark's own
    commit publishes all parts at the end; a failed job leaves none.
    """
    lines, by = _lines(df, order)
    ordered = lines.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.select("line").write.mode(mode).text(path)


def write_file(df: DataFrame, path: str, order: Sequence[str | Column] = ("product_id",)) -> None:
    """Write one CSV file in order, for feeds that one task can write.

    The file appears under its name when it is complete; an existing one is not replaced.
    """
    spark = df.sparkSession
    lines, by = _lines(df, order)
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        lines.repartition(1).sortWithinPartitions(*by).select("line").write.text(staged)
        move_only_part(spark, staged, path)
    finally:
        drop_folder(spark, staged)


def write_feed(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write CSV part files, one header each, in export order."""
    export_columns(df).write.mode(mode).options(**WRITE_OPTIONS).csv(path)
