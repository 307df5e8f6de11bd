"""Typed CSV load of the six star tables into Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.operators.profile import row_counts
from tillscope.sources.published import current, new_folder, publish
from tillscope.sources.schema import TABLES
from tillscope.sources.star import Star, fill_defaults, read_star

# a quote inside a quoted cell is written twice; a backslash is a plain character
_QUOTING = {"quote": '"', "escape": '"'}
_DATES = "yyyy-MM-dd"
REJECTS = "rejects"
_REJECTED = "table_name STRING, file STRING, line BIGINT, column_name STRING, cell STRING"


def read_csv_table(
    spark: SparkSession,
    path: str,
    table: str,
    multi_line: bool = False,
    fill_nulls: bool = False,
) -> DataFrame:
    """Read one CSV with its declared types; nothing is inferred.

    The header has to name the columns in the declared order; one with a declared
    default may be left out and then holds the default. An empty cell stays NULL, as
    ``not_null_check`` reports it, unless ``fill_nulls`` asks for defaults there too.
    A cell that does not fit its type fails the read. Decimals of excess scale are
    rounded half up. Booleans may be written 1/0 or true/false: the CSV reader would
    turn 1/0 into NULL, so they are read as text and cast.

    ``multi_line`` lets quoted cells hold line breaks. A file is then read by one
    task, so it is off unless asked for.
    """
    spec = TABLES[table]
    names = spark.read.csv(path, header=True, multiLine=multi_line, **_QUOTING).columns
    present = [f for f in spec.struct if f.name in names or f.name not in spec.defaults]
    on_file = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.dataType == T.BooleanType() else f.dataType)
            for f in present
        ]
    )
    raw = spark.read.csv(
        path,
        schema=on_file,
        header=True,
        enforceSchema=False,
        mode="FAILFAST",
        dateFormat=_DATES,
        multiLine=multi_line,
        **_QUOTING,
    )
    given = {f.name for f in present}
    typed = raw.select(
        *(
            (F.col(f.name) if f.name in given else F.expr(spec.defaults[f.name]))
            .cast(f.dataType)
            .alias(f.name)
            for f in spec.struct
        )
    )
    return fill_defaults(typed, table) if fill_nulls else typed


def _as_declared(cell: Column, kind: T.DataType) -> Column:
    """The cell under its type, null where it does not fit."""
    if kind == T.DateType():
        # the cast alone would take a date without leading zeros
        return F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), cell.try_cast(kind))
    return cell.try_cast(kind)


def _lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Every line of the files, cut up, with file, block of the file, and place within the scan.

    A line without a quote is cut at its commas into ``_plain``; only one with a quote needs
    the CSV reader, slow on single lines, for ``_quoted``. Who reads no cells cuts none.
    """
    fields = ", ".join(f"`{name}` STRING" for name in names)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_whole", **_QUOTING}
    line = F.col("value")
    quote = F.contains(line, F.lit('"'))
    place = F.monotonically_increasing_id()
    # always so; as a place is no function of the row, Spark cuts once and not per condition
    placed = place >= 0
    return spark.read.text(path).select(
        line.alias("_line"),
        F.when(~quote & placed, F.split(line, ",", -1)).alias("_plain"),
        F.when(quote, F.from_csv(line, f"{fields}, _whole STRING", options)).alias("_quoted"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        place.alias("_place"),
    )


def _cell(at: int, name: str) -> Column:
    """A cell of ``_lines`` as text, null where empty."""
    plain = F.nullif(F.get("_plain", F.lit(at)), F.lit(""))
    return F.coalesce(plain, F.col(f"_quoted.`{name}`"))


def _odd(names: list[str]) -> Column:
    """Whether a line of ``_lines`` has too few or too many cells."""
    return F.coalesce(F.size("_plain") != len(names), F.col("_quoted._whole").isNotNull())


def _line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of ``lines`` with ``line``, their number in the file from 1.

    A scan numbers the lines of a block without a gap, so a number is the place within the
    block and the lines of earlier blocks: one row per block, however long the file.
    """
    blocks = lines.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_held"), F.min("_place").alias("_first")
    )
    earlier = (
        Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
    number = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return rows.join(blocks, ["_file", "_block"]).withColumn("line", number)


def split_csv_table(
    spark: SparkSession, path: str, table: str, fill_nulls: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of one CSV that fit their types, and the cells that do not.

    Rows are as ``read_csv_table`` gives them. Rejects have table_name, file, line (of the
    file, the header is line 1), column_name and cell; a row with several bad cells has several
    and is not loaded. A line with too few or too many cells is rejected whole, under a null
    column. Cells cannot hold line breaks here.
    """
    spec = TABLES[table]
    names = spark.read.csv(path, header=True, **_QUOTING).columns
    given = [f for f in spec.struct if f.name in names or f.name not in spec.defaults]
    if names != [f.name for f in given]:
        raise ValueError(f"{path} has the columns {names}, not {[f.name for f in given]}")
    lines = _lines(spark, path, names)
    header = (F.col("_block") == 0) & (F.col("_line") == ",".join(names))
    parsed = lines.where((F.length("_line") > 0) & ~header)
    at = {name: i for i, name in enumerate(names)}

    def cell(f: T.StructField) -> Column:
        return _cell(at[f.name], f.name)

    odd = _odd(names)
    bad = [cell(f).isNotNull() & _as_declared(cell(f), f.dataType).isNull() for f in given]
    fits = ~odd & ~reduce(Column.__or__, bad)
    typed = parsed.where(fits).select(
        *(
            (
                _as_declared(cell(f), f.dataType)
                if f.name in at
                else F.expr(spec.defaults[f.name]).cast(f.dataType)
            ).alias(f.name)
            for f in spec.struct
        )
    )
    found = [
        F.when(odd, F.struct(F.lit(None).cast("string").alias("column_name"), F.col("_line").alias("cell"))),
        *(
            F.when(~odd & test, F.struct(F.lit(f.name).alias("column_name"), cell(f).alias("cell")))
            for f, test in zip(given, bad, strict=True)
        ),
    ]
    rejects = _line_numbers(parsed.where(~fits), lines).select(
        F.lit(table).alias("table_name"),
        F.col("_file").alias("file"),
        "line",
        F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())),
    )
    return fill_defaults(typed, table) if fill_nulls else typed, rejects


def load_tables(
    spark: SparkSession,
    csv_root: str,
    root: str,
    multi_line: bool = False,
    fill_nulls: bool = False,
    set_aside: bool = False,
) -> Star:
    """Rebuild every table under ``root`` from ``csv_root/<table>.csv``, all or nothing.

    The tables are written to a new folder and published together at the end. A load that
    fails leaves the star that was there as it was. Cells that do not fit their type fail it,
    or with ``set_aside`` go to the published table of rejects (see ``read_rejects``), with
    their rows left out.
    """
    if multi_line and set_aside:
        raise ValueError("lines are not numbered where cells hold line breaks")
    folder = new_folder()
    rejected = None
    for table in TABLES:
        path = f"{csv_root}/{table}.csv"
        if set_aside:
            frame, rejects = split_csv_table(spark, path, table, fill_nulls)
            rejected = rejects if rejected is None else rejected.unionByName(rejects)
        else:
            frame = read_csv_table(spark, path, table, multi_line, fill_nulls)
        frame.write.parquet(f"{root}/{folder}/{table}")
    parts: dict[str, str | None] = {table: f"{folder}/{table}" for table in TABLES}
    parts[REJECTS] = None
    if rejected is not None:
        rejected.write.parquet(f"{root}/{folder}/{REJECTS}")
        parts[REJECTS] = f"{folder}/{REJECTS}"
    publish(spark, root, parts)
    return read_star(spark, root)


def read_rejects(spark: SparkSession, root: str) -> DataFrame | None:
    """Cells that the published load set aside; None where it set none aside by order."""
    folder = current(spark, root).get(REJECTS)
    return None if folder is None else spark.read.schema(_REJECTED).parquet(folder)


def reject_report(spark: SparkSession, csv_root: str, root: str) -> DataFrame:
    """Load everything, bad cells aside, and count per table what came in and what did not."""
    star = load_tables(spark, csv_root, root, set_aside=True)
    rejects = read_rejects(spark, root).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("bad_cells"),
        F.count_distinct("file", "line").alias("rows_set_aside"),
        F.count_distinct("column_name").alias("bad_columns"),
    )
    none = F.lit(0).cast("bigint")
    return (
        row_counts(star)
        .join(rejects, "table_name", "left")
        .select(
            "load_order",
            "table_name",
            "row_count",
            *(F.coalesce(c, none).alias(c) for c in ("rows_set_aside", "bad_cells", "bad_columns")),
        )
        .orderBy("load_order")
    )


def write_csv_tables(star: Star, csv_root: str) -> None:
    """Write a star as the CSV files that ``load_tables`` reads."""
    for table, spec in TABLES.items():
        frame = star.table(table).select(*(name for name, _ in spec.columns))
        frame.write.mode("overwrite").csv(
            f"{csv_root}/{table}.csv",
            header=True,
            dateFormat=_DATES,
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            **_QUOTING,
        )


def load_report(spark: SparkSession, csv_root: str, root: str) -> DataFrame:
    """Load everything and report the rows per table, in load order."""
    return row_counts(load_tables(spark, csv_root, root))


def load_differences(before: Star, after: Star) -> DataFrame:
    """Per table: rows of ``after``, rows that only ``before`` has, rows that only ``after`` has.

    Whole rows are compared by value with their number of copies, in one shuffle a table.
    """

    def compared(table: str) -> DataFrame:
        kinds = TABLES[table].columns
        sides = [
            star.table(table).select(
                *(F.col(name).cast(kind).alias(name) for name, kind in kinds),
                F.lit(was).alias("_was"),
                F.lit(now).alias("_now"),
            )
            for star, was, now in ((before, 1, 0), (after, 0, 1))
        ]
        rows = sides[0].unionByName(sides[1])
        counted = rows.groupBy(*(name for name, _ in kinds)).agg(
            F.sum("_was").alias("was"), F.sum("_now").alias("now")
        )
        surplus = F.col("was") - F.col("now")
        return counted.agg(
            F.coalesce(F.sum("now"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.greatest(surplus, F.lit(0))), F.lit(0)).alias("rows_lost"),
            F.coalesce(F.sum(F.greatest(-surplus, F.lit(0))), F.lit(0)).alias("rows_gained"),
        ).select(F.lit(table).alias("table_name"), "row_count", "rows_lost", "rows_gained")

    return reduce(DataFrame.unionByName, map(compared, TABLES))
