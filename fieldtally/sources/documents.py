"""Project documents as capped text.

Files are read as lines and split like any other input: a line's place in its file is its block's start and its order there. Only the
lines that the cap can reach leave their task, so no file is ever one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.functions.text import DOCUMENT_CAP, cap_chars

# Rows of a table that are shown, and what stands for the others.
TABLE_ROWS = 200
OMITTED = "[... more rows omitted ...]\n"
# A shown character of a CSV cell takes at most four in the file: "" in quotes of its own.
QUOTING = 4
CELL = r',("(?:[^"]++|"")*+"[^,]*|[^,]*)'


def doc_text(value: Column, cap: int = DOCUMENT_CAP) -> Column:
    """Text of a document, its tail replaced by a marker past the cap."""
    return cap_chars(value, cap)


def _first_lines(spark: SparkSession, path: str, glob: str, chars: int) -> DataFrame:
    """``(path, block, at, line, begin, ended)``: the lines of every file that begin within its first ``chars`` characters.

    ``begin`` counts the characters before the line, ``ended`` tells whether the file's last line ends in a line break.
    """
    lines = spark.read.text(path, lineSep="\n", pathGlobFilter=glob, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), F.length("value").alias("length"), F.octet_length("value").alias("bytes"),
        F.left("value", F.lit(chars)).alias("line"),
    )
    blocks = lines.groupBy("path", "block", "size").agg(F.sum(F.col("length") + 1).alias("chars"), F.sum(F.col("bytes") + 1).alias("bytes"))
    in_file = Window.partitionBy("path").orderBy("block")  # a row per block of a file
    before = F.coalesce(F.sum("chars").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("bytes").over(Window.partitionBy("path"))
    blocks = blocks.select("path", "block", before.alias("before"), (whole <= F.col("size")).alias("ended")).where(F.col("before") <= chars)
    # every line has a character at least, its break: the rank limit holds inside each task
    here = Window.partitionBy("path", "block").orderBy("at")
    few = lines.withColumn("rank", F.row_number().over(here)).where(F.col("rank") <= chars + 1)
    running = F.coalesce(F.sum(F.col("length") + 1).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = few.join(blocks, ["path", "block"]).withColumn("begin", F.col("before") + running)
    return placed.where(F.col("begin") <= chars).select("path", "block", "at", "line", "begin", "ended")


def _joined(rows: DataFrame, order: Column, line: Column) -> DataFrame:
    """One text per file of at most a few caps' characters."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), line.alias("line")))), lambda p: p["line"])
    return rows.groupBy("path").agg(F.array_join(parts, "").alias("text"))


def _texts(spark: SparkSession, path: str, cap: int) -> DataFrame:
    lines = _first_lines(spark, path, "*.{md,txt}", cap + 1)
    last = F.lead("begin").over(Window.partitionBy("path").orderBy("begin")).isNull()  # the last line that is looked at
    whole = F.when(last & ~F.col("ended"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    return _joined(lines.withColumn("line", whole), F.col("begin"), F.col("line"))


def _tables(spark: SparkSession, path: str, cap: int) -> DataFrame:
    lines = _first_lines(spark, path, "*.csv", QUOTING * (cap + 1))
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    inside = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 1  # the line goes on in a cell of the line before
    upto = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("inside", inside).withColumn("row", F.sum((~F.col("inside")).cast("int")).over(upto))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("begin", "line"))), lambda p: p["line"])
    rows = numbered.where(F.col("row") <= TABLE_ROWS + 1).groupBy("path", "row").agg(F.array_join(parts, "\n").alias("record"))
    raw = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("record", r"\r\z", "")), F.lit(CELL), F.lit(1))
    inner = r'^"((?:[^"]++|"")*+)"'
    cells = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, inner, "$1"), F.lit('""'), F.lit('"'))).otherwise(c))
    shown = F.when(F.col("row") > TABLE_ROWS, F.lit(OMITTED)).otherwise(F.concat(F.array_join(cells, "\t"), F.lit("\n")))
    return _joined(rows.withColumn("shown", shown), F.col("row"), F.col("shown"))


def scan_documents(spark: SparkSession, path: str, cap: int = DOCUMENT_CAP) -> DataFrame:
    """``(path, name, text)`` for every text, Markdown and CSV file below ``path``; one row per file.

    CSV files are shown with tabs between cells, 200 rows at most (header included) and a marker for the others. Empty files
    (Spark's reader passes them over) and other kinds of files have no row.
    """
    read = _texts(spark, path, cap).unionByName(_tables(spark, path, cap))
    name = F.element_at(F.split("path", "/"), -1)
    return read.select("path", name.alias("name"), doc_text(F.col("text"), cap).alias("text"))
