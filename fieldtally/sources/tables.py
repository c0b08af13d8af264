"""Tabular scans and the dataset catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.errors import DatasetNotFound, ReportError
from fieldtally.functions.columns import col, nan_to_null
from fieldtally.functions.text import strip
from fieldtally.operators.period import Period, check_period, scope, source_info
from fieldtally.operators.pii import pii_detect
from fieldtally.sources.verdicts import kept_verdict

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE = r"^\s*[+-]?\d+\s*$"
REAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table with NaN as missing; predicates and columns reach the reader.

    A known ``schema`` saves the job that reads it from a file's footer.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


SURPLUS = "__surplus"
# whole cells, and then one that is quoted and not closed; a quote inside an unquoted cell (5" pipe) is a sign like others
OPEN_CELL = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+$'


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """A CSV table with a header, missing-value tokens as NULL, and typed columns.

    Without ``schema`` a pass over the cells decides per column between bigint, double, boolean and string; whole
    numbers beyond bigint stay text, as do dates. Files are split, so a cell may hold a line break only with
    ``multiline=True`` (one task per file). A file that breaks this, or has a row with more cells than the header,
    is refused by its name.
    """
    options = {"header": True, "inferSchema": False, "multiLine": multiline, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, enforceSchema=False, **options).columns
    # one more column than the header has takes the cells that would be dropped without a word
    wide = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    text = spark.read.csv(path, schema=wide, enforceSchema=True, **options)
    if not multiline:
        _refuse(spark.read.text(path).where(F.col("value").rlike(OPEN_CELL)), "a cell holds a line break: read it with multiline=True")
    cells = text.select(*(F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in names), SURPLUS)
    types, surplus = _cell_types(cells, names if schema is None else ())
    if surplus:
        _refuse(text.where(col(SURPLUS).isNotNull()), "a row has more cells than the header")
    text = cells.select(*map(col, names))
    if schema is None:
        return cast_cells(text, types)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return cast_cells(text, {f.name: f.dataType.simpleString() for f in schema.fields if f.name in text.columns})


def _refuse(rows: DataFrame, why: str) -> None:
    """An error that names the files of these rows, and no cell of them, if there are any."""
    file = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")
    found = rows.select(file).distinct().orderBy("file").limit(5).collect()
    if found:
        raise ReportError("; ".join(f"{r.file}: {why}" for r in found))


def _cell_types(text: DataFrame, columns: Sequence[str]) -> tuple[dict[str, str], int]:
    """From one pass over the cells: the narrowest type that every present cell of a column fits, and how many rows are too wide."""
    tests = [F.count(col(SURPLUS)).alias("surplus")]
    for n, c in enumerate(columns):
        cell = col(c)
        tests += [
            F.count(cell).alias(f"n{n}"),
            F.bool_and(cell.rlike(WHOLE)).alias(f"w{n}"),
            F.bool_and(F.when(cell.isNotNull(), strip(cell).try_cast("bigint").isNotNull())).alias(f"i{n}"),
            F.bool_and(cell.rlike(REAL)).alias(f"r{n}"),
            F.bool_and(cell.isin(*BOOLEAN)).alias(f"b{n}"),
        ]
    row = text.agg(*tests).first()
    types = {}
    for n, c in enumerate(columns):
        if row[f"n{n}"] and row[f"w{n}"]:
            types[c] = "bigint" if row[f"i{n}"] else "string"  # a double would round a long id
        elif row[f"n{n}"] == 0 or row[f"r{n}"]:
            types[c] = "double"
        else:
            types[c] = "boolean" if row[f"b{n}"] else "string"
    return types, row["surplus"]


def cast_cells(text: DataFrame, types: Mapping[str, str]) -> DataFrame:
    cast = {
        c: col(c) if types.get(c, "string") == "string" else strip(col(c)).try_cast(types[c])
        for c in text.columns
    }
    return nan_to_null(text.select(*(value.alias(c) for c, value in cast.items())))


@dataclass
class Catalog:
    """Datasets by name. ``<name>_clean`` is preferred over ``<name>``."""

    tables: Mapping[str, DataFrame]
    orders: Mapping[str, Sequence[str]] = field(default_factory=dict)  # what "first" means in a table
    _pii: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of_views(cls, spark: SparkSession, *names: str) -> Catalog:
        """Tables and temporary views the session already knows."""
        known = names or [t.name for t in spark.catalog.listTables()]
        return cls({name: spark.table(name) for name in known})

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, *names: str) -> Catalog:
        """Stored tables below ``root``, with the verdicts that the sinks kept beside them."""
        paths = {name: f"{root.rstrip('/')}/{name}" for name in names}
        verdicts = {name: kept_verdict(spark, path) for name, path in paths.items()}
        tables = {name: scan_parquet(spark, path) for name, path in paths.items()}
        return cls(tables, _pii={name: found for name, found in verdicts.items() if found is not None})

    def resolve(self, name: str) -> tuple[str, bool]:
        """``(table, used_clean)``."""
        if f"{name}_clean" in self.tables:
            return f"{name}_clean", True
        if name in self.tables:
            return name, name.endswith("_clean")
        known = ", ".join(sorted(self.tables)) or "(none)"
        raise DatasetNotFound(f"Dataset {name!r} not found. Available: {known}")

    def personal(self, table: str) -> list[str]:
        """Personal-data columns of a table: as kept when it was stored, else looked up once on the whole table."""
        if table not in self._pii:
            self._pii[table] = pii_detect(self.tables[table], [col(c) for c in self.orders.get(table, ())])
        return self._pii[table]

    def load(self, name: str, period: Period | None = None) -> Loaded:
        """The scoped table, its row account, and its personal-data columns."""
        table, used_clean = self.resolve(name)
        df = self.tables[table]
        pii = self.personal(table)
        if period is not None:
            check_period(df, period, pii, table)
        info = source_info(df, period, name, "clean" if used_clean else "raw")
        return Loaded(name, scope(df, period), info, pii, used_clean)

    def stripped(self, name: str, include_pii: bool = False) -> DataFrame:
        """A table by its exact name, without its personal-data columns."""
        if name not in self.tables:
            known = ", ".join(sorted(self.tables)) or "(none)"
            raise DatasetNotFound(f"Dataset {name!r} not found. Available: {known}")
        df = self.tables[name]
        if include_pii:
            return df
        personal = set(self.personal(name))
        return df.select(*(col(c) for c in df.columns if c not in personal))


@dataclass(frozen=True)
class Loaded:
    name: str
    frame: DataFrame
    info: DataFrame
    pii: list[str]
    used_clean: bool


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A dataset file by its suffix; the error names the file and never a cell."""
    readers = {".csv": scan_csv, ".parquet": scan_parquet}
    reader = next((r for suffix, r in readers.items() if path.lower().endswith(suffix)), None)
    if reader is None:
        raise ReportError(f"Could not read {path.rsplit('/', 1)[-1]}: expected a .csv or .parquet table.")
    try:
        return reader(spark, path)
    except Exception:
        raise ReportError(
            f"Could not read {path.rsplit('/', 1)[-1]} as a table: check that it is a valid file and "
            "save it again."
        ) from None
