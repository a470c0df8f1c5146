"""What the operators share: words, lineage cuts and joins with a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_folder  # noqa: F401

#: The words of most contracts: maximal runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: A joined side is broadcast up to this many rows; the callers' rows are under 400 bytes.
BROADCAST_ROWS = 100_000
#: State of loops, a row or three a group, is held by the driver up to this many rows, else written.
HELD_ROWS = 1_000


def words(text: Column | str) -> Column:
    """Words of a text in order, as written; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(df: DataFrame, rows: int) -> DataFrame:
    """cut() for a loop's state, of at most the given number of rows: few are kept in the plan itself.

    Each stage and each file scan costs the driver a buffer of 4 MB (spark.broadcast.blockSize), so that rounds over files take
    far more of its memory than the few rows that they pass on.
    """
    if rows > HELD_ROWS:
        return cut(df)
    found = df.toArrow()
    return df.sparkSession.createDataFrame(found if found.num_rows else [], df.schema)


def some(df: DataFrame) -> bool:
    """Whether df has rows: as few partitions as that takes are read, without an exchange."""
    return bool(df.select(F.lit(1)).take(1))


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows, else as it is: the join then shuffles and AQE splits hot keys.

    Without rows, df is counted; of a cut that reads no more than the files' own numbers of rows.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= bound else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
