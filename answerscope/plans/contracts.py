"""Contracts that the writing of a table observes, so that a check of counts, keys and references is no job of its own.

What is counted stands at the top of the written plan, in the tasks of its result: Spark takes each of these once, however
often a lost executor has them run again, while what stands below an exchange may be counted twice. So what has to be
known of a lower row (that its key was repeated, that it found no partner) is carried up as a column of the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schemas import ContractError
from .storage import new_path

#: Contracts that no table guards against: a break ends the job.
HARD = ("answers_repeated", "citations_without_answer", "mentions_without_sentence", "mentions_of_repeated_sentences")


class Watched(NamedTuple):
    """Rows with the columns that their contracts are of: breaks (conditions, or numbers) are summed over all rows, then
    the rows that hold `keep` are written without the columns in `carried`."""

    df: DataFrame
    breaks: dict[str, Column]
    keep: Column | None = None
    carried: tuple[str, ...] = ()


def observing(rows: DataFrame | Watched) -> tuple[DataFrame, Observation]:
    """What is to be written, and the observation that has `rows` (of the written table) and each break once it is."""
    w = rows if isinstance(rows, Watched) else Watched(rows, {})
    written = F.lit(True) if w.keep is None else w.keep
    seen = Observation()
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in w.breaks.items()]
    df = w.df.observe(seen, F.count_if(written).alias("rows"), *sums)
    return df.where(written).drop(*w.carried), seen


def stored_watched(rows: DataFrame | Watched, name: str) -> tuple[DataFrame, dict[str, int]]:
    """storage.stored with what the write has observed."""
    df, seen = observing(rows)
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get)


def checked_only(rows: DataFrame | Watched) -> dict[str, int]:
    """What a write would observe, over all rows, which aren't kept."""
    df, seen = observing(rows)
    df.write.format("noop").mode("overwrite").save()
    return dict(seen.get)


def gather(checks: dict[str, int], table: str, found: dict[str, int]) -> None:
    """Adds what a write has observed: rows under the table's name."""
    checks |= {f"rows:{table}" if k == "rows" else k: int(v) for k, v in found.items()}


def hold(checks: dict[str, int], expected: dict[str, int] | None = None) -> None:
    """Raises where a hard contract is broken, or a table's rows aren't as many as expected."""
    broken = {k: checks[k] for k in HARD if checks.get(k)}
    broken |= {f"rows:{k}": checks[f"rows:{k}"] for k, n in (expected or {}).items() if checks.get(f"rows:{k}", n) != n}
    if broken:
        raise ContractError(f"broken contracts: {broken}")


def contract_rows(spark: SparkSession, checks: dict[str, int]) -> DataFrame:
    """contract, n: rows of tables and breaks, a row for each contract there is (not of the data)."""
    return spark.createDataFrame(sorted(checks.items()), "contract string, n long")
