"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of ASCII only take the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns, whatever else there is. Names are matched in their exact spelling and by position,
    so further columns may repeat a name or differ from one in case only."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(c)}").alias(c) for c in columns])


def having(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows of `docs` whose id is in the one column of `ids`, null among them, with all their columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    wanted = ids.toDF("kept_id").distinct()
    same = plain[f"c{docs.columns.index(id_column)}"].eqNullSafe(wanted["kept_id"])
    return plain.join(wanted, same, "left_semi").toDF(*docs.columns)
