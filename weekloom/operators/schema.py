"""Projection, renaming, typing and the yearly source layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions import as_column, clean_name


def clean_colnames(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[as_column(c) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def add_literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def cast_numeric(df: DataFrame, keep: Sequence[str], lenient: bool = False) -> DataFrame:
    """All columns but `keep` to double. Text that is no number raises, or gives null if lenient."""
    cast = (lambda c: as_column(c).try_cast("double")) if lenient else (lambda c: as_column(c).cast("double"))
    return df.select(*[as_column(c) if c in keep else cast(c).alias(c) for c in df.columns])


def columns_by_type(df: DataFrame, *types: type[T.DataType]) -> list[tuple[int, str]]:
    """Position and name of the columns of the given types; strings by default."""
    wanted = types or (T.StringType,)
    return [(i, f.name) for i, f in enumerate(df.schema) if isinstance(f.dataType, wanted)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for _, name in columns_by_type(df, T.NumericType)]


def assemble_features(
    df: DataFrame,
    categorical: Sequence[str] = (),
    time: Sequence[str] = (),
    scaled: Sequence[str] = (),
    logged: Sequence[str] = (),
    keep: Sequence[str] = (),
    output: str = "features",
) -> DataFrame:
    """One vector from the feature blocks in order; weight, label and ids stay named columns."""
    blocks = [*categorical, *time, *scaled, *logged]
    assembler = VectorAssembler(inputCols=blocks, outputCol=output, handleInvalid="error")
    return assembler.transform(df).select(*[as_column(c) for c in keep], output)


@dataclass(frozen=True)
class VintageNames:
    """Column naming of yearly files: a prefix per year, common suffixes, a few exceptions."""

    prefixes: Mapping[int, str]
    suffixes: Mapping[str, str]
    exceptions: Mapping[int, Mapping[str, str]] = field(default_factory=dict)

    def mapping(self, year: int) -> dict[str, str]:
        """Vendor code to common name for one year."""
        special = self.exceptions.get(year, {})
        return {special.get(s, self.prefixes[year] + s): name for s, name in self.suffixes.items()}


# Demographic file layout: fixed values.
DEMOGRAPHIC_NAMES = VintageNames(
    prefixes={2016: "EHY", 2017: "Y17", 2018: "Y18", 2019: "Y19", 2020: "Y20", 2021: "ECY"},
    suffixes={
        "BASPOP": "Total Population",
        "PTA2024": "Total 20 To 24",
        "PTA2529": "Total 25 To 29",
        "PTA3034": "Total 30 To 34",
        "PTA3539": "Total 35 To 39",
        "PTA4044": "Total 40 To 44",
        "PTA4549": "Total 45 To 49",
        "PTA5054": "Total 50 To 54",
        "PTA5559": "Total 55 To 59",
        "PTA6064": "Total 60 To 64",
        "PTA6569": "Total 65 To 69",
        "PTA7074": "Total 70 To 74",
        "PTA7579": "Total 75 To 79",
        "PTA8084": "Total 80 To 84",
        "PTA85P": "Total 85 Or Older",
        "TENHHD": "Total Households For Tenure",
        "TENOWN": "Owned",
        "TENRENT": "Rented",
        "TENBAND": "Band Housing",
        "HRI_020": "Household Income $0 To $19,999 (Constant Year 2015 $)",
        "HRI2040": "Household Income $20,000 To $39,999 (Constant Year 2015 $)",
        "HRI4060": "Household Income $40,000 To $59,999 (Constant Year 2015 $)",
        "HRI6080": "Household Income $60,000 To $79,999 (Constant Year 2015 $)",
        "HRIX100": "Household Income $80,000 To $99,999 (Constant Year 2015 $)",
        "HRI100P": "Household Income $100,000 Or Over (Constant Year 2015 $)",
        "HRIX125": "Household Income $100,000 To $124,999 (Constant Year 2015 $)",
        "HRIX150": "Household Income $125,000 To $149,999 (Constant Year 2015 $)",
        "HRIX200": "Household Income $150,000 To $199,999 (Constant Year 2015 $)",
        "HRI200P": "Household Income $200,000 Or Over (Constant Year 2015 $)",
        "HRIX300": "Household Income $200,000 To $299,999 (Constant Year 2015 $)",
        "HRI300P": "Household Income $300,000 Or Over (Constant Year 2015 $)",
        "EDUNCDD": "No Certificate, Diploma Or Degree",
        "EDUHSCE": "High School Certificate Or Equivalent",
        "EDUATCD": "Apprenticeship Or Trades Certificate Or Diploma",
        "EDUCOLL": "College, CEGEP Or Other Non-University Certificate Or Diploma",
        "EDUUDBB": "University Certificate Or Diploma Below Bachelor",
        "EDUUD": "University Degree",
        "EDUUDBD": "Bachelor's Degree",
        "EDUUDBP": "Above Bachelor's",
        "PTAAVG": "Average AGE",
        "HRIAVG": "Average Income",
    },
    exceptions={
        2016: {"PTAAVG": "ECYPTAAVG", "HRIAVG": "ECYHRIAVG"},
        2020: {"HRIAVG": "Y21HRIAVG"},
        2021: {"PTAAVG": "Y21PTAAVG", "HRIAVG": "Y21HRIAVG"},
    },
)


def rename_vintage(df: DataFrame, year: int, names: VintageNames = DEMOGRAPHIC_NAMES) -> DataFrame:
    """Vendor codes of one year to common names; columns without a mapping keep theirs."""
    return df.withColumnsRenamed(names.mapping(year))


def _named(*suffixes: str) -> list[str]:
    return [DEMOGRAPHIC_NAMES.suffixes[s] for s in suffixes]


# Coarse bands by the fine bands they add up: fixed values.
AGE_BANDS = {
    "Total_20_39": ["Total 20 To 24", "Total 25 To 29", "Total 30 To 34", "Total 35 To 39"],
    "Total_40_59": ["Total 40 To 44", "Total 45 To 49", "Total 50 To 54", "Total 55 To 59"],
    "Total 60+": [
        "Total 60 To 64", "Total 65 To 69", "Total 70 To 74",
        "Total 75 To 79", "Total 80 To 84", "Total 85 Or Older",
    ],
}
INCOME_BANDS = {
    "Household Income <$60000": _named("HRI_020", "HRI2040", "HRI4060"),
    "Household Income $60000 - $99000": _named("HRI6080", "HRIX100"),
    # The open-ended totals are added to their own parts here, so high incomes count several times.
    "Household Income >=$100000": _named("HRI100P", "HRIX125", "HRIX150", "HRIX200", "HRI200P", "HRIX300", "HRI300P"),
}
# Every household counted once: the 100,000 Or Over total already holds its parts.
INCOME_BANDS_ONCE = {**INCOME_BANDS, "Household Income >=$100000": _named("HRI100P")}
