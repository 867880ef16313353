"""Literal recodes."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import col

# The projection's age bands and the census age groups they fall into.
AGE_BANDS = {
    "Age 0 - 4": "0-15",
    "Aged 5-9": "0-15",
    "Aged 10-14": "0-15",
    "Aged 15-19": "16-24",
    "Aged 20-24": "16-24",
    "Aged 25-29": "25-34",
    "Aged 30-34": "25-34",
    "Aged 35-39": "35-44",
    "Aged 40-44": "35-44",
    "Aged 45-49": "45-54",
    "Aged 50-54": "45-54",
    "Aged 55-59": "55-64",
    "Aged 60-64": "55-64",
    "Aged 65-69": "65+",
    "Aged 70-74": "65+",
    "Aged 75-79": "65+",
    "Aged 80-84": "65+",
    "Aged 85+": "65+",
}

# Sex as coded in the census, and the census codes of the age groups.
SEX_CODES = {"Male": 2, "Female": 1}
AGE_GROUP_LABELS = {
    -8: "NA",
    1: "0-15",
    2: "16-24",
    3: "25-34",
    4: "35-44",
    5: "45-54",
    6: "55-64",
    7: "65+",
}


def recode(column: Column, mapping: Mapping) -> Column:
    """Replace each value by its partner in ``mapping``; anything else becomes null."""
    pairs = chain.from_iterable(mapping.items())
    return F.create_map(*[F.lit(item) for item in pairs])[column]


def apply_labels(df: DataFrame, labels: Mapping[str, Mapping]) -> DataFrame:
    """Turn codes into labels, column by column: ``{column: {code: label}}``."""
    missing = [name for name in labels if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumns({name: recode(col(name), mapping) for name, mapping in labels.items()})


def null_count(column: Column) -> Column:
    """How many values a recode left unmapped."""
    return F.count_if(column.isNull())


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))
