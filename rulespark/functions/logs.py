"""Messages on the way: columns that pass a value on, and relations that are watched.

Rows are many and live on executors, so messages go to the executors' Python
logs; ``watch`` counts them without Python.
"""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rulespark.functions.std import col

LEVELS = {"trace": 5, "debug": 10, "info": 20, "warn": 30, "error": 40, "fatal": 50}


def log(module: str, level: int, message) -> Column:
    """True, after the message is logged."""

    def write(text: pd.Series) -> pd.Series:
        logger = logging.getLogger(module)
        for t in text:
            logger.log(level, "%s", t)
        return pd.Series([True] * len(text))

    return F.pandas_udf(write, "boolean")(col(message).cast("string"))


def _at(level: int):
    return lambda message, module="rules": log(module, level, message)


trace, debug, info, warn, error, fatal = map(_at, LEVELS.values())
print = info  # noqa: A001


def printTrue(message) -> Column:  # noqa: N802
    return info(message)


def watch(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The relation, and a count of its rows once it is computed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def debug_event(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    return watch(df, name)


debug_event_join = debug_split_group = debug_event
