"""Queries on quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlode.operators import units
from paperlode.session import read


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.common_units(read(spark, sf_dir, "numeric_values"), read(spark, sf_dir, "chunks"), read(spark, sf_dir, "feeds"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.changed(p1_units(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_units": p1_units}
