"""Named static catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from splitfold.errors import BadRequest
from splitfold.sources.base import CatalogTable
from splitfold.sources.static import CatalogFile, StaticCatalog

_named: dict[str, Callable[[SparkSession], CatalogTable]] = {}

# The columns of the public taxi files of 2009, in their order.
TAXI_COLUMNS = """vendor_id string, pickup_at timestamp_ntz, dropoff_at timestamp_ntz, passenger_count tinyint, trip_distance float,
pickup_longitude float, pickup_latitude float, rate_code_id void, store_and_fwd_flag string, dropoff_longitude float,
dropoff_latitude float, payment_type string, fare_amount float, extra float, mta_tax float, tip_amount float, tolls_amount float,
total_amount float"""


def register(name: str, make: Callable[[SparkSession], CatalogTable]) -> None:
    """Makes a static catalog known by the name that requests give as its uri."""
    _named[name] = make


def register_taxi(name: str, root: str, sizes: list[int], year: int = 2009) -> None:
    """Registers monthly taxi files root/YYYY/MM/data.parquet with partition column month, from January on."""

    def make(spark: SparkSession) -> CatalogTable:
        months = [f"{year}/{k:02d}" for k in range(1, len(sizes) + 1)]
        files = [CatalogFile(f"{m}/data.parquet", n, (m,)) for m, n in zip(months, sizes, strict=True)]
        return StaticCatalog(spark, T.StructType.fromDDL(TAXI_COLUMNS.replace("void", "string")), root, ["month"], files)

    register(name, make)


def named(spark: SparkSession, name: str) -> CatalogTable:
    if name not in _named:
        raise BadRequest(f"static catalog not found: {name}")
    return _named[name](spark)


# Bytes of the public taxi files of 2009, January to December.
register_taxi("nyc_taxi_ursa", "s3a://ursa-labs-taxi-data", [461966527, 436405669, 474795751, 470914229, 489248585, 465578495, 448227037, 450774566, 460835784, 517609313, 471148697, 479899902])
