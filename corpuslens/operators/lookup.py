"""Lookups of a batch of probes in a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(probes: DataFrame, data: DataFrame, on: list[str]) -> DataFrame:
    """Every probe with its rows of ``data``, or one row of nulls.

    The result of a left outer join, planned as an inner join, of which Spark may
    send the small side or split the rows of a hot key on either side, and an
    anti join on the keys alone for the probes that find nothing."""
    added = [f for f in data.schema.fields if f.name not in on]
    hits = probes.join(data, on)
    misses = probes.join(data.select(*on), on, "left_anti")
    columns = [*probes.columns, *(f.name for f in added)]
    return hits.select(*columns).unionByName(misses.select(
        *probes.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in added)))
