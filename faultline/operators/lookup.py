"""Few rows out of many, without moving the many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import BROADCAST_BYTES, fits_broadcast

MAX_PARTS = 64


def only_wanted(
    rows: DataFrame, wanted: DataFrame, keys: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``rows`` whose ``keys`` are in the stored table ``wanted``; rows are filtered where they are read.

    A table too large to be sent to every executor is sent in parts by a hash of
    the keys, and the rows are read once for each part.
    """
    keyed = wanted.select(*keys).distinct()
    parts = 1
    while parts < MAX_PARTS and not fits_broadcast(wanted.select(*keys), broadcast_bytes * parts):
        parts *= 2
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    found = [
        rows.where(part == i).join(F.broadcast(keyed.where(part == i)), list(keys), "left_semi")
        for i in range(parts)
    ]
    return reduce(DataFrame.unionByName, found)
