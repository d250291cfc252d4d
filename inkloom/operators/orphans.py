"""References to records that do not exist, per period.

Method: keys of references and parents are dictionary-encoded to integers (key range, offset).  Per key range and
period two compressed bitmaps are built: the keys referred to, and the keys whose presence flips in that period.  The
parents present at the end of a period are the running XOR of the flips; references AND NOT parents leaves the orphan
bits, which are decoded and joined back to the referring rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 32768  # of one bitmap, as the engine's bitmap aggregates have it
_SCHEMA = "space string, part bigint, offset bigint, period bigint"
DENSE = 2048  # offsets from which 4,096 bytes of bits are shorter than a list of two-byte offsets


def pack(bits: bytes | None) -> bytes:
    """Compress a bitmap: a sorted list of offsets while sparse, plain bits when dense."""
    flat = np.frombuffer(bits or b"", dtype=np.uint8)
    offsets = np.flatnonzero(np.unpackbits(flat, bitorder="little"))
    return b"L" + offsets.astype("<u2").tobytes() if len(offsets) < DENSE else b"B" + flat.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """A bool array of BITS values."""
    out = np.zeros(BITS, dtype=bool)
    if packed[:1] == b"L":
        out[np.frombuffer(packed, dtype="<u2", offset=1)] = True
    else:
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8, offset=1), bitorder="little")[:BITS]
        out[: len(bits)] = bits.astype(bool)
    return out


@F.pandas_udf(T.BinaryType())
def _pack(bits: pd.Series) -> pd.Series:
    return bits.map(pack)


def _survivors(group: pd.DataFrame) -> pd.DataFrame:
    """Orphan bits of one key range: a few bitmaps per period, whatever the number of rows behind them."""
    state, found = np.zeros(BITS, dtype=bool), []
    group = group.assign(order=group["side"].map({"flip": 0, "ref": 1})).sort_values(["period", "order"])
    for period, side, packed in group[["period", "side", "bits"]].itertuples(index=False):
        if side == "flip":
            state ^= unpack(packed)
        else:
            offsets = np.flatnonzero(unpack(packed) & ~state)
            found.append(pd.DataFrame({"offset": offsets.astype(np.int64), "period": np.int64(period)}))
    left = pd.concat(found) if found else pd.DataFrame({"offset": np.zeros(0, np.int64), "period": np.zeros(0, np.int64)})
    return left.assign(space=group["space"].iloc[0], part=np.int64(group["part"].iloc[0]))[["space", "part", "offset", "period"]]


def _bitmaps(rows: DataFrame, side: str) -> DataFrame:
    made = rows.groupBy("space", "part", "period").agg(F.bitmap_construct_agg("offset").alias("bits"))
    return made.select("space", "part", "period", F.lit(side).alias("side"), _pack("bits").alias("bits"))


def month_number(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("bigint")


def month_label(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))


def orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct ``(space, key, period)`` of the references to keys absent at the end of their period.

    ``refs``: ``space, key, period``; repeated rows don't matter.  ``parents``: ``space, key, period, seq, present`` -
    the states a key takes; within a period the state with the greatest ``seq`` holds (ties: present wins), and it
    holds on until the next.  A key without parent row is never present.  Periods are integers.  Rows with a null key
    or period are no references and no parents.  Either side may be empty.
    """
    refs = refs.where("key is not null and period is not null").select("space", "key", "period").distinct()
    parents = parents.where("key is not null and period is not null")
    last = parents.groupBy("space", "key", "period").agg(F.max(F.struct("seq", "present")).alias("m")).select("space", "key", "period", "m.present")
    before = F.lag("present", 1, False).over(Window.partitionBy("space", "key").orderBy("period"))
    flips = last.withColumn("was", before).where("present <> was").select("space", "key", "period")
    # The dictionary numbers the keys inside hash ranges, so no range ever meets in one task but its own keys; a range
    # that outgrows one bitmap goes on in the next part.
    events = refs.withColumn("side", F.lit("ref")).unionByName(flips.withColumn("side", F.lit("flip")))
    spread = F.pmod(F.xxhash64("space", "key"), F.lit(1 << 12)).cast("bigint")
    keys = events.select("space", "key", spread.alias("range")).distinct()
    number = (F.row_number().over(Window.partitionBy("space", "range").orderBy("key")) - 1).cast("bigint")
    # Parts hold 2**5 ranges of up to 1,024 keys each; number // 1024 opens further parts.
    dictionary = keys.withColumn("number", number).select(
        "space",
        "key",
        (F.floor(F.col("range") / 32) + 128 * F.floor(F.col("number") / 1024)).cast("bigint").alias("part"),
        (F.col("range") % 32 * 1024 + F.col("number") % 1024).cast("bigint").alias("offset"),
    )
    coded = events.join(dictionary, ["space", "key"])
    maps = _bitmaps(coded.where("side = 'ref'"), "ref").unionByName(_bitmaps(coded.where("side = 'flip'"), "flip"))
    left = maps.groupBy("space", "part").applyInPandas(_survivors, _SCHEMA)
    return left.join(dictionary, ["space", "part", "offset"]).select("space", "key", "period")

