"""Byte planes of fixed-width elements: plane p has byte p of each element. A coder packs planes better than elements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def to_planes(content: pd.Series, width: pd.Series) -> pd.Series:
    """Elements as planes, one after another; bytes beyond the last whole element go."""
    return pd.Series([None if c is None else np.frombuffer(c, np.uint8)[: len(c) // w * w].reshape(-1, w).T.tobytes() for c, w in zip(content, width, strict=True)])


@F.pandas_udf(BinaryType())
def from_planes(planes: pd.Series, width: pd.Series) -> pd.Series:
    """Planes of whole elements as elements again."""
    return pd.Series([None if c is None else np.frombuffer(c, np.uint8).reshape(w, -1).T.tobytes() for c, w in zip(planes, width, strict=True)])


# Numbers of codecs and of methods that a plane is coded by.
SPLIT, BF16, BF16_CONDITIONED, SPLIT_TABLE = 2, 3, 5, 9
STORED, RANS = 0, 3
MOST_PLANES = 16


def device_reason(codec: Column, width: Column, rlen: Column, flags: Column, grain: int) -> Column:
    """Why a device cannot decode a chunk, by the first rule that it breaks; NULL if it can. flags has two bits a plane."""
    planes = F.when(codec == BF16, F.lit(2)).otherwise(width).cast("int")
    elements = F.floor(rlen / F.nullif(planes, F.lit(0)))
    odd = F.exists(F.sequence(F.lit(0), F.greatest(planes, F.lit(1)) - 1), lambda p: ~F.floor(flags / F.pow(F.lit(4), p)).cast("long").bitwiseAND(F.lit(3)).isin(STORED, RANS))
    return (
        F.when(codec == SPLIT_TABLE, "shared table")
        .when(codec == BF16_CONDITIONED, "conditioned planes")
        .when(~codec.isin(SPLIT, BF16), "no planes")
        .when((planes <= 0) | (rlen % F.nullif(planes, F.lit(0)) != 0), "part of an element")
        .when(elements % grain != 0, "off the grain")
        .when(planes > MOST_PLANES, "too many planes")
        .when(odd, "plane of another coder")
    )
