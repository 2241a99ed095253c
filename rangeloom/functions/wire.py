"""Fields of protocol-buffer messages without their schema."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

FIELD = StructType([StructField("number", LongType()), StructField("wire", LongType()), StructField("value", LongType()), StructField("data", BinaryType())])


def read_fields(message: bytes) -> list[tuple[int, int, int | None, bytes | None]]:
    """(number, wire type, whole number, bytes) of the top level; ValueError if the message ends early or has an old group."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(message) or shift > 63:
                raise ValueError("a number does not end")
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            whole = varint()
            out.append((number, wire, whole - (1 << 64) if whole >> 63 else whole, None))
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"wire type {wire} is not read")
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        if at + n > len(message):
            raise ValueError("a field does not end")
        out.append((number, wire, None, message[at : at + n]))
        at += n
    return out


@F.pandas_udf(ArrayType(FIELD))
def wire_fields(messages: pd.Series) -> pd.Series:
    """The fields of each message, NULL where it can't be read."""

    def one(m: bytes | None):
        try:
            return None if m is None else [dict(zip(("number", "wire", "value", "data"), f, strict=True)) for f in read_fields(m)]
        except ValueError:
            return None

    return messages.map(one)


def varint(whole: Column) -> Column:
    """A whole number of 64 bits in ten bytes, as many as the largest takes: seven bits each, lowest first."""
    n = whole.cast("long")
    parts = [F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127)) + (128 if i < 9 else 0) for i in range(10)]
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in parts]))


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
