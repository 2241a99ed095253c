"""Keys: derived keys, public identifiers and message authentication, with the library's own HMAC."""

from __future__ import annotations

import hmac
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: What a key is derived for; part of the derivation.
FOR_CHUNKS, FOR_STRUCTURE, FOR_NAME = b"rangeloom chunk key", b"rangeloom structure key", b"rangeloom key name"
KEY_BYTES = 32


def hkdf(key: bytes, salt: bytes, info: bytes, length: int = KEY_BYTES) -> bytes:
    """HKDF with SHA-256, extract then expand (RFC 5869)."""
    if not 0 < length <= 255 * 32:
        raise ValueError("HKDF gives 1 to 8160 bytes")
    extracted, out, last = hmac.digest(salt, key, "sha256"), [], b""
    for i in range(-(-length // 32)):
        last = hmac.digest(extracted, last + info + bytes([i + 1]), "sha256")
        out.append(last)
    return b"".join(out)[:length]


def key_name(key: bytes) -> str:
    """A public identifier of a key that tells nothing about it; a wrong key is refused by it before anything is read."""
    return hmac.digest(key, FOR_NAME, "sha256").hex()[:16]


@F.pandas_udf(BinaryType())
def subkeys(key: pd.Series, salt: pd.Series) -> pd.Series:
    """The key of one file: nonces count from 0 in each file, so no two files may share a key."""
    return pd.Series([None if k is None or s is None else hkdf(k, s, FOR_CHUNKS) for k, s in zip(key, salt, strict=True)])


@F.pandas_udf(StringType())
def key_names(key: pd.Series) -> pd.Series:
    return key.map(lambda k: None if k is None else key_name(k))


@F.pandas_udf(BinaryType())
def authentication(key: pd.Series, message: pd.Series) -> pd.Series:
    """HMAC-SHA256 of messages, as requests are signed with."""
    return pd.Series([None if k is None or m is None else hmac.digest(k, m, "sha256") for k, m in zip(key, message, strict=True)])


def signing_key(secret: Column, parts: list[Column]) -> Column:
    """The key that a chain of dates and scopes makes of a secret, each part authenticated by the key before it."""
    out = secret
    for p in parts:
        out = authentication(out, p.cast("binary"))
    return out


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
