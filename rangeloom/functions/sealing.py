"""Sealing of chunks with AES-GCM in the JVM; the key never stands in a plan as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nonce


def key_bytes(raw: bytes) -> bytes:
    """A key of 32 bytes, or of 64 hexadecimal digits."""
    text = raw.strip()
    if len(raw) == 32:
        return raw
    if len(text) == 64:
        return bytes.fromhex(text.decode())
    raise ValueError("a key has 32 bytes or 64 hexadecimal digits")


def seal(chunks: DataFrame, keys: DataFrame, content: str = "content", ordinal: str = "ord") -> DataFrame:
    """``chunks`` with sealed bytes; ``keys`` is one row with a column ``key``. The nonce is the chunk's ordinal."""
    blob = F.aes_encrypt(F.col(content), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), nonce(F.col(ordinal)))
    return chunks.crossJoin(F.broadcast(keys)).withColumn("sealed", F.substring(blob, 13, 2**31 - 1)).drop("key")


def open_sealed(chunks: DataFrame, keys: DataFrame, sealed: str = "sealed", ordinal: str = "ord") -> DataFrame:
    """``chunks`` with the opened bytes; a chunk that was changed gives NULL."""
    return chunks.crossJoin(F.broadcast(keys)).withColumn("opened", F.try_aes_decrypt(F.concat(nonce(F.col(ordinal)), F.col(sealed)), F.col("key"), F.lit("GCM"))).drop("key")


def verify_crc(content: Column, crc: Column) -> Column:
    """The content, or an error where its checksum differs."""
    return F.when(F.crc32(content) == crc, content).otherwise(F.raise_error(F.lit("checksum differs")).cast("binary"))
