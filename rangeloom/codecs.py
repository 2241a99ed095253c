"""Coders of single chunks, by name. A coder declares its options; one that it does not declare is an error."""

from __future__ import annotations

import sys
import zlib
from abc import ABC, abstractmethod

import numpy as np
from pyspark import cloudpickle


class Codec(ABC):
    name: str
    #: Options with their defaults.
    options: dict[str, int] = {}

    def __init__(self, **given: int):
        unknown = sorted(set(given) - set(self.options))
        if unknown:
            raise ValueError(f"coder {self.name} has no options {unknown}; there are {sorted(self.options)}")
        self.given = self.options | given

    @abstractmethod
    def encode(self, plain: bytes) -> bytes: ...

    @abstractmethod
    def decode(self, coded: bytes) -> bytes: ...


CODECS: dict[str, type[Codec]] = {}


def register(codec: type[Codec]) -> type[Codec]:
    CODECS[codec.name] = codec
    return codec


def codec(name: str, **options: int) -> Codec:
    if name not in CODECS:
        raise ValueError(f"no coder {name}; there are {sorted(CODECS)}")
    return CODECS[name](**options)


@register
class Stored(Codec):
    name = "stored"

    def encode(self, plain: bytes) -> bytes:
        return plain

    def decode(self, coded: bytes) -> bytes:
        return coded


@register
class Deflate(Codec):
    name, options = "deflate", {"level": 1}

    def encode(self, plain: bytes) -> bytes:
        return zlib.compress(plain, self.given["level"])

    def decode(self, coded: bytes) -> bytes:
        return zlib.decompress(coded)


@register
class Zstandard(Codec):
    name, options = "zstd", {"level": 3}

    def encode(self, plain: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=self.given["level"]).compress(plain)

    def decode(self, coded: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(coded)


@register
class Planes(Deflate):
    """Byte planes of elements, deflated; bytes beyond the last whole element follow as they are."""

    name, options = "planes", {"level": 1, "width": 4}

    def encode(self, plain: bytes) -> bytes:
        w, n = self.given["width"], len(plain) // self.given["width"] * self.given["width"]
        turned = np.frombuffer(plain, np.uint8)[:n].reshape(-1, w).T.tobytes()
        return super().encode(turned + plain[n:])

    def decode(self, coded: bytes) -> bytes:
        w, turned = self.given["width"], super().decode(coded)
        n = len(turned) // w * w
        return np.frombuffer(turned, np.uint8)[:n].reshape(w, -1).T.tobytes() + turned[n:]


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
