"""Avro object container files, as far as table manifests need them: decoding to Python values, without a library."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

MAGIC = b"Obj\x01"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends too soon")
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value >> 1 ^ -(value & 1)

    def blocks(self) -> Iterator[None]:
        """Once for each item of an array or map."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()  # bytes of the block
            for _ in range(n):
                yield

    def value(self, kind, named: dict):
        if isinstance(kind, list):
            return self.value(kind[self.long()], named)
        if isinstance(kind, str):
            if kind in named:
                return self.value(named[kind], named)
            return {
                "null": lambda: None,
                "boolean": lambda: self.take(1) == b"\x01",
                "int": self.long,
                "long": self.long,
                "float": lambda: struct.unpack("<f", self.take(4))[0],
                "double": lambda: struct.unpack("<d", self.take(8))[0],
                "bytes": lambda: self.take(self.long()),
                "string": lambda: self.take(self.long()).decode(),
            }[kind]()
        name = kind["type"]
        if "name" in kind and name in ("record", "enum", "fixed"):
            named[kind["name"]] = kind
        if name == "record":
            return {f["name"]: self.value(f["type"], named) for f in kind["fields"]}
        if name == "array":
            return [self.value(kind["items"], named) for _ in self.blocks()]
        if name == "map":
            return {self.value("string", named): self.value(kind["values"], named) for _ in self.blocks()}
        if name == "enum":
            return kind["symbols"][self.long()]
        if name == "fixed":
            return self.take(kind["size"])
        return self.value(name, named)  # a logical type, or a nested one


def records(data: bytes) -> Iterator[dict]:
    """The records of a file, whose blocks are plain or deflated."""
    file = _Reader(data)
    if file.take(4) != MAGIC:
        raise ValueError("not an Avro file")
    head = file.value({"type": "map", "values": "bytes"}, {})
    schema, codec, sync = json.loads(head["avro.schema"]), head.get("avro.codec", b"null").decode(), file.take(16)
    while file.at < len(data):
        n, size = file.long(), file.long()
        block = file.take(size)
        if codec not in ("null", "deflate"):
            raise ValueError(f"codec {codec} is not read")
        inner = _Reader(zlib.decompress(block, -15) if codec == "deflate" else block)
        for _ in range(n):
            yield inner.value(schema, {})
        if file.take(16) != sync:
            raise ValueError("a block's mark is wrong")
