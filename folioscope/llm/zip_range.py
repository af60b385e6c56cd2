"""Reading and writing ZIP archives of stored members by byte ranges.

The reader takes the end of the file, follows the central directory (with
ZIP64 where fields don't suffice), and reads any range of a stored member
straight from the archive; nothing is unpacked.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlparse

_END = struct.Struct("<4s4H2LH")
_END64_AT = struct.Struct("<4sLQL")
_END64 = struct.Struct("<4sQ2H2L4Q")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipError(ValueError):
    """The file isn't an archive that can be read by ranges."""


def _local_path(uri: str) -> str | None:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Ranges:
    """A file of the shared store, read by offset and length."""

    def __init__(self, uri: str):
        local = _local_path(uri)
        if local is not None:
            self.file: BinaryIO = open(local, "rb")  # noqa: SIM115
            self.size = os.fstat(self.file.fileno()).st_size
        else:
            system, path = _filesystem(uri)
            self.file = system.open_input_file(path)
            self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ZipError(f"range {at}+{n} is outside the file of {self.size} bytes")
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ZipError("the file ended early")
        return out

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header_at: int


def _end(file: Ranges) -> tuple[int, int, int]:
    """Entries, size and place of the central directory."""
    tail_at = max(0, file.size - _END.size - _FULL16)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ZipError("no end of a central directory")
    _, _, _, _, entries, size, place, _ = _END.unpack_from(tail, at)
    locator_at = tail_at + at - _END64_AT.size
    if locator_at >= 0:
        sign, _, where, _ = _END64_AT.unpack(file.read(locator_at, _END64_AT.size))
        if sign == b"PK\x06\x07":
            fields = _END64.unpack(file.read(where, _END64.size))
            if fields[0] != b"PK\x06\x06":
                raise ZipError("no ZIP64 end of the central directory")
            entries, size, place = fields[7:10]
    return entries, size, place


def _wide(extra: bytes, size: int, packed: int, header_at: int) -> tuple[int, int, int]:
    """Fill the fields that are full from the ZIP64 extra field, in their fixed order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values, take = [size, packed, header_at], at + 4
            for k in range(3):
                if values[k] == _FULL32:
                    (values[k],) = struct.unpack_from("<Q", extra, take)
                    take += 8
            return tuple(values)
        at += 4 + n
    return size, packed, header_at


def members(file: Ranges) -> Iterator[Member]:
    """The entries of the central directory."""
    entries, size, place = _end(file)
    directory, at = file.read(place, size), 0
    for _ in range(entries):
        fields = _ENTRY.unpack_from(directory, at)
        if fields[0] != b"PK\x01\x02":
            raise ZipError("a broken central directory")
        packed, whole, name_n, extra_n, note_n, header_at = fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
        at += _ENTRY.size
        name = directory[at : at + name_n].decode("utf-8" if fields[3] & 0x800 else "cp437")
        whole, packed, header_at = _wide(directory[at + name_n : at + name_n + extra_n], whole, packed, header_at)
        at += name_n + extra_n + note_n
        yield Member(name, fields[4] == 0 and not fields[3] & 1 and packed == whole, whole, header_at)


def data_at(file: Ranges, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if not member.stored:
        raise ZipError(f"{member.name} is compressed or encrypted: it has no ranges")
    fields = _LOCAL.unpack(file.read(member.header_at, _LOCAL.size))
    if fields[0] != b"PK\x03\x04":
        raise ZipError(f"{member.name} has no local header")
    return member.header_at + _LOCAL.size + fields[9] + fields[10]


class Writing:
    """A new file of the shared store; it gets its name only when it is complete."""

    def __init__(self, uri: str, attempt: str):
        self.local, self.uri = _local_path(uri), uri
        self.draft = f"{self.local or uri}.{attempt}.draft"
        if self.local is not None:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.file: BinaryIO = open(self.draft, "wb")  # noqa: SIM115
        else:
            self.system, self.path = _filesystem(uri)
            self.system.create_dir(os.path.dirname(self.path), recursive=True)
            self.draft = f"{self.path}.{attempt}.draft"
            self.file = self.system.open_output_stream(self.draft)

    def commit(self) -> None:
        self.file.close()
        if self.local is not None:
            os.replace(self.draft, self.local)
        else:
            self.system.move(self.draft, self.path)
