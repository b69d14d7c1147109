"""ZIP containers of stored members: a sequential writer, and a reader that only makes range reads.

Both know ZIP64: the writer puts every size and offset into ZIP64 fields, so one layout serves archives
of any size; the reader takes the 32-bit fields and looks into ZIP64 ones where these say so.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

#: Fixed values of the format: signatures, and what a field holds whose value is in a ZIP64 record.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
IN_64, IN_64_SHORT, EXTRA_64, STORED = 0xFFFFFFFF, 0xFFFF, 1, 0
VERSION_64, UTF8_NAME, DAY_ONE = 45, 0x800, 0x21
END_SIZE, MAX_COMMENT = 22, 65535


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored_size: int
    header_at: int


def write(out, members: list[tuple[str, bytes]]) -> None:
    """Write a whole archive of stored members to a file that can only be appended to."""
    directory, at = [], 0
    for name, body in members:
        raw, crc = name.encode(), zlib.crc32(body)
        common = struct.pack("<HHHHHIII", VERSION_64, UTF8_NAME, STORED, 0, DAY_ONE, crc, IN_64, IN_64)
        extra = struct.pack("<HHQQ", EXTRA_64, 16, len(body), len(body))
        head = LOCAL + common + struct.pack("<HH", len(raw), len(extra)) + raw + extra
        out.write(head)
        out.write(body)
        extra = struct.pack("<HHQQQ", EXTRA_64, 24, len(body), len(body), at)
        directory.append(CENTRAL + struct.pack("<H", VERSION_64) + common + struct.pack(
            "<HHHHHII", len(raw), len(extra), 0, 0, 0, 0, IN_64) + raw + extra)
        at += len(head) + len(body)
    listing = b"".join(directory)
    n = len(members)
    out.write(listing)
    out.write(END64 + struct.pack("<QHHIIQQQQ", 44, VERSION_64, VERSION_64, 0, 0, n, n, len(listing), at))
    out.write(LOCATOR64 + struct.pack("<IQI", 0, at + len(listing), 1))
    out.write(END + struct.pack("<HHHHIIH", 0, 0, IN_64_SHORT, IN_64_SHORT, IN_64, IN_64, 0))


def read_at(source, at: int, size: int) -> bytes:
    source.seek(at)
    body = source.read(size)
    if len(body) != size:
        raise ValueError("the archive ends too early")
    return body


def directory(source, length: int) -> list[Member]:
    """Members of the central directory of an open, seekable file of `length` bytes."""
    tail_at = max(0, length - END_SIZE - MAX_COMMENT)
    tail = read_at(source, tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_SIZE + int.from_bytes(tail[end + 20:end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    _, _, _, count, size, at, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
    if count == IN_64_SHORT or IN_64 in (size, at):
        locator = read_at(source, tail_at + end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read_at(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of the central directory")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    listing, members, i = read_at(source, at, size), [], 0
    for _ in range(count):
        if listing[i:i + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        flags, method, _, _, crc, stored, whole, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", listing, i + 8)
        header_at = struct.unpack_from("<I", listing, i + 42)[0]
        name = listing[i + 46:i + 46 + n].decode("utf-8" if flags & UTF8_NAME else "cp437")
        fields = listing[i + 46 + n:i + 46 + n + extra]
        whole, stored, header_at = _wide(fields, [whole, stored, header_at])
        members.append(Member(name, method, crc, whole, stored, header_at))
        i += 46 + n + extra + comment
    return members


def _wide(fields: bytes, values: list[int]) -> list[int]:
    """Values with those taken from the ZIP64 field that do not fit into 32 bits."""
    i = 0
    while i + 4 <= len(fields):
        kind, size = struct.unpack_from("<HH", fields, i)
        if kind == EXTRA_64:
            at, out = i + 4, []
            for value in values:
                if value == IN_64:
                    value, at = struct.unpack_from("<Q", fields, at)[0], at + 8
                out.append(value)
            return out
        i += 4 + size
    return values


def body_at(source, member: Member) -> int:
    """Where the bytes of a stored member begin; its local header may have other extra fields."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is not stored, so its records cannot be read by range")
    head = read_at(source, member.header_at, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n + extra
