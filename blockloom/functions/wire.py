"""Scalar functions over bytes: little-endian integers, checksums, zero tests, parsing. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operation codes of the block protocol, by ordinal.
OPS = ("NO_OP", "CONNECT", "CONNECT_ACK_OKAY", "CONNECT_ACK_FAIL", "DISCONNECT", "READ", "READ_REPLY", "WRITE", "WRITE_ACK", "WRITE_PUNCH_HOLE")
#: Field, offset and bytes of the message header, which is 128 bytes long.
HEADER = (("optype", 0, 4), ("payload_size", 4, 4), ("driveid", 8, 4), ("driveoffset", 12, 8), ("datasize", 20, 4), ("seq_num", 24, 8))
HEADER_BYTES = 128


def _turned(hexed: Column, size: int) -> Column:
    """The pairs of digits of size bytes in the other order. (reverse() on bytes turns UTF-8 characters, not bytes.)"""
    return F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size))])


def set_int(x: Column) -> Column:
    """Four bytes, least first."""
    return F.unhex(_turned(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(8)), 4))


def set_long(x: Column) -> Column:
    """Eight bytes, least first."""
    return F.unhex(_turned(F.lpad(F.hex(x.cast("long")), 16, "0"), 8))


def get_int(b: Column, offset: int) -> Column:
    value = F.conv(_turned(F.hex(F.substring(b, offset + 1, 4)), 4), 16, 10).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def get_long(b: Column, offset: int) -> Column:
    return F.conv(_turned(F.hex(F.substring(b, offset + 1, 8)), 8), 16, -10).cast("long")


def encode_header(**fields: Column) -> Column:
    """The 128 bytes of a header; bytes between and after the fields are zero."""
    parts, at = [], 0
    for name, offset, size in HEADER:
        parts += [F.unhex(F.lit("00" * (offset - at)))] * (offset > at)
        parts.append((set_int if size == 4 else set_long)(fields[name]))
        at = offset + size
    return F.concat(*parts, F.unhex(F.lit("00" * (HEADER_BYTES - at))))


def decode_header(b: Column) -> list[Column]:
    return [(get_int if size == 4 else get_long)(b, offset).alias(name) for name, offset, size in HEADER]


def op_name(code: Column) -> Column:
    """The name of an operation code, UNKNOWN for codes that there aren't."""
    return F.coalesce(F.try_element_at(F.array([F.lit(x) for x in OPS]), F.when(code >= 0, code + 1)), F.lit("UNKNOWN"))


def checksum(b: Column, offset: int = 0, size: int | None = None) -> Column:
    """MD5 of a slice in upper-case hex."""
    part = b if size is None and not offset else F.substring(b, offset + 1, size if size is not None else (1 << 31) - 1)
    return F.upper(F.md5(part))


def all_zero(b: Column) -> Column:
    """Whether every byte is zero; so is a buffer without bytes."""
    return F.translate(F.hex(b), "0", "") == ""


def megabytes(size: Column) -> Column:
    return F.shiftright(size.cast("long"), 20)


def parse_int(text: Column) -> Column:
    return text.try_cast("int")


def is_ipv4(text: Column) -> Column:
    part = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return text.rlike(rf"^{part}(\.{part}){{3}}$")


def require(condition: Column, message: str) -> Column:
    """Null where the condition holds; fails the query otherwise."""
    return F.assert_true(condition, message)


#: The operations that a client encodes; of others the header stays zero.
CLIENT_OPS = ("NO_OP", "CONNECT", "READ", "WRITE", "DISCONNECT", "WRITE_PUNCH_HOLE")
