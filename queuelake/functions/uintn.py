"""Variable-width unsigned integers.

Ids below 2**63 are BIGINT columns and every function on them is a built-in
expression. Wider numbers are decimal strings; functions that end in ``_big``
work on these, in Arrow batches, at any width.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from queuelake.model import width_of

VALID_SIZES = (1, 2, 4, 8, 16)


def width(c: Column) -> Column:
    """Bytes of the least width class that holds the value."""
    return F.when(c < 1 << 8, 1).when(c < 1 << 16, 2).when(c < 1 << 32, 4).otherwise(8)


def is_valid_size(c: Column) -> Column:
    return c.isin(*VALID_SIZES)


def can_fit(c: Column, size: Column | int) -> Column:
    return width(c) <= size


def is_zero(c: Column) -> Column:
    return c == 0


def increment(c: Column) -> Column:
    return c + F.lit(1).cast("long")


def decrement(c: Column) -> Column:
    """One less; 0 is an error."""
    return F.when(c == 0, F.raise_error(F.lit("unsigned underflow")).cast("long")).otherwise(c - F.lit(1).cast("long"))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    """a - b; a negative result is an error."""
    return F.when(a < b, F.raise_error(F.lit("unsigned underflow")).cast("long")).otherwise(a - b)


def _half(c: Column) -> Column:
    return F.shiftright(c, 1)


def middle(a: Column, b: Column) -> Column:
    """floor((a + b) / 2) without overflow."""
    return _half(a) + _half(b) + _half(a % 2 + b % 2)


def rem(a: Column, b: Column) -> Column:
    """a mod b; b = 0 is an error."""
    return F.when(b == 0, F.raise_error(F.lit("remainder by zero")).cast("long")).otherwise(a % b)


def step_by(c: Column, k: Column | int) -> Column:
    return c + k


def in_step(c: Column, start: Column | int, step: int) -> Column:
    """Whether ``c`` is at or after ``start`` and a whole number of steps from it; step 0 counts as 1."""
    start = start if isinstance(start, Column) else F.lit(start).cast("long")
    after = c >= start
    return after if step <= 1 else after & ((c - start) % step == 0)


def display(c: Column) -> Column:
    return c.cast("string")


def display_client(c: Column) -> Column:
    """As the network client prints numbers: one-byte ones in hex, others in decimal."""
    return F.when(c < 1 << 8, F.lower(F.hex(c))).otherwise(c.cast("string"))


def parse_decimal(c: Column) -> Column:
    """A decimal string as a number; null where it isn't one or doesn't fit."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def checked(c: Column, size: int) -> Column:
    """The value, or an error where it doesn't fit ``size`` bytes."""
    if size not in VALID_SIZES:
        raise ValueError(f"not a width: {size}")
    return F.when(width(c) <= size, c).otherwise(F.raise_error(F.lit(f"value does not fit {size} bytes")).cast("long"))


def progress(current: Column, start: Column, end: Column) -> Column:
    """How far ``current`` is from ``start`` to ``end``, between 0 and 1; at or before the start it is 0, even in an empty range."""
    part = F.try_divide((current - start).cast("double"), (end - start).cast("double"))
    return F.when(current <= start, 0.0).when(current >= end, 1.0).otherwise(part)


def from_hex(c: Column) -> Column:
    return F.conv(c, 16, 10).try_cast("long")


def path_of(c: Column) -> Column:
    """Lower hex, padded on the left to a multiple of three digits, three digits a directory."""
    digits = F.lower(F.hex(c))
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 3.0) * 3).cast("int"), "0")
    return F.rtrim(F.regexp_replace(padded, "(...)", "$1/"), F.lit("/"))


def file_path(prefix: Column | str, c: Column, extension: str) -> Column:
    prefix = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit("/"))), path_of(c), F.lit(f".{extension}"))


def path_to_id(c: Column) -> Column:
    """The id in a path relative to its queue's directory; null where there is none."""
    digits = F.regexp_replace(F.regexp_replace(c, r"\.[a-z]+$", ""), "/", "")
    return F.when(digits.rlike("^[0-9a-fA-F]+$"), from_hex(digits))


def nearest_rank(values: Column, percent: int) -> Column:
    """The value at rank floor(n * percent / 100) of a sorted array, the last one at most."""
    place = F.least(F.floor(F.size(values) * percent / 100), F.size(values) - 1)
    return F.get(F.array_sort(values), place.cast("int"))


# Any width: decimal strings


def _unsigned(n: int) -> str:
    if n < 0:
        raise ValueError("unsigned underflow")
    return str(n)


@pandas_udf(T.StringType())
def add_big(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else str(int(x) + int(y)) for x, y in zip(a, b)], dtype=object)


@pandas_udf(T.StringType())
def sub_big(a: pd.Series, b: pd.Series) -> pd.Series:
    """A negative result is an error."""
    return pd.Series([None if x is None or y is None else _unsigned(int(x) - int(y)) for x, y in zip(a, b)], dtype=object)


@pandas_udf(T.StringType())
def middle_big(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else str((int(x) + int(y)) // 2) for x, y in zip(a, b)], dtype=object)


@pandas_udf(T.StringType())
def rem_big(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else str(int(x) % int(y)) for x, y in zip(a, b)], dtype=object)


@pandas_udf(T.IntegerType())
def width_big(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else width_of(int(x)) for x in a], dtype="Int32")


@pandas_udf(T.StringType())
def key_big(a: pd.Series) -> pd.Series:
    """A string that sorts as the number does: the count of hex digits, then the digits."""
    return pd.Series([None if x is None else f"{len(f'{int(x):x}'):04x}{int(x):x}" for x in a], dtype=object)


@pandas_udf(T.StringType())
def path_big(a: pd.Series) -> pd.Series:
    def path(n: int) -> str:
        digits = f"{n:x}"
        digits = digits.zfill(-(-len(digits) // 3) * 3)
        return "/".join(digits[i : i + 3] for i in range(0, len(digits), 3))

    return pd.Series([None if x is None else path(int(x)) for x in a], dtype=object)


@pandas_udf(T.StringType())
def from_hex_big(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else str(int(x, 16)) for x in a], dtype=object)


# Little-endian codecs, over decimal strings


@pandas_udf(T.BinaryType())
def to_le_bytes(a: pd.Series) -> pd.Series:
    """As many bytes as the width class has."""
    return pd.Series([None if x is None else int(x).to_bytes(width_of(int(x)), "little") for x in a], dtype=object)


def to_le_bytes_of(size: int):
    """Exactly ``size`` bytes; a value that doesn't fit is an error."""

    @pandas_udf(T.BinaryType())
    def fixed(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else int(x).to_bytes(size, "little") for x in a], dtype=object)

    return fixed


@pandas_udf(T.StringType())
def from_le_bytes(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else str(int.from_bytes(x, "little")) for x in a], dtype=object)


@pandas_udf(T.StringType())
def from_be_bytes(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else str(int.from_bytes(x, "big")) for x in a], dtype=object)


@pandas_udf(T.BinaryType())
def to_prefixed(a: pd.Series) -> pd.Series:
    """Eight bytes of length, then the value's bytes."""

    def write(n: int) -> bytes:
        size = width_of(n)
        return size.to_bytes(8, "little") + n.to_bytes(size, "little")

    return pd.Series([None if x is None else write(int(x)) for x in a], dtype=object)


@pandas_udf(T.StringType())
def from_prefixed(a: pd.Series) -> pd.Series:
    """The value after its length; null where the bytes end too early."""

    def read(b: bytes) -> str | None:
        size = int.from_bytes(b[:8], "little")
        return str(int.from_bytes(b[8 : 8 + size], "little")) if len(b) >= 8 + size and len(b) >= 8 else None

    return pd.Series([None if x is None else read(bytes(x)) for x in a], dtype=object)
