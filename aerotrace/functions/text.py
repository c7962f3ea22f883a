"""Formats of the telemetry text log and its properties."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the polynomial that the handshake uses.
CRC_POLYNOMIAL = 0x42F0E1EBA9EA3693


def properties(text: Column) -> Column:
    """The key=value parts of a property list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def property_value(parts: Column, key: str) -> Column:
    """The last value of a key, null if the key is absent."""
    own = F.filter(parts, lambda p: F.trim(F.substring_index(p, "=", 1)) == key)
    last = F.try_element_at(own, F.lit(-1))
    return F.when(last.contains("="), F.trim(F.regexp_replace(last, "^[^=]*=", ""))).when(last.isNotNull(), F.lit(""))


def number(text: Column) -> Column:
    """The number in a text, null where it holds none or nothing."""
    return F.nullif(text, F.lit("")).try_cast("double")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit(","), F.lit("\\,"))


def formatted(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def object_id(x: Column) -> Column:
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def property_name(prefix: str, order: int, suffix: str) -> str:
    return f"{prefix}{order:03d}{''.join(p[:1].upper() + p[1:] for p in suffix.split('_'))}"


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def stem(path: Column) -> Column:
    """File name without folders and its log suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)(\.zip\.acmi|\.acmi|\.zip|\.txt)$", "")


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (CRC_POLYNOMIAL if i & 1 else 0)
        table.append(i)
    return table


_CRC = _crc_table()


def crc64_digest(text: str) -> str:
    """The handshake's digest of a password: CRC-64 of its UTF-16 text, as 0x and 16 hexadecimal digits."""
    crc = (1 << 64) - 1
    for byte in text.encode("utf-16-le"):
        crc = _CRC[(crc ^ byte) & 255] ^ (crc >> 8)
    return f"0x{crc ^ ((1 << 64) - 1):016x}"


def crc64_hash(password: Column) -> Column:
    """crc64_digest of a column."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else crc64_digest(t))

    return digest(password)
