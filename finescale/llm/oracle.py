"""Pieces of DuckDB SQL that several contracts need: DuckDB has no crc32."""

from __future__ import annotations

import string

ALPHABET = string.ascii_lowercase


def crc32_table() -> str:
    """One row with ``crc``, the 256 remainders of the reflected polynomial 0xEDB88320."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: {step}) ORDER BY i) AS crc FROM range(256) t(i)"


def utf8_sql(text: str) -> str:
    """Bytes of a text whose characters are below U+0800."""
    return (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]"
            f" ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))")


def crc32_sql(text: str, table: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes."""
    step = f"xor(c >> 8, {table}.crc[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8_sql(text)}), lambda c, b: {step}), 4294967295)"
