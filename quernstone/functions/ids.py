"""Identifiers and hashes."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
POSTING_ID = r"^[a-z2-7]{16}$"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def board_id(source: Column, slug: Column) -> Column:
    """``source:slug`` in lower case; null if the slug is none."""
    return F.when(slug.rlike(SLUG), F.concat_ws(":", source, F.lower(slug)))


def parse_board_id(c: Column) -> Column:
    at = F.instr(c, ":")
    return F.when(at > 1, F.struct(F.substring_index(c, ":", 1).alias("source"), c.substr(at + 1, F.length(c)).alias("slug")))


def base32_of_hex(c: Column, groups: int) -> Column:
    """Lower-case base 32 of ``groups`` times ten hex digits (40 bits each)."""
    parts = [F.lpad(F.conv(c.substr(10 * i + 1, 10), 16, 32), 8, "0") for i in range(groups)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def posting_id(board: Column, external: Column) -> Column:
    """80 bits of the hash of ``board:external`` in base 32."""
    return base32_of_hex(F.sha2(F.concat_ws(":", board, external), 256), 2)


def _number(x: float | int) -> str:
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    r = repr(x)
    if "e" in r:
        mantissa, exponent = r.split("e")
        e = int(exponent)
        if -7 < e < 21:
            return format(x, f".{max(0, len(mantissa.replace('-', '').replace('.', '')) - 1 - e)}f")
        return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"
    return r


def canonical(value: object) -> str:
    """JSON with sorted keys (by UTF-16 units), composed strings and shortest numbers."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(unicodedata.normalize("NFC", value), ensure_ascii=False)
    if isinstance(value, list | tuple):
        return f"[{','.join(map(canonical, value))}]"
    if isinstance(value, dict):
        own = {unicodedata.normalize("NFC", k): v for k, v in value.items()}
        if len(own) < len(value):
            raise ValueError("keys that compose to one")
        return "{" + ",".join(f"{canonical(k)}:{canonical(own[k])}" for k in sorted(own, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(type(value).__name__)


@F.pandas_udf(StringType())
def canonical_json(source: pd.Series) -> pd.Series:
    """JSON text in canonical form; null where it is no JSON."""

    def one(text: str) -> str | None:
        try:
            return canonical(json.loads(text))
        except (ValueError, TypeError):
            return None

    return source.map(one, na_action="ignore")


def content_hash(source: Column) -> Column:
    return F.sha2(canonical_json(source), 256)


def _times(h: Column, factor: int) -> Column:
    """h * factor modulo 2 ** 32 without an overflow: in halves of 16 bits."""
    high, low = factor >> 16, factor & 0xFFFF
    upper = (F.shiftright(h, 16) * F.lit(low) + h.bitwiseAND(F.lit(0xFFFF)) * F.lit(high)).bitwiseAND(F.lit(0xFFFF))
    return (upper * F.lit(65536) + h.bitwiseAND(F.lit(0xFFFF)) * F.lit(low)).bitwiseAND(F.lit(0xFFFFFFFF))


def shuffle_key(c: Column) -> Column:
    """FNV-1a of 32 bits with a final mix, as eight hex digits: an order that spreads like ids."""
    start = F.lit(0x811C9DC5).cast("bigint")
    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, lambda h, x: _times(h.bitwiseXOR(F.ascii(x).cast("bigint")), 0x01000193))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        h = _times(h, factor) if factor else h
    return F.lower(F.lpad(F.hex(h), 8, "0"))
