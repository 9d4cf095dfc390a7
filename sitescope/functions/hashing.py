"""Deterministic per-row uniform numbers for sampling and splitting.

Integral keys use an integer mix (multiply-mod-prime and xor-shift rounds, all
products below 2**62) that any SQL engine can evaluate identically; other keys
use xxhash64. Both are stable across partitionings and re-runs, so a lost
executor recomputes the same split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 2147483647  # 2**31 - 1
_A1, _A2 = 48271, 69621


def unit_hash_int(key, seed: int = 42) -> Column:
    """Uniform double in [0, 1) from an integral key and a seed."""
    k = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    x = ((k % _M) + _M) % _M
    x = (x * _A1 + (seed * 7919 + 11)) % _M
    x = F.shiftright(x, 16).bitwiseXOR(x)
    x = (x * _A2 + 7) % _M
    x = F.shiftright(x, 11).bitwiseXOR(x)
    x = (x * _A1) % _M
    return x.cast("double") / float(_M)


def unit_hash(*keys, seed: int = 42) -> Column:
    """Uniform double in [0, 1) from any key columns."""
    h = F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed))
    return (F.abs(h % 1000000007)).cast("double") / 1000000007.0


def unit_hash_sql(key: str, seed: int = 42) -> str:
    """The same integer mix as ANSI SQL text (for the oracle)."""
    x = f"((({key}) % {_M}) + {_M}) % {_M}"
    x = f"((({x}) * {_A1} + {seed * 7919 + 11}) % {_M})"
    x = f"xor(({x}) >> 16, ({x}))"
    x = f"((({x}) * {_A2} + 7) % {_M})"
    x = f"xor(({x}) >> 11, ({x}))"
    x = f"((({x}) * {_A1}) % {_M})"
    return f"(cast({x} as double) / {_M}.0)"
