"""Random numbers as functions of a seed and keys: the same on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(k) -> Column:
    return F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k)


def bits(seed: int, op: str, *keys) -> Column:
    """A 32-bit integer from the MD5 of ``seed:op:keys``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(op), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int, op: str, *keys) -> Column:
    """In (0, 1): never 0, so its logarithm is finite."""
    return (bits(seed, op, *keys) + 0.5) / 4294967296.0


def normal(seed: int, op: str, *keys) -> Column:
    """Standard normal, by Box and Muller from two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, op + "/a", *keys))) * F.cos(2 * F.pi() * uniform(seed, op + "/b", *keys))


def sql_bits(seed: int, op: str, *keys: str) -> str:
    """The same as DuckDB SQL."""
    parts = "".join(f" || ':' || ({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5('{seed}:{op}'{parts}), 1, 8))::BIGINT)"


def sql_uniform(seed: int, op: str, *keys: str) -> str:
    return f"(({sql_bits(seed, op, *keys)} + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def sql_normal(seed: int, op: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({sql_uniform(seed, op + '/a', *keys)})) * cos(2 * pi() * {sql_uniform(seed, op + '/b', *keys)}))"
