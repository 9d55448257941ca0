"""Keyed pseudonyms for identifier columns and default-deny column policies."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "\x1f"


def surrogate(col: Column, namespace: str, prefix: str, salt: str, width: int = 8) -> Column:
    """PREFIX + ``width`` digits derived from a salted SHA-256, inside the JVM.

    Null stays null and '' stays ''.  The same value in the same namespace
    always maps to the same surrogate, so joins survive.
    """
    text = col.cast("string")
    digest = F.sha2(F.concat_ws(SEPARATOR, F.lit(salt), F.lit(namespace), text), 256)
    number = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(10**width))
    code = F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
    return F.when(text.isNull(), None).when(text == "", "").otherwise(code)


def surrogate_blake2b(col: Column, namespace: str, prefix: str, salt: str, width: int = 8) -> Column:
    """The same contract with a keyed BLAKE2b digest (Arrow batches).

    Use it only where surrogates must match ones issued with that digest.
    """
    key = salt.encode()[:64]

    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            h = hashlib.blake2b(f"{namespace}{SEPARATOR}{v}".encode(), key=key, digest_size=8)
            return f"{prefix}{int.from_bytes(h.digest(), 'big') % 10**width:0{width}d}"
        seen = values.dropna().unique()
        codes = {v: (one(v) if v else "") for v in seen}
        return pd.Series([codes.get(v) if isinstance(v, str) else None for v in values], dtype=object)

    return encode(col.cast("string"))


def pseudonymise(
    df: DataFrame, columns: dict[str, str], prefixes: dict[str, str], salt: str,
    width: int = 8, encode=surrogate,
) -> DataFrame:
    """Replace each listed column that exists by its surrogate.

    ``columns`` maps column -> namespace, ``prefixes`` namespace -> prefix.
    """
    return df.withColumns({
        c: encode(F.col(c), ns, prefixes[ns], salt, width)
        for c, ns in columns.items() if c in df.columns
    })


def keep_columns(df: DataFrame, keep: list[str], encoded: list[str], keep_prefixes: list[str] = ()) -> DataFrame:
    """Default-deny projection in source order."""
    allowed = set(keep) | set(encoded)
    return df.select([
        c for c in df.columns if c in allowed or any(c.startswith(p) for p in keep_prefixes)
    ])


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and rows per column, one row per column.

    Each column is first reduced to its distinct values by a plain group-by,
    so no task holds a distinct set.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    per_value = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("column").agg(
        F.count("value").alias("n_unique"), F.sum("n").alias("n_rows"))


def audit(df: DataFrame, expected: list[str]) -> DataFrame:
    """Rows, kept columns and missing columns of one written source."""
    missing = sorted(set(expected) - set(df.columns))
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(missing)).alias("missing"))
