"""Filters and gates that table builders and queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(df: DataFrame, kind: str, *wanted: str) -> DataFrame:
    """Rows whose type column, such as that of registry values, is one of the wanted; rows without a type go."""
    return df.filter(F.col(kind).isin(*wanted))


def extension(path: Column) -> Column:
    """Lower-case extension of a path or url, letters only, without its dot; empty without any, null of null."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def with_extension(df: DataFrame, path: str, *wanted: str) -> DataFrame:
    return df.filter(extension(F.col(path)).isin(*(w.lower().lstrip(".") for w in wanted)))


def has_signature(content: Column, signature: Column) -> Column:
    """Whether bytes begin with a signature; null if either is null, and false for shorter contents."""
    return F.startswith(content.cast("binary"), signature.cast("binary"))


def quarantine(df: DataFrame, value: str, kind: str, out: str, reason: str = "reason") -> DataFrame:
    """Adds out, the value as kind, and why it is none: ``missing``, ``not a <kind>``, or null where it is one."""
    typed = df.withColumn(out, F.col(value).try_cast(kind))
    return typed.withColumn(reason, F.when(F.col(value).isNull(), "missing").when(F.col(out).isNull(), f"not a {kind}"))


def with_profile(users: DataFrame, has: Column) -> DataFrame:
    """Users that have a profile; those of whom it isn't known go."""
    return users.filter(has)


def counter(flag: Column, if_set: str, otherwise: str) -> Column:
    """Of two places where a counter may stand, the one that the flag tells; the other if the flag is null."""
    return F.when(flag, F.col(if_set)).otherwise(F.col(otherwise))
