"""Inventories of programs from registry values: applications, their files, and the compatibility cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.artefacts import reg_typed
from . import decode as B

# Keys and names of values of the inventories.
APPLICATIONS, FILES = "InventoryApplication", "InventoryApplicationFile"
APPLICATION_VALUES = {"Name": "name", "Publisher": "publisher", "RootDirPath": "root_dir", "Version": "version", "InstallDate": "_date"}
FILE_VALUES = {"Name": "name", "Publisher": "publisher", "LowerCaseLongPath": "long_path", "Version": "version", "LinkDate": "_date", "IsOsComponent": "_flag"}
COMPATIBILITY_CACHE = "AppCompatCache"


def values_as_columns(reg: DataFrame, key: str, names: dict[str, str], value: Column) -> DataFrame:
    """One row for each key right below one of the name key: host, id (the key's own name) and a column for each named value, null
    where the key hasn't got it. Names are told apart whatever their case; of a value that is there twice, the greatest. Texts are summed up
    by a sort, so rows are dealt by key before it: a task sorts a share of the keys, not all of the input that it reads. Of a value only what is shown moves."""
    d = reg.filter(F.col("key_path").rlike(rf"(?i)(^|\\){key}\\[^\\]+$"))
    keys = ["host", "hive", "key_path"]
    d = d.select(*keys, F.lower("value_name").alias("_name"), value.alias("_value")).repartition(*keys)
    of = lambda n: F.max(F.when(F.col("_name") == n.lower(), F.col("_value")))
    return d.groupBy(*keys).agg(*(of(n).alias(c) for n, c in names.items())).select("host", F.element_at(F.split("key_path", r"\\"), -1).alias("id"), *names.values())


def _text() -> Column:
    """A value as text: strings as they are, flags and numbers by their first byte."""
    return F.coalesce("text", F.col("flag").cast("string"))


def amcache_apps_from_registry(reg: DataFrame) -> DataFrame:
    """host, id, name, publisher, root_dir, version, install_ts of each application. Dates are texts without a zone, read as they stand."""
    d = values_as_columns(reg_typed(reg), APPLICATIONS, APPLICATION_VALUES, _text())
    return d.withColumn("install_ts", S.parse_us_date(F.col("_date"))).drop("_date")


def amcache_files_from_registry(reg: DataFrame) -> DataFrame:
    """host, id, name, publisher, long_path, version, link_ts, is_os_component of each application's file."""
    d = values_as_columns(reg_typed(reg), FILES, FILE_VALUES, _text())
    return d.withColumns({"link_ts": S.parse_us_date(F.col("_date")), "is_os_component": F.col("_flag").try_cast("boolean")}).drop("_date", "_flag")


def shimcache_from_registry(reg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """host, pos, path, last_mod_ts, executed of each record of the compatibility caches, and the quarantine: host and reason. reg: of the current control
    set, as current_control_set() leaves it. Of a damaged cache the records before the damage stay."""
    d = reg.filter(F.col("key_path").rlike(rf"(?i)\\{COMPATIBILITY_CACHE}$") & (F.lower("value_name") == COMPATIBILITY_CACHE.lower()) & (F.col("value_type") == "REG_BINARY"))
    good, bad = B.split_errors(B.decode_shimcache(d, "data", ["host"]))
    return good.select("host", "pos", "path", S.filetime_to_ts(F.col("ticks")).alias("last_mod_ts"), "executed"), bad.select("host", F.col("error").alias("reason"))
