"""Reading and writing a fleet's artefact drops.

A drop is ``<root>/host=<name>/<file>``, one JSON file per kind with an array of objects (one object for the system).
Schemas are fixed, with the keys that the files really hold; builders rename them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import scalars as S

_SID = "`SID` string, `SIDName` string"
_WRITE = "`LastWriteTime` string, `LastWriteTimeUtc` string"
_TIMES = "`Created` string, `CreatedUtc` string, `Modified` string, `ModifiedUtc` string, `Accessed` string, `AccessedUtc` string"
_LINK = """`Path` string, `md5Source` string, `Target` string, `md5Target` string, `SourceCreated` string, `SourceCreatedUtc` string, `SourceModified` string,
  `SourceModifiedUtc` string, `SourceAccessed` string, `SourceAccessedUtc` string, `TargetCreated` string, `TargetCreatedUtc` string, `TargetModified` string,
  `TargetModifiedUtc` string, `TargetAccessed` string, `TargetAccessedUtc` string, `LNKFlags` string, `FileAttributes` string, `IconIndex` string,
  `CommandOption` string, `Description` string, `RelativePath` string, `WorkingDirectory` string, `Arguments` string, `IconLocation` string,
  `VolumeDrive Type` string, `VolumeSerial` string, `VolumeLabel` string, `NetName` string, `NetProviderType` string, `NetDeviceName` string, `IdList` variant"""


def _struct(ddl: str) -> str:
    """The same columns as a struct's."""
    return "struct<" + ", ".join(x.replace("` ", "`:", 1) for x in map(str.strip, ddl.split(", "))) + ">"


_EVENT = ["ProviderName", "ProviderGuid", "EventID", "Qualifiers", "Level", "Task", "Opcode", "Keywords", "TimeCreated", "EventRecordId", "ActivityID", "RelatedActivityID", "ProcessID", "ThreadID", "Channel", "Computer", "UserID", "Version"]

# File and keys of each kind.
KINDS: dict[str, tuple[str, str]] = {
    "system": ("OperatingSystem.json", "`OsArchitecture` string, `OsName` string, `ComputerName` string, `DomainName` string, `LocalDateTime` string, `LocalDateTimeUtc` string, `CurrentTimeZoneId` string, `CurrentTimeZoneCaption` string, `CurrentBias` string, `DaylightInEffect` string, `Version` string, `ServicePack` string"),
    "tasks": ("ScheduledTasks.json", "`Name` string, `Description` string, `Author` string, `Enabled` string, `RunAs` string, `RunAsSID` string, `Path` string, `State` string, `LastRun` string, `LastRunUtc` string, `NextRun` string, `NextRunUtc` string, `LastTaskResult` string, `NumberOfMissedRuns` string, `Actions` array<struct<`Type`:string, `Md5`:string, `Command`:string, `Arguments`:string, `ClassId`:string, `ClassId Name`:string, `data`:string>>, `Triggers` array<struct<`Type`:string, `Interval`:string>>"),
    "sessions": ("Sessions.json", "`SessionId` string, `SID` string, `LogonName` string, `LogonDomainName` string, `LogonType` string, `LogonTypeName` string, `AuthenticationPackage` string, `StartTime` string, `StartTimeUtc` string"),
    "processes": ("processes.json", "`Nom` string, `md5` string, `SID` string, `Owner` string, `PID` string, `PPId` string, `ModulesMessage` string, `Modules` array<string>"),
    "services": ("services.json", "`Name` string, `DislayName` string, `Status` string, `ProcessId` string, `AccessMessage` string, `StartType` string, `Owner` string, `Binary` string, `MD5` string"),
    "users": ("users.json", "`Name` string, `FullName` string, `SID` string, `Disabled` string, `Profile` string"),
    "events": ("events.json", ", ".join(f"`EvtSystem{k}` string" for k in _EVENT) + ", `EvtEventData` array<string>, `EvtEventMessage` string"),
    "usbstor": ("Usbstor.json", "`HardwareId` array<string>, `FriendlyName` string, `CompatibleIds` string, `ClassGuid` string, `SerialNumber` string, `LastInsertion` string, `LastInsertionUtc` string, `FirstInsertion` string, `FirstInsertionUtc` string"),
    "mounted_devices": ("mounted_device.json", "`Drive` string, `Device` string"),
    "bam": ("bams.json", f"{_SID}, `Name` string, `executionTime` string, `executionTimeUtc` string"),
    "muicache": ("muicache.json", f"{_SID}, `Name` string, `Data` string"),
    "amcache_app": ("amcache_applications.json", "`Name` string, `Publisher` string, `RootDirPath` string, `Version` string, `InstallDate` string, `InstallDateUtc` string"),
    "amcache_file": ("amcache_application_files.json", "`Name` string, `Publisher` string, `LongPath` string, `MD5` string, `Version` string, `LinkDate` string, `LinkDateUtc` string, `IsOsComponent` boolean"),
    "userassist": ("userassists.json", f"{_SID}, `Class` string, `Name` string, `Count` long, `FocusCount` long, `DateLocale` string, `DateLocaleUtc` string"),
    "run": ("run.json", f"{_SID}, `Key` string, `Name` string, `Value` string, {_WRITE}"),
    "shimcache": ("shimcache.json", "`Path` string, `MD5` string, `LastModification` string, `LastModificationUtc` string, `Executes` boolean"),
    "shellbags": ("shellbags.json", f"`ID` long, `Parent` long, {_SID}, `Source` string, {_WRITE}, `ShellItems` variant, `Childs` variant"),
    "mru": ("mrus.json", f"`ID` long, `Extension` string, {_SID}, `Source` string, {_WRITE}, `ShellItems` variant"),
    "mru_apps": ("mruApps.json", f"`ID` long, `Name` string, {_SID}, `Source` string, {_WRITE}, `ShellItems` variant"),
    "recent_docs": ("recentdocs.json", _LINK),
    "prefetch": ("prefetchs.json", f"`Path` string, `Hash` string, `Filename` string, `FullPath` string, `Md5` string, {_TIMES}, `RunCount` string, `NbVolumes` string, `NbFilesStrings` string, `Runs` array<string>, `RunsUtc` array<string>, `Volumes` array<struct<`DeviceName`:string, `SerialNumber`:string, `MountPoint`:string, `CreationTime`:string, `CreationTimeUtc`:string, `NbDirs`:string, `Dirs`:array<struct<`Dir`:string, `FullPath`:string>>>>, `FilesStrings` array<struct<`Filename`:string, `FullPath`:string, `Md5`:string>>"),
    "jumplist_auto": ("jumplistAutomaticDestinations.json", f"`File` string, {_SID}, `Application` string, {_TIMES}, `LNKs` array<{_struct(_LINK)}>"),
    "jumplist_custom": ("jumplistCustomDestinations.json", f"{_SID}, `Application` string, `Path` string, `Type` string, {_TIMES}, `recentDocs` array<{_struct(_LINK)}>"),
}

#: A whole string, or else a comma before a closing bracket, which some files have.
STRING_OR_TRAILING_COMMA = r'("(?:[^"\\]++|\\.)*+")|,(\s*[}\]])'


@dataclass(frozen=True)
class Options:
    """What a run computes besides the base columns."""

    dump: bool = False
    events: bool = False
    md5: bool = False
    out: str = "output"

    def kinds(self) -> list[str]:
        return [k for k in KINDS if self.events or k != "events"]

    def columns(self, df: DataFrame, content: str = "content") -> DataFrame:
        """Adds ``dump`` and ``md5`` of a content column if they are asked for."""
        if self.dump:
            df = df.withColumn("dump", S.hex_dump(F.col(content)))
        return df.withColumn("md5", S.md5_upper(F.col(content))) if self.md5 else df


def repair_json(text: Column) -> Column:
    """Without commas before closing brackets; those inside strings stay."""
    return F.regexp_replace(text, STRING_OR_TRAILING_COMMA, "$1$2")


def parse_drops(files: DataFrame, kind: str, repair: bool = True, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of whole-file texts, and the quarantine. A file is parsed as it stands; only one that fails is repaired and
    parsed again, so that a sound file's strings are never touched. Files that fail twice, single array elements that
    aren't objects, and empty files go to the quarantine with a reason. Of a key that an object repeats, as some items do,
    the last value counts. Other columns of files are carried along."""
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    whole = ArrayType(StructType.fromDDL(KINDS[kind][1]))
    array = F.when(F.startswith(F.ltrim(F.col(text)), F.lit("[")), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    fail = {"mode": "PERMISSIVE"}
    # An array that doesn't parse as strict variant JSON is not sound, whatever rows a lenient reader finds in it.
    parsed = files.withColumn("_json", array).withColumn("_v", F.try_parse_json("_json"))
    if repair:
        parsed = parsed.withColumn("_json", F.when(F.col("_v").isNotNull(), F.col("_json")).otherwise(repair_json(F.col("_json"))))
        parsed = parsed.withColumn("_v", F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.try_parse_json("_json")))
    parsed = parsed.withColumn("_items", F.try_variant_get("_v", "$", "array<variant>"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    parsed = parsed.withColumn("_plain", F.forall("_items", is_object))
    # All of a file comes out of one array, rows and what is wrong alike, and is told apart behind it: a test before it would parse the text again.
    row = lambda r, i: F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("text"), i.cast("int").alias("pos"), r.alias("r"))
    wrong = lambda reason, said: F.struct(F.lit(reason).alias("reason"), said.alias("text"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast(whole.elementType).alias("r"))
    only = lambda reason: F.array(wrong(reason, F.col(text)))
    one = lambda v: F.get(F.from_json(F.concat(F.lit("["), F.to_json(v), F.lit("]")), whole, fail), F.lit(0))
    # Elements one by one only where some of them aren't objects.
    each = lambda v, i: F.when(is_object(v), row(one(v), i)).otherwise(wrong("not an object", F.coalesce(F.to_json(v), F.lit("null"))))
    found = F.when(F.col("_plain"), F.transform(F.from_json("_json", whole, fail), row)).otherwise(F.transform("_items", each))
    blank = ~F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    out = F.when(blank, only("empty file")).when(F.col("_v").isNull(), only("invalid JSON")).otherwise(F.coalesce(found, only("not an array of objects")))
    carried = [c for c in files.columns if c != text]
    # Outer, since Spark would test for empty arrays before it otherwise.
    every = parsed.select(*carried, F.explode_outer(out).alias("_o"))
    rows = every.filter(F.col("_o.reason").isNull() & F.col("_o.r").isNotNull()).select(*carried, "_o.pos", "_o.r.*")
    return rows, every.filter(F.col("_o.reason").isNotNull()).select(*carried, "_o.reason", "_o.text")


def read_artefact(spark: SparkSession, root: str, kind: str, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows and quarantine of one kind for all hosts under root; ``host`` comes from the folder. The system's file may
    also lie in the root's ``default`` folder next to it, as older collectors put it there."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", KINDS[kind][0]).text(root)
    files = files.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("collected_at"))
    files = files.withColumn("host", F.regexp_extract("source_file", r"/host=([^/]+)/", 1))
    return parse_drops(files, kind, repair)


def write_artefact(df: DataFrame, out: str, kind: str, fmt: str = "parquet") -> str:
    """One dataset per kind, partitioned by host; what was there goes."""
    path = f"{out}/{kind}"
    df.write.mode("overwrite").partitionBy("host").format(fmt).save(path)
    return path


#: Glob of each raw kind.
RAW_KINDS = {"lnk": "*.{lnk,LNK}", "url": "*.{url,URL}", "prefetch": "*.{pf,PF}", "jumplist_auto": "*.automaticDestinations-ms", "jumplist_custom": "*.customDestinations-ms", "txt": "*.txt"}


def read_binary(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Raw files of a kind: path, modificationTime, length, content, host and the owner's profile from the path."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", RAW_KINDS[kind]).option("recursiveFileLookup", True).load(root)
    return d.withColumn("host", F.regexp_extract("path", r"/host=([^/]+)/", 1)).withColumn("owner", F.regexp_extract("path", r"/Users/([^/]+)/", 1))


REG_VALUES = "host string, hive string, sid string, key_path string, value_name string, value_type string, data binary, key_last_write timestamp"


def reg_typed(reg: DataFrame) -> DataFrame:
    """Registry values with their data decoded by type: ``text``, ``texts``, ``flag``, ``number``, ``filetime``; null where
    another type applies."""
    kind, data = F.col("value_type"), F.col("data")
    size = F.octet_length(data)
    return reg.withColumns({
        "text": F.when(kind.isin("REG_SZ", "REG_EXPAND_SZ"), S.utf16_z(data)),
        "texts": F.when(kind == "REG_MULTI_SZ", S.multi_sz(data)),
        "flag": F.when(kind.isin("REG_DWORD", "REG_BINARY") & (size > 0), S.le_uint(data, 0, 1) != 0),
        "number": F.when((kind == "REG_DWORD") & (size == 4), S.le_uint(data, 0, 4)).when((kind == "REG_QWORD") & (size == 8), S.le_uint(data, 0, 8)),
        "filetime": F.when(kind.isin("REG_BINARY", "REG_QWORD", "REG_FILETIME") & (size == 8), S.filetime_to_ts(S.le_uint(data, 0, 8))),
    })


def current_control_set(reg: DataFrame) -> DataFrame:
    """Only the keys of each host's current control set; those outside control sets stay. ``Select\\Current`` names it."""
    number = S.le_uint(F.col("data"), 0, 4).cast("string")
    current = reg.filter(F.col("key_path").rlike(r"(?i)(^|\\)Select$") & (F.lower("value_name") == "current"))
    current = current.select(F.col("host").alias("_host"), F.concat(F.lit("ControlSet"), F.lpad(number, 3, "0")).alias("_set")).dropDuplicates(["_host"])
    own = F.regexp_extract("key_path", r"(?i)^(?:SYSTEM\\)?(ControlSet[0-9]{3})(?:\\|$)", 1)
    return reg.join(current, reg["host"] == current["_host"], "left").filter((own == "") | (F.lower(own) == F.lower("_set"))).drop("_host", "_set")


#: Layout of event tables: the folders, in order.
EVENT_LAYOUT = ["host", "channel", "day"]


def write_events(events: DataFrame, root: str, time: str = "time_created") -> None:
    """Event rows below host, channel and day of their instant (null instants have a folder of their own), sorted by record in each file. Folders
    of any share of the rows are split over tasks, and small ones share a task, so that neither one task nor many small files come of it."""
    d = events.withColumn("day", F.to_date(time))
    d.hint("rebalance", *EVENT_LAYOUT).sortWithinPartitions(*EVENT_LAYOUT, "record_id").write.mode("overwrite").partitionBy(*EVENT_LAYOUT).parquet(root)


def read_events(spark: SparkSession, root: str, columns: list[str] | None = None, channels: list[str] | None = None, days: tuple[str, str] | None = None, hosts: DataFrame | None = None) -> DataFrame:
    """Event rows of all hosts and channels, kept as Parquet; splittable, with its columns pruned. Of a layout that write_events() made, only the
    folders of the channels and days (first and last) are listed, and with hosts (a table with a filter on its rows) only those of its
    hosts are read, which is found out as the query runs."""
    d = spark.read.parquet(root)
    if channels is not None:
        d = d.filter(F.col("channel").isin(channels))
    if days is not None:
        d = d.filter(F.col("day").between(*(F.lit(x).cast("date") for x in days)))
    if hosts is not None:
        d = d.join(hosts.select("host").distinct(), "host")
    return d.select(*columns) if columns else d


def gate(df: DataFrame, good: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with a reason. Null counts as not passing."""
    ok = F.coalesce(good, F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit(reason))


