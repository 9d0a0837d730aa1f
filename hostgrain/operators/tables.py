"""Typed artefact tables.

build_<kind>(bronze, ...) turns a kind's rows, as the files hold them, into a typed table; <kind>_from_registry(reg)
does so from raw registry values. Instants are true UTC: of each pair of texts the one is parsed that holds it, which
differs by artefact (table INSTANTS). Numbers in quotes are cast; what can't be cast is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.artefacts import reg_typed
from . import lookups as L
from . import nested as N
from .decode import bam_time, mounted_device, userassist_columns

#: Which of the two texts holds true UTC: the one named ``...Utc`` (its raw time was UTC and converted to local, or it was
#: local and converted to UTC), or the plain one (its raw time was UTC and taken for local).
INSTANTS = {
    "tasks": "utc", "sessions": "plain", "usbstor": "plain", "bam": "plain", "amcache_app": "utc", "amcache_file": "utc", "userassist": "plain", "run": "utc",
    "shimcache": "plain", "shellbags": "utc", "mru": "utc", "mru_apps": "utc", "recent_docs.Source": "utc", "recent_docs.Target": "plain",
    "jumplist_auto": "utc", "jumplist_custom": "utc", "prefetch": "utc",
}


def instant(kind: str, column: str) -> Column:
    return S.parse_display_time(F.col(column + "Utc" if INSTANTS[kind] == "utc" else column))


def _int(column: str) -> Column:
    return F.col(column).try_cast("int")


def _long(column: str) -> Column:
    return F.col(column).try_cast("bigint")


def build_system(b: DataFrame) -> DataFrame:
    return b.select(
        "host", F.col("OsArchitecture").alias("os_arch"), F.col("OsName").alias("os_name"), F.col("ComputerName").alias("computer"),
        F.coalesce(F.nullif(F.trim("DomainName"), F.lit("")), F.lit("WORKGROUP")).alias("domain"),
        S.parse_display_time(F.col("LocalDateTime")).alias("local_ts"), S.parse_display_time(F.col("LocalDateTimeUtc")).alias("utc_ts"),
        F.col("CurrentTimeZoneId").alias("tz_id"), F.col("CurrentTimeZoneCaption").alias("tz_caption"), _int("CurrentBias").alias("bias"),
        S.text_bool(F.col("DaylightInEffect")).alias("dst"), F.col("Version").alias("version"), F.col("ServicePack").alias("sp"),
    )


def version_text(major: Column, minor: Column, build: Column) -> Column:
    return F.concat_ws(".", major.cast("string"), minor.cast("string"), build.cast("string"))


def total_bias(bias: Column, dst: Column, daylight: Column, standard: Column) -> Column:
    return bias + F.when(dst, daylight).otherwise(standard)


def build_tasks(b: DataFrame, users: DataFrame) -> DataFrame:
    """users: host, sid, name; fills a missing SID by the account's name."""
    u = users.select(F.col("host").alias("_host"), F.lower("name").alias("_name"), F.col("sid").alias("_sid")).dropDuplicates(["_host", "_name"])
    account = F.lower(F.element_at(F.split("RunAs", r"\\"), -1))
    d = b.join(u, (b["host"] == u["_host"]) & (account == u["_name"]), "left")
    return d.select(
        "host", F.col("Name").alias("name"), F.col("Description").alias("descr"), F.col("Author").alias("author"), S.text_bool(F.col("Enabled")).alias("enabled"),
        F.col("RunAs").alias("run_as"), F.coalesce(F.nullif("RunAsSID", F.lit("")), "_sid", F.lit("")).alias("run_as_sid"), F.col("Path").alias("path"), F.col("State").alias("state"),
        instant("tasks", "LastRun").alias("last_run"), instant("tasks", "NextRun").alias("next_run"), _long("LastTaskResult").alias("last_result"),
        _int("NumberOfMissedRuns").alias("missed"), F.col("Actions").alias("actions"), F.col("Triggers").alias("triggers"),
    )


def build_task_actions(tasks: DataFrame, guids: DataFrame) -> DataFrame:
    """Exec actions have command, arguments and md5, COM handlers class and data; a task without actions has one empty row."""
    d = N.flatten(tasks.select("host", F.col("path").alias("task_path"), "actions"), "actions")
    d = d.select("host", "task_path", "pos", F.col("item.Type").alias("type"), F.col("item.Command").alias("command"), F.col("item.Arguments").alias("arguments"), F.col("item.Md5").alias("md5"), F.col("item.ClassId").alias("class_id"), F.col("item.data").alias("data"))
    d = L.guid_names(d, "class_id", guids, "class_name")
    exec_ = F.col("command").isNotNull()
    return d.select("host", "task_path", "pos", "type", "command", F.when(exec_, F.col("arguments")).alias("arguments"), F.when(exec_, F.col("md5")).alias("md5"), "class_id", F.when(F.col("class_id").isNotNull(), F.col("class_name")).alias("class_name"), F.when(F.col("class_id").isNotNull(), F.col("data")).alias("data"))


def build_task_triggers(tasks: DataFrame) -> DataFrame:
    d = N.flatten(tasks.select("host", F.col("path").alias("task_path"), "triggers"), "triggers")
    return d.select("host", "task_path", "pos", F.col("item.Type").alias("type"), F.when(F.upper("item.Type").contains("TIME"), F.col("item.Interval")).alias("interval"))


def build_sessions(b: DataFrame) -> DataFrame:
    code = _int("LogonType")
    return b.select(
        "host", _long("SessionId").alias("session_id"), F.col("SID").alias("sid"), F.col("LogonName").alias("logon_name"), F.col("LogonDomainName").alias("domain"), code.alias("logon_type"),
        F.coalesce(F.nullif("LogonTypeName", F.lit("")), L.code_label("logon_type", code)).alias("logon_type_name"), F.col("AuthenticationPackage").alias("auth_pkg"),
        instant("sessions", "StartTime").alias("start_ts"),
    )


def build_processes(b: DataFrame) -> DataFrame:
    return b.select("host", _int("PID").alias("pid"), _int("PPId").alias("ppid"), F.col("Nom").alias("name"), F.col("md5"), F.col("SID").alias("sid"), F.col("Owner").alias("owner"), F.col("ModulesMessage").alias("modules_message"))


def build_process_modules(b: DataFrame) -> DataFrame:
    """The module at position 0 is the executable."""
    return b.select("host", _int("PID").alias("pid"), F.posexplode("Modules").alias("pos", "path"))


def build_services(b: DataFrame) -> DataFrame:
    return b.select(
        "host", F.col("Name").alias("name"), F.col("DislayName").alias("display"), F.col("Status").alias("status"), _int("ProcessId").alias("pid"), F.col("StartType").alias("start_type"),
        F.col("Owner").alias("owner"), F.col("Binary").alias("command"), S.exe_path(F.col("Binary")).alias("binary"), F.col("MD5").alias("md5"), F.col("AccessMessage").alias("access_message"),
    )


def build_users(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("Name").alias("name"), F.col("FullName").alias("full_name"), F.col("SID").alias("sid"), S.text_bool(F.col("Disabled")).alias("disabled"), F.col("Profile").alias("profile"))


# Fixed value: the flag of a disabled account.
ACCOUNT_DISABLED = 0x2


def account_disabled(flags: Column) -> Column:
    return flags.bitwiseAND(ACCOUNT_DISABLED) != 0


def build_usbstor(b: DataFrame) -> DataFrame:
    return b.select(
        "host", F.col("HardwareId").alias("hardware_id"), F.col("FriendlyName").alias("friendly_name"), F.col("CompatibleIds").alias("compatible_ids"), F.col("ClassGuid").alias("class_guid"),
        F.col("SerialNumber").alias("serial"), instant("usbstor", "FirstInsertion").alias("first_ts"), instant("usbstor", "LastInsertion").alias("last_ts"),
    )


def usbstor_from_registry(reg: DataFrame) -> DataFrame:
    """Devices below ``Enum\\USBSTOR\\<vendor>\\<serial>``; their values and, from property subkeys, first and last insertion."""
    inside = r"(?i)Enum\\USBSTOR\\([^\\]+)\\([^\\]+)"
    d = reg_typed(reg.filter(F.col("key_path").rlike(inside))).withColumn("vendor", F.regexp_extract("key_path", inside, 1)).withColumn("serial", F.regexp_extract("key_path", inside, 2))
    leaf = F.upper(F.element_at(F.split("key_path", r"\\"), -1))

    def value(name: str, column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.lower("value_name") == name.lower(), F.col("key_path"))).alias(name)

    first, last = F.max(F.when(leaf == "0064", F.col("filetime"))), F.max(F.when(leaf == "0066", F.col("filetime")))
    out = d.groupBy("host", "vendor", "serial").agg(value("HardwareID", "texts"), value("FriendlyName", "text"), value("CompatibleIDs", "texts"), value("ClassGUID", "text"), first.alias("first_ts"), last.alias("last_ts"))
    return out.select("host", F.col("HardwareID").alias("hardware_id"), F.col("FriendlyName").alias("friendly_name"), F.array_join("CompatibleIDs", ", ").alias("compatible_ids"), F.col("ClassGUID").alias("class_guid"), "serial", "first_ts", "last_ts")


def build_mounted_devices(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("Drive").alias("drive"), F.col("Device").alias("device"))


def mounted_devices_from_registry(reg: DataFrame) -> DataFrame:
    return reg.filter(F.col("key_path").rlike(r"(?i)(^|\\)MountedDevices$")).select("host", F.col("value_name").alias("drive"), mounted_device(F.col("data")).alias("device"))


def build_bam(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Name").alias("name"), instant("bam", "executionTime").alias("exec_ts"))


def bam_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    """Both places that hold such values, told apart by ``source``."""
    p = r"(?i)\\(bam(?:\\state)?)\\UserSettings\\(S-1-[0-9-]+)$"
    d = reg.filter((F.col("value_type") == "REG_BINARY") & F.col("key_path").rlike(p))
    d = d.select("host", F.regexp_extract("key_path", p, 2).alias("sid"), F.col("value_name").alias("name"), bam_time(F.col("data")).alias("exec_ts"), F.lower(F.regexp_extract("key_path", p, 1)).alias("source"))
    return L.sid_names(d, users)


def build_muicache(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Name").alias("name"), F.col("Data").alias("data"))


def muicache_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    d = reg_typed(reg.filter((F.col("value_type") == "REG_SZ") & F.col("key_path").rlike(r"(?i)\\MuiCache$")))
    return L.sid_names(d.select("host", "sid", F.col("value_name").alias("name"), F.col("text").alias("data")), users)


def build_amcache_app(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("Name").alias("name"), F.col("Publisher").alias("publisher"), F.col("RootDirPath").alias("root_dir"), F.col("Version").alias("version"), instant("amcache_app", "InstallDate").alias("install_ts"))


def build_amcache_file(b: DataFrame) -> DataFrame:
    return b.select(
        "host", F.col("Name").alias("name"), F.col("Publisher").alias("publisher"), F.col("LongPath").alias("long_path"), F.col("MD5").alias("md5"), F.col("Version").alias("version"),
        instant("amcache_file", "LinkDate").alias("link_ts"), F.col("IsOsComponent").alias("is_os_component"),
    )


def build_userassist(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Class").alias("class"), F.col("Name").alias("name"), F.col("Count").alias("count"), F.col("FocusCount").alias("focus_count"), instant("userassist", "DateLocale").alias("last_ts"))


# The two UserAssist classes, of executables and of shortcuts.
USERASSIST_CLASSES = ["{CEBFF5CD-ACE2-4F4F-9178-9926F41749EA}", "{F4E57C4B-2036-45F0-A9AB-443BCFE33D9F}"]


def userassist_from_registry(reg: DataFrame, users: DataFrame, guids: DataFrame) -> DataFrame:
    p = r"(?i)\\UserAssist\\(\{[0-9A-F-]{36}\})\\Count$"
    d = reg.filter(F.col("key_path").rlike(p)).withColumn("class", F.upper(F.regexp_extract("key_path", p, 1))).filter(F.col("class").isin(USERASSIST_CLASSES))
    d = d.select("host", "sid", "class", *(c.alias(n) for n, c in userassist_columns(F.col("value_name"), F.col("data")).items()))
    return L.sid_names(L.replace_guids(d, "name", guids), users)


def build_run(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Key").alias("key"), F.col("Name").alias("name"), F.col("Value").alias("value"), instant("run", "LastWriteTime").alias("key_last_write"))


def run_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    """Run and RunOnce of the machine (no SID, named HKLM) and of every user; text values only."""
    d = reg_typed(reg.filter((F.col("value_type") == "REG_SZ") & F.col("key_path").rlike(r"(?i)\\CurrentVersion\\(Run|RunOnce)$")))
    d = d.select("host", F.coalesce("sid", F.lit("")).alias("sid"), F.col("key_path").alias("key"), F.col("value_name").alias("name"), F.col("text").alias("value"), "key_last_write")
    return L.sid_names(d, users).withColumn("sid_name", F.when(F.col("sid") == "", "HKLM").otherwise(F.col("sid_name")))


def build_shimcache(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("Path").alias("path"), F.col("MD5").alias("md5"), instant("shimcache", "LastModification").alias("last_mod_ts"), F.col("Executes").alias("executed"), "pos")


def _is_archive_item(item: Column) -> Column:
    name = F.try_variant_get(item, "$.Name", "string")
    return F.coalesce((F.try_variant_get(item, "$.Type", "string") != "ArchiveContent") & S.is_archive(name, F.lit(True)), F.lit(False))


def shell_items(df: DataFrame, column: str = "items") -> DataFrame:
    """One row per item: ``pos``, ``item_type``, ``name`` and ``in_archive``: an archive comes earlier in the list, or the row
    has the flag from the nodes above it, as build_shellbags() gives it."""
    above = F.coalesce("in_archive", F.lit(False)) if "in_archive" in df.columns else F.lit(False)
    d = df.withColumn("_items", F.col(column).cast("array<variant>"))
    d = d.withColumns({"_first": F.array_position(F.transform("_items", _is_archive_item), True), "_above": above})
    own = [c for c in df.columns if c not in (column, "in_archive")]
    rows = d.select(*own, "_first", "_above", F.posexplode("_items").alias("pos", "_i"))
    after = F.col("_above") | ((F.col("_first") > 0) & (F.col("pos") >= F.col("_first")))
    return rows.select(*own, "pos", F.try_variant_get("_i", "$.Type", "string").alias("item_type"), F.try_variant_get("_i", "$.Name", "string").alias("name"), after.alias("in_archive"))


def build_shellbags(b: DataFrame) -> DataFrame:
    """The recursive bags as rows: node_path, depth, parent, mru_pos (place in its parent's list, whose order is that of use; null
    for roots), in_archive (a node above holds an archive), and each node's own values."""
    d = b.select("host", F.col("SID").alias("sid"), F.to_json(F.struct("ID", "Parent", "Source", "LastWriteTime", "LastWriteTimeUtc", "ShellItems", "Childs")).alias("j"))
    holds = lambda v: F.exists(F.try_variant_get(v, "$.ShellItems", "array<variant>"), _is_archive_item)
    fields = {"ID": "bigint", "Source": "string", "LastWriteTime": "string", "LastWriteTimeUtc": "string", "ShellItems": "variant"}
    t = N.variant_tree(d, "j", ["host", "sid"], "Childs", fields, position="mru_pos", inherit={"in_archive": holds})
    return t.select("host", "sid", F.col("Source").alias("source"), "node_path", F.col("ID").alias("id"), "parent", "depth", "mru_pos", instant("shellbags", "LastWriteTime").alias("key_last_write"), "in_archive", F.col("ShellItems").alias("items"))


def mru_positions(order: Column) -> Column:
    """Numbers of an MRUListEx value, most recent first, up to its terminator."""
    return N.take_until(order, F.lit(-1))


def build_mru(b: DataFrame) -> DataFrame:
    return b.filter("Extension <> '*'").select("host", F.col("ID").alias("id"), F.col("Extension").alias("extension"), F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Source").alias("source"), instant("mru", "LastWriteTime").alias("key_last_write"), F.col("ShellItems").alias("items"))


def build_mru_apps(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("ID").alias("id"), F.col("Name").alias("name"), F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Source").alias("source"), instant("mru_apps", "LastWriteTime").alias("key_last_write"), F.col("ShellItems").alias("items"))


def link_columns(get=F.col) -> list[Column]:
    """Columns of a shell link's row."""
    def when(side: str, what: str) -> Column:
        utc = INSTANTS[f"recent_docs.{side}"] == "utc"
        return S.parse_display_time(get(f"{side}{what}Utc" if utc else f"{side}{what}")).alias(f"{side.lower()}_{what.lower()}_ts")

    def split(name: str, out: str) -> Column:
        return F.filter(F.split(get(name), ", "), lambda x: x != "").alias(out)

    plain = {"Path": "path", "md5Source": "md5_source", "Target": "target", "md5Target": "md5_target", "CommandOption": "show_cmd", "Description": "descr", "RelativePath": "rel_path", "WorkingDirectory": "work_dir", "Arguments": "args", "IconLocation": "icon_loc", "VolumeDrive Type": "drive_type", "VolumeLabel": "vol_label", "NetName": "net_name", "NetProviderType": "net_provider", "NetDeviceName": "net_device", "IdList": "items"}
    return [
        *(get(k).alias(v) for k, v in plain.items()), *(when(s, w) for s in ("Source", "Target") for w in ("Created", "Modified", "Accessed")),
        split("LNKFlags", "flags"), split("FileAttributes", "attrs"), get("IconIndex").try_cast("int").alias("icon_index"), S.serial_normal(F.nullif(get("VolumeSerial"), F.lit(""))).alias("vol_serial"),
    ]


def build_recent_docs(b: DataFrame) -> DataFrame:
    owner = F.regexp_extract(F.replace("Path", F.lit("\\"), F.lit("/")), r"(?i)/Users/([^/]+)/", 1)
    return b.select("host", owner.alias("owner"), *link_columns(lambda c: F.col(f"`{c}`")))


def _file_times(kind: str) -> list[Column]:
    return [instant(kind, w).alias(f"{w.lower()}_ts") for w in ("Created", "Modified", "Accessed")]


def build_jumplist_auto(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("File").alias("file"), F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Application").alias("application"), *_file_times("jumplist_auto"), F.transform("LNKs", lambda x: F.struct(*link_columns(lambda c: x[c]))).alias("lnks"))


def build_jumplist_custom(b: DataFrame) -> DataFrame:
    return b.select("host", F.col("Path").alias("file"), F.col("SID").alias("sid"), F.col("SIDName").alias("sid_name"), F.col("Application").alias("application"), F.col("Type").alias("type"), *_file_times("jumplist_custom"), F.transform("recentDocs", lambda x: F.struct(*link_columns(lambda c: x[c]))).alias("lnks"))


def app_id(file: Column) -> Column:
    """The application id of a jump-list file: its stem."""
    return F.lower(F.substring_index(F.element_at(F.split(F.replace(file, F.lit("/"), F.lit("\\")), r"\\"), -1), ".", 1))


def build_prefetch(b: DataFrame) -> DataFrame:
    runs = F.filter(F.transform(F.slice("RunsUtc", 1, 8), S.parse_display_time), lambda t: t.isNotNull())
    files = F.transform("FilesStrings", lambda f: F.struct(f["Filename"].alias("file"), f["FullPath"].alias("path"), f["Md5"].alias("md5")))
    volumes = F.transform("Volumes", lambda v: F.struct(v["DeviceName"].alias("device"), S.serial_kept(v["SerialNumber"]).alias("serial"), v["MountPoint"].alias("mount"), S.parse_display_time(v["CreationTimeUtc"]).alias("created_ts"), F.size(v["Dirs"]).alias("n_dirs"), v["Dirs"].alias("dirs")))
    own = N.last_match(F.col("FilesStrings"), lambda f: F.upper(S.base_name(f["Filename"])) == F.upper(F.col("Filename")))
    return b.select(
        "host", F.col("Path").alias("path"), S.serial_kept(F.col("Hash")).alias("hash"), F.col("Filename").alias("filename"), F.coalesce(own["FullPath"], F.col("FullPath")).alias("full_path"), F.col("Md5").alias("md5"),
        *_file_times("prefetch"), _int("RunCount").alias("run_count"), runs.alias("runs"), volumes.alias("volumes"), files.alias("files"),
    )


def build_prefetch_runs(p: DataFrame) -> DataFrame:
    return p.select("host", "path", F.posexplode("runs").alias("pos", "run_ts"))


def build_prefetch_volumes(p: DataFrame) -> DataFrame:
    return p.select("host", "path", F.posexplode("volumes").alias("pos", "v")).select("host", "path", "pos", "v.device", "v.serial", "v.mount", "v.created_ts", "v.n_dirs")


def build_prefetch_dirs(p: DataFrame) -> DataFrame:
    d = p.select("host", "path", F.posexplode("volumes").alias("volume", "v"))
    return d.select("host", "path", "volume", F.posexplode("v.dirs").alias("pos", "d")).select("host", "path", "volume", "pos", F.col("d.Dir").alias("dir"), F.col("d.FullPath").alias("full_path"))


def build_prefetch_files(p: DataFrame) -> DataFrame:
    return p.select("host", "path", F.posexplode("files").alias("pos", "f")).select("host", "path", "pos", "f.file", F.col("f.path").alias("full_path"), "f.md5")


def prefetch_from_files(decoded: DataFrame, letters: Column | None = None) -> DataFrame:
    """Rows decoded from raw files: device names of paths give way to the mount point of the first volume that fits."""
    from .lookups import volume_of

    def path_of(f: Column) -> Column:
        v = volume_of(f, F.col("volumes"))
        mount = F.element_at(letters, v["serial"]) if letters is not None else F.lit(None).cast("string")
        return F.when(v.isNotNull() & mount.isNotNull(), F.replace(f, v["device"], mount)).otherwise(f)

    paths = F.transform("files", lambda f: F.struct(f.alias("file"), path_of(f).alias("path")))
    own = N.last_match(F.col("_paths"), lambda f: F.upper(S.base_name(f["file"])) == F.upper(F.col("name")))
    d = decoded.withColumn("_paths", paths)
    return d.select(*(c for c in decoded.columns if c not in ("runs",)), own["path"].alias("full_path"), F.transform("runs", S.filetime_to_ts).alias("runs"), F.col("_paths").alias("paths")).drop("files")


def build_events(b: DataFrame) -> DataFrame:
    """Times before 1970 are the marks of a defect of the source and become null."""
    p = "EvtSystem"
    time = S.parse_display_time(F.col(p + "TimeCreated"))
    ints = {"EventID": "event_id", "Qualifiers": "qualifiers", "Level": "level", "Task": "task", "Opcode": "opcode", "ProcessID": "pid", "ThreadID": "tid", "Version": "version"}
    texts = {"ProviderName": "provider", "ProviderGuid": "provider_guid", "Keywords": "keywords", "ActivityID": "activity_id", "RelatedActivityID": "related_id", "Channel": "channel", "Computer": "computer", "UserID": "user_sid"}
    return b.select(
        "host", *(_int(p + k).alias(v) for k, v in ints.items()), *(F.col(p + k).alias(v) for k, v in texts.items()), _long(p + "EventRecordId").alias("record_id"),
        F.when(F.year(time) >= 1970, time).alias("time_created"), F.col("EvtEventData").alias("event_data"), F.col("EvtEventMessage").alias("message"),
    )
