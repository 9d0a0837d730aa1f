"""Lookups: labels of codes, names of SIDs and GUIDs, hashes of paths, parents of children.

Dimension tables that grow with the fleet (users, volumes, hashes) are joined without a hint, so that the
optimizer broadcasts them only if their measured size allows it; label tables of fixed size become literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_guid, serial_normal, serial_unpadded

# Labels of codes, from public documentation of the Windows API.
CODE_LABELS = {
    "drive_type": ["DRIVE_UNKNOWN", "DRIVE_NO_ROOT_DIR", "DRIVE_REMOVABLE", "DRIVE_FIXED", "DRIVE_REMOTE", "DRIVE_CDROM", "DRIVE_RAMDISK"],
    "logon_type": {
        0: "System", 2: "Interactive", 3: "Network", 4: "Batch", 5: "Service", 6: "Proxy", 7: "Unlock", 8: "NetworkCleartext",
        9: "NewCredentials", 10: "RemoteInteractive", 11: "CachedInteractive", 12: "CachedRemoteInteractive", 13: "CachedUnlock",
    },
    "service_start": ["SERVICE_BOOT_START", "SERVICE_SYSTEM_START", "SERVICE_AUTO_START", "SERVICE_DEMAND_START", "SERVICE_DISABLED"],
    "service_state": {
        1: "SERVICE_STOPPED", 2: "SERVICE_START_PENDING", 3: "SERVICE_STOP_PENDING", 4: "SERVICE_RUNNING", 5: "SERVICE_CONTINUE_PENDING",
        6: "SERVICE_PAUSE_PENDING", 7: "SERVICE_PAUSED",
    },
    "task_state": ["Unknown", "Disabled", "Queued", "Ready", "Running"],
    "task_action": {0: "Exec", 5: "ComHandler", 6: "SendEmail", 7: "ShowMessage"},
    "task_trigger": {
        0: "Event", 1: "Time", 2: "Daily", 3: "Weekly", 4: "Monthly", 5: "MonthlyDOW", 6: "Idle", 7: "Registration", 8: "Boot", 9: "Logon",
        11: "SessionStateChange", 12: "Custom",
    },
    "show_command": {1: "SW_SHOWNORMAL", 3: "SW_SHOWMAXIMIZED", 7: "SW_SHOWMINNOACTIVE"},
    "os_arch": {0: "x86", 5: "ARM", 6: "IA64", 9: "x64", 12: "ARM64"},
    "net_provider": {
        0x1A0000: "WNNC_NET_AVID", 0x1B0000: "WNNC_NET_DOCUSPACE", 0x1C0000: "WNNC_NET_MANGOSOFT", 0x1D0000: "WNNC_NET_SERNET",
        0x1E0000: "WNNC_NET_RIVERFRONT1", 0x1F0000: "WNNC_NET_RIVERFRONT2", 0x200000: "WNNC_NET_DECORB", 0x210000: "WNNC_NET_PROTSTOR",
        0x220000: "WNNC_NET_FJ_REDIR", 0x230000: "WNNC_NET_DISTINCT", 0x240000: "WNNC_NET_TWINS", 0x250000: "WNNC_NET_RDR2SAMPLE",
        0x260000: "WNNC_NET_CSC", 0x270000: "WNNC_NET_3IN1", 0x290000: "WNNC_NET_EXTENDNET", 0x2A0000: "WNNC_NET_STAC",
        0x2B0000: "WNNC_NET_FOXBAT", 0x2C0000: "WNNC_NET_YAHOO", 0x2D0000: "WNNC_NET_EXIFS", 0x2E0000: "WNNC_NET_DAV",
        0x2F0000: "WNNC_NET_KNOWARE", 0x300000: "WNNC_NET_OBJECT_DIRE", 0x310000: "WNNC_NET_MASFAX", 0x320000: "WNNC_NET_HOB_NFS",
        0x330000: "WNNC_NET_SHIVA", 0x340000: "WNNC_NET_IBMAL", 0x350000: "WNNC_NET_LOCK", 0x360000: "WNNC_NET_TERMSRV",
        0x370000: "WNNC_NET_SRT", 0x380000: "WNNC_NET_QUINCY", 0x390000: "WNNC_NET_OPENAFS", 0x3A0000: "WNNC_NET_AVID1",
        0x3B0000: "WNNC_NET_DFS", 0x3C0000: "WNNC_NET_KWNP", 0x3D0000: "WNNC_NET_ZENWORKS", 0x3E0000: "WNNC_NET_DRIVEONWEB",
        0x3F0000: "WNNC_NET_VMWARE", 0x400000: "WNNC_NET_RSFX", 0x410000: "WNNC_NET_MFILES", 0x420000: "WNNC_NET_MS_NFS", 0x430000: "WNNC_NET_GOOGLE",
    },
    "custom_category": ["Recent", "Frequent", "Tasks"],
    "custom_type": ["Custom category", "Known category", "User tasks"],
    "control_panel": [
        "All Control Panel Items", "Appearance and Personalization", "Hardware and Sound", "Network and Internet", "Sounds, Speech, and Audio Devices",
        "System and Security", "Clock, Language, and Region", "Ease of Access", "Programs", "User Accounts", "Security Center (Windows XP [SP2~SP3])",
        "Mobile PC (Windows Vista Mobile)",
    ],
    "service_type": {
        0x1: "SERVICE_KERNEL_DRIVER", 0x2: "SERVICE_FILE_SYSTEM_DRIVER", 0x10: "SERVICE_WIN32_OWN_PROCESS", 0x20: "SERVICE_WIN32_SHARE_PROCESS",
        0x50: "SERVICE_USER_OWN_PROCESS", 0x60: "SERVICE_USER_SHARE_PROCESS",
    },
    "net_subtype": {0x41: "Domain/Workgroup name", 0x42: "Server UNC path", 0x43: "Share UNC path", 0x46: "Microsoft Windows Network", 0x47: "Entire Network"},
    "sort_index": {
        0x00: "INTERNET_EXPLORER", 0x42: "LIBRARIES", 0x44: "USERS", 0x48: "MY_DOCUMENTS", 0x50: "MY_COMPUTER", 0x58: "MY_NETWORK_PLACES",
        0x60: "RECYCLE_BIN", 0x68: "INTERNET_EXPLORER", 0x70: "UNKNOWN", 0x80: "MY_GAMES",
    },
    "shell_item": {
        0x01: "ControlPanelCategory", 0x1F: "RootFolder", 0x2E: "Volume", 0x2F: "Volume", 0x31: "FileEntry", 0x32: "FileEntry", 0x35: "FileEntry", 0x36: "FileEntry",
        0x41: "Network", 0x42: "Network", 0x46: "Network", 0x47: "Network", 0x4C: "Network", 0x52: "ArchiveContent", 0x61: "URI",
        0x71: "ControlPanel", 0x74: "UsersFilesFolder", 0xC3: "Network",
    },
}

# Labels of codes without one.
DEFAULT_LABELS = {"drive_type": "BAD TYPE", "net_provider": "BAD NET PROVIDER", "show_command": "UNKOWN", "shell_item": "Unknown", "control_panel": "Unknown", "net_subtype": "Unknown", "custom_type": ""}

# Well-known security identifiers.
WELL_KNOWN_SIDS = {
    "S-1-0-0": "Nobody", "S-1-1-0": "Everyone", "S-1-5-18": "SYSTEM", "S-1-5-19": "LOCAL SERVICE", "S-1-5-20": "NETWORK SERVICE",
    "S-1-5-32-544": "Administrators", "S-1-5-32-545": "Users",
}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def code_label(domain: str, code: Column, default: str | None = None) -> Column:
    """Label of a number; what has none gets the domain's default."""
    labels = CODE_LABELS[domain]
    labels = labels if isinstance(labels, dict) else dict(enumerate(labels))
    return F.coalesce(F.element_at(_map(labels), code.cast("int")), F.lit(DEFAULT_LABELS.get(domain, "UNKNOWN") if default is None else default))


def label_join(df: DataFrame, code: str, labels: DataFrame, default: str, out: str = "label") -> DataFrame:
    """A label from a table (code, label) by left join; labels are one row per code."""
    dim = labels.select(F.col("code").alias("_code"), F.col("label").alias("_label")).dropDuplicates(["_code"])
    return df.join(dim, df[code] == dim["_code"], "left").drop("_code").withColumn(out, F.coalesce("_label", F.lit(default))).drop("_label")


def app_names(df: DataFrame, app_id: str, apps: DataFrame, out: str = "application") -> DataFrame:
    """Names of application ids, whatever their case; an id without one stands for itself. apps: app_id, name."""
    dim = apps.select(F.lower("app_id").alias("_app"), F.col("name").alias("_name")).dropDuplicates(["_app"])
    return df.join(dim, F.lower(df[app_id]) == dim["_app"], "left").withColumn(out, F.coalesce("_name", app_id)).drop("_app", "_name")


def sid_names(df: DataFrame, users: DataFrame, sid: str = "sid", out: str = "sid_name") -> DataFrame:
    """Account names by (host, sid), then well-known ones; otherwise empty text. users: host, sid, name."""
    dim = users.select(F.col("host").alias("_host"), F.col("sid").alias("_sid"), F.col("name").alias("_name")).dropDuplicates(["_host", "_sid"])
    joined = df.join(dim, (df["host"] == dim["_host"]) & (df[sid] == dim["_sid"]), "left")
    return joined.withColumn(out, F.coalesce("_name", F.element_at(_map(WELL_KNOWN_SIDS), F.col(sid)), F.lit(""))).drop("_host", "_sid", "_name")


def guid_names(df: DataFrame, guid: str, names: DataFrame, out: str = "guid_name", default: str = "") -> DataFrame:
    """Friendly names of GUIDs, whatever their case. names: guid, name."""
    dim = names.select(F.upper("guid").alias("_guid"), F.col("name").alias("_name")).dropDuplicates(["_guid"])
    return df.join(dim, F.upper(df[guid]) == dim["_guid"], "left").withColumn(out, F.coalesce("_name", F.lit(default))).drop("_guid", "_name")


def property_names(df: DataFrame, guid: str, id: str, names: DataFrame, out: str = "property") -> DataFrame:
    """Property names by (guid, id); otherwise ``(Undefined)``. names: guid, id, name."""
    dim = names.select(F.upper("guid").alias("_guid"), F.col("id").alias("_id"), F.col("name").alias("_name")).dropDuplicates(["_guid", "_id"])
    on = (F.upper(df[guid]) == dim["_guid"]) & (df[id] == dim["_id"])
    return df.join(dim, on, "left").withColumn(out, F.coalesce("_name", F.lit("(Undefined)"))).drop("_guid", "_id", "_name")


def replace_guids(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """The first GUID of a text, wherever it stands in it, gives way to its name; one without a name stays."""
    found = guid_names(df.withColumn("_first", first_guid(F.col(text))), "_first", names, "_label", "")
    return found.withColumn(text, F.when(F.col("_label") != "", F.replace(text, F.col("_first"), F.col("_label"))).otherwise(F.col(text))).drop("_first", "_label")


def expected_keys(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every registry key that should exist: profiles times the catalogue of keys, which is a few dozen rows that the user gives,
    whatever the fleet's size."""
    return profiles.crossJoin(catalog)


def entry_streams(entries: DataFrame, streams: DataFrame, keys: list[str], number: str = "entry_no", name: str = "stream", stop_at_gap: str | None = None) -> DataFrame:
    """Jump-list entries with their streams, by the hexadecimal of the entry's number. stop_at_gap: order column; entries
    from the first without a stream on are left out, as some collectors do."""
    from .scan import running

    e = entries.withColumn("_hex", F.lower(F.hex(number)))
    s = streams.withColumn("_hex", F.lower(name))
    if stop_at_gap is None:
        return e.join(s, [*keys, "_hex"]).drop("_hex")
    s = s.withColumn("_there", F.lit(1))
    j = e.join(s, [*keys, "_hex"], "left")
    j = running(j, keys, [F.col(stop_at_gap)], sums={"_miss": F.when(F.col("_there").isNull(), 1).otherwise(0)})
    return j.filter("_miss = 0").drop("_hex", "_there", "_miss")


def volume_of(path: Column, volumes: Column) -> Column:
    """The first of a row's volumes (array of struct with device) that a device path starts with; else null."""
    return F.get(F.filter(volumes, lambda v: F.startswith(path, v["device"])), F.lit(0))


def prefix_join(df: DataFrame, text: str, dim: DataFrame, prefix: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns of dim's first row, by order, whose prefix the text starts with (and whose keys are the same);
    without any, nulls. A column that both have is an error.

    Prefixes and texts are sorted together. All prefixes of a text are prefixes of the last prefix before it in that order, too: so
    each prefix has its chain, those of dim that it begins with and itself, each with the first row up to it, and a text takes from the
    chain of the one before it the longest that it starts with. No row of df is copied, however many lengths there are."""
    from .scan import running

    own = [c for c in dim.columns if c not in keys]
    if clash := {*own} & {*df.columns}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    given = dim.filter(F.length(prefix) > 0).select(*keys, F.col(prefix).alias("_p"), F.struct(F.col(order).alias("_o"), *own).alias("_hit"))
    each = given.groupBy(*keys, "_p").agg(F.min("_hit").alias("_hit"))
    sizes = each.select(F.length("_p").alias("_size")).distinct().agg(F.sort_array(F.collect_set("_size")).alias("_sizes"))  # few lengths, on dim's side only
    above = each.crossJoin(F.broadcast(sizes)).select(*keys, F.col("_p").alias("_below"), F.explode(F.filter("_sizes", lambda n: n <= F.length("_p"))).alias("_n"))
    above = above.withColumn("_p", F.substring(F.col("_below"), F.lit(1), F.col("_n")))
    chain = above.join(each, [*keys, "_p"]).groupBy(*keys, "_below").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("_p").alias("p"), F.col("_hit").alias("hit")))).alias("_chain"))
    marks = chain.select(*keys, F.col("_below").alias("_text"), F.lit(0).alias("_side"), "_chain", F.lit(None).cast(df.schema.simpleString()).alias("_row"))
    rows = df.select(*keys, F.col(text).alias("_text"), F.lit(1).alias("_side"), F.lit(None).cast(chain.schema["_chain"].dataType).alias("_chain"), F.struct(*df.columns).alias("_row"))
    at = running(marks.unionByName(rows), list(keys), [F.col("_text"), F.col("_side")], lasts={"_last": F.col("_chain")}).filter("_side = 1")
    hits = F.transform(F.filter("_last", lambda e: F.startswith(F.col("_text"), e["p"])), lambda e: e["hit"])
    return at.select("_row.*", F.array_min(hits).alias("_hit")).select(*df.columns, *(F.col(f"_hit.{c}").alias(c) for c in own))


def drive_letters(df: DataFrame, path: str, volumes: DataFrame, out: str) -> DataFrame:
    """Paths that begin with the device name of one of their host's volumes, with the drive letter in its place; others as they
    are. volumes: host, device, letter. A device is a whole name, so volume 1 isn't volume 10."""
    v = volumes.select("host", F.concat("device", F.lit("\\")).alias("_device"), F.col("letter").alias("_letter"))
    d = prefix_join(df, path, v, "_device", "_letter", keys=("host",))
    moved = F.concat("_letter", F.substring(F.col(path), F.length("_device"), F.length(path)))
    return d.withColumn(out, F.coalesce(moved, path)).drop("_device", "_letter")


def mount_points(df: DataFrame, serial: str, volumes: DataFrame, out: str = "mount") -> DataFrame:
    """Drive letters by (host, serial), for padded and unpadded spellings. volumes: host, serial, letter. An unpadded spelling that
    several serials of a host share names none of them (1101 and 0111 both become 00111). Of a serial at several letters, the least."""
    normal = serial_normal(F.col("serial"))
    v = volumes.select(F.col("host").alias("_host"), normal.alias("_normal"), F.explode(F.array_distinct(F.array(normal, serial_unpadded(normal)))).alias("_serial"), F.col("letter").alias("_letter"))
    v = v.groupBy("_host", "_serial").agg(F.min("_letter").alias("_letter"), F.min("_normal").alias("_a"), F.max("_normal").alias("_b")).filter("_a = _b").drop("_a", "_b")
    joined = df.join(v, (df["host"] == v["_host"]) & (F.upper(df[serial]) == v["_serial"]), "left")
    return joined.withColumn(out, F.coalesce("_letter", F.lit(""))).drop("_host", "_serial", "_letter")


def file_md5(df: DataFrame, path: str, hashes: DataFrame, out: str = "md5") -> DataFrame:
    """MD5 of the file a path names, by (host, lower-case path); else empty. hashes: host, path_norm, md5."""
    h = hashes.select(F.col("host").alias("_host"), F.lower("path_norm").alias("_path"), F.col("md5").alias("_md5")).dropDuplicates(["_host", "_path"])
    joined = df.join(h, (df["host"] == h["_host"]) & (F.lower(df[path]) == h["_path"]), "left")
    return joined.withColumn(out, F.coalesce("_md5", F.lit(""))).drop("_host", "_path", "_md5")


def profile_paths(users: DataFrame, reg: DataFrame) -> DataFrame:
    """Users with their profile path from the ProfileList key of reg_values; else empty text."""
    from ..functions.scalars import utf16_z

    p = reg.filter(F.col("key_path").rlike(r"(?i)\\ProfileList\\S-1-") & (F.col("value_name") == "ProfileImagePath"))
    p = p.select(F.col("host").alias("_host"), F.regexp_extract("key_path", r"(S-1-[0-9-]+)$", 1).alias("_sid"), utf16_z(F.col("data")).alias("_profile")).dropDuplicates(["_host", "_sid"])
    joined = users.join(p, (users["host"] == p["_host"]) & (users["sid"] == p["_sid"]), "left")
    return joined.withColumn("profile", F.coalesce("_profile", F.lit(""))).drop("_host", "_sid", "_profile")


def with_parent(df: DataFrame, keys: list[str], id: str, parent: str, columns: list[str]) -> DataFrame:
    """Each row with columns of its parent, prefixed by ``parent_``; orphans get nulls."""
    p = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(id).alias("_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    on = (df[parent] == p["_id"])
    for k in keys:
        on &= df[k] == p[f"_{k}"]
    return df.join(p, on, "left").drop("_id", *(f"_{k}" for k in keys))
