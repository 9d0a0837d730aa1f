"""From raw values and files to artefact tables: recent lists, shortcuts and jump lists.

Each function joins a decoder with its lookups and gives the columns of the kind's build_ function in tables.py. Second
results are quarantined rows, with why they couldn't be read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import decode as B
from . import lookups as L
from .nested import tree_paths
from .store import cut
from .tables import app_id

# The keys below ComDlg32 that hold recent files and recent programs.
MRU_SOURCES = ["OpenSavePidlMRU", "OpenSaveMRU"]
MRU_APP_SOURCES = ["LastVisitedMRU", "LastVisitedPidlMRU", "LastVisitedPidlMRULegacy"]
MRU_ORDER = "MRUListEx"
#: The keys that hold bags; the first group is the source.
BAG_KEYS = r"(?i)\\Shell\\(BagMRU)(?:\\[0-9]+)*$"
#: The order's value that ends it.
MRU_END = 0xFFFFFFFF

#: The columns of a shell item that tables keep.
_ITEM = f"struct<type:string,name:string,size:bigint,modified_fat:bigint,attributes:int,category:bigint,guid:string,blocks:array<{B.BLOCK}>,properties:array<{B.PROPERTY}>,in_archive:boolean,hex:string>"


def mru_numbers(data: Column) -> Column:
    """Numbers of a MRUListEx value, most recent first, up to its terminator; an odd end is left out."""
    starts = F.sequence(F.lit(0), F.octet_length(data) - 4, F.lit(4))
    numbers = F.transform(starts, lambda at: S.le_uint(data, at, 4))
    end = F.coalesce(F.array_position(numbers, F.lit(MRU_END).cast("bigint")), F.lit(0))
    listed = F.when(end > 0, F.slice(numbers, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(numbers)
    return F.when(F.octet_length(data) >= 4, listed)


def items_of(df: DataFrame, blob: str, keys: list[str], out: str = "items", inside: bool = False) -> DataFrame:
    """keys, the array of the shell items of each row's blob, and ``archive``: whether any of them is an archive's file. One
    call a row: a list's items are few by nature of the artefact. Of a damaged list, the items before the damage stay, and
    ``error`` says why. inside: all lists are content of an archive."""
    fields = [f.split(":")[0] for f in ("type", "name", "size", "modified_fat", "attributes", "category", "guid", "blocks", "properties", "in_archive", "hex")]

    def parse(data: bytes) -> Iterator[dict]:
        found, archive, error = [], False, None
        try:
            for item in B.parse_shell_items(data, archives=True, inside=inside):
                found.append({f: item.get(f) for f in fields})
                archive = archive or item["archive"]
        except ValueError as e:
            error = str(e)[:200]
        yield {"_items": found, "_archive": archive, "_error": error}

    d = B.decode(df, blob, keys, f"_items array<{_ITEM}>, _archive boolean, _error string", parse)
    return d.select(*keys, F.col("_items").alias(out), F.coalesce("_archive", F.lit(False)).alias("archive"), F.coalesce("_error", "error").alias("error"))


def _listed(reg: DataFrame, pattern: str, how: str = "inner") -> DataFrame:
    """host, sid, source, the key's last group as ``extension``, its last write, and the value ``data`` of each number that the
    key's order lists, with its rank. Numbers without a value are left out, or with how left have null data."""
    d = reg.filter(F.col("key_path").rlike(pattern) & (F.col("value_type") == "REG_BINARY"))
    d = d.select("host", "hive", "sid", "key_path", "value_name", "data", "key_last_write")
    key = ["host", "hive", "sid", "key_path"]
    order = d.filter(F.lower("value_name") == MRU_ORDER.lower()).select(*key, "key_last_write", F.posexplode(mru_numbers(F.col("data"))).alias("rank", "id"))
    values = d.filter(F.col("value_name").rlike("^[0-9]+$")).select(*(F.col(k).alias(f"_{k}") for k in key), F.col("value_name").try_cast("bigint").alias("_id"), "data")
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = order.join(values, same & (F.col("id") == F.col("_id")), how).drop("_id", *(f"_{k}" for k in key))
    return out.withColumns({"source": F.regexp_extract("key_path", pattern, 1), "extension": F.element_at(F.split("key_path", r"\\"), -1)})


def mru_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    """Recent files of both keys, by extension: host, id, rank (0 is the most recent), extension, sid, sid_name, source,
    key_last_write, items, error. The list of all extensions, ``*``, is left out, since the others hold the same."""
    d = _listed(reg, rf"(?i)\\ComDlg32\\({'|'.join(MRU_SOURCES)})\\[^\\]+$").filter("extension <> '*'")
    keys = ["host", "sid", "source", "extension", "key_last_write", "rank", "id"]
    return L.sid_names(items_of(d, "data", keys), users).select("host", "id", "rank", "extension", "sid", "sid_name", "source", "key_last_write", "items", "error")


def mru_apps_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    """Recent programs of the three keys: a value is the program's name in UTF-16, its NUL, and the items."""
    d = _listed(reg, rf"(?i)\\ComDlg32\\({'|'.join(MRU_APP_SOURCES)})$").withColumn("name", S.utf16_z(F.col("data")))
    # Code units, not characters: two bytes each, also of the two halves of a pair.
    size = F.octet_length(F.encode("name", "UTF-16LE")) + 2
    d = d.withColumn("data", F.substring(F.col("data"), size + 1, F.octet_length("data")))
    keys = ["host", "sid", "source", "key_last_write", "rank", "id", "name"]
    return L.sid_names(items_of(d, "data", keys), users).select("host", "id", "rank", "name", "sid", "sid_name", "source", "key_last_write", "items", "error")


def shellbags_from_registry(reg: DataFrame, users: DataFrame) -> DataFrame:
    """The tree of bags below ``BagMRU`` as rows: host, sid, sid_name, source, node_path (numbers from the root), id, parent
    (its number, null for roots), depth (0 for roots), mru_pos (0 is the most recent of its key), key_last_write (of the key that lists it), in_archive, items, error.

    A key lists its children by its order value; a number whose value is missing is a node without items, one without a key
    of its own is a leaf, and what lies below a number that its key doesn't list is left out. A node is in an archive if any
    node above holds an archive's file: then all its items are content of it. So the flag goes down the tree first, and
    lists that get it are read again as content. Of one user's keys in several hives each hive is a tree."""
    d = _listed(reg, BAG_KEYS, how="left")
    number = F.col("id").cast("string")
    hive = F.to_json(F.struct("host", "hive", "sid"))
    d = cut(d.select("host", "sid", "source", "id", "rank", "key_last_write", "data", hive.alias("_tree"), F.lower("key_path").alias("_key"), F.concat(F.lower("key_path"), F.lit("\\"), number).alias("_own")))
    # A number that an order repeats is one node, at its most recent place.
    d = d.withColumn("_first", F.min("rank").over(Window.partitionBy("_tree", "_own"))).filter(F.col("rank") == F.col("_first")).drop("_first")
    # Items are read with all of a row at hand, also a row without a value, so that no join has to bring them together again.
    there, blob = F.col("data").isNotNull(), F.coalesce("data", F.lit(b"")).alias("_bytes")
    read = items_of(d.select("*", blob), "_bytes", d.columns)
    d = cut(read.select(*d.columns, *(F.when(there, F.col(c)).alias(c) for c in ("items", "archive", "error"))))
    way = tree_paths(d, ["_tree"], "_own", "_key", "id", "/", inherit=("archive",))
    # Below a number that isn't listed, a walk begins deeper than its key lies.
    way = way.select("_tree", "_own", F.col("path").alias("node_path"), "depth", F.col("archive_above").alias("in_archive"))
    rows = cut(d.join(way, ["_tree", "_own"]))
    rows = rows.filter(F.col("depth") == F.size(F.split(F.regexp_extract("_key", r"\\bagmru((?:\\[0-9]+)*)$", 1), r"\\")) - 1)
    own = ["host", "sid", "source", "node_path", "id", "depth", "rank", "key_last_write", "in_archive"]
    rows = rows.select(*own, "_key", "data", F.col("items").alias("_free"), F.coalesce("error", F.when(F.col("items").isNull(), "no value")).alias("_why"))
    content = items_of(rows.filter("in_archive").select("*", blob), "_bytes", rows.columns, inside=True)
    content = content.select(*rows.columns, F.when(there, F.col("items")).alias("_content"))
    read = rows.filter("NOT in_archive").unionByName(content, allowMissingColumns=True)
    read = read.withColumns({"items": F.coalesce("_content", "_free"), "error": F.col("_why")})
    out = L.sid_names(read, users)
    parent = F.regexp_extract("_key", r"\\bagmru(?:\\[0-9]+)*\\([0-9]+)$", 1).try_cast("bigint")
    return out.select("host", "sid", "sid_name", "source", "node_path", "id", parent.alias("parent"), "depth", F.col("rank").alias("mru_pos"), "key_last_write", "in_archive", "items", "error")


def _link(at: str, ticks_of_file: Column | None = None) -> dict[str, Column]:
    """The columns of a link's row from those of decode_lnk() in the struct or row named at (``""``: the row's own)."""
    c = lambda name: F.col(f"{at}.{name}" if at else name)
    return {
        "target": F.coalesce(F.nullif(c("base_path"), F.lit("")), c("net_name"), F.lit("")), "flags": S.flag_names(c("link_flags"), S.LINK_FLAGS), "attrs": S.flag_names(c("attributes"), S.FILE_ATTRIBUTES),
        "target_created_ts": S.filetime_to_ts(c("created_ticks")), "target_modified_ts": S.filetime_to_ts(c("modified_ticks")), "target_accessed_ts": S.filetime_to_ts(c("accessed_ticks")),
        "size": c("size"), "icon_index": c("icon_index"), "show_cmd": L.code_label("show_command", c("show_code").try_cast("int")), "descr": c("descr"), "rel_path": c("rel_path"), "work_dir": c("work_dir"), "args": c("args"),
        "icon_loc": c("icon_location"), "drive_type": F.when(c("drive_code").isNotNull(), L.code_label("drive_type", c("drive_code").try_cast("int"))), "vol_serial": c("vol_serial"), "vol_label": c("vol_label"),
        "net_name": c("net_name"), "net_provider": F.when(c("net_code").isNotNull(), L.code_label("net_provider", c("net_code").bitwiseAND(0xFFFF0000).try_cast("int"))), "net_device": c("net_device"), "idlist": c("idlist"),
    }


def links(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of a link's row, from decode_lnk()'s rows. An empty target stays empty."""
    return decoded.select(*keys, *(v.alias(n) for n, v in _link("").items()))


def recent_docs_from_files(lnk: DataFrame, url: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Shortcut files' rows: host, path, owner and a link's columns; and the quarantine. lnk and url: path, host, owner and
    content, as read_binary() gives them. Of a .url file only the target is known."""
    keys = ["path", "host", "owner"]
    good, bad = B.split_errors(B.decode_lnk(lnk, "content", keys))
    out = links(good, keys)
    bad = bad.select(*keys, F.col("error").alias("reason"))
    if url is None:
        return out, bad
    target = S.url_target(F.decode("content", "UTF-8"))
    marked = url.select(*keys, target.alias("target"))
    found = marked.filter("target IS NOT NULL AND target <> ''")
    lost = marked.filter("target IS NULL OR target = ''").select(*keys, F.lit("no target").alias("reason"))
    return out.unionByName(found, allowMissingColumns=True), bad.unionByName(lost)


def jumplist_auto_from_streams(destlist: DataFrame, streams: DataFrame, apps: DataFrame, stop_at_gap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of automatic jump lists with their links: host, file, application, pos, entry_no, host_name, entry_path,
    last_mod_ts, pinned, the four droids and a link's columns; and the quarantine.

    destlist: host, file and content, the DestList stream; streams: host, file, stream (the name, a hexadecimal number) and
    content, a link. apps: app_id, name. An entry without a stream is left out; with stop_at_gap, so are those after it."""
    keys = ["host", "file"]
    entries, bad = B.split_errors(B.decode_destlist(destlist.withColumnRenamed("host", "_h"), "content", ["_h", "file"]))
    droids = ["droid_volume", "droid_file", "birth_volume", "birth_file"]
    e = entries.select(F.col("_h").alias("host"), "file", "pos", "entry_no", F.col("host").alias("host_name"), F.col("path").alias("entry_path"), S.filetime_to_ts(F.col("ticks")).alias("last_mod_ts"), "pinned", *droids)
    found = L.entry_streams(e, streams.select(*keys, "stream", "content"), keys, stop_at_gap="pos" if stop_at_gap else None)
    own = [c for c in e.columns if c != "pos"]
    good, broken = B.split_errors(B.decode_lnk(found.withColumnRenamed("pos", "place"), "content", [*own, "place"]))
    out = L.app_names(links(good.drop("pos"), [*own, "place"]).withColumn("_id", app_id(F.col("file"))), "_id", apps).drop("_id").withColumnRenamed("place", "pos")
    lost = bad.select(F.col("_h").alias("host"), "file", F.col("error").alias("reason"))
    return out, lost.unionByName(broken.select(*keys, F.col("error").alias("reason")))


def jumplist_custom_from_files(files: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links inside custom destinations: host, file, application, type, offset and a link's columns; and the quarantine.

    files: host, file and content. The first number is the type; only files of user tasks of more than 24 bytes hold
    links. Others, and those of user tasks without any, are rows with null offset and link."""
    keys = ["host", "file", "type"]
    code = S.le_uint(F.col("content"), 0, 4)
    d = files.select("host", "file", L.code_label("custom_type", code.try_cast("int")).alias("type"), F.when((code == 2) & (F.octet_length("content") > 24), F.col("content")).alias("content"))
    good, bad = B.split_errors(B.embedded_links(d, "content", keys, bare=True))
    out = links(good, [*keys, "offset"])
    out = out.select(*keys, "offset", *(F.when(F.col("offset").isNotNull(), F.col(c)).alias(c) for c in out.columns[len(keys) + 1 :]))
    out = out.withColumn("_id", app_id(F.col("file")))
    return L.app_names(out, "_id", apps).drop("_id"), bad.select("host", "file", F.col("error").alias("reason"))
