"""Scalar functions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of the keyspaces that a cluster makes for itself.
SYSTEM_KEYSPACES = (
    "00000000000000000000000000000001",
    "00000000000000000000000000000002",
    "00000000000000000000000000000003",
    "00000001000030008000000000000000",
    "00000004000030008000000000000000",
)
CATALOG_OIDS = 16384  # object ids below it are the catalog's


def cut_text(col: Column, n: int = 80) -> Column:
    """The first ``n`` characters, with line ends, tabs and quotes escaped."""
    text = F.left(col, F.lit(n))
    for found, written in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("'", "\\'"), ('"', '\\"')):
        text = F.replace(text, F.lit(found), F.lit(written))
    return text


def object_oid(col: Column) -> Column:
    """The last eight hex digits of a 32-digit id as a number, else 0."""
    hex_ = F.when(F.length(col) == 32, F.substring(col, 25, 8))
    return F.coalesce(F.conv(F.when(hex_.rlike("^[0-9A-Fa-f]{8}$"), hex_), 16, 10).cast("long"), F.lit(0).cast("long"))


def is_catalog_object(col: Column) -> Column:
    return object_oid(col) < CATALOG_OIDS


def is_system_keyspace(col: Column) -> Column:
    return col.isin(*SYSTEM_KEYSPACES)


def is_colocation_parent(table_id: Column, keyspace_id: Column) -> Column:
    """Both forms of a colocation parent's id."""
    old = table_id == F.concat(keyspace_id, F.lit(".colocated.parent.uuid"))
    new = F.startswith(table_id, F.left(keyspace_id, F.lit(22))) & F.endswith(table_id, F.lit(".colocation.parent.uuid"))
    return old | new


def reverse_path(col: Column, sep: str = "->") -> Column:
    return F.array_join(F.reverse(F.split(col, sep)), sep)


def stack_frames(col: Column) -> Column:
    """Function names of a stack trace's ``@ 0x... name`` lines, root first, joined by ``;``."""
    return F.array_join(F.reverse(F.regexp_extract_all(col, F.lit(r"@\s+0x[0-9a-f]+\s+(\S+)"), F.lit(1))), ";")


def host_of(col: Column) -> Column:
    return F.split_part(col, F.lit(":"), F.lit(1))


def port_of(col: Column) -> Column:
    return F.split_part(col, F.lit(":"), F.lit(2)).try_cast("int")


def table_label(namespace: Column, name: Column) -> Column:
    """``namespace.table``, or whichever of the two is not empty."""
    return F.concat_ws(".", F.nullif(namespace, F.lit("")), F.nullif(name, F.lit("")))


def pct_used(used: Column, total: Column) -> Column:
    return F.round(F.try_divide(F.lit(100) * used, total), 2)


def sst_fields(line: Column) -> Column:
    """Fields of a storage-file line, by white space."""
    return F.split(F.trim(line), r"\s+")


def _human(col: Column, units: dict[str, float]) -> Column:
    number = F.regexp_extract(col, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.regexp_extract(col, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2)
    table = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(float(v)))])
    return number.try_cast("double") * F.element_at(table, unit)


def human_bytes(col: Column) -> Column:
    """``25.68M`` in bytes; null for what is no size."""
    return _human(col, {"": 1, "B": 1, "K": 2**10, "KB": 2**10, "M": 2**20, "MB": 2**20, "G": 2**30, "GB": 2**30, "T": 2**40, "TB": 2**40})


def human_seconds(col: Column) -> Column:
    """``2.24ms`` in seconds; null for what is no duration."""
    return _human(col, {"s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "m": 60, "h": 3600})
