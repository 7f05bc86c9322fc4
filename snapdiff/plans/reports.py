"""Reports over one snapshot, and the full diff of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut_text
from ..functions.filters import apply_visibility, backend_label, call_label, match_filters, severity_filter, text_filter
from ..operators import change as G
from ..operators import entities as E
from ..operators import numeric as N
from ..sources import page_specs as P
from ..sources.payloads import stamp_of
from ..sources.store import settled_all

#: Sections of the full report, in order.
SECTIONS = ("values", "countsums", "countsumrows", "statements", "samples", "keyspaces", "tables", "tablets", "replicas", "masters", "tablet_servers", "vars", "versions", "health")
NONMETRICS = SECTIONS[5:]
GAUGES = ("gauges", "sample_gauges")
ALL_SECTIONS = ("values", "gauges", *SECTIONS[1:5], "sample_gauges", *NONMETRICS)


def latency_report(clocks: DataFrame, leaders: DataFrame) -> DataFrame:
    """Leader to server latency, as the leader of each snapshot sees it."""
    return E.leader_rows(clocks, leaders)


def masters_report(masters: DataFrame, leaders: DataFrame, details: bool = False) -> DataFrame:
    return masters if details else E.leader_rows(masters, leaders)


def tservers_report(servers: DataFrame, leaders: DataFrame, details: bool = False) -> DataFrame:
    return servers if details else E.leader_rows(servers, leaders)


def vars_report(vars_: DataFrame, details: bool = False, host: str | None = None, stat: str | None = None) -> DataFrame:
    return match_filters(apply_visibility(vars_, details=details), host, stat)


def gflags_report(flags: DataFrame, host: str | None = None, stat: str | None = None) -> DataFrame:
    """Settings of the flag text, by host and name."""
    return match_filters(flags, host, stat)


def versions_report(versions: DataFrame, host: str | None = None) -> DataFrame:
    """What is installed where: the build of each host."""
    rows = match_filters(versions, host)
    return rows.select(*stamp_of(rows), "version_number", "build_number", "build_type", "build_timestamp", "git_hash")


def rpc_report(connections: DataFrame, calls: DataFrame, details: bool = False) -> DataFrame:
    """Calls first; with details also the connections without any."""
    busy = call_label(calls).select("hostname_port", "direction", F.col("remote").alias("peer"), "label", "elapsed_ms")
    if not details:
        return busy
    idle = backend_label(connections).where(~F.col("active"))
    return busy.unionByName(idle.select("hostname_port", "direction", "peer", F.lit("").alias("label"), F.lit(None).cast("long").alias("elapsed_ms")))


def log_report(lines: DataFrame, levels: str = "WEF", pattern: str | None = None) -> DataFrame:
    return text_filter(severity_filter(lines, levels), pattern).orderBy("ts")


def health_report(health: DataFrame, leaders: DataFrame) -> DataFrame:
    return E.leader_rows(health, leaders)


def config_report(configs: DataFrame, leaders: DataFrame) -> DataFrame:
    return E.leader_rows(configs, leaders).withColumn("doc", F.to_json("doc"))


def _part(name: str, df: DataFrame, key: str) -> DataFrame:
    """A part of an object's page as (snapshot_id, key, part, detail): detail is the part's own columns as JSON."""
    own = [c for c in df.columns if c not in ("cluster_id", "snapshot_id", "hostname_port", "captured_at", "table", "heading", "depth", "object_id", key)]
    return df.select("snapshot_id", F.col("object_id" if "object_id" in df.columns else key).alias(key), F.lit(name).alias("part"), F.to_json(F.struct(*own)).alias("detail"))


def _object_report(basic: DataFrame, shown: DataFrame, parts: dict[str, DataFrame], key: str, uuid: str | None) -> DataFrame:
    """The list's row of each object and, for objects of ``shown``, the parts of their own pages; of one object or of all.

    Parts are put together first, so that one join picks those that show.
    """
    one = lambda df: df if uuid is None else df.where(F.col(key) == uuid)
    rows = [one(_part(name, df, key)) for name, df in parts.items()]
    while len(rows) > 1:
        rows = [a.union(b) for a, b in zip(rows[::2], rows[1::2], strict=False)] + rows[len(rows) & ~1 :]
    known = one(shown.select("snapshot_id", key))
    return one(_part("general", basic, key)).unionByName(rows[0].join(known, ["snapshot_id", key], "left_semi"))


def table_report(tables: DataFrame, pages: DataFrame, uuid: str | None = None, leaders: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, table_id, part, detail) of a table: its row in the leader's list, and properties, columns, tablets and tasks of its page.

    ``tables`` are rows of the list of tables, ``pages`` parsed pages of tables, which name theirs in ``object_id``; they
    are parsed once, for all parts.
    """
    rows, pages = tables if leaders is None else E.leader_rows(tables, leaders), settled_all({"pages": pages})["pages"]
    parts = {"property": P.keyed_values(pages), "column": P.page(pages, "columns"), "tablet": P.page(pages, "tablets_of_table"), "task": P.page(pages, "tasks_of_table")}
    return _object_report(rows, rows, parts, "table_id", uuid)


def tablet_report(tablets: DataFrame, pages: dict[str, DataFrame], uuid: str | None = None) -> DataFrame:
    """(snapshot_id, tablet_id, part, detail) of a tablet: its row in each server's list and, if it runs, consensus, log anchors, transactions and stores.

    ``pages`` has any of the parsed pages ``consensus``, ``log_anchors``, ``transactions`` and ``stores``, which name their tablet in ``object_id``.
    """
    parts, pages = {}, settled_all(pages)
    if "consensus" in pages:
        parts |= {"consensus": P.consensus_state(pages["consensus"]), "watermark": P.page(pages["consensus"], "watermarks"), "message": P.page(pages["consensus"], "messages")}
    if "log_anchors" in pages:
        parts["log_anchor"] = P.pre_lines(pages["log_anchors"])
    if "transactions" in pages:
        parts["transaction"] = P.transactions(pages["transactions"])
    if "stores" in pages:
        blocks = P.pre_blocks(pages["stores"])
        parts |= {"file": P.sst_files(blocks), "store": P.store_parts(blocks)}
    return _object_report(tablets, tablets.where("upper(state) = 'RUNNING'"), parts, "tablet_id", uuid)


#: A section's key columns; detail is the rest.
KEYS = {
    **dict.fromkeys(N.SECTIONS, list(N.SERIES)), "statements": ["hostname_port", "query"], **dict.fromkeys(("samples", "sample_gauges"), ["hostname_port", "name", "labels"]), "keyspaces": ["keyspace_id"], "tables": ["table_id"], "tablets": ["tablet_id"],
    "replicas": ["tablet_id", "server_uuid"], "masters": ["permanent_uuid"], "tablet_servers": ["server"], "vars": ["hostname_port", "name"], "versions": ["hostname_port"], "health": ["item", "value"],
}
#: The tables that a section reads.
NEEDS = {
    **dict.fromkeys(("values", "gauges"), ("metrics", "catalog")), **dict.fromkeys(("countsums", "countsumrows"), ("metrics",)), "statements": ("statements",), **dict.fromkeys(("samples", "sample_gauges"), ("samples",)), "keyspaces": ("keyspaces", "tables"),
    "tables": ("tables", "keyspaces", "tablets"), **dict.fromkeys(("tablets", "replicas"), ("tablets", "replicas", "tables", "keyspaces")), **{k: (k,) for k in ("masters", "tablet_servers", "vars", "versions", "health")},
}
HIERARCHY = ("keyspaces", "tables", "tablets", "replicas")


def _long(section: str, df: DataFrame) -> DataFrame:
    """A section as (n, section, change, key, detail): detail is the other columns as JSON, nulls left out."""
    key = KEYS[section]
    change = F.col("change") if "change" in df.columns else F.lit("=")
    rest = [c for c in df.columns if c not in ("change", *key)]
    return df.select(F.lit(ALL_SECTIONS.index(section)).alias("n"), F.lit(section).alias("section"), change.alias("change"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.to_json(F.struct(*rest) if rest else F.struct(F.lit("").alias("x"))).alias("detail"))


def _metrics_long(df: DataFrame) -> DataFrame:
    n = F.lit(-1)
    for s in N.SECTIONS:
        n = F.when(F.col("section") == s, ALL_SECTIONS.index(s)).otherwise(n)
    return df.select(n.alias("n"), "section", F.lit("=").alias("change"), F.concat_ws("|", *[F.col(k).cast("string") for k in N.SERIES]).alias("key"), "detail")


def diff_report(tables: dict[str, DataFrame], begin: int, end: int, sections: tuple[str, ...] = SECTIONS, details: bool = False, gauges: bool = False, host: str | None = None, stat: str | None = None, table: str | None = None, statement_length: int | None = None) -> DataFrame:
    """The sections whose tables are given, as one long table; tables of other sections are not read.

    Each table is cut to the two snapshots first and read once: all sections of metrics come from one scan and one
    aggregate, and tables of the hierarchy that several sections use are written, cut, to the shared folder. With ``leaders``
    (looked up once) the hierarchy, masters, tablet servers and health are as the leader of each side saw them. ``host`` is a
    pattern for metrics, samples, statements and versions, ``stat`` for metrics and samples, ``table`` for metrics of tables and
    for the names of tables, tablets and replicas; ``gauges`` adds the sections of gauges, ``details`` rows of
    each object and CPU; ``statement_length`` cuts statements in the key.
    """
    snaps, leaders = tables.get("snapshots"), tables.get("leaders")
    wanted = [s for s in ALL_SECTIONS if (s in sections or gauges and s in GAUGES) and all(n in tables for n in NEEDS[s])]
    if not wanted:
        raise ValueError("no section has its tables")
    used = [n for s in wanted for n in NEEDS[s]]
    t = {k: G.pair(v, begin, end) if "snapshot_id" in v.columns else v for k, v in tables.items() if k in used}
    led = [k for k in (*HIERARCHY, "masters", "tablet_servers", "health") if k in t and "hostname_port" in t[k].columns]
    if leaders is not None and led:
        found = G.leaders_of_pair(leaders, begin, end)
        t |= {k: G.leader_view(t[k], found, begin, end) for k in led}
    shared = {k: t[k] for k in HIERARCHY if used.count(k) > 1}
    if shared:
        t |= settled_all(shared)
    for k in ("statements", "versions"):
        if k in t:
            t[k] = match_filters(t[k], host)
    own = {"host": host, "stat": stat}
    named = lambda df, *cols: df if table is None else df.where(F.concat_ws(".", *cols).rlike(table))

    def statements() -> DataFrame:
        d = N.statements_diff(t["statements"], snaps, begin, end)
        return d if statement_length is None else d.withColumn("query", cut_text(F.col("query"), statement_length))

    makers = {
        "statements": statements,
        "samples": lambda: N.sample_counter_diff(t["samples"], snaps, begin, end, details, **own),
        "sample_gauges": lambda: N.sample_gauge_diff(t["samples"], snaps, begin, end, **own),
        "keyspaces": lambda: E.keyspace_diff(t["keyspaces"], t["tables"], begin, end),
        "tables": lambda: named(E.table_diff(t["tables"], t["keyspaces"], t["tablets"], begin, end), "keyspace_name", F.coalesce("table_name_after", "table_name_before")),
        "tablets": lambda: named(E.tablet_diff(t["tablets"], t["replicas"], t["tables"], t["keyspaces"], begin, end), "keyspace_name", "table_name"),
        "replicas": lambda: named(E.replica_diff(t["replicas"], t["tablets"], t["tables"], t["keyspaces"], begin, end), "keyspace_name", "table_name"),
        "masters": lambda: G.masters_diff(t["masters"], begin, end),
        "tablet_servers": lambda: G.tserver_diff(t["tablet_servers"], begin, end),
        "vars": lambda: G.vars_diff(t["vars"], begin, end),
        "versions": lambda: G.versions_diff(t["versions"], begin, end),
        "health": lambda: G.health_diff(t["health"], begin, end),
    }
    numeric = tuple(s for s in wanted if s in N.SECTIONS)
    parts = [_metrics_long(N.metric_sections(t["metrics"], snaps, begin, end, numeric, t.get("catalog"), details, **own, table=table))] if numeric else []
    parts += [_long(s, makers[s]()) for s in wanted if s in makers]
    while len(parts) > 1:  # pairs first, as each union looks at its whole plan again
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) & ~1 :]
    return parts[0]
