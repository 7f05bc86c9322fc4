"""The pages that are read as tables: headers and columns, and what is derived from their strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cut_text, human_bytes, human_seconds, reverse_path, sst_fields, stack_frames
from .html_pages import table_rows
from .payloads import stamp_of

#: page -> (headers as the page has them, our column names); the headers are fixed values
SPECS: dict[str, tuple[list[str], list[str]]] = {
    "memtrackers": (["Id", "Current Consumption", "Peak consumption", "Limit"], ["id", "current", "peak", "limit"]),
    "threads": (["Thread name", "Cumulative User CPU(s)", "Cumulative Kernel CPU(s)", "Cumulative IO-wait(s)"], ["thread_name", "user_cpu", "kernel_cpu", "io_wait", "stack"]),
    "clocks": (["Server", "Time since heartbeat", "Status & Uptime", "Physical Time (UTC)", "Hybrid Time (UTC)", "Heartbeat RTT", "Cloud", "Region", "Zone"], ["server", "since_heartbeat", "status_uptime", "physical_time", "hybrid_time", "rtt", "cloud", "region", "zone"]),
    "drives": (["Path", "Used Space", "Total Space"], ["path", "used", "total"]),
    "tasks": (["Task Name", "State", "Start Time", "Time", "Description"], ["task_name", "state", "start_time", "duration", "description"]),
    "operations": (["Tablet id", "Op Id", "Transaction Type", "Total Time In-flight", "Description"], ["tablet_id", "op_id", "type", "time_in_flight", "description"]),
    "leaderless": (["Table Name", "Table UUID", "Tablet ID"], ["table_name", "table_id", "tablet_id"]),
    "under_replicated": (["Table Name", "Table UUID", "Tablet ID", "Tablet Replication Count"], ["table_name", "table_id", "tablet_id", "replication_count"]),
    "tables": (["Keyspace", "Table Name", "State", "Message", "UUID", "YSQL OID", "Hidden"], ["keyspace", "table_name", "state", "message", "table_id", "oid", "hidden", "on_disk_size"]),
    "columns": (["Column", "ID", "Type"], ["column", "column_id", "type"]),
    "tablets_of_table": (["Tablet ID", "Partition", "SplitDepth", "State", "Hidden", "Message", "RaftConfig"], ["tablet_id", "partition", "split_depth", "state", "hidden", "message", "raft_config"]),
    "tasks_of_table": (["Task Name", "State", "Start Time", "Time", "Description"], ["task_name", "state", "start_time", "duration", "description"]),
    "watermarks": (["Peer", "Watermark"], ["peer", "watermark"]),
    "messages": (["Entry", "OpId", "Type", "Size", "Status"], ["entry", "op_id", "type", "size", "status"]),
    "tablets": (["Namespace", "Table name", "Table UUID", "Tablet ID", "Partition", "State", "Hidden", "Num SST Files", "On-disk size", "RaftConfig", "Last status"], ["namespace", "table_name", "table_id", "tablet_id", "partition", "state", "hidden", "num_sst_files", "on_disk_size", "raft_config", "last_status"]),
}


def page(pages: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of table."""
    header, columns = SPECS[kind]
    return table_rows(pages, header, columns, exact=kind not in ("threads", "tables"))


def memtrackers(pages: DataFrame) -> DataFrame:
    """Tracker ids from the root down, with sizes in bytes."""
    return page(pages, "memtrackers").withColumns({"id": reverse_path(F.col("id")), "current_bytes": human_bytes(F.col("current")), "peak_bytes": human_bytes(F.col("peak")), "limit_bytes": human_bytes(F.col("limit"))})


def threads(pages: DataFrame) -> DataFrame:
    """A stack cell spans the rows after it, so it is carried on within its table."""
    rows = page(pages, "threads")
    w = Window.partitionBy(*stamp_of(pages), "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stack", stack_frames(F.last("stack", ignorenulls=True).over(w)))


def clocks(pages: DataFrame) -> DataFrame:
    return page(pages, "clocks").withColumns({"since_heartbeat_s": human_seconds(F.col("since_heartbeat")), "rtt_s": human_seconds(F.col("rtt"))})


def drives(pages: DataFrame) -> DataFrame:
    return page(pages, "drives").withColumns({"used_bytes": human_bytes(F.col("used")), "total_bytes": human_bytes(F.col("total"))})


def tasks(pages: DataFrame) -> DataFrame:
    """The three tables of the page, told apart by their order: active tasks, jobs done, tasks done."""
    w = Window.partitionBy(*stamp_of(pages)).orderBy("table")
    rows = page(pages, "tasks").withColumn("n", F.dense_rank().over(w))
    return rows.withColumns({"type": F.when(F.col("n") == 2, "user job").otherwise("task"), "status": F.when(F.col("n") == 1, "active").otherwise("done")}).drop("n")


def operations(pages: DataFrame) -> DataFrame:
    """Some pages write all cells as header cells; descriptions are cut to 80 characters."""
    return page(pages, "operations").withColumn("description", cut_text(F.col("description"), 80))


def replication_issues(pages: DataFrame) -> DataFrame:
    """Leaderless and under-replicated tablets in one table."""
    few, none = page(pages, "under_replicated"), page(pages, "leaderless")
    return few.withColumn("issue", F.lit("under_replicated")).unionByName(none.withColumn("issue", F.lit("leaderless")), allowMissingColumns=True)


def table_pages(pages: DataFrame) -> DataFrame:
    """The list of tables; the panel's title tells the type of object."""
    kind = F.lower(F.regexp_extract("heading", r"^(User|Index|System|Parent)", 1))
    return page(pages, "tables").withColumns({"object_type": kind, "on_disk_bytes": human_bytes(F.col("on_disk_size"))})


def tablet_pages(pages: DataFrame) -> DataFrame:
    return page(pages, "tablets").withColumn("on_disk_bytes", human_bytes(F.col("on_disk_size")))


def page_with_detail(basic: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """List rows with the rows of their own pages; a detail page names its object in ``key``."""
    return basic.join(detail.select(key, *[c for c in detail.columns if c not in basic.columns]), key)


def keyed_values(pages: DataFrame) -> DataFrame:
    """Tables without a header and with two cells a row, as key and value."""
    each = pages.select(*stamp_of(pages), F.explode(F.filter("tables", lambda t: F.size(t["header"]) == 0)).alias("t"))
    rows = each.select(*stamp_of(pages), F.explode("t.rows").alias("r")).where("size(r) = 2")
    return rows.select(*stamp_of(pages), F.col("r")[0].alias("key"), F.col("r")[1].alias("value"))


def pre_blocks(pages: DataFrame) -> DataFrame:
    """Preformatted blocks with the heading above each; ``part``: how many headings ``Options`` there were so far."""
    stamp = stamp_of(pages)
    each = pages.select(*stamp, F.explode(F.filter("tables", lambda t: t["header"] == F.array(F.lit("pre")))).alias("t"))
    rows = each.select(*stamp, F.col("t.pos").alias("table"), "t.heading", F.col("t.rows")[0][0].alias("text"))
    w = Window.partitionBy(*stamp).orderBy("table").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum((F.col("heading") == "Options").cast("int")).over(w))


def sst_files(blocks: DataFrame) -> DataFrame:
    """Storage files of the regular (first) and the intents (second) store, by white space."""
    lines = blocks.where("heading = 'Files'").select(*stamp_of(blocks), F.when(F.col("part") <= 1, "regular").otherwise("intents").alias("store"), F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    f = sst_fields(F.col("line"))
    return lines.select(*stamp_of(blocks), "store", f[0].alias("name"), f[1].try_cast("long").alias("total_size"), f[2].try_cast("long").alias("base_size"))


def consensus_state(pages: DataFrame) -> DataFrame:
    """(item, text) of a tablet's consensus page: its state and the overview of its queue."""
    blocks = pre_blocks(pages).where("heading IN ('State', 'Queue overview')")
    return blocks.select(*stamp_of(pages), F.when(F.col("heading") == "State", "state").otherwise("queue_overview").alias("item"), "text")


def pre_lines(pages: DataFrame) -> DataFrame:
    """Lines of all preformatted blocks, with their place: pages of log anchors and of transactions."""
    each = pages.select(*stamp_of(pages), F.explode(F.filter("tables", lambda t: t["header"] == F.array(F.lit("pre")))).alias("t"))
    text = F.regexp_replace(F.col("t.rows")[0][0], r"\n\z", "")
    return each.select(*stamp_of(pages), F.col("t.pos").alias("block"), F.posexplode(F.split(text, "\n")).alias("line", "text"))


def store_parts(blocks: DataFrame) -> DataFrame:
    """(store, item, name, text): options of the regular and the intents store, and the details of their files."""
    item = F.when(F.col("heading") == "Options", "options").when((F.col("heading") != "Files") & (F.col("part") > 0), "file")
    name = F.when(item == "file", F.element_at(sst_fields(F.col("heading")), 1)).otherwise("")
    store = F.when(F.col("part") <= 1, "regular").otherwise("intents")
    return blocks.select(*stamp_of(blocks), store.alias("store"), item.alias("item"), name.alias("name"), "text").where("item IS NOT NULL")


def transactions(pages: DataFrame) -> DataFrame:
    """Lines of a tablet's page of transactions."""
    return pre_lines(pages).where("trim(text) <> ''")
