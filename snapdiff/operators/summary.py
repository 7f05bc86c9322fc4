"""Roll-ups of exporter samples: CPU states, network queues and the scheduler, over all CPUs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the samples that are summed over CPUs.
CPU = "node_cpu_seconds_total"
CPU_STATES = ("idle", "irq", "softirq", "system", "user", "iowait", "nice", "steal")
SOFTNET = ("node_softnet_processed_total", "node_softnet_dropped_total", "node_softnet_times_squeezed_total")
SCHEDSTAT = ("node_schedstat_running_seconds_total", "node_schedstat_timeslices_total", "node_schedstat_waiting_seconds_total")


def add_summaries(samples: DataFrame) -> DataFrame:
    """The samples, per-CPU ones marked ``detail``, with their sums over CPUs, marked ``summary``.

    A sum keeps the state (for CPU time) as its label and the earliest exporter time. One pass and
    one aggregate for all three groups.
    """
    state = F.regexp_extract("labels", f"_({'|'.join(CPU_STATES)})$", 1)
    is_cpu = (F.col("name") == CPU) & (state != "")
    summed = is_cpu | F.col("name").isin(*SOFTNET, *SCHEDSTAT)
    marked = samples.withColumn("category", F.when(summed, "detail").otherwise(F.col("category")))
    label = F.when(is_cpu, F.concat(F.lit("_"), state)).otherwise(F.lit("")).alias("labels")
    sums = samples.where(summed).groupBy("snapshot_id", "captured_at", "hostname_port", "name", label, "exporter_type").agg(F.sum("value").alias("value"), F.min("exporter_ts").alias("exporter_ts"))
    return marked.unionByName(sums.withColumns({"category": F.lit("summary"), "pos": F.lit(0)}))
