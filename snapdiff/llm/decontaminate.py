"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Every benchmark item becomes windows of ``window`` consecutive words (an item with fewer
words is one window). A window can only occur where its rarest shingle occurs, so that
shingle is the whole prefix which exact containment needs:

1. count each benchmark shingle over all documents; that gives the global order by rarity;
2. for each window keep its rarest shingle and its place in the window;
3. join document shingles with those prefixes, apply the length and the position bound,
   and compare the item-sized slice of the document with the window, word by word.

The documents are read twice and their texts never shuffled: ``posexplode`` and the
broadcast join are one stage, and only hits leave it. The benchmark side is broadcast when
its counted size is under ``broadcast_rows``; a larger one is joined by shuffle, with the
texts of documents that have candidates joined back for the comparison.

Nulls, ties and repeats: a null or wordless text has 0 words and no hits; an item without
words has no window and is never reported; null item ids are left out of the digest; equal
windows of several items count for each of them; every input row gives one output row, also
when rows or ids repeat; no benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at every ASCII character that is no letter or digit."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.split(F.trim(F.regexp_replace(low, NOT_WORD, " ")), " ")


def word_count(w: Column) -> Column:
    """Splitting an empty text gives one empty word, which counts as none."""
    return F.when(w[0] == "", F.lit(0)).otherwise(F.size(w)).cast("long")


def _shingles(w: Column, n: Column, k: int) -> Column:
    """Hashes of the ``k``-word shingles at each place of ``w``; null without any."""
    at = lambda i: F.xxhash64(F.lit(k), *[w[i + j] for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), (n - k).cast("int")), at))


def benchmark_windows(benchmark: DataFrame, window: int = 10, shingle: int = 3, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(windows, members)``: distinct windows (wid, win, k) and which items hold them (wid, item)."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).withColumn("n", word_count(F.col("w"))).where("n > 0")
    last = F.greatest(F.col("n") - window, F.lit(0)).cast("int")
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("win"))
    each = each.select(F.sha2(F.array_join("win", " "), 256).alias("wid"), "item", "win").distinct()
    windows = each.groupBy("wid").agg(F.first("win").alias("win"))
    return windows.withColumn("k", F.least(F.lit(shingle), F.size("win"))), each.select("wid", "item").distinct()


def _bounded(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All occurrences of benchmark windows in the documents.

    Returns ``(hits, members, docs)``: hits (doc_id, row_key, start, len, wid), members
    (wid, item) and docs (doc_id, row_key, n_words), where row_key tells apart rows that
    share an id but not a text.
    """
    spark = documents.sparkSession
    windows, members = benchmark_windows(benchmark, window, shingle, item_col, item_text_col)
    sizes = [r.k for r in windows.groupBy("k").agg(F.count("*").alias("c")).orderBy("k").collect()]  # at most `shingle` values
    n_windows = windows.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), words(text).alias("w")).withColumn("n", word_count(F.col("w")))
    counted = docs.select("doc_id", "row_key", F.col("n").alias("n_words"))
    if not n_windows:
        none = spark.createDataFrame([], "row_key long, start int, len int, wid string")
        return docs.select("doc_id").limit(0).crossJoin(none), members, counted

    def occurrences(k: int, keep: list[str]) -> DataFrame:
        # the outer form, since Spark repeats the generator's input in an inferred filter otherwise
        return docs.select(*keep, _shingles(F.col("w"), F.col("n"), k).alias("h")).select(*keep, F.posexplode_outer("h").alias("pos", "sh"))

    parts, n_prefix = [], 0
    for k in sizes:
        own = windows.where(F.col("k") == k).select("wid", "win", F.posexplode(_shingles(F.col("win"), F.size("win"), k)).alias("at", "sh"))
        grams = own.select("sh").distinct()
        n_grams = grams.count()
        seen = occurrences(k, []).select("sh").join(_bounded(grams, n_grams, broadcast_rows), "sh").groupBy("sh").agg(F.count("*").alias("df"))
        rare = Window.partitionBy("wid").orderBy("df", "sh", "at")
        # a window whose rarest shingle no document has cannot occur
        ranked = own.join(seen, "sh", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("r", F.row_number().over(rare))
        parts.append((k, ranked.where("r = 1 AND df > 0").select("sh", "at", "wid", "win")))
        n_prefix += n_windows
    found = []
    for k, prefix in parts:
        fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("win") <= F.col("n"))
        same = F.slice("w", F.col("pos") - F.col("at") + 1, F.size("win")) == F.col("win")
        start = (F.col("pos") - F.col("at")).alias("start")
        if n_prefix <= broadcast_rows:
            at = occurrences(k, ["doc_id", "row_key", "n", "w"]).join(F.broadcast(prefix), "sh").where(fits).where(same)
        else:
            near = occurrences(k, ["doc_id", "row_key", "n"]).join(prefix, "sh").where(fits).select("doc_id", "row_key", "pos", "at", "wid", "win").distinct()
            at = near.join(docs.dropDuplicates(["doc_id", "row_key"]).withColumnsRenamed({"doc_id": "d", "row_key": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r"))).where(same)
        found.append(at.select("doc_id", "row_key", start, F.size("win").alias("len"), "wid"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return stored(hits.distinct(), "hits"), members, counted  # few rows, used several times


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window; overlaps count once.
    """
    hits, members, docs = find_benchmark(documents, benchmark, window, shingle, id_col, text_col, item_col, item_text_col)
    spans = hits.select("doc_id", "row_key", "start", (F.col("start") + F.col("len")).alias("end")).groupBy("doc_id", "row_key", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id", "row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = new.groupBy("doc_id", "row_key").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    items = hits.select("doc_id", "row_key", "wid").distinct().join(members, "wid").select("doc_id", "row_key", "item").distinct().groupBy("doc_id", "row_key").agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("items"))
    side = n_hit.join(items, (n_hit["doc_id"].eqNullSafe(items["doc_id"])) & (n_hit["row_key"] == items["row_key"])).select(n_hit["doc_id"].alias("d"), n_hit["row_key"].alias("r"), "n_hit", "n_items", "items")
    out = docs.join(side, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["row_key"] == F.col("r")), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "row_key", F.col("n_words").cast("long"), n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, all columns, without those that hold an occurrence of a benchmark window."""
    hits, _, _ = find_benchmark(documents, benchmark, window, shingle, id_col, text_col)
    bad = hits.select(F.col("doc_id").alias("__bad_id"), F.col("row_key").alias("__bad_key")).distinct()
    return documents.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__bad_key")), "left_anti")
