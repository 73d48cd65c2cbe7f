"""T-series: streams of reading states, searches, file changes, pages and documents, and their batch twins.

Keyed state lives in Spark's state store (``transformWithState``): a batch touches the keys that
it holds, and a stream gives one row for each key that changed.  ``change_log`` appends those
rows to a log, a folder a batch; a batch that runs again replaces its own folder and no other.
Readers take the newest row of each key.  Each batch twin gives what the stream ends with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions.matches import fold, folded_query, matches, search_pattern, unfolded
from quire.operators import sensitive

KEPT_SEARCHES, STATE_LIMIT, STATE_KEPT, BURST = 10, 500, 300, "400 milliseconds"
CHUNKS = "doc_id long, page_index int, chunk_no int, text string, mtime int"
STATES = "key string, last_page long, updated_at timestamp"
SEARCHES = "key long, query string, ts timestamp"
#: Patterns that one pass over a batch looks for.
PATTERNS = 50_000
#: Folders of a home that storage providers keep, and what keys say instead of them.
PROVIDERS = [
    (r"^/(?:Users|home)/[^/]+/Library/Mobile Documents/", "icloud:"),
    (r"^/(?:Users|home)/[^/]+/Library/CloudStorage/", "cloudstorage:"),
    (r"^/Volumes/GoogleDrive/", "cloudstorage:GoogleDrive/"),
]
SYNCED = [(r"^/(?:Users|home)/[^/]+/Documents/", "icloud:Documents/"), (r"^/(?:Users|home)/[^/]+/Desktop/", "icloud:Desktop/")]


def canonical_key(path: Column, synced: Column | None = None) -> Column:
    """A document's key, the same on every machine: its provider and the path there, or else the plain path.

    Documents and desktop count as a provider's if ``synced`` says so.
    """
    plain = F.regexp_replace(F.regexp_replace(path, "/(?:[.]?/)+", "/"), "(?<=.)/$", "")
    key = F.lit(None).cast("string")
    for rules, applies in ((PROVIDERS, F.lit(True)), (SYNCED, F.coalesce(synced, F.lit(False)) if synced is not None else F.lit(False))):
        for start, said in rules:
            key = F.coalesce(key, F.when(applies & plain.rlike(start), F.concat(F.lit(said), F.regexp_replace(plain, start, ""))))
    return F.coalesce(key, plain)


def keyed_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, expires: bool = False) -> DataFrame:
    """``stream`` grouped by ``key`` through a processor; its state needs the session's RocksDB store, which is set here.

    State that expires needs batches as time goes by, whether or not there are new rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.where(F.col(key).isNotNull()).groupBy(key).transformWithState(processor, schema, "Update", "ProcessingTime" if expires else "None")


def change_log(path: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """A foreachBatch function that writes ``make(batch)`` to the folder of its batch under ``path``."""

    def append(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return append


def newest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key of a change log, by ``order``."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in columns))


class LatestState(StatefulProcessor):
    """Keeps the latest update of a key, for ``days`` after it came if these are given."""

    def __init__(self, days: int | None = None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at long, last_page long", *([self.days * 86_400_000] if self.days else []))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        had = tuple(self.latest.get()) if self.latest.exists() else None
        now = max([(r["at"], r["last_page"]) for r in rows] + ([had] if had else []))
        if now != had:
            self.latest.update(now)
            yield Row(key=key[0], last_page=now[1], at=now[0])

    def close(self) -> None:
        pass


def reading_states(updates: DataFrame, days: int | None = None) -> DataFrame:
    """T1, stream: key, last_page, updated_at of every key whose latest state changed; updates without key or time are left out."""
    rows = updates.where("updated_at IS NOT NULL AND last_page IS NOT NULL").select("key", "last_page", F.unix_micros("updated_at").alias("at"))
    kind = updates.schema["key"].dataType.simpleString()
    out = keyed_state(rows, "key", LatestState(days), f"key {kind}, last_page long, at long", expires=bool(days))
    return out.select("key", "last_page", F.timestamp_micros("at").alias("updated_at"))


def latest_states(updates: DataFrame) -> DataFrame:
    """T1, batch twin: the latest update of each key (key, last_page, updated_at)."""
    return updates.groupBy("key").agg(F.max_by("last_page", F.struct("updated_at", "last_page")).alias("last_page"), F.max("updated_at").alias("updated_at"))


class RecentSearches(StatefulProcessor):
    """Keeps a key's newest searches, one for each spelling whatever its case."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.searches = handle.getListState("searches", "low string, at long, query string")
        self.changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        had = [tuple(x) for x in self.searches.get()] if self.searches.exists() else []
        by_spelling: dict[str, tuple[int, str]] = {}
        for low, at, query in had + [(r["low"], r["at"], r["query"]) for r in rows]:
            by_spelling[low] = max(by_spelling.get(low, (at, query)), (at, query))
        now = sorted(((low, at, query) for low, (at, query) in by_spelling.items()), key=lambda x: (-x[1], x[0]))[: self.kept]
        if now != had:
            n = 1 + (self.changes.get()[0] if self.changes.exists() else 0)
            self.searches.put(now)
            self.changes.update((n,))
            yield Row(key=key[0], n=n, searches=[(query, at) for _, at, query in now])

    def close(self) -> None:
        pass


def _asked(searches: DataFrame) -> DataFrame:
    return searches.where(F.btrim("query", F.lit(" \t\n")) != "").withColumn("low", F.lower("query"))


def search_lists(searches: DataFrame, kept: int = KEPT_SEARCHES) -> DataFrame:
    """T2, stream: key, n (which change it is) and searches (query, at; newest first) of every key whose list changed."""
    rows = _asked(searches).where("ts IS NOT NULL").select("key", "low", F.unix_micros("ts").alias("at"), "query")
    kind = searches.schema["key"].dataType.simpleString()
    return keyed_state(rows, "key", RecentSearches(kept), f"key {kind}, n long, searches array<struct<query:string,at:long>>")


def listed_searches(log: DataFrame) -> DataFrame:
    """Key, rank, query, ts from the change log of ``search_lists``."""
    each = newest(log, "key", "n").select("key", F.posexplode("searches").alias("rank", "s"))
    return each.select("key", (F.col("rank") + 1).alias("rank"), "s.query", F.timestamp_micros("s.at").alias("ts"))


def recent_searches(searches: DataFrame, kept: int = KEPT_SEARCHES) -> DataFrame:
    """T2, batch twin: the newest searches of each key, one for each spelling whatever its case, blanks left out."""
    latest = _asked(searches).groupBy("key", "low").agg(F.max("ts").alias("ts"), F.max_by("query", F.struct("ts", "query")).alias("query"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), "low"))
    return latest.withColumn("rank", rank).where(F.col("rank") <= kept).select("key", "rank", "query", "ts")


def pruned_states(states: DataFrame, limit: int = STATE_LIMIT, kept: int = STATE_KEPT) -> DataFrame:
    """Above ``limit`` entries the ``kept`` latest stay."""
    return states.orderBy(F.desc("updated_at"), "key").limit(kept) if states.count() > limit else states


def pruned_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The table that ``merge_and_prune`` left after a batch; empty if there is none."""
    try:
        return spark.read.schema(STATES).parquet(f"{path}/v={number}")
    except AnalysisException:  # no batch has been written
        return spark.createDataFrame([], STATES)


def merge_and_prune(path: str, limit: int = STATE_LIMIT, kept: int = STATE_KEPT):
    """A foreachBatch function for a table of latest states that is pruned after every batch, so it stays below ``limit`` rows and a batch's own.

    Each batch writes a version of its own from the one before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = pruned_version(batch.sparkSession, path, number - 1)
        rows = batch.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), "last_page", "updated_at")
        pruned_states(latest_states(old.unionByName(rows)), limit, kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def notifications(events: DataFrame, burst: str = BURST, late: str | None = None) -> DataFrame:
    """T4: one row for each burst of file events (path, ts, stamp) in which the stamp changed: a session window.

    With ``late`` the events are a stream and that is its watermark.
    """
    rows = events.withWatermark("ts", late) if late else events
    sessions = rows.groupBy("path", F.session_window("ts", burst).alias("w")).agg(F.count("*").alias("events"), F.min_by("stamp", "ts").alias("before"), F.max_by("stamp", "ts").alias("after"))
    return sessions.where("before != after OR events = 1").select("path", F.col("w.start").alias("started"), "events")


def standing_search(pages: DataFrame, query: str) -> DataFrame:
    """T5: matches (doc_id, page_index, ts, start, len, matched) of arriving pages; stateless, so it serves streams and tables alike."""
    pattern = search_pattern(query)
    hit = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page_index", "ts", F.explode(matches(F.col("text"), pattern)).alias("m"))
    return hit.select("doc_id", "page_index", "ts", "m.*")


def standing_findings(pages: DataFrame) -> DataFrame:
    """T5: sensitive data in arriving pages, by all presets; stateless."""
    return sensitive.scan(pages)


def active_patterns(versions: DataFrame) -> DataFrame:
    """pattern_id, query of the patterns in force: the newest version of each, unless that one is not active."""
    return newest(versions, "pattern_id", "version").where("active AND query IS NOT NULL").select("pattern_id", "query")


@lru_cache(maxsize=4)
def _automaton(patterns: tuple[tuple[int, str], ...]) -> ahocorasick.Automaton:
    known = ahocorasick.Automaton()
    by_text: dict[str, list[int]] = {}
    for number, query in patterns:
        if query:
            by_text.setdefault(query, []).append(number)
    for text, numbers in by_text.items():
        known.add_word(text, (len(text), numbers))
    known.make_automaton()
    return known


def search_all(pages: DataFrame, patterns: DataFrame, block: int = PATTERNS) -> DataFrame:
    """T5: doc_id, page_index, ts, pattern_id, start, len, matched: the matches of many patterns (pattern_id, query) in ``pages``.

    The queries are smart ones, as of ``search_pattern``: runs of dashes and white space match any
    such run, quotes each other, A-Z any case.  Texts are folded as the queries are, and one
    automaton finds all of them in one pass; beyond ``block`` patterns each block has its own.
    Matches of one pattern don't overlap.
    """
    spark = pages.sparkSession
    blocks = -(-patterns.count() // block)
    shown = pages.select("doc_id", "page_index", "ts", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.schema.fields[:3]) + ", pattern_id long, start int, len int, matched string"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        some = patterns.where(F.pmod(F.xxhash64("pattern_id"), F.lit(blocks)) == k)
        known = spark.sparkContext.broadcast(tuple(sorted((r["pattern_id"], folded_query(r["query"])) for r in some.collect())))  # about ``block`` patterns

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(known.value)
            for batch in batches:
                rows, found = [], []
                if len(automaton):
                    for n, text in enumerate(batch.column(3).to_pylist()):
                        if not text:
                            continue
                        reach: dict[int, int] = {}
                        hits = [(end + 1 - size, end + 1, p) for end, (size, numbers) in automaton.iter(fold(text)) for p in numbers]
                        if not hits:
                            continue
                        places = unfolded(text)
                        for low, high, p in sorted(hits):
                            if low >= reach.get(p, 0):
                                reach[p] = high
                                rows.append(n)
                                found.append((p, places[low], places[high] - places[low], text[places[low] : places[high]]))
                kept = pa.array(rows, pa.int64())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
                columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(kept) for j in range(3)), *columns], ["doc_id", "page_index", "ts", "pattern_id", "start", "len", "matched"])

        out = out.unionByName(shown.mapInArrow(run, schema))
    return out


def monitor(path: str, read_patterns: Callable[[], DataFrame]):
    """T5: a foreachBatch function that matches each batch of pages with the patterns that are in force as it begins.

    ``read_patterns`` gives their versions (pattern_id, query, active, version) as a table.
    """
    return change_log(path, lambda batch: search_all(batch, active_patterns(read_patterns())))


def match_counts(found: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    """T5: matches (with ts) by sliding windows."""
    rows = found.withWatermark("ts", late) if late else found
    return rows.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


class NewestVersion(StatefulProcessor):
    """Lets a document pass if its mtime is later than all before; keeps that time only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mtime = handle.getValueState("mtime", "mtime long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        best = max(((r["mtime"], r["text"] or "") for r in rows), default=None)
        if best is not None and (not self.mtime.exists() or self.mtime.get()[0] < best[0]):
            self.mtime.update((best[0],))
            yield Row(doc_id=key[0], text=best[1], mtime=best[0])

    def close(self) -> None:
        pass


def changed_documents(docs: DataFrame) -> DataFrame:
    """T6, stream: doc_id, text, mtime of documents that are new or whose mtime moved on."""
    rows = docs.where("mtime IS NOT NULL").select("doc_id", "text", F.col("mtime").cast("long").alias("mtime"))
    return keyed_state(rows, "doc_id", NewestVersion(), "doc_id long, text string, mtime long").withColumn("mtime", F.col("mtime").cast("int"))


def refresh_index(path: str, chunk: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function that adds the chunks of ``changed_documents`` to an index's log.

    A row without chunk stands for the document's version itself, which may have no chunks.
    """

    def versions(batch: DataFrame) -> DataFrame:
        made = chunk(batch.select("doc_id", "text")).join(batch.select("doc_id", "mtime"), "doc_id")
        return made.select("doc_id", "page_index", "chunk_no", "text", "mtime").unionByName(batch.select("doc_id", "mtime"), allowMissingColumns=True)

    return change_log(path, versions)


def index_now(log: DataFrame) -> DataFrame:
    """The chunks of each document's newest version, from the index's log."""
    last = log.where("chunk_no IS NULL").groupBy("doc_id").agg(F.max("mtime").alias("mtime"))
    return log.where("chunk_no IS NOT NULL").join(last, ["doc_id", "mtime"]).select("doc_id", "page_index", "chunk_no", "text", "mtime")


def index_after(batches: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T6, batch twin: chunks of the newest version of each document."""
    rows = batches.where("mtime IS NOT NULL")
    last = rows.groupBy("doc_id").agg(F.max_by("text", F.struct("mtime", "text")).alias("text"), F.max("mtime").alias("mtime"))
    return chunk(last).join(last.select("doc_id", "mtime"), "doc_id")
