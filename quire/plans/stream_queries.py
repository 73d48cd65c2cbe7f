"""T-series: batch twins of the streams, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.retrieval import chunks
from quire.plans.base import query
from quire.sources.corpus import page_text, table
from quire.streaming import state as T


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading positions in files of five kinds of places, on several machines."""
    n, file = F.col("event_id"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf"))
    machine = F.concat(F.lit("/Users/u"), (n % 7).cast("string"))
    path = (
        F.when(n % 5 == 0, F.concat(machine, F.lit("/Library/Mobile Documents/com~apple~CloudDocs/"), file))
        .when(n % 5 == 1, F.concat(F.lit("/home/h"), (n % 3).cast("string"), F.lit("/Library/CloudStorage/Box//"), file))
        .when(n % 5 == 2, F.concat(F.lit("/Volumes/GoogleDrive/./"), file))
        .when(n % 5 == 3, F.concat(machine, F.lit("/Documents/"), file))
        .otherwise(F.concat(F.lit("/data//"), file, F.lit("/")))
    )
    return _events(spark, sf_dir).select(T.canonical_key(path, n % 2 == 0).alias("key"), F.floor("value").alias("last_page"), F.col("ts").alias("updated_at"))


@query("""
    SELECT key, CAST(arg_max(floor(value), (ts, floor(value))) AS BIGINT) AS last_page, epoch_us(max(ts)) AS updated_at
    FROM (SELECT value, ts, CASE event_id % 5 WHEN 0 THEN 'icloud:com~apple~CloudDocs/' WHEN 1 THEN 'cloudstorage:Box/' WHEN 2 THEN 'cloudstorage:GoogleDrive/'
                                 WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'icloud:Documents/' ELSE '/Users/u' || event_id % 7 || '/Documents/' END ELSE '/data/' END || 'f' || user_id || '.pdf' AS key FROM events)
    GROUP BY key""")
def t1_reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_states(_updates(spark, sf_dir)).withColumn("updated_at", F.unix_micros("updated_at"))


@query("""
    WITH q AS (SELECT user_id AS key, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' ' || event_id % 4 AS query, ts FROM events WHERE event_id % 9 <> 0),
    n AS (SELECT key, lower(query) AS low, max(ts) AS ts, arg_max(query, (ts, query)) AS query FROM q GROUP BY ALL)
    SELECT key, rank, query FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, low) AS rank FROM n) WHERE rank <= 10""")
def t2_recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(F.when(n % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), (n % 4).cast("string"))
    asked = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(n % 9 == 0, "  ").otherwise(text).alias("query"), "ts")
    return T.recent_searches(asked).select("key", "rank", "query")


@query("SELECT user_id AS key FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id ORDER BY t DESC, user_id LIMIT 100)")
def t3_state_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.floor("value").alias("last_page"), F.col("ts").alias("updated_at"))
    return T.pruned_states(T.latest_states(updates), limit=120, kept=100).select("key")


@query("""
    WITH o AS (SELECT user_id AS path, ts, value AS stamp, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT path, epoch_us(min(ts)) AS started, count(*) AS events FROM s GROUP BY path, k HAVING arg_min(stamp, ts) <> arg_max(stamp, ts) OR count(*) = 1""")
def t4_change_debouncing(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _events(spark, sf_dir).select(F.col("user_id").alias("path"), "ts", F.col("value").alias("stamp"))
    return T.notifications(changes, burst="1 hour").withColumn("started", F.unix_micros("started"))


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("an "), F.col("event_type"), F.lit("-page by user "), F.col("user_id").cast("string"), F.lit(", "), F.upper("event_type"), F.lit("  Page “"), F.col("event_type"), F.lit("”"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_index"), "ts", text.alias("text"))


@query("""
    WITH versions AS (SELECT n_nationkey % 15 AS pattern_id, n_nationkey AS version, n_nationkey % 11 <> 3 AS active, ['click', 'view', 'purchase', 'error', 'login'][n_nationkey % 5 + 1] || ['-page', ' page by user', ' “', ''][n_nationkey % 4 + 1] AS query FROM nation),
    patterns AS (SELECT pattern_id, arg_max(query, version) AS query FROM versions GROUP BY pattern_id HAVING arg_max(active, version)),
    texts AS (SELECT 'an ' || event_type || '-page by user ' || user_id || ', ' || upper(event_type) || '  Page "' || event_type || '"' AS text, epoch_us(ts) // 86400000000 AS day FROM events)
    SELECT pattern_id, day, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT pattern_id, day, len(regexp_extract_all(text, '(?i)' || replace(replace(replace(query, '-', ' '), '“', '"'), ' ', '[- ]+'))) AS n FROM texts, patterns) WHERE n > 0 GROUP BY ALL""")
def t5_pattern_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by pattern and day; the patterns have versions, and some of the newest are not active."""
    k = F.col("n_nationkey")
    pick = lambda key, *values: F.get(F.array(*map(F.lit, values)), (k % key).cast("int"))
    versions = table(spark, sf_dir, "nation").select((k % 15).cast("long").alias("pattern_id"), F.concat(pick(5, "click", "view", "purchase", "error", "login"), pick(4, "-page", " page by user", " “", "")).alias("query"), (k % 11 != 3).alias("active"), k.cast("int").alias("version"))
    found = T.search_all(_monitored(spark, sf_dir), T.active_patterns(versions))
    return found.groupBy("pattern_id", F.expr("unix_micros(ts) div 86400000000").alias("day")).agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS started, count(*) AS n
    FROM (SELECT ts, unnest(regexp_extract_all('an ' || event_type || '-page by user ' || user_id || ', ' || event_type || ' page', '(?i)error[- ]+page')) AS m FROM events) GROUP BY 1""")
def t5_monitor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a standing search in the pages that events bring, by the day."""
    text = F.concat(F.lit("an "), F.col("event_type"), F.lit("-page by user "), F.col("user_id").cast("string"), F.lit(", "), F.col("event_type"), F.lit(" page"))
    pages = _events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_index"), "ts", text.alias("text"))
    return T.match_counts(T.standing_search(pages, "error page"), "1 day", "1 day").select(F.unix_seconds("started").alias("started"), "n")


@query()
def t6_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each document, the second of every third with a line more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first, second = docs.withColumn("mtime", F.lit(1)), docs.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit("\nanother line of text")).alias("text"), F.lit(2).alias("mtime"))
    return T.index_after(first.unionByName(second), lambda d: chunks(page_text(d)))
