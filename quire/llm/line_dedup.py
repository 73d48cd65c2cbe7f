"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

Documents come in batches of rising doc_id.  A batch merge-joins the keys of its lines
against the runs that earlier batches left (a key found there was held by a smaller doc_id)
and leaves its own new keys as a run of level 0.  When a level holds ``fanout`` runs they are
compacted into one run of the next level.  Runs are tables bucketed and sorted by the hash,
so that a batch meets them without shuffling them again.

A key is the line stripped of white space at both ends with A-Z lower-cased.  Keys of at least
``min_chars`` code points held by two documents lose all their lines except those in the
smallest doc_id.

Defined results: a null or empty text is one empty line, which stays; a row without doc_id
counts as the last document; repeated rows are judged alike (a doc_id never loses lines to
itself); an empty table gives an empty result; columns beside doc_id and text pass through
``dedup_lines`` and may have any name that does not start with ``_ld_``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import few, fresh_path, row_id, saved, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "\t\n\x0b\x0c\r "


class LineRuns:
    """Levels of sorted runs; ``meet`` marks known keys, ``add`` leaves a run."""

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, keys: DataFrame) -> str:
        name = f"quire_line_run_{uuid.uuid4().hex}"
        (
            keys.select("_ld_key").repartition(self.buckets, "_ld_key")
            .write.option("path", fresh_path(self.spark, "line-run"))
            .bucketBy(self.buckets, "_ld_key").sortBy("_ld_key").saveAsTable(name)
        )
        return name

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def known(self, keys: DataFrame) -> DataFrame:
        """``keys`` with _ld_old: whether an earlier run holds the key."""
        keys = keys.withColumn("_ld_old", F.lit(False))
        for name in self.tables():
            run = self.spark.table(name).select("_ld_key", F.lit(True).alias("_ld_hit"))
            keys = keys.join(run.hint("merge"), "_ld_key", "left").withColumn("_ld_old", F.col("_ld_old") | F.col("_ld_hit").isNotNull()).drop("_ld_hit")
        return keys

    def add(self, keys: DataFrame) -> None:
        new, level = self._write(keys), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            parts, self.levels[level] = self.levels[level], []
            merged = self.spark.table(parts[0])
            for name in parts[1:]:
                merged = merged.unionAll(self.spark.table(name))
            new = self._write(merged)
            for name in parts:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def close(self) -> None:
        for name in self.tables():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _key_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """_ld_id, _ld_tag (the text's hash), _ld_pos and _ld_key of the lines whose key is long enough."""
    text = whole_text()
    lines = docs.select(row_id().alias("_ld_id"), F.xxhash64(text).alias("_ld_tag"), F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n")).alias("_ld_pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    return lines.where(F.char_length(key) >= min_chars).select("_ld_id", "_ld_tag", "_ld_pos", F.unhex(F.md5(key.cast("binary"))).alias("_ld_key"))


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """_ld_id, _ld_tag, _ld_pos of every line that goes."""
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx(row_id(), [k / batches for k in range(1, batches)]).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    batch: Column = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("_ld_id") > cut).cast("int")
    lines = saved(_key_lines(docs, min_chars).withColumn("_ld_batch", batch), "key-lines", "_ld_batch")

    runs, drops = LineRuns(spark, fanout), []
    for k in range(len(cuts) + 1):
        own = lines.where(F.col("_ld_batch") == k).drop("_ld_batch")
        keys = own.groupBy("_ld_key").agg(F.min("_ld_id").alias("_ld_first"), F.max("_ld_id").alias("_ld_last"))
        met = saved(runs.known(keys), "met-keys")
        repeated = met.where(F.col("_ld_old") | (F.col("_ld_first") < F.col("_ld_last")))
        gone = own.join(few(repeated.select("_ld_key", "_ld_old", "_ld_first")), "_ld_key").where(F.col("_ld_old") | (F.col("_ld_id") > F.col("_ld_first")))
        drops.append(saved(gone.select("_ld_id", "_ld_tag", "_ld_pos"), "dropped-lines"))
        if k < len(cuts):
            runs.add(met.where(~F.col("_ld_old")))
    runs.close()
    out = drops[0]
    for more in drops[1:]:
        out = out.unionAll(more)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, n_lines: str = "_ld_lines", n_dropped: str = "_ld_dropped") -> DataFrame:
    """``docs`` with text replaced by the lines that stay, plus two counts, whose names must be free."""
    drops = dropped_lines(docs, min_chars, batches, fanout)
    per_doc = drops.groupBy("_ld_id", "_ld_tag").agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_gone"))
    lines = F.split(whole_text(), "\n")
    joined = (
        docs.select(F.struct(*(c for c in docs.columns if c.lower() != "text")).alias("row"), "text", row_id().alias("_ld_id"), F.xxhash64(whole_text()).alias("_ld_tag"))
        .join(per_doc, ["_ld_id", "_ld_tag"], "left")
        .withColumn("_ld_gone", F.coalesce("_ld_gone", F.array().cast("array<int>")))
        .withColumns({"_ld_lines": F.size(lines).cast("long"), "_ld_dropped": F.size("_ld_gone").cast("long")})
        .withColumn("_ld_cuts", F.concat(F.array(F.lit(-1)), F.col("_ld_gone"), F.array(F.col("_ld_lines").cast("int"))))
    )
    between = F.transform(
        F.sequence(F.lit(1), F.size("_ld_gone") + 1),
        lambda i: F.slice(lines, F.element_at("_ld_cuts", i) + 2, F.element_at("_ld_cuts", i + 1) - F.element_at("_ld_cuts", i) - 1),
    )
    kept = F.when(F.col("_ld_dropped") == 0, whole_text()).otherwise(F.array_join(F.flatten(between), "\n"))
    own = [kept.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*own, F.col("_ld_lines").alias(n_lines), F.col("_ld_dropped").alias(n_dropped))
