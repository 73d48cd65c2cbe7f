"""M-series: measurement takeoff over marks made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import takeoff as M
from quire.plans.base import query
from quire.sources.corpus import table


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "area").when(F.col("l_returnflag") == "N", "length").otherwise("count")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("mark_no"), kind.alias("type"), F.col("l_extendedprice").cast("double").alias("value"), (F.col("l_partkey") % 5).alias("group"), (F.col("l_suppkey") % 4).alias("layer"))


def page_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = marks(spark, sf_dir).where("doc_id % 3 != 0").select("doc_id", "page_index", ((F.col("doc_id") + F.col("page_index")) % len(M.PRESETS)).cast("int").alias("preset")).distinct()
    return pages.join(F.broadcast(M.preset_table(spark)), "preset").select("doc_id", "page_index", "per_unit", "unit")


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.real_values(marks(spark, sf_dir), page_scales(spark, sf_dir))


_ratio, _unit, _per = M.PRESETS[M.DEFAULT]
PRESETS_SQL = "(VALUES " + ", ".join(f"""({i}, '{r.replace("'", "''")}', '{u}', {p!r}::DOUBLE)""" for i, (r, u, p) in enumerate(M.PRESETS)) + ") AS p(preset, ratio, unit, per_unit)"
MARKS_SQL = f"""
    marks AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_index, l_partkey * 1000 + l_suppkey AS mark_no, CASE l_returnflag WHEN 'A' THEN 'area' WHEN 'N' THEN 'length' ELSE 'count' END AS type,
                     CAST(l_extendedprice AS DOUBLE) AS value, l_partkey % 5 AS "group", l_suppkey % 4 AS layer FROM lineitem),
    valued AS (SELECT m.*, coalesce(ratio, '{_ratio}') AS ratio, coalesce(unit, '{_unit}') AS unit, ratio IS NULL AS from_default,
                      CASE type WHEN 'length' THEN value / coalesce(per_unit, {_per!r}) WHEN 'area' THEN value / (coalesce(per_unit, {_per!r}) * coalesce(per_unit, {_per!r})) ELSE value END AS real
               FROM marks m LEFT JOIN {PRESETS_SQL} ON doc_id % 3 <> 0 AND p.preset = (doc_id + page_index) % {len(M.PRESETS)}),
    shown AS (SELECT * FROM valued WHERE layer <> 3),
    schedule AS (SELECT doc_id, page_index, mark_no, type, "group", layer, 1::BIGINT AS n, real, unit, CASE WHEN type = 'area' AND unit = 'm' THEN printf('%.2f m²', floor(real * 100 + 0.5) / 100) WHEN type = 'area' THEN printf('%.1f sq ft', floor(real * 10 + 0.5) / 10) WHEN unit = 'm' THEN printf('%.2f m', floor(real * 100 + 0.5) / 100)
                             ELSE (k // 192) || '''-' || CASE WHEN k % 16 = 0 THEN '' || k // 16 % 12 ELSE CASE WHEN k // 16 % 12 = 0 THEN '' ELSE k // 16 % 12 || ' ' END || k % 16 // gcd(k % 16, 16) || '/' || 16 // gcd(k % 16, 16) END || '"' END AS shown
                 FROM (SELECT *, CAST(floor(real * 192 + 0.5) AS BIGINT) AS k FROM shown) WHERE type <> 'count'
                 UNION ALL SELECT doc_id, page_index, min(mark_no), 'count', "group", min(layer), count(*), NULL, NULL, CAST(count(*) AS VARCHAR) FROM shown WHERE type = 'count' GROUP BY doc_id, page_index, "group")"""
METRES_SQL = "CASE unit " + " ".join(f"WHEN '{u}' THEN {m!r}" for u, m in M.UNITS.items()) + " END"


@query("""
    SELECT o_orderkey AS doc_id, round(sqrt(1.0 * a * a + 1.0 * b * b), 4) AS length, round(a * b / 2.0, 4) AS area FROM (SELECT o_orderkey, o_orderkey % 300 AS a, o_custkey % 400 AS b FROM orders)""")
def m1_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right triangles: the path along the long side, and the area."""
    sides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 300).cast("double").alias("a"), (F.col("o_custkey") % 400).cast("double").alias("b"))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    shapes = sides.select("doc_id", F.array(at(F.col("a"), zero), at(zero, F.col("b"))).alias("path"), F.array(at(zero, zero), at(F.col("a"), zero), at(zero, F.col("b"))).alias("ring"))
    return shapes.select("doc_id", F.round(M.polyline_length(F.col("path")), 4).alias("length"), F.round(M.polygon_area(F.col("ring")), 4).alias("area"))


@query("""
    SELECT doc_id, kind, round(CASE kind WHEN 'rectangle' THEN w * h WHEN 'circle' THEN pi() * (w * w + h * h) WHEN 'arc' THEN w * t ELSE sqrt(w * w + h * h) END, 3) AS value, CAST(CASE kind WHEN 'rectangle' THEN 4 WHEN 'circle' THEN 180 WHEN 'arc' THEN greatest(2, ceil(degrees(t) / 2 - 1e-9)) + 1 ELSE 2 END AS INT) AS drawn
    FROM (SELECT o_orderkey AS doc_id, ['rectangle', 'circle', 'arc', 'line'][o_orderkey % 4 + 1] AS kind, o_orderkey % 300 + 5 AS w, o_custkey % 400 + 5 AS h, (o_custkey % 170 + 5) * 2 * pi() / 181 AS t FROM orders)""")
def m1_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, circles, arcs that turn either way by up to nearly all round, and arcs whose points are on a line."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h, t = (k % 300 + 5).cast("double"), (c % 400 + 5).cast("double"), (c % 170 + 5) * 2 * F.pi() / 181
    x, y, way = (c % 50).cast("double"), (k % 70).cast("double"), F.when(c % 2 == 0, 1).otherwise(-1)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    on = lambda part: at(x + w * F.cos(k + way * t * part), y + w * F.sin(k + way * t * part))
    points = F.when(k % 4 < 2, F.array(at(x, y), at(x - w, y + h))).when(k % 4 == 2, F.array(on(0.0), on(0.4), on(1.0))).otherwise(F.array(at(x, y), at(x + w / 2, y + h / 2), at(x + w, y + h)))
    kind = F.get(F.array(*map(F.lit, ("rectangle", "circle", "arc", "line"))), (k % 4).cast("int"))
    shapes = table(spark, sf_dir, "orders").select(k.alias("doc_id"), kind.alias("kind"), F.when(k % 4 == 3, "arc").otherwise(kind).alias("drawn_as"), points.alias("points"))
    return shapes.select("doc_id", "kind", F.round(M.shape_value(F.col("drawn_as"), F.col("points")), 3).alias("value"), F.size(M.traced(F.col("drawn_as"), F.col("points"))).alias("drawn"))


@query(f"""WITH {MARKS_SQL} SELECT doc_id, page_index, mark_no, type, ratio, unit, from_default, floor(real * 100 + 0.5) / 100 AS real FROM valued""")
def m2_scale_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(spark, sf_dir).select("doc_id", "page_index", "mark_no", "type", "ratio", "unit", "from_default", (F.floor(F.col("real") * 100 + 0.5) / 100).alias("real"))


@query(f"""WITH {MARKS_SQL} SELECT doc_id, page_index, mark_no, type, "group", layer, n, shown FROM schedule""")
def m3_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.schedule(valued(spark, sf_dir), [3]).select("doc_id", "page_index", "mark_no", "type", "group", "layer", "n", "shown")


@query(f"""WITH {MARKS_SQL},
    sums AS (SELECT doc_id, sum(CASE WHEN type = 'length' THEN real * {METRES_SQL} END) AS m, sum(CASE WHEN type = 'area' THEN real * {METRES_SQL} * {METRES_SQL} END) AS m2,
                    arg_min(unit, (page_index, mark_no)) AS unit FROM schedule WHERE type IN ('length', 'area') GROUP BY doc_id)
    SELECT doc_id, unit, floor(round(CASE WHEN m <> 0 THEN m / {METRES_SQL} END, 6) * 1000 + 0.5) / 1000 AS length, floor(round(CASE WHEN m2 <> 0 THEN m2 / ({METRES_SQL} * {METRES_SQL}) END, 6) * 1000 + 0.5) / 1000 AS area FROM sums""")
def m4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.totals(M.schedule(valued(spark, sf_dir), [3]))
    rounded = lambda c: (F.floor(F.round(c, 6) * 1000 + 0.5) / 1000).alias(c)
    return out.select("doc_id", "unit", rounded("length"), rounded("area"))


@query(f"""WITH {MARKS_SQL} SELECT layer, type, CAST(grouping(layer) * 2 + grouping(type) AS INT) AS level, count(*) AS entries, CAST(sum(n) AS BIGINT) AS marks FROM schedule GROUP BY ROLLUP (layer, type)""")
def m4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rollup_totals(M.schedule(valued(spark, sf_dir), [3]))


@query(f"""WITH {MARKS_SQL} SELECT doc_id, "group", CAST(sum(n) AS BIGINT) AS n FROM schedule WHERE type = 'count' GROUP BY ALL""")
def m5_counts_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts_by_group(M.schedule(valued(spark, sf_dir), [3]))
