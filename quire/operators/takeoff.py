"""Measurement takeoff: values of marks, scales, schedule, totals and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points in a metre on paper, and metres in each unit: fixed values.
POINTS_PER_METRE = 72 / 0.0254
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254, "ft-in": 0.3048}
#: Named scales (ratio, linear unit, points to a unit), by number.
PRESETS = [(f"1:{n}", "m", POINTS_PER_METRE / n) for n in (20, 50, 100, 200, 500)] + [(f'1/{d}" = 1\'', "ft-in", 72 / d) for d in (16, 8, 4)]
DEFAULT = 2
#: How lengths are written, parts of an inch, and what no circle is: three points on a line, or a radius beyond.
LENGTH_FORMS = {"m": ("%.2f m", 100), "cm": ("%.1f cm", 10), "mm": ("%.0f mm", 1), "ft": ("%.2f ft", 100)}
INCH_PARTS, LINE, MOST_RADIUS = 16, 1e-6, 1e6


def polyline_length(points: Column) -> Column:
    """M1: length of the path through the points, in points."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def polygon_area(points: Column) -> Column:
    """M1: shoelace area in square points, 0 for fewer than three points."""
    turned = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, d: s + d)) / 2)


def apex_angle(points: Column) -> Column:
    """M1: angle in degrees at the second of three points."""
    a, b, c = points[0], points[1], points[2]
    ax, ay, cx, cy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * cx + ay * cy) / (F.hypot(ax, ay) * F.hypot(cx, cy))))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _corner(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def circle_through(points: Column) -> Column:
    """M1: struct(x, y, r, start, sweep) of the circle through three points and the turn from the first to the last by way of the second.

    Null if the points lie on a line, or nearly: the circle's radius would be ``MOST_RADIUS`` or more.
    """

    def centre(p: Column) -> Column:
        a, b, e = (F.get(p, F.lit(k)) for k in range(3))
        d = 2 * (a["x"] * (b["y"] - e["y"]) + b["x"] * (e["y"] - a["y"]) + e["x"] * (a["y"] - b["y"]))
        norm = lambda q: q["x"] * q["x"] + q["y"] * q["y"]
        x = F.try_divide(norm(a) * (b["y"] - e["y"]) + norm(b) * (e["y"] - a["y"]) + norm(e) * (a["y"] - b["y"]), d)
        y = F.try_divide(norm(a) * (e["x"] - b["x"]) + norm(b) * (a["x"] - e["x"]) + norm(e) * (b["x"] - a["x"]), d)
        return _let(F.struct(a.alias("a"), b.alias("b"), e.alias("e"), d.alias("d"), x.alias("x"), y.alias("y")), turned)

    def turned(c: Column) -> Column:
        angle = lambda name: F.atan2(c[name]["y"] - c["y"], c[name]["x"] - c["x"])
        whole = 2 * F.pi()
        return _let(
            F.struct(c["d"].alias("d"), c["x"].alias("x"), c["y"].alias("y"), F.hypot(c["a"]["x"] - c["x"], c["a"]["y"] - c["y"]).alias("r"), angle("a").alias("start"), F.pmod(angle("b") - angle("a"), whole).alias("to_middle"), F.pmod(angle("e") - angle("a"), whole).alias("to_end")),
            lambda t: F.when((F.abs(t["d"]) > LINE) & (t["r"] < MOST_RADIUS), F.struct(t["x"].alias("x"), t["y"].alias("y"), t["r"].alias("r"), t["start"].alias("start"), F.when(t["to_middle"] <= t["to_end"], t["to_end"]).otherwise(t["to_end"] - whole).alias("sweep"))),
        )

    return _let(points, centre)


def shape_value(kind: Column, points: Column) -> Column:
    """M1: area of a rectangle (two corners) or circle (centre, point on it), length of an arc (start, point along it, end); null with other points."""

    def value(p: Column) -> Column:
        a, b, e = (F.get(p, F.lit(k)) for k in range(3))
        arc = _let(circle_through(p), lambda c: F.coalesce(c["r"] * F.abs(c["sweep"]), F.hypot(e["x"] - a["x"], e["y"] - a["y"])))
        reach = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        two, three = F.size(p) == 2, F.size(p) == 3
        return F.when((kind == "rectangle") & two, F.abs((b["x"] - a["x"]) * (b["y"] - a["y"]))).when((kind == "circle") & two, F.pi() * reach * reach).when((kind == "arc") & three, arc)

    return _let(points, value)


def _around(c: Column, n: Column, last: Column) -> Column:
    """Points of a circle struct (x, y, r, start, sweep), from 0 to ``last`` of ``n`` steps."""
    turn = lambda k: c["start"] + c["sweep"] * k / n
    return F.transform(F.sequence(F.lit(0), last), lambda k: _corner(c["x"] + c["r"] * F.cos(turn(k)), c["y"] + c["r"] * F.sin(turn(k))))


def traced(kind: Column, points: Column) -> Column:
    """M1: the points that a shape is drawn through: corners, or one every two degrees."""

    def drawn(p: Column) -> Column:
        a, b, e = (F.get(p, F.lit(k)) for k in range(3))
        corners = F.array(_corner(a["x"], a["y"]), _corner(b["x"], a["y"]), _corner(b["x"], b["y"]), _corner(a["x"], b["y"]))
        whole = F.struct(a["x"].alias("x"), a["y"].alias("y"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("r"), F.atan2(b["y"] - a["y"], b["x"] - a["x"]).alias("start"), (2 * F.pi()).alias("sweep"))
        ring = _let(whole, lambda c: _around(c, F.lit(180), F.lit(179)))
        straight = F.array(_corner(a["x"], a["y"]), _corner(e["x"], e["y"]))
        steps = lambda c: F.greatest(F.lit(2), F.ceil(F.degrees(F.abs(c["sweep"])) / 2 - 1e-9).cast("int"))
        bow = _let(circle_through(p), lambda c: F.when(c.isNotNull(), _around(c, steps(c), steps(c))).otherwise(straight))
        return F.when(kind == "rectangle", corners).when(kind == "circle", ring).when(kind == "arc", bow)

    return _let(points, drawn)


def _common_divisor(a: Column, b: Column) -> Column:
    """Euclid's, for numbers that fit an int."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: F.greatest(F.lit(1).cast("long"), s["x"]))


def _fraction(parts: Column, of: int) -> Column:
    """parts / of in lowest terms."""
    return _let(_common_divisor(parts, F.lit(of)), lambda c: F.concat((parts / c).cast("long").cast("string"), F.lit("/"), (F.lit(of) / c).cast("long").cast("string")))


def length_text(real: Column, unit: Column, parts: int = INCH_PARTS) -> Column:
    """M3: a length as drawings write it; feet and inches, and inches, with fractions in lowest terms."""
    plain = F.lit(None).cast("string")
    for name, (form, scale) in LENGTH_FORMS.items():
        plain = F.when(unit == name, F.format_string(form, F.floor(real * scale + 0.5) / scale)).otherwise(plain)
    total = F.floor(F.greatest(real, F.lit(0.0)) * F.when(unit == "ft-in", 12).otherwise(1) * parts + 0.5).cast("long")
    split = F.struct((total / parts).cast("long").alias("whole"), (total % parts).alias("rest"))

    def written(t: Column) -> Column:
        inches = lambda n: F.when(t["rest"] == 0, n.cast("string")).when(n == 0, _fraction(t["rest"], parts)).otherwise(F.concat(n.cast("string"), F.lit(" "), _fraction(t["rest"], parts)))
        feet = F.concat((t["whole"] / 12).cast("long").cast("string"), F.lit("'-"), inches(t["whole"] % 12), F.lit('"'))
        return F.when(unit == "ft-in", feet).when(unit == "in", F.concat(inches(t["whole"]), F.lit('"')))

    return F.coalesce(plain, _let(split, written))


def area_text(real: Column, unit: Column) -> Column:
    """M3: an area as drawings write it: square feet or inches, or else square metres."""
    metres = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[unit]
    rounded = lambda x, n: F.floor(x * n + 0.5) / n
    return F.when(unit.isin("ft", "ft-in"), F.format_string("%.1f sq ft", rounded(real, 10))).when(unit == "in", F.format_string("%.0f sq in", rounded(real, 1))).otherwise(F.format_string("%.2f m²", rounded(real * metres * metres, 100)))


def preset_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRESETS)], "preset int, ratio string, unit string, per_unit double")


def real_values(marks: DataFrame, scales: DataFrame) -> DataFrame:
    """M2: marks with unit, ratio and real value: the page's scale, else the default.

    ``scales`` has doc_id, page_index, per_unit, unit; the ratio is that of the preset with the
    unit whose points to a unit agree within 0.1 %.
    """
    presets = preset_table(marks.sparkSession)
    named = scales.join(F.broadcast(presets.select(F.col("unit").alias("p_unit"), "ratio", F.col("per_unit").alias("p_per"))), (F.col("unit") == F.col("p_unit")) & (F.abs(F.col("per_unit") - F.col("p_per")) <= 0.001 * F.col("p_per")), "left").drop("p_unit", "p_per")
    ratio, unit, per = PRESETS[DEFAULT]
    out = marks.join(named, ["doc_id", "page_index"], "left").withColumns({"from_default": F.col("per_unit").isNull()})
    out = out.withColumns({"unit": F.when(F.col("from_default"), unit).otherwise(F.col("unit")), "ratio": F.when(F.col("from_default"), ratio).otherwise(F.col("ratio")), "per_unit": F.coalesce("per_unit", F.lit(per))})
    real = F.when(F.col("type") == "length", F.col("value") / F.col("per_unit")).when(F.col("type") == "area", F.col("value") / (F.col("per_unit") * F.col("per_unit"))).otherwise(F.col("value"))
    return out.withColumn("real", real)


def schedule(valued: DataFrame, hidden_layers: list[int]) -> DataFrame:
    """M3: one row a mark, count markers one row for page and group; hidden layers are left out."""
    shown = valued.where(~F.col("layer").isin(hidden_layers))
    text = F.when(F.col("type") == "area", area_text(F.col("real"), F.col("unit"))).otherwise(length_text(F.col("real"), F.col("unit")))
    single = shown.where("type != 'count'").select("doc_id", "page_index", "mark_no", "type", "group", "layer", F.lit(1).cast("long").alias("n"), "real", "unit", text.alias("shown"))
    counts = shown.where("type = 'count'").groupBy("doc_id", "page_index", "group").agg(F.min("mark_no").alias("mark_no"), F.min("layer").alias("layer"), F.count("*").alias("n"))
    counted = counts.select("doc_id", "page_index", "mark_no", F.lit("count").alias("type"), "group", "layer", "n", F.lit(None).cast("double").alias("real"), F.lit(None).cast("string").alias("unit"), F.col("n").cast("string").alias("shown"))
    return single.unionByName(counted)


def totals(rows: DataFrame) -> DataFrame:
    """M4: length and area of each document in the units of its first entry; null where nothing was measured."""
    metres = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("unit")]
    measured = rows.where("type IN ('length', 'area')").withColumn("metres", metres)
    first = F.min_by("unit", F.struct("page_index", "mark_no"))
    per_doc = measured.groupBy("doc_id").agg(F.sum(F.when(F.col("type") == "length", F.col("real") * F.col("metres"))).alias("m"), F.sum(F.when(F.col("type") == "area", F.col("real") * F.col("metres") * F.col("metres"))).alias("m2"), first.alias("unit"))
    to = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("unit")]
    return per_doc.select("doc_id", "unit", F.when(F.col("m") != 0, F.col("m") / to).alias("length"), F.when(F.col("m2") != 0, F.col("m2") / (to * to)).alias("area"))


def rollup_totals(rows: DataFrame) -> DataFrame:
    """M4: entries and measured values by layer and type, with subtotals."""
    return rows.rollup("layer", "type").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("entries"), F.sum("n").alias("marks"))


def counts_by_group(rows: DataFrame) -> DataFrame:
    """M5: count markers by group over all pages."""
    return rows.where("type = 'count'").groupBy("doc_id", "group").agg(F.sum("n").alias("n"))
