"""Pattern matches with their offsets (code points, from 0), as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a run of dashes or spaces in a query stands for.
DASH_OR_SPACE = "[ \\t\\n\\r\\f­‐‑‒–—− -]+"
_QUERY_RUN = re.compile("[ \t\\-­–—−]+")
SINGLE_QUOTES, DOUBLE_QUOTES = "'‘’", '"“”'


def literal(text: str) -> str:
    """The text as a pattern that both Java and RE2 take literally."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def smart_pattern(query: str) -> str:
    """Spaces and dashes match any run of either, quotes of all shapes each other, the rest itself."""
    if len(query) > 1 and query[0] in SINGLE_QUOTES + DOUBLE_QUOTES and query[-1] in SINGLE_QUOTES + DOUBLE_QUOTES:
        query = query[1:-1]
    out, at = [], 0
    for run in [*_QUERY_RUN.finditer(query), None]:
        for c in query[at : run.start() if run else len(query)]:
            same = next((q for q in (SINGLE_QUOTES, DOUBLE_QUOTES) if c in q), None)
            out.append(f"[{same}]" if same else literal(c))
        if run:
            out.append(DASH_OR_SPACE)
            at = run.end()
    return "".join(out)


_TEXT_RUN = re.compile(DASH_OR_SPACE)
_FOLDED = {ord(c): "'" for c in SINGLE_QUOTES} | {ord(c): '"' for c in DOUBLE_QUOTES} | {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """The text as smart search sees it: runs of dashes and white space are one space, quotes plain, A-Z small."""
    return _TEXT_RUN.sub(" ", text).translate(_FOLDED)


def folded_query(query: str) -> str:
    """A smart query in the same form, without quotes around it."""
    if len(query) > 1 and query[0] in SINGLE_QUOTES + DOUBLE_QUOTES and query[-1] in SINGLE_QUOTES + DOUBLE_QUOTES:
        query = query[1:-1]
    return fold(query)


def unfolded(text: str) -> list[int]:
    """Where each letter of ``fold(text)``, and its end, is in the text."""
    places, at = [], 0
    for run in _TEXT_RUN.finditer(text):
        places.extend(range(at, run.start() + 1))
        at = run.end()
    places.extend(range(at, len(text) + 1))
    return places


def space_pattern(query: str) -> str:
    """White-space runs match any white-space run, the rest itself."""
    return "[ \\t\\n\\r\\f]+".join(literal(w) for w in re.split(r"\s+", query))


def search_pattern(query: str, mode: str = "smart", match_case: bool = False) -> str:
    made = {"smart": smart_pattern, "literal": space_pattern, "regex": lambda q: q}[mode](query)
    return made if match_case else "(?i)" + made


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, len int, matched string>> of the pattern's non-overlapping matches.

    Offsets are prefix sums over the matches and the texts between them.
    """
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), F.slice(parts, 1, F.size(found)).alias("g"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int,matched:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start, n = acc["at"] + F.char_length(x["g"]), F.char_length(x["m"])
        here = F.struct(start.alias("start"), n.alias("len"), x["m"].alias("matched"))
        return F.struct((start + n).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, empty, step, lambda acc: acc["out"])).otherwise(empty["out"])


def matches_sql(table: str, keys: str, text: str, pattern: str, name: str, not_after: str = "") -> str:
    """The same as DuckDB SQL: a CTE ``name`` with keys, start, len, matched.

    RE2 can't look behind, so matches that may not follow some characters are marked first.
    """
    p = pattern.replace("'", "''")
    source, first = text, 1
    if not_after:
        source, p, first = f"regexp_replace({text}, '(^|[^{not_after}])({p.removeprefix('(?i)')})', '\\1' || chr(1) || '\\2', 'g')", f"\x01{p.removeprefix('(?i)')}", 2
    return f"""
    {name} AS (
        SELECT {keys}, CAST(coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x) - {first - 1})), 0) AS INT) AS start,
               CAST(length(found[k]) - {first - 1} AS INT) AS len, substr(found[k], {first}) AS matched, {text}
        FROM (SELECT {keys}, {text}, found, parts, unnest(range(1, len(found) + 1)) AS k
              FROM (SELECT {keys}, {text}, regexp_extract_all(marked, '{p}') AS found, string_split_regex(marked, '{p}') AS parts FROM (SELECT *, {source} AS marked FROM {table}))))"""
