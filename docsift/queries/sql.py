"""DuckDB twins of the text expressions, and rows given alike to both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return f"{value}::BIGINT"
    if isinstance(value, list):
        return f"[{', '.join(map(lit, value))}]"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A relation of the rows, for FROM."""
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS given({columns})"


def rx(pattern: str) -> str:
    return lit(pattern)


def strip(t: str) -> str:
    return f"trim({t}, {lit(X.WS_CHARS)})"


def flat(t: str) -> str:
    for pattern, new in X.FLATTEN_STEPS:
        t = f"regexp_replace({t}, {rx(pattern.replace('(?md)', '(?m)'))}, {lit(new.replace('$', chr(92)))}, 'g')"
    return strip(t)


def tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {rx(f'[{X.WS}]+')}), lambda x: x <> '')"


def words(t: str) -> str:
    return f"list_filter(regexp_extract_all({t}, {rx(f'[{X.LETTERS}]{{2,}}')}), lambda x: NOT regexp_matches(x, {rx(f'[{X.CJK}]')}))"


def odd_share(t: str) -> str:
    return f"(len(regexp_replace({t}, {rx(f'[{chr(92)}p{{L}}{chr(92)}p{{N}}{X.WS}]+')}, '', 'g'))::DOUBLE / nullif(len({t}), 0)::DOUBLE)"


def repeat(t: str) -> str:
    chars = f"string_split({t}, '')"
    return f"(SELECT coalesce(bool_or(c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4] AND c[i] <> chr(10)), false) FROM (SELECT c, unnest(range(1, len(c) - 3)) AS i FROM (SELECT {chars} AS c)))"


def strokes(t: str) -> str:
    return f"regexp_matches({t}, {rx(f'^[{X.STROKES}]+$')})"


def jumbled(x: str) -> str:
    bare = f"trim({x}, {lit(X.EDGE_MARKS)})"
    inner = rf"[^\p{{L}}\p{{N}}{X.INNER_MARKS}]"
    return f"(len({bare}) >= 3 AND regexp_matches({bare}, '\\p{{L}}') AND regexp_matches({bare}, {rx(f'[{X.DIGITS}]')}) AND regexp_matches({bare}, {rx(inner)}))"


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"
SCORE = "0.5::DOUBLE + ((doc_id * 31 + pos * 17) % 50)::DOUBLE / 100.0::DOUBLE"


def judged(source: str, hit_rate: str | None = None) -> str:
    """CTE judged(doc_id, pos, text, score, t, reason) from a relation (doc_id, pos, text, score[, hit_rate])."""
    extra = f" WHEN {hit_rate} < 0.5 THEN 'dictionary'" if hit_rate else ""
    return f"""features AS (SELECT *, {strip('text')} AS t FROM {source}),
counted AS (SELECT *, {tokens('t')} AS toks FROM features),
marked AS (SELECT *, len(toks) AS n_toks, len(list_filter(toks, lambda x: {jumbled('x')})) AS n_jumbled, {repeat('t')} AS rep FROM counted),
judged AS (SELECT *, CASE WHEN len(t) < 2 THEN 'short' WHEN score < 0.8::DOUBLE THEN 'score' WHEN {odd_share('t')} > 0.35::DOUBLE THEN 'symbols' WHEN rep THEN 'repeat' WHEN {strokes('t')} THEN 'strokes'
    WHEN n_toks >= 2 AND n_jumbled * 2 >= n_toks THEN 'jumbled'{extra} END AS reason FROM marked)"""
