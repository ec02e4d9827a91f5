"""Queries over lines of documents: the quality gate, flattening, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators import evaluate, quality, routing
from docsift.plans.joins import settled, spread
from docsift.queries import sql as S
from docsift.queries.sql import table

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Lines that the documents lack, added alike in both engines.
LINES = [
    "day as a reminder of the", "Total $1,299.00", "v1.2-beta", "东京の天気は晴れ", "|||", "llIl1", "l1Il|", "-------", "aaaaaah", "x", "xqzt vbnm plkj wrtz", "a1#b c2$d", "@@##$$%%",
    "", "   ", " padded line here ", "ok ok ok1#2", "tab\tseparated words", "......", "été 12³# mixed", "11111 22222", "I I l 1 |",
]
MARKDOWN = [
    "![a](b) [c](d)", "**b** snake_case", "# Title\ntext", "para\n\n- item", "x\n* item", "a\n\n\n\nb", "| h1 | h2 |\n|----|:--:|\n| c1 | c2 |", "> quoted\n>> twice", "`code` and ```block```",
    "###### deep\n\n\n\ntext", " - a\n - b", "+ plus\n---\nend", "", "\n \n", "text | with | pipes", "[link](http://a.b/c_d) tail", "1. one\n2. two", "a\r\nb", "__init__ *x*", "#hash\n#  two",
]


def score(doc: str = "doc_id", pos: str = "pos"):
    """The documents carry no recognizer scores; this one is the same in every run."""
    return F.lit(0.5) + ((F.col(doc) * 31 + F.col(pos) * 17) % 50).cast("double") / F.lit(100.0)


def scored_lines(spark: SparkSession, sf_dir: str, inject: bool = False) -> DataFrame:
    lines = quality.split_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("score", score())
    if inject:
        rows = spark.createDataFrame([(-1, i, t, 0.98) for i, t in enumerate(LINES)], "doc_id long, pos int, text string, score double")
        lines = lines.unionByName(rows)
    return lines


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = quality.split_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("stripped", X.strip(F.col("text")))
    return lines.where("stripped <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("text").cast("long").alias("n_chars"), "stripped")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scored_lines(spark, sf_dir, inject=True).withColumn("t", X.strip(F.col("text")))
    t = F.col("t")
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), X.token_count(t).cast("long").alias("n_tokens"), F.size(X.words(t)).cast("long").alias("n_words"), F.round(X.odd_share(t), 6).alias("odd_share"), X.has_repeat(t).alias("has_repeat"), X.only_strokes(t).alias("only_strokes"))


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_lines(scored_lines(spark, sf_dir, inject=True), ["doc_id", "pos"])
    return judged.select("doc_id", F.col("pos").cast("long").alias("pos"), "ok", "reason")


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = quality.judge_pages(scored_lines(spark, sf_dir), ["doc_id", "pos"], ["doc_id"])
    return pages.select("doc_id", "n_chars", "good_chars", F.round("quality", 6).alias("quality"))


def page_quality_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = quality.lexicon_from(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))
    pages = quality.judge_pages(scored_lines(spark, sf_dir), ["doc_id", "pos"], ["doc_id"], lexicon, F.array(F.lit("en"), F.lit("fr")))
    return pages.select("doc_id", "n_chars", "good_chars", F.round("quality", 6).alias("quality"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lexicon_from(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))).select("lang", "word", F.round("zipf", 6).alias("zipf"))


def jumbled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_lines(spark, sf_dir, inject=True).select("doc_id", F.explode(X.tokens(X.strip(F.col("text")))).alias("token"))
    return rows.where(X.jumbled(F.col("token"))).groupBy("token").agg(F.count("*").alias("uses"))


def cjk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "id long, text string")
    found = F.regexp_extract_all("text", F.lit(f"[{X.LETTERS}]{{2,}}"), F.lit(0))
    rows = rows.select("id", F.explode(found).alias("word"))
    return rows.select("id", "word", F.col("word").rlike(f"[{X.CJK}]").alias("cjk"))


def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thorough engine is stood in for by upper case; it fails (null) for every seventh document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = settled(quality.judge_pages(scored_lines(spark, sf_dir), ["doc_id", "pos"], ["doc_id"]).select("doc_id", "quality"))
    primary = spread(docs).join(pages, "doc_id")

    def thorough(low: DataFrame) -> DataFrame:
        return low.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.translate("text", ALPHABET, ALPHABET.upper())).alias("text"))

    out = routing.route(primary, thorough, "doc_id", min_quality=0.4)
    return out.select("doc_id", "engine", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def gate_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = quality.judge_pages(scored_lines(spark, sf_dir), ["doc_id", "pos"], ["doc_id"])
    return _confusion(pages, table(spark, sf_dir, "labels"))


def _confusion(pages: DataFrame, labels: DataFrame) -> DataFrame:
    rows = pages.select("doc_id", (F.col("quality") >= 0.4).alias("passes")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rows.groupBy("label", "passes").agg(F.count("*").alias("n"))


def to_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    injected = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(MARKDOWN)], "doc_id long, text string")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(injected)
    return docs.select("doc_id", X.to_plaintext(F.col("text")).alias("plain"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("stem"), F.col("doc_id").alias("pos"))
    return routing.output_names(docs, folder="out")


def batch_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a pipe are taken as failed; per language: failures, total, status."""
    docs = table(spark, sf_dir, "documents")
    error = F.when(F.col("text").contains("|"), F.concat(F.lit("[tool] bad page "), F.col("doc_id").cast("string")))
    rows = docs.select("lang", routing.failure_text(error).alias("error"))
    per = rows.groupBy("lang").agg(F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.count("*").alias("n_total"), F.max("error").alias("last_error"))
    return per.withColumn("status", F.when(F.col("n_failed") > 0, 1).otherwise(0))


def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    swapped = F.replace(F.replace("text", F.lit("th"), F.lit("ht")), F.lit("e "), F.lit(" "))
    return bench.select("item_id", F.round(evaluate.cer(swapped, F.col("text")), 6).alias("cer"), F.round(evaluate.cer(F.lit(""), F.col("text")), 6).alias("cer_empty"), F.round(evaluate.cer(F.col("text"), F.lit("")), 6).alias("cer_no_truth"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as runs: the role is the variant, the conversation the stem."""
    c = table(spark, sf_dir, "conversations")
    second = F.lit(0.25)
    return c.select(F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("variant"), F.col("conv_id").alias("stem"), F.col("turn").alias("pos"), "text", (F.length("text").cast("double") * second).alias("vision_s"), (F.length("text").cast("double") * 2.0).alias("total_s"))


def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.compare_variants(_runs(spark, sf_dir), "a")
    return out.select("variant", "n", *[F.round(c, 6).alias(c) for c in ("vision_s", "total_s", "cer", "speedup")], "identical")


def variant_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    truth = runs.where("pos = 0").select("stem", F.lower("text").alias("truth"))
    return evaluate.truth_cer(runs, truth).select("variant", "n", F.round("cer", 6).alias("cer"))


QUERIES = {
    f.__name__: f
    for f in (line_split, line_features, line_quality, page_quality, page_quality_lexicon, lexicon, jumbled_tokens, cjk_words, route_pages, gate_vs_labels, to_plaintext, output_names, batch_with_failures, cer, variant_summary, variant_truth)
}

_SCORED = f"{S.LINES}, scored AS (SELECT *, {S.SCORE} AS score FROM lines)"
_INJECTED = f"{_SCORED}, both_lines AS (SELECT doc_id, pos, text, score FROM scored UNION ALL SELECT * FROM {S.values([(-1, i, t, 0.98) for i, t in enumerate(LINES)], 'doc_id, pos, text, score')})"
_PAGES = f"""{_SCORED}, {S.judged('scored')}, quality AS (SELECT doc_id, sum(CASE WHEN t <> '' THEN len(text) ELSE 0 END)::BIGINT AS n_chars, sum(CASE WHEN t <> '' AND reason IS NULL THEN len(text) ELSE 0 END)::BIGINT AS good_chars FROM judged GROUP BY doc_id),
pages_q AS (SELECT *, good_chars::DOUBLE / greatest(n_chars, 1)::DOUBLE AS q FROM quality)"""
_LEXICON = f"""spread AS (SELECT doc_id, lang, lower(unnest(regexp_extract_all(text, {S.rx(f'[{X.LETTERS}]{{2,}}')}))) AS word FROM documents WHERE lang IS NOT NULL),
per_word AS (SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM spread GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM per_word GROUP BY lang),
lex AS (SELECT lang, word, log10(n::DOUBLE / total::DOUBLE * 1000000000.0::DOUBLE) AS zipf FROM per_word JOIN totals USING (lang) WHERE docs >= 3)"""

ORACLES = {
    "line_split": f"WITH {S.LINES}, s AS (SELECT *, {S.strip('text')} AS stripped FROM lines) SELECT doc_id, pos::BIGINT AS pos, len(text)::BIGINT AS n_chars, stripped FROM s WHERE stripped <> ''",
    "line_features": f"WITH {_INJECTED}, s AS (SELECT *, {S.strip('text')} AS t FROM both_lines) SELECT doc_id, pos::BIGINT AS pos, len({S.tokens('t')})::BIGINT AS n_tokens, len({S.words('t')})::BIGINT AS n_words, round({S.odd_share('t')}, 6) AS odd_share, {S.repeat('t')} AS has_repeat, {S.strokes('t')} AS only_strokes FROM s",
    "line_quality": f"WITH {_INJECTED}, {S.judged('both_lines')} SELECT doc_id, pos::BIGINT AS pos, reason IS NULL AS ok, reason FROM judged",
    "page_quality": f"WITH {_PAGES} SELECT doc_id, n_chars, good_chars, round(q, 6) AS quality FROM pages_q",
    "page_quality_lexicon": f"""WITH {_LEXICON}, {_SCORED}, ws AS (SELECT doc_id, pos, {S.words(S.strip('text'))} AS words FROM scored),
one AS (SELECT doc_id, pos, lower(unnest(words)) AS word FROM ws WHERE len(words) >= 3),
known AS (SELECT DISTINCT word FROM lex WHERE lang IN ('en', 'fr') AND zipf > 1.5),
rates AS (SELECT doc_id, pos, avg((known.word IS NOT NULL)::INT::DOUBLE) AS hit_rate FROM one LEFT JOIN known USING (word) GROUP BY ALL),
rated AS (SELECT scored.*, hit_rate FROM scored LEFT JOIN rates USING (doc_id, pos)), {S.judged('rated', 'hit_rate')}
SELECT doc_id, sum(CASE WHEN t <> '' THEN len(text) ELSE 0 END)::BIGINT AS n_chars, sum(CASE WHEN t <> '' AND reason IS NULL THEN len(text) ELSE 0 END)::BIGINT AS good_chars,
    round(sum(CASE WHEN t <> '' AND reason IS NULL THEN len(text) ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN t <> '' THEN len(text) ELSE 0 END), 1)::DOUBLE, 6) AS quality FROM judged GROUP BY doc_id""",
    "lexicon": f"WITH {_LEXICON} SELECT lang, word, round(zipf, 6) AS zipf FROM lex",
    "jumbled_tokens": f"WITH {_INJECTED}, s AS (SELECT unnest({S.tokens(S.strip('text'))}) AS token FROM both_lines) SELECT token, count(*) AS uses FROM s WHERE {S.jumbled('token')} GROUP BY token",
    "cjk_words": f"WITH s AS (SELECT id, unnest(regexp_extract_all(text, {S.rx(f'[{X.LETTERS}]{{2,}}')})) AS word FROM {S.values([(i, t) for i, t in enumerate(LINES)], 'id, text')}) SELECT id, word, regexp_matches(word, {S.rx(f'[{X.CJK}]')}) AS cjk FROM s",
    "route_pages": f"""WITH {_PAGES}, r AS (SELECT doc_id, text, q, CASE WHEN doc_id % 7 <> 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS thorough FROM documents JOIN pages_q USING (doc_id)),
c AS (SELECT doc_id, CASE WHEN q >= 0.4 OR thorough IS NULL THEN 'primary' ELSE 'secondary' END AS engine, CASE WHEN q >= 0.4 OR thorough IS NULL THEN text ELSE {S.flat('thorough')} END AS text FROM r)
SELECT doc_id, engine, len(text)::BIGINT AS n_chars, md5(text) AS digest FROM c""",
    "gate_vs_labels": f"WITH {_PAGES} SELECT quality AS label, q >= 0.4 AS passes, count(*) AS n FROM pages_q JOIN labels USING (doc_id) GROUP BY ALL",
    "to_plaintext": f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {S.values([(-1 - i, t) for i, t in enumerate(MARKDOWN)], 'doc_id, text')}) SELECT doc_id, {S.flat('text')} AS plain FROM d",
    "output_names": "WITH d AS (SELECT concat_ws('-', source, lang) AS stem, doc_id AS pos FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pos) AS no FROM d) SELECT stem, pos, 'out/' || stem || '_ocr' || CASE WHEN no > 1 THEN '_' || no ELSE '' END || '.txt' AS path FROM n",
    "batch_with_failures": "WITH r AS (SELECT lang, CASE WHEN contains(text, '|') THEN 'bad page ' || doc_id END AS error FROM documents) SELECT lang, count(error) AS n_failed, count(*) AS n_total, max(error) AS last_error, CASE WHEN count(error) > 0 THEN 1 ELSE 0 END AS status FROM r GROUP BY lang",
}
#: DuckDB counts edits of bytes. Letters beyond ASCII stand as control characters there, a byte each, so that edits are
#: those of characters. The letters that the tables hold beyond ASCII.
_FOREIGN = "éèêëàâçîïôûùóíáúñöäüßÉÈÊÇÓÍÑÖÄÜ"
_BYTES = "".join(map(chr, [*range(1, 9), *range(14, 28), *range(28, 32), 127, 11, 12, 35, 36]))[: len(_FOREIGN)]


def _one_byte(text: str) -> str:
    return f"translate({text}, {S.lit(_FOREIGN)}, {' || '.join(f'chr({ord(c)})' for c in _BYTES)})"


_CER = "CASE WHEN {r} = '' THEN CASE WHEN {h} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein({h}, {r})::DOUBLE / len({r})::DOUBLE END"
ORACLES["cer"] = f"""WITH b AS (SELECT item_id, {_one_byte('text')} AS text FROM benchmark), s AS (SELECT item_id, text, replace(replace(text, 'th', 'ht'), 'e ', ' ') AS h FROM b)
SELECT item_id, round({_CER.format(h='h', r='text')}, 6) AS cer, round({_CER.format(h="''", r='text')}, 6) AS cer_empty, CASE WHEN text = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS cer_no_truth FROM s"""
_RUNS = f"runs AS (SELECT CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS variant, conv_id AS stem, turn AS pos, text, len(text)::DOUBLE * 0.25::DOUBLE AS vision_s, len(text)::DOUBLE * 2.0::DOUBLE AS total_s FROM conversations)"
ORACLES["variant_summary"] = f"""WITH {_RUNS}, base AS (SELECT stem, arg_max(text, pos) AS base_text FROM runs WHERE variant = 'a' GROUP BY stem), pairs AS (SELECT r.*, base_text, {_one_byte('text')} AS h, {_one_byte('base_text')} AS g FROM runs r JOIN base USING (stem)),
per AS (SELECT variant, count(*) AS n, avg(vision_s) AS vision_s, avg(total_s) AS total_s, avg({_CER.format(h='h', r='g')}) AS cer, sum((text = base_text)::INT)::BIGINT AS identical FROM pairs GROUP BY variant)
SELECT variant, n, round(vision_s, 6) AS vision_s, round(total_s, 6) AS total_s, round(cer, 6) AS cer, round((SELECT vision_s FROM per WHERE variant = 'a') / vision_s, 6) AS speedup, identical FROM per"""
ORACLES["variant_truth"] = f"WITH {_RUNS}, truth AS (SELECT stem, lower(text) AS truth FROM runs WHERE pos = 0), pairs AS (SELECT variant, {_one_byte('text')} AS h, {_one_byte('truth')} AS g FROM runs JOIN truth USING (stem)) SELECT variant, count(*) AS n, round(avg({_CER.format(h='h', r='g')}), 6) AS cer FROM pairs GROUP BY variant"
