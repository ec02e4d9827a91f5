"""Quality gate: which recognised lines are text, and what share of a page they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.functions.geometry import bind
from docsift.plans.joins import settled, small_side

MIN_SCORE, MAX_ODD_SHARE, MIN_HIT_RATE, MIN_ZIPF, MIN_WORDS = 0.80, 0.35, 0.5, 1.5, 3


def split_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., pos, text): lines of a text, pos from 0."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))


def visible(lines: DataFrame) -> DataFrame:
    """Lines that are more than blanks."""
    return lines.where(X.strip(F.col("text")) != "")


def stripped_reason(t: Column, score: Column, min_score: float = MIN_SCORE) -> Column:
    """Why a line without blanks at its ends is not text, as far as no dictionary tells; null if it is. Cheap tests come
    first, and CASE keeps their order."""
    return (
        F.when(F.length(t) < 2, "short")
        .when(score < min_score, "score")
        .when(X.odd_share(t) > MAX_ODD_SHARE, "symbols")
        .when(X.has_repeat(t), "repeat")
        .when(X.only_strokes(t), "strokes")
        .when(X.mostly_jumbled(t), "jumbled")
    )


def fail_reason(text: Column, score: Column, hit_rate: Column | None = None, min_score: float = MIN_SCORE) -> Column:
    reason = bind(X.strip(text), lambda t: stripped_reason(t, score, min_score))
    return reason if hit_rate is None else F.coalesce(reason, F.when(hit_rate < MIN_HIT_RATE, "dictionary"))


def _asked_words(t: Column, reason: Column) -> Column:
    """Lower-case words that the dictionary is asked for: those of lines that pass all else and have MIN_WORDS or more."""
    return F.when(reason.isNull(), bind(X.words(t), lambda w: F.when(F.size(w) >= MIN_WORDS, F.transform(w, F.lower))))


def known_words(lexicon: DataFrame) -> DataFrame:
    """(__word, in_langs) from (lang, word, zipf), one row per known word."""
    return lexicon.where(F.col("zipf") > MIN_ZIPF).groupBy(F.col("word").alias("__word")).agg(F.collect_set("lang").alias("in_langs"))


def hit_rates(asked: DataFrame, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """(key..., hit_rate) of the lines (key..., langs, words): the share of their words that any of the languages knows.

    Known words are broadcast if a count allows; a line then shuffles as two sums.
    """
    spread_ = asked.select(*key, "langs", F.explode("words").alias("word"))
    joined = spread_.join(small_side(settled(known_words(lexicon))), F.col("word") == F.col("__word"), "left")
    hit = F.coalesce(F.arrays_overlap("langs", "in_langs"), F.lit(False)).cast("double")
    return joined.groupBy(*key).agg(F.avg(hit).alias("hit_rate"))


def judge_lines(lines: DataFrame, key: list[str], lexicon: DataFrame | None = None, langs: Column | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """lines with reason and ok. Without a lexicon every word counts as known; with one, only lines that pass all else
    are looked up. Where texts are not needed any more, drop them before: the look-up joins by the key."""
    judged = lines.withColumn("__t", X.strip(F.col("text"))).withColumn("reason", stripped_reason(F.col("__t"), F.col("score"), min_score))
    if lexicon is not None:
        asked = judged.select(*key, (F.array(F.lit("en")) if langs is None else langs).alias("langs"), _asked_words(F.col("__t"), F.col("reason")).alias("words")).where("words IS NOT NULL")
        judged = judged.join(hit_rates(asked, lexicon, key), key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("hit_rate") < MIN_HIT_RATE, "dictionary")))
    return judged.drop("__t").withColumn("ok", F.col("reason").isNull())


def _chars(t: Column, text: Column) -> Column:
    return F.when(t != "", F.length(text)).otherwise(0).cast("long")


def _sums(judged: DataFrame, page: list[str]) -> DataFrame:
    sums = judged.groupBy(*page).agg(F.sum("__chars").alias("n_chars"), F.sum(F.when(F.col("ok"), F.col("__chars")).otherwise(0)).alias("good_chars"))
    return sums.withColumn("quality", F.col("good_chars").cast("double") / F.greatest("n_chars", F.lit(1)).cast("double"))


def page_quality(judged: DataFrame, page: list[str]) -> DataFrame:
    """(page..., n_chars, good_chars, quality): share of characters in good lines; 0 for a page without text."""
    return _sums(judged.withColumn("__chars", _chars(X.strip(F.col("text")), F.col("text"))), page)


def judge_pages(lines: DataFrame, key: list[str], page: list[str], lexicon: DataFrame | None = None, langs: Column | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """page_quality of judge_lines in one pass over the texts, which are not shuffled: only lengths, reasons and the words
    that are asked for go on. page must be part of key."""
    stripped = lines.withColumn("__t", X.strip(F.col("text")))
    narrow = stripped.select(*key, (F.array(F.lit("en")) if langs is None else langs).alias("langs"), "__t", _chars(F.col("__t"), F.col("text")).alias("__chars"), stripped_reason(F.col("__t"), F.col("score"), min_score).alias("reason"))
    if lexicon is None:
        return _sums(narrow.withColumn("ok", F.col("reason").isNull()), page)
    asked = narrow.select(*key, "langs", "__chars", "reason", _asked_words(F.col("__t"), F.col("reason")).alias("words"))
    spread = asked.select(*key, "langs", "__chars", "reason", F.explode_outer("words").alias("word"))
    joined = spread.join(small_side(settled(known_words(lexicon))), F.col("word") == F.col("__word"), "left")
    hit = F.when(F.col("word").isNotNull(), F.coalesce(F.arrays_overlap("langs", "in_langs"), F.lit(False)).cast("double"))
    per_line = joined.groupBy(*key).agg(F.first("__chars").alias("__chars"), F.first("reason").alias("reason"), F.avg(hit).alias("hit_rate"))
    return _sums(per_line.withColumn("ok", F.col("reason").isNull() & ~F.coalesce(F.col("hit_rate") < MIN_HIT_RATE, F.lit(False))), page)


def lexicon_from(docs: DataFrame, lang: str = "lang", min_docs: int = 3) -> DataFrame:
    """(lang, word, zipf) from a corpus: log10 of uses in a thousand million words. Words of fewer documents are unknown."""
    spread = docs.where(F.col(lang).isNotNull()).select("doc_id", F.col(lang).alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(f"[{X.LETTERS}]{{2,}}"), F.lit(0))).alias("word"))
    per_doc = spread.groupBy("lang", F.lower("word").alias("word"), "doc_id").agg(F.count("*").alias("n"))
    per_word = per_doc.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    total = per_word.groupBy("lang").agg(F.sum("n").alias("total"))
    return per_word.where(F.col("docs") >= min_docs).join(small_side(total), "lang").select("lang", "word", F.log10(F.col("n").cast("double") / F.col("total").cast("double") * 1e9).alias("zipf"))
