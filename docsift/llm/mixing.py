"""Operator 3: mixing sources to target weights.

Tokens are summed per source, each source gets a target share by water-filling, and every document of a source is
emitted floor(rate) times plus one more copy by a draw that is seeded by a hash of its id and text. Its probability is
the rate's fraction, and the draws of a source are tied to one another so that its words come near the target:

* Large documents, those with more than 1 / ``LARGE`` of their source's words (fewer than ``LARGE`` a source), draw one
  after the other by falling size, each with the fraction corrected by what those before it took too much or too little.
  Only where the smaller documents could not make up for one outcome the other is taken without a draw, and the nearer
  one where they could for neither.
* All others draw against one threshold a source: the least draws are taken, as many as the words still wanted need.

So a source misses its target by half the size of a small document at most, or, where a document is larger than all
smaller ones of its source together, by half of what it is larger. The thresholds and the large documents that are taken are all that meets the texts, which
are not shuffled. Only DataFrame functions.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; a null doc_id draws by its text;
rows of equal id and text draw alike and count as one document of their joint size; ties of draws are such rows; a source
of size 0 has target 0 and its documents are taken 0 times; empty input gives an empty result; texts of any length are
counted whole. Extra columns pass through ``mix``, unless their names begin with two underscores; it adds ``copy_no`` (a
clashing column is replaced). ``mix_report`` reads doc_id, source and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.geometry import bind
from docsift.llm.common import broadcast_if_small, cut, cut_narrow, running_sums, table, unit_draw

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
#: Documents with more than one part in LARGE of their source draw one by one. BUCKETS: of draws, to find thresholds.
LARGE, BUCKETS = 200, 1024


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Water-filling in closed form: order sources by cap / weight; with those before k at their caps, the level of k is
    what is left over the weights that are left. The level rises while sources are capped and falls afterwards, so the
    common level is its maximum, and each target is min(cap, weight * level). Ranks and running sums go by ranges, so
    sources may be as many as hosts.
    """
    sources = sized.select("source").distinct().count()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running_sums(cut_narrow(per_source, sources), by_name, {"rank_no": F.lit(1).cast("long")}, sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank_no") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_rate)
    by_level = [F.col("cap") / F.col("weight").cast("double"), F.col("rank_no")]
    ordered = cut_narrow(running_sums(ranked, by_level, {"caps": F.col("cap"), "weights": F.col("weight")}, sources), sources)
    total, all_weights = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0) - F.col("caps")).cast("double") / (F.lit(all_weights or 0) - F.col("weights")).cast("double")
    common = ordered.agg(F.max(level)).first()[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.lit(common or 0.0))
    return ordered.select("source", "source_size", target.alias("target"))


def draw_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return unit_draw(seed, doc_id, F.md5(text))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, draw): all that the choice of copies needs."""
    return cut_narrow(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw")), docs.count())


def _is_large(size: Column, source_size: Column) -> Column:
    return size * LARGE > source_size


def _same_source(right: str) -> Column:
    return F.col("source").eqNullSafe(F.col(right))


def _large_draws(units: DataFrame) -> DataFrame:
    """Per source: what its large documents leave wanted of the extra words, and the draws of those that are taken.

    units: source, source_size, fraction, draw, size, one row for rows that draw alike.
    """
    listed = units.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("fraction").alias("fraction"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "draw"))).alias("large"))
    start = F.struct(F.lit(0.0).alias("wanted"), F.col("source_size").alias("rest"), F.array().cast("array<double>").alias("taken"))

    def weighed(state: Column, unit: Column) -> Column:
        """What is wanted if the document is left out, and the words after it."""
        size = -unit["minus"].cast("double")
        return F.struct((state["wanted"] + F.col("fraction") * size).alias("wanted"), (state["rest"] + unit["minus"]).alias("rest"), size.alias("size"), unit["draw"].alias("draw"), state["taken"].alias("taken"))

    def decided(w: Column) -> Column:
        over = w["wanted"] - (1 - F.col("fraction")) * w["rest"].cast("double")  # above 0: more than the rest can give
        under = w["size"] - w["wanted"] - F.col("fraction") * w["rest"].cast("double")  # above 0: more than it can spare
        takes = F.when((over <= 0) & (under <= 0), w["draw"] < w["wanted"] / w["size"]).otherwise(under <= over)
        return F.struct(w.alias("w"), takes.alias("takes"))

    def moved(d: Column) -> Column:
        w = d["w"]
        return F.struct(
            F.when(d["takes"], w["wanted"] - w["size"]).otherwise(w["wanted"]).alias("wanted"), w["rest"].alias("rest"), F.when(d["takes"], F.concat(w["taken"], F.array(w["draw"]))).otherwise(w["taken"]).alias("taken")
        )

    def step(state: Column, unit: Column) -> Column:
        return bind(bind(weighed(state, unit), decided), moved)

    done = listed.select("source", F.aggregate("large", start, step).alias("done"))
    return done.select(F.col("source").alias("__s"), F.col("done.wanted").alias("wanted"), F.col("done.taken").alias("taken"))


def choices(sized: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, rate, bound) per source, and (source, draw) of the large documents with an extra copy.

    Documents that are not large have an extra copy if their draw is bound or less.
    """
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size").cast("double"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    rates = cut(source_targets(sized, weights, max_rate).withColumn("rate", rate))
    sources = rates.count()
    given = broadcast_if_small(rates.select(F.col("source").alias("__source"), "source_size", (F.col("rate") - F.floor("rate")).alias("fraction")))
    rows = sized.select("source", "size", "draw").join(given, _same_source("__source")).drop("__source")
    large = _is_large(F.col("size"), F.col("source_size"))
    units = rows.where(large).groupBy("source", "draw").agg(F.max("source_size").alias("source_size"), F.max("fraction").alias("fraction"), F.sum("size").alias("size"))
    drawn = cut_narrow(_large_draws(units), sources)
    bucket = F.floor(F.col("draw") * BUCKETS).cast("long")
    small = rows.where(~large).withColumn("bucket", bucket)
    hist = small.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("fraction").alias("fraction"))
    order = Window.partitionBy("source").orderBy("bucket")  # BUCKETS rows of a source at most
    whole = Window.partitionBy("source")
    hist = hist.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all_words", F.sum("words").over(whole))
    hist = hist.join(broadcast_if_small(drawn.select("__s", F.col("wanted").alias("left"))), _same_source("__s"), "left")
    need = F.col("fraction") * F.col("all_words").cast("double") + F.coalesce("left", F.lit(0.0))
    hist = hist.withColumn("need", need)
    # the bucket in which the wanted words are reached: the last one that begins below them
    edge = cut_narrow(hist.where(F.col("before").cast("double") <= F.col("need")).groupBy("source").agg(F.max(F.struct("bucket", "before", "need")).alias("edge")).select(F.col("source").alias("__e"), "edge.*"), sources)
    near = small.select("source", "draw", "size", F.col("bucket").alias("own")).join(broadcast_if_small(edge), _same_source("__e") & (F.col("own") == F.col("bucket")))
    units = near.groupBy("source", "draw").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("need").alias("need"))
    within = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)  # one bucket of a source
    middle = (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).cast("double") + F.col("size").cast("double") / 2
    reached = units.withColumn("middle", middle).where("middle <= need").groupBy("source").agg(F.max("draw").alias("last"))
    bounds = edge.join(reached.withColumnRenamed("source", "__r"), F.col("__e").eqNullSafe(F.col("__r")), "left")
    # no draw of the bucket is taken: those of all buckets before it are
    bounds = cut_narrow(bounds.select("__e", F.coalesce("last", F.col("bucket").cast("double") / BUCKETS - 2.0**-60).alias("bound")), sources)
    per_source = rates.join(broadcast_if_small(bounds), _same_source("__e"), "left").select("source", "source_size", "target", "rate", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    return cut(per_source), cut(drawn.select(F.col("__s").alias("source"), F.explode("taken").alias("draw")))


def _with_copies(rows: DataFrame, per_source: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (with source, __size and __draw) and __n, the number of their copies, with __source_size and __target."""
    given = per_source.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"), F.col("bound").alias("__bound"))
    rows = rows.join(broadcast_if_small(given), _same_source("__s"), "left")
    chosen = broadcast_if_small(taken.select(F.col("source").alias("__c"), F.col("draw").alias("__d"), F.lit(True).alias("__takes")))
    large = _is_large(F.col("__size"), F.col("__source_size"))
    rows = rows.join(chosen, large & _same_source("__c") & (F.col("__draw") == F.col("__d")), "left")
    extra = F.when(large, F.coalesce("__takes", F.lit(False))).otherwise(F.col("__draw") <= F.col("__bound"))
    return rows.withColumn("__n", (F.floor("__rate") + extra.cast("int")).cast("int"))


def mix_report(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies. The text is read once."""
    sized = _sized(docs, seed)
    rows = _with_copies(sized.withColumnsRenamed({"size": "__size", "draw": "__draw"}), *choices(sized, weights, max_rate))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__n")).cast("long").alias("taken"), F.col("__n").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with copy_no from 1. No shuffle of texts."""
    kept = [c for c in docs.columns if c != "copy_no" and not c.startswith("__")]
    rows = docs.select(*kept, text_size(F.col("text")).alias("__size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("__draw"))
    rows = _with_copies(rows, *choices(_sized(docs, seed), weights, max_rate)).where("__n > 0")
    return rows.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy_no"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


#: DuckDB, over a relation with doc_id, source, text.
MIX_SQL = r"""
sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw FROM {docs}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank_no FROM per_source),
weighed AS (SELECT *, ([5, 2, 1])[(rank_no % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM ranked),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rank_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM weighed),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * max(lvl) OVER ()) AS target FROM leveled),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets),
joined AS (SELECT s.doc_id, s.source, s.size, s.draw, r.source_size, r.target, r.rate, r.rate - floor(r.rate) AS fraction, s.size * 200 > r.source_size AS large FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
units AS (SELECT source, large, draw, any_value(fraction) AS fraction, any_value(source_size) AS source_size, sum(size)::BIGINT AS size FROM joined GROUP BY source, large, draw),
numbered AS (SELECT *, size::DOUBLE AS s, (source_size - sum(size) OVER (PARTITION BY source ORDER BY size DESC, draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS rest,
    row_number() OVER (PARTITION BY source ORDER BY size DESC, draw) AS no FROM units WHERE large),
walk AS (SELECT source, 0::BIGINT AS no, 0.0::DOUBLE AS draw, 0.0::DOUBLE AS wanted, false AS takes FROM rates
    UNION ALL SELECT source, no, draw, CASE WHEN takes THEN wanted - s ELSE wanted END, takes FROM (SELECT *, CASE WHEN over_it <= 0 AND under_it <= 0 THEN draw < wanted / s ELSE under_it <= over_it END AS takes
        FROM (SELECT *, wanted - (1 - fraction) * rest AS over_it, s - wanted - fraction * rest AS under_it
            FROM (SELECT n.source, n.no, n.draw, n.s, n.rest, n.fraction, w.wanted + n.fraction * n.s AS wanted FROM walk w JOIN numbered n ON n.source IS NOT DISTINCT FROM w.source AND n.no = w.no + 1)))),
left_over AS (SELECT source, arg_max(wanted, no) AS wanted FROM walk GROUP BY source),
small AS (SELECT u.source, u.draw, (coalesce(sum(u.size) OVER (PARTITION BY u.source ORDER BY u.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE + u.size::DOUBLE / 2 AS middle,
    u.fraction * (sum(u.size) OVER (PARTITION BY u.source))::DOUBLE + l.wanted AS need FROM units u JOIN left_over l ON u.source IS NOT DISTINCT FROM l.source WHERE NOT u.large),
takers AS (SELECT source, draw, false AS large FROM small WHERE middle <= need UNION ALL SELECT source, draw, true FROM walk WHERE takes),
counted AS (SELECT j.*, (floor(j.rate) + (t.draw IS NOT NULL)::INT)::INT AS copies FROM joined j LEFT JOIN takers t ON j.source IS NOT DISTINCT FROM t.source AND j.draw = t.draw AND j.large = t.large)
"""
ORACLE = f"WITH RECURSIVE {MIX_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM counted"
