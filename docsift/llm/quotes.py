"""Operator 1: quotation linking for conversations.

Lines that begin with ``>`` marks are quotations; the number of marks is their level. Consecutive lines of one level are
a passage. Its words (lower case, line ends and blanks alike) are hashed by windows of ``WIDTH``, and the windows joined
to those of earlier messages' own text in the same conversation, so that a passage may be wrapped anew or begin and end
within a message. A passage comes from the message that has most of its windows, if that is half of them or more; the
later one of equals. A passage of fewer words than a window is hashed whole and comes from a message that says just that.
A message replies to the one that most windows of its first-level passages come from. Messages then stand by thread:
after the message that starts their chain of replies, in order of turn, and without quotations. A line ``... wrote:``
directly before a quotation belongs to it.

Only DataFrame functions. Own text is cut into windows only in conversations that quote, and only windows that are quoted
go on. The latest message with a window is found by a scan over ranges of (conversation, window, turn), positions by
ranges of the reply order, and joins by conversation or parent split heavy keys, so that one conversation, one window or
one parent may hold any share of the rows.

Defined cases: a null text has an empty body and no quotation; null conv_ids are one conversation; a message with a null
turn links to nothing and comes first; different messages of one turn are linked one by one, and the turn as a parent
stands for all of them, in the thread of the earliest that one of them replies to; repeated rows are one message for links
and several in the order; ties of the order go by the body's hash; an empty table gives an empty result; a message that
quotes nothing known starts a thread; texts are read whole at any length. Extra columns pass through ``reply_order`` unless
they clash with its own or begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.geometry import bind
from docsift.llm.common import broadcast_if_small, cut, join_per_key, last_before, running_sums, table

MARKS = r"^[ \t]*>[ \t>]*"
WROTE = r"(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$"
BLANKS = r"[\x09-\x0D\x20]+"
WIDTH = 5
MAX_ROUNDS = 64
OWN = ("body", "levels", "n_quoted", "n_linked", "parent_turn", "thread_turn", "position")
#: What a message is known by.
MESSAGE = ["conv_id", "turn", "digest"]


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def body_of(text: Column) -> Column:
    """The text without quotations and the lines that introduce them."""

    def kept(lines: Column) -> Column:
        def keep(line: Column, at: Column) -> Column:
            following = F.coalesce(F.get(lines, at + 1), F.lit(""))
            return ~line.rlike(MARKS) & ~(line.rlike(WROTE) & following.rlike(MARKS))

        return F.filter(lines, keep)

    own = bind(F.split(F.coalesce(text, F.lit("")), "\n"), kept)
    return F.btrim(F.array_join(own, "\n"), F.lit("\t\n\x0b\x0c\r "))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def keys_of(words: Column) -> Column:
    """Hashes of all windows of WIDTH words, or of all words if they are fewer."""

    def keys(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WIDTH), " ")))
        return F.when(n >= WIDTH, windows).when(n > 0, F.array(F.xxhash64(F.lit("whole"), F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))

    return bind(words, keys)


def _same(keys: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(keys, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, passage, level, words): runs of quoted lines of one level that have a word.

    Only quoted lines are shuffled, to their message.
    """
    once = messages.where(F.col("text").rlike("(?m)" + MARKS)).select("conv_id", "turn", "text", F.md5("text").alias("digest"))
    lines = once.select(*MESSAGE, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(MARKS)).distinct()
    lines = lines.select(*MESSAGE, "line_no", level_of(F.col("line")).alias("level"), F.regexp_replace("line", MARKS, "").alias("bare"))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(*MESSAGE, "level").orderBy("line_no"))  # lines of a message
    joined = lines.withColumn("run", run).groupBy(*MESSAGE, "level", "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "bare"))).alias("own"))
    words = words_of(F.array_join(F.transform("own", lambda x: x["bare"]), " "))
    return joined.select(*MESSAGE, F.get("own", F.lit(0))["line_no"].alias("passage"), "level", words.alias("words")).where(F.size("words") > 0)


def window_origins(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, passage, level, key, origin): every window of the passages and the turn it comes from."""
    asked = cut(quoted.select(*MESSAGE, "passage", "level", F.explode(keys_of(F.col("words"))).alias("key")))
    wanted = cut(asked.select(F.col("conv_id").alias("__c"), F.col("key").alias("__k")).distinct())
    quoting = broadcast_if_small(cut(wanted.select("__c").distinct()))
    own = messages.where("turn IS NOT NULL AND text IS NOT NULL").join(quoting, _same(["conv_id"], ["__c"]), "left_semi")
    own = own.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode(keys_of(words_of(body_of(F.col("text"))))).alias("key")).distinct()
    own = own.join(broadcast_if_small(wanted), _same(["conv_id", "key"], ["__c", "__k"]), "left_semi")
    both = asked.withColumn("is_own", F.lit(0)).unionByName(own.select("conv_id", "turn", "key", F.lit(1).alias("is_own")), allowMissingColumns=True)
    # a turn's questions stand before its own windows, so the last one before is of an earlier turn
    order = [F.col("conv_id"), F.col("key"), F.col("turn"), F.col("is_own"), F.xxhash64("digest", "passage")]
    seen = last_before(both, order, F.when(F.col("is_own") == 1, F.struct("conv_id", "key", "turn")), "__seen")
    here = F.col("__seen.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("__seen.key") == F.col("key")) & F.col("turn").isNotNull()
    return seen.where("is_own = 0").select(*MESSAGE, "passage", "level", "key", F.when(here, F.col("__seen.turn")).alias("origin"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, levels, n_quoted, n_linked, parent_turn) of the messages that quote."""
    passage = [*MESSAGE, "passage", "level"]
    found = window_origins(messages, passages(messages)).groupBy(*passage, "origin").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct("n", "origin")))
    per = found.groupBy(*passage).agg(F.sum("n").alias("windows"), best.alias("best"))
    per = cut(per.select(*passage, F.when(F.col("best.n") * 2 >= F.col("windows"), F.col("best")).alias("best")))
    counts = per.groupBy(*MESSAGE).agg(F.max("level").cast("long").alias("levels"), F.count("*").alias("n_quoted"), F.count("best").alias("n_linked"))
    votes = per.where("level = 1 AND best IS NOT NULL").groupBy(*MESSAGE, F.col("best.origin").alias("origin")).agg(F.sum("best.n").alias("n"))
    parent = votes.groupBy(*MESSAGE).agg(F.max(F.struct("n", "origin")).getField("origin").alias("parent_turn"))
    right = ["__c", "__t", "__d"]
    return counts.join(parent.withColumnsRenamed(dict(zip(MESSAGE, right, strict=True))), _same(MESSAGE, right), "left").drop(*right)


def _place(conv: Column, turn: Column) -> Column:
    """One string for a turn of a conversation, nulls included."""
    return F.concat_ws(":", F.coalesce(turn.cast("string"), F.lit("null")), F.coalesce(conv.cast("string"), F.lit("null")), conv.isNull().cast("string"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(place, thread_turn) of every turn that replies, by pointer doubling: rounds follow the log of the depth."""
    conv = F.first("conv_id").alias("conv")
    state = cut(links.where("parent_turn IS NOT NULL").groupBy(_place(F.col("conv_id"), F.col("turn")).alias("place")).agg(conv, F.min("parent_turn").alias("thread_turn")))
    total = state.count()
    for _ in range(MAX_ROUNDS):
        asking = state.withColumn("up_place", _place(F.col("conv"), F.col("thread_turn")))
        step = state.select(F.col("place").alias("__p"), F.col("thread_turn").alias("up"))
        ups = asking.groupBy("up_place").agg(F.count("*").alias("uses")).join(step, F.col("up_place") == F.col("__p"), "left").select("up_place", "up", "uses")
        moved = join_per_key(asking, cut(ups), "up_place", total, F.xxhash64("place"), "left")
        moved = cut(moved.select("place", "conv", F.coalesce("up", "thread_turn").alias("thread_turn"), F.col("up").isNotNull().alias("went")))
        state = moved.drop("went")
        if moved.where("went").isEmpty():
            return state.drop("conv")
    raise RuntimeError("reply chains did not settle")


def reply_order(messages: DataFrame) -> DataFrame:
    """Every message with its body, quotation counts, parent_turn, thread_turn and position in its conversation."""
    kept = [c for c in messages.columns if c not in OWN and c != "text" and not c.startswith("__")]
    links = cut(reply_links(messages))
    roots = thread_roots(links).select(F.col("place").alias("__place"), F.col("thread_turn").alias("__root"))
    links = links.select(*[F.col(c).alias(f"__{c}") for c in MESSAGE], "levels", "n_quoted", "n_linked", "parent_turn")
    rows = messages.select(*kept, body_of(F.col("text")).alias("body"), F.md5("text").alias("__own"))
    rows = rows.join(broadcast_if_small(links), _same(["conv_id", "turn", "__own"], [f"__{c}" for c in MESSAGE]), "left").drop(*[f"__{c}" for c in MESSAGE], "__own")
    # the thread of a message that replies is its parent's, and the parent's own turn if that starts it
    rows = rows.join(broadcast_if_small(cut(roots)), _place(F.col("conv_id"), F.col("parent_turn")) == F.col("__place"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("levels", "n_quoted", "n_linked")]
    rows = rows.select(*kept, "body", *zero, F.col("parent_turn").cast("long").alias("parent_turn"), F.coalesce("__root", "parent_turn", "turn").cast("long").alias("thread_turn"))
    return _positions(rows)


def _positions(rows: DataFrame) -> DataFrame:
    """Rank of each row in its conversation, by (thread_turn, turn, hash of the body)."""
    order = [F.col("conv_id").isNotNull(), F.col("conv_id"), F.col("thread_turn"), F.col("turn"), F.md5("body"), F.monotonically_increasing_id()]
    placed = cut(running_sums(rows.withColumn("__conv", _place(F.col("conv_id"), F.lit(0))), order, {"__at": F.lit(1).cast("long")}))
    first = placed.groupBy("__conv").agg(F.min("__at").alias("__first"), F.count("*").alias("uses"))
    joined = join_per_key(placed.withColumnRenamed("uses", "__uses") if "uses" in placed.columns else placed, first, "__conv", placed.count(), F.xxhash64("__at"))
    if "uses" in rows.columns:
        joined = joined.withColumnRenamed("__uses", "uses")
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + 1).cast("long").alias("position"))


def requoted(conversations: DataFrame) -> DataFrame:
    """conversations in which every message quotes the one before it, wrapped anew at seven words, before its own text.

    The tables hold no quotation; this gives the operator all of them to find.
    """
    before = conversations.groupBy(F.col("conv_id").alias("__c"), (F.col("turn") + 1).alias("__t")).agg(F.max("text").alias("__text"))
    wrapped = F.regexp_replace(F.regexp_replace(F.col("__text"), BLANKS, " "), "((?:[^ ]+ ){6}[^ ]+) ", "$1\n> ")
    text = F.when(F.col("__text").isNull(), F.col("text")).otherwise(F.concat(F.lit("On some day they wrote:\n> "), wrapped, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return conversations.join(before, _same(["conv_id", "turn"], ["__c", "__t"]), "left").withColumn("text", text).drop("__c", "__t", "__text")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


def quotations_of_requoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over conversations that quote; a check of it, as the table itself holds no quotation."""
    return reply_order(requoted(table(spark, sf_dir, "conversations")))


#: DuckDB, over a relation conv_id, turn, role, text named given.
LINK_SQL = r"""
msg AS (SELECT *, md5(text) AS digest FROM given),
split AS (SELECT DISTINCT conv_id, turn, digest, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM msg),
quoted AS (SELECT conv_id, turn, digest, line_no, len(regexp_replace(regexp_extract(line, '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[ \t>]*', '') AS bare FROM split WHERE regexp_matches(line, '^[ \t]*>[ \t>]*')),
islands AS (SELECT *, line_no - row_number() OVER (PARTITION BY conv_id, turn, digest, level ORDER BY line_no) AS run FROM quoted),
passages AS (SELECT conv_id, turn, digest, level, min(line_no) AS passage, list_filter(string_split_regex(lower(string_agg(bare, ' ' ORDER BY line_no)), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words FROM islands GROUP BY conv_id, turn, digest, level, run),
body AS (SELECT conv_id, turn, role, digest, trim(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: NOT regexp_matches(x, '^[ \t]*>[ \t>]*')
    AND NOT (regexp_matches(x, '(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$') AND regexp_matches(coalesce(string_split(coalesce(text, ''), chr(10))[i + 1], ''), '^[ \t]*>[ \t>]*'))), chr(10)), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM msg),
said AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(body), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words FROM body WHERE turn IS NOT NULL),
asked AS (SELECT conv_id, turn, digest, passage, level, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN ['= ' || array_to_string(words, ' ')] ELSE [] END) AS key FROM passages),
own AS (SELECT DISTINCT conv_id, turn, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN ['= ' || array_to_string(words, ' ')] ELSE [] END) AS key FROM said),
told AS (SELECT a.conv_id, a.turn, a.digest, a.passage, a.level, a.key, a.no, max(o.turn) AS origin FROM (SELECT *, row_number() OVER () AS no FROM asked) a LEFT JOIN own o ON o.conv_id = a.conv_id AND o.key = a.key AND o.turn < a.turn GROUP BY ALL),
counted AS (SELECT conv_id, turn, digest, passage, level, origin, count(*) AS n FROM told GROUP BY ALL),
per AS (SELECT conv_id, turn, digest, passage, level, sum(n) AS windows, max(CASE WHEN origin IS NOT NULL THEN {'n': n, 'origin': origin} END) AS best FROM counted GROUP BY ALL),
linked AS (SELECT *, CASE WHEN best.n * 2 >= windows THEN best END AS top FROM per),
totals AS (SELECT conv_id, turn, digest, max(level) AS levels, count(*) AS n_quoted, count(top) AS n_linked FROM linked GROUP BY ALL),
votes AS (SELECT conv_id, turn, digest, top.origin AS origin, sum(top.n) AS n FROM linked WHERE level = 1 AND top IS NOT NULL GROUP BY ALL),
parent AS (SELECT conv_id, turn, digest, max({'n': n, 'origin': origin}).origin AS parent_turn FROM votes GROUP BY ALL),
replies AS (SELECT conv_id, turn, min(parent_turn) AS up FROM parent GROUP BY ALL),
climb AS (SELECT conv_id, turn, up FROM replies UNION ALL SELECT c.conv_id, c.turn, r.up FROM climb c JOIN replies r ON c.conv_id = r.conv_id AND c.up = r.turn),
roots AS (SELECT conv_id, turn, min(up) AS root FROM climb GROUP BY ALL),
placed AS (SELECT b.conv_id, b.turn, b.role, b.body, coalesce(t.levels, 0)::BIGINT AS levels, coalesce(t.n_quoted, 0)::BIGINT AS n_quoted, coalesce(t.n_linked, 0)::BIGINT AS n_linked, p.parent_turn::BIGINT AS parent_turn, coalesce(r.root, p.parent_turn, b.turn)::BIGINT AS thread_turn
    FROM body b LEFT JOIN totals t ON t.conv_id = b.conv_id AND t.turn = b.turn AND t.digest = b.digest LEFT JOIN parent p ON p.conv_id = b.conv_id AND p.turn = b.turn AND p.digest = b.digest LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = p.parent_turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, md5(body))::BIGINT AS position FROM placed
"""
ORACLE = f"WITH RECURSIVE given AS (SELECT conv_id, turn, role, text FROM conversations), {LINK_SQL}"
REQUOTED_ORACLE = rf"""WITH RECURSIVE before AS (SELECT conv_id, turn + 1 AS turn, max(text) AS earlier FROM conversations GROUP BY ALL),
given AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN earlier IS NULL THEN text ELSE 'On some day they wrote:' || chr(10) || '> ' || regexp_replace(regexp_replace(earlier, '[\x09-\x0D\x20]+', ' ', 'g'), '((?:[^ ]+ ){{6}}[^ ]+) ', '\1' || chr(10) || '> ', 'g') || chr(10) || coalesce(text, '') END AS text
    FROM conversations c LEFT JOIN before b ON c.conv_id = b.conv_id AND c.turn = b.turn), {LINK_SQL}"""
