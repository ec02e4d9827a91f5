"""Queries over sizes, quads, reading order and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import geometry as G
from docsift.functions import sequences as Q
from docsift.operators import boxes, images, layout
from docsift.queries import sql as S
from docsift.queries.sql import table

RUNS = [
    (1, [7] * 40), (2, [7] * 39), (3, [1, 2] * 20), (4, [5] + [1, 2, 3] * 13), (5, list(range(50))), (6, list(range(20)) * 3), (7, list(range(60)) * 3), (8, list(range(61)) * 3), (9, [1, 2, 3]), (10, []),
    (11, list(range(40)) + [4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16] * 3), (12, [9] + list(range(12)) * 6),
]
SEQUENCES = [(1, [1, 2, 3, 4, 1, 2, 3]), (2, [1, 2]), (3, [1, 1, 1, 1, 1]), (4, [1, 2, 3, 4, 1, 2, 3, 5, 1, 2, 3]), (5, []), (6, [4, 5, 6])]
CHARSET = ["<blank>", "a", "b", "c", "d", "e", " ", "g"]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 2999 + 1).alias("h"), (F.col("p_partkey") * 53 % 3001 + F.col("p_size")).alias("w"))


def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).withColumn("r", G.smart_resize(F.col("h"), F.col("w")))
    return rows.select("p_partkey", F.col("r.h").alias("rh"), F.col("r.w").alias("rw"))


def det_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).withColumn("r", G.det_resize(F.col("h") * 3, F.col("w") * 2))
    return rows.select("p_partkey", F.col("r.h").alias("rh"), F.col("r.w").alias("rw"))


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles turned by Pythagorean slopes, corners in an order that changes from row to row."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (k * 13 % 500).cast("double").alias("cx"), (k * 29 % 700).cast("double").alias("cy"), (k * 11 % 90 + 1).cast("double").alias("a"), (k * 17 % 15).cast("double").alias("b"), (k % 4).alias("turn"), (k % 3).alias("lean"))
    ux, uy = F.when(F.col("lean") == 0, 1.0).when(F.col("lean") == 1, 0.8).otherwise(0.6), F.when(F.col("lean") == 0, 0.0).when(F.col("lean") == 1, 0.6).otherwise(-0.8)
    corners = [(F.col("cx") + s * F.col("a") * ux - t * F.col("b") * uy, F.col("cy") + s * F.col("a") * uy + t * F.col("b") * ux) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    quad = F.array(*[G.point(x, y) for x, y in corners])
    rects = boxes.once(rows, rect=quad).select("l_orderkey", "l_linenumber", "rect", "turn", "a", "b")
    return boxes.once(rects, quad=F.array(*[F.get("rect", ((F.lit(i) + F.col("turn")) % 4).cast("int")) for i in range(4)])).drop("turn")


def _flat(quad: str) -> list:
    return [F.round(F.col(quad)[i][axis], 6).alias(f"{axis}{i}") for i in range(4) for axis in ("x", "y")]


def order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quads(spark, sf_dir).select("l_orderkey", "l_linenumber", G.order_quad(F.col("quad")).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", *_flat("q"))


def unclip_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes.grow(_quads(spark, sf_dir), "rect", 1.5, "q")
    return rows.select("l_orderkey", "l_linenumber", *_flat("q"))


def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's filters in order: candidates, side, score, side after growing, size on the page."""
    rows = _quads(spark, sf_dir).withColumn("score", (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 10 / F.lit(10.0))
    rows = rows.where("l_linenumber <= 5").withColumn("side", F.least(2 * F.col("a"), 2 * F.col("b"))).drop("quad").withColumnRenamed("rect", "quad")
    kept = boxes.filter_boxes(rows, (600, 800), (150, 200))
    return boxes.once(kept, size=G.crop_size(F.col("page"))).select("l_orderkey", "l_linenumber", "size.w", "size.h", "size.vertical")


def aspect_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 41 % 900 + 10).alias("w"), (F.col("p_size") % 40 + 8).alias("h"))
    rows = images.aspect_batches(strips, ["p_brand"])
    widths = rows.groupBy("p_brand", "batch").agg(F.count("*").alias("n"), G.batch_width(F.max("ratio")).alias("width"), F.min("pos").alias("first_pos"))
    return widths


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads derived from line numbers: two columns, slanted rows, gaps."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("t"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey")).alias("text"), ((F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 3 * 120).cast("double").alias("x"), (F.floor((F.col("l_linenumber") - 1) / 2) * 24 + (F.col("l_orderkey") * F.col("l_linenumber")) % 9 + F.when(F.col("l_linenumber") > 4, 40).otherwise(0)).cast("double").alias("y"))
    quad = F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x") + 100, F.col("y")), G.point(F.col("x") + 100, F.col("y") + 20), G.point(F.col("x"), F.col("y") + 20))
    pages = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", quad.alias("quad"), "text"))).alias("items"))
    return pages.select("l_orderkey", layout.assemble_lines(F.col("items")).alias("text"))


def _matrix() -> F.Column:
    e = F.col("embedding")
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(e, t * 8 + 1, F.lit(8)))


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", Q.ctc_decode(_matrix(), F.array(*[F.lit(c) for c in CHARSET[:7]])).alias("r"))
    return rows.select("vec_id", F.col("r.text").alias("text"), F.round("r.score", 6).alias("score"))


def softmax_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarded = Q.softmax_guard(F.transform(_matrix(), lambda r: F.transform(r, lambda x: x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(guarded).alias("t", "row"))
    return rows.select("vec_id", F.col("t").cast("long").alias("t"), Q.argmax(F.col("row")).alias("k"), F.round(F.array_max("row"), 6).alias("p"))


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A sequence of three to nine tokens for every vector; together they ask for all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    seqs = rows.select(F.col("vec_id").alias("seq_id"), F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 7 + 2).cast("int")), lambda i: (F.col("vec_id") * 17 + i * 29) % n).alias("ids"))
    return seqs, rows.select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.embedding_lookup(*_tokens(spark, sf_dir))
    return rows.select("seq_id", F.col("pos").cast("long").alias("pos"), "token_id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.size("vec").alias("width"))


def embedding_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even tokens count as placeholder 0; the k-th image row is vector k."""
    looked = images.embedding_lookup(*_tokens(spark, sf_dir)).withColumn("token_id", F.when(F.col("token_id") % 2 == 0, 0).otherwise(F.col("token_id")))
    marks = looked.where("token_id = 0").groupBy("seq_id").agg(F.count("*").cast("int").alias("n")).select("seq_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    image = marks.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("image_vec")), "k")
    rows = images.splice_image_rows(looked, image, 0)
    return rows.select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("token_id").cast("long").alias("token_id"), F.round(F.col("vec")[1].cast("double"), 6).alias("second"))


def _user_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user in order, as token numbers; short sequences by a modest alphabet."""
    types = ["click", "purchase", "scroll", "signup", "view"]
    token = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")), F.lit(0)).cast("int")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", token.alias("token")))).alias("e"))
    return per.select("user_id", F.transform("e", lambda x: x["token"]).alias("seq"))


def banned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(-i, s) for i, s in SEQUENCES], "user_id long, seq array<int>")
    rows = _user_tokens(spark, sf_dir).unionByName(given)
    return rows.select("user_id", F.array_join(Q.banned_next(F.col("seq")), ",").alias("banned"))


def loop_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(-i, s) for i, s in RUNS], "user_id long, seq array<int>")
    rows = _user_tokens(spark, sf_dir).unionByName(given)
    return rows.select("user_id", Q.looping(F.col("seq")).alias("looping"))


def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits scripted by the users' events: the event's own token leads, the next number is second, 5 (view) ends."""
    import pandas as pd

    from docsift.models.decode import greedy

    def run(frames):
        for frame in frames:
            rows = []
            for user, seq in zip(frame["user_id"], frame["seq"], strict=True):
                script = [[2.0 * (k == t) + 1.0 * (k == (t + 1) % 6) for k in range(6)] for t in seq]
                at = iter(script[1:] + [[0.0] * 5 + [9.0]] * 2049)
                tokens, stop = greedy(script[0], lambda _, at=at: next(at), eos=5)
                rows.append((user, ",".join(map(str, tokens)), stop))
            yield pd.DataFrame(rows, columns=["user_id", "tokens", "stop"])

    return _user_tokens(spark, sf_dir).mapInPandas(run, "user_id long, tokens string, stop string")


def onnx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-encoded look-up graph and a broken file, as tables."""
    from docsift.models.wire import bytes_field as b
    from docsift.models.wire import int_field as i
    from docsift.models.wire import onnx_tables as tables

    gather = b(1, b(1, b"t") + b(1, b"ids") + b(2, b"e") + b(3, b"look") + b(4, b"Gather"))
    rows = b(5, i(1, 2) + i(1, 2) + i(2, 1) + b(8, b"t") + b(9, bytes(16)))
    graph = b(7, gather + rows + b(11, b(1, b"ids")) + b(12, b(1, b"e"))) + b(8, b(1, b"") + i(2, 13))
    files = spark.createDataFrame([("lookup.onnx", bytearray(graph)), ("broken.onnx", bytearray(b"\x3a\x7f"))], "path string, content binary")
    return tables(files).selectExpr("path", "opset", "lookup", "last_position", "error", "nodes[0].op AS op", "array_join(tensors[0].dims, ',') AS dims")


QUERIES = {
    f.__name__: f
    for f in (greedy_decode, onnx_tables, smart_resize, det_resize, order_quads, unclip_quads, box_filter, aspect_batches, reading_order, ctc_decode, softmax_guard, embedding_lookup, embedding_splice, banned_tokens, loop_detect)
}

_SIZES = "sizes AS (SELECT p_partkey, (p_partkey * 37 % 2999 + 1)::DOUBLE AS h, (p_partkey * 53 % 3001 + p_size)::DOUBLE AS w FROM part)"
_RECTS = """rows0 AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
rows1 AS (SELECT *, (k * 13 % 500)::DOUBLE AS cx, (k * 29 % 700)::DOUBLE AS cy, (k * 11 % 90 + 1)::DOUBLE AS a, (k * 17 % 15)::DOUBLE AS b, k % 4 AS turn, CASE k % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS ux, CASE k % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE -0.8::DOUBLE END AS uy FROM rows0),
rects AS (SELECT *, [{'x': cx - a * ux + b * uy, 'y': cy - a * uy - b * ux}, {'x': cx + a * ux + b * uy, 'y': cy + a * uy - b * ux}, {'x': cx + a * ux - b * uy, 'y': cy + a * uy + b * ux}, {'x': cx - a * ux - b * uy, 'y': cy - a * uy + b * ux}] AS r FROM rows1)"""
_OUT8 = ", ".join(f"round(q[{i + 1}].{axis}, 6) AS {axis}{i}" for i in range(4) for axis in "xy")


def _grown(ratio: float) -> str:
    """CTEs grown(..., q) from rects."""
    return f"""sides AS (SELECT *, sqrt((r[2].x - r[1].x) * (r[2].x - r[1].x) + (r[2].y - r[1].y) * (r[2].y - r[1].y)) AS w, sqrt((r[4].x - r[1].x) * (r[4].x - r[1].x) + (r[4].y - r[1].y) * (r[4].y - r[1].y)) AS h, (r[1].x + r[2].x + r[3].x + r[4].x) / 4 AS mx, (r[1].y + r[2].y + r[3].y + r[4].y) / 4 AS my FROM rects),
steps AS (SELECT *, w * h * {ratio}::DOUBLE / (2 * (w + h)) AS d FROM sides),
axes AS (SELECT *, (w / 2 + d) * (r[2].x - r[1].x) / w AS ax, (w / 2 + d) * (r[2].y - r[1].y) / w AS ay, (h / 2 + d) * (r[4].x - r[1].x) / h AS bx, (h / 2 + d) * (r[4].y - r[1].y) / h AS by_ FROM steps),
grown AS (SELECT *, CASE WHEN w < 1e-6 OR h < 1e-6 THEN r ELSE [{{'x': mx - ax - bx, 'y': my - ay - by_}}, {{'x': mx + ax - bx, 'y': my + ay - by_}}, {{'x': mx + ax + bx, 'y': my + ay + by_}}, {{'x': mx - ax + bx, 'y': my - ay + by_}}] END AS q FROM axes)"""


def _len(q: str, i: int, j: int) -> str:
    return f"sqrt(({q}[{i}].x - {q}[{j}].x) * ({q}[{i}].x - {q}[{j}].x) + ({q}[{i}].y - {q}[{j}].y) * ({q}[{i}].y - {q}[{j}].y))"


_CHARS = S.lit(CHARSET[:7])
_MATRIX = "mat AS (SELECT vec_id, t, embedding[t * 8 + 1:t * 8 + 8] AS r FROM embeddings, (SELECT unnest(range(0, 8)) AS t))"
_EVENTS = "ev AS (SELECT user_id, event_id, ts, coalesce(list_position(['click', 'purchase', 'scroll', 'signup', 'view'], event_type), 0)::INT AS token FROM events), seqs0 AS (SELECT user_id, list(token ORDER BY ts, event_id) AS seq FROM ev GROUP BY user_id)"


def _given(rows: list) -> str:
    return " UNION ALL ".join(f"SELECT {-i}::BIGINT AS user_id, [{', '.join(map(str, s))}]::INT[] AS seq" for i, s in rows)


ORACLES = {
    "smart_resize": f"""WITH {_SIZES}, a AS (SELECT p_partkey, CASE WHEN h < 28 THEN round_even(w * 28.0::DOUBLE / h, 0)::DOUBLE ELSE w END AS w1, greatest(h, 28.0::DOUBLE) AS h1 FROM sizes),
b AS (SELECT p_partkey, CASE WHEN w1 < 28 THEN round_even(h1 * 28.0::DOUBLE / w1, 0)::DOUBLE ELSE h1 END AS h2, greatest(w1, 28.0::DOUBLE) AS w2 FROM a),
c AS (SELECT *, round_even(h2 / 28.0::DOUBLE, 0)::DOUBLE * 28 AS hb, round_even(w2 / 28.0::DOUBLE, 0)::DOUBLE * 28 AS wb, sqrt(h2 * w2 / 1003520.0::DOUBLE) AS s, sqrt(112896.0::DOUBLE / (h2 * w2)) AS g FROM b)
SELECT p_partkey, CASE WHEN greatest(h2, w2) / least(h2, w2) <= 200 THEN (CASE WHEN hb * wb > 1003520 THEN floor(h2 / s / 28) * 28 WHEN hb * wb < 112896 THEN ceil(h2 * g / 28) * 28 ELSE hb END)::BIGINT END AS rh,
    CASE WHEN greatest(h2, w2) / least(h2, w2) <= 200 THEN (CASE WHEN hb * wb > 1003520 THEN floor(w2 / s / 28) * 28 WHEN hb * wb < 112896 THEN ceil(w2 * g / 28) * 28 ELSE wb END)::BIGINT END AS rw FROM c""",
    "det_resize": f"""WITH {_SIZES}, a AS (SELECT p_partkey, h * 3 AS h, w * 2 AS w, CASE WHEN least(h * 3, w * 2) < 64 THEN 64 / least(h * 3, w * 2) ELSE 1.0::DOUBLE END AS r FROM sizes),
b AS (SELECT p_partkey, h, w, CASE WHEN greatest(h, w) * r > 4000 THEN 4000 / greatest(h, w) ELSE r END AS r FROM a)
SELECT p_partkey, greatest(round_even(h * r / 32.0::DOUBLE, 0)::BIGINT * 32, 32)::BIGINT AS rh, greatest(round_even(w * r / 32.0::DOUBLE, 0)::BIGINT * 32, 32)::BIGINT AS rw FROM b""",
    "order_quads": f"""WITH {_RECTS}, s AS (SELECT l_orderkey, l_linenumber, list_sort([{', '.join(f"{{'x': r[({i} + turn) % 4 + 1].x, 'i': {i}, 'y': r[({i} + turn) % 4 + 1].y}}" for i in range(4))}]) AS v FROM rects),
q AS (SELECT l_orderkey, l_linenumber, [CASE WHEN v[2].y > v[1].y THEN v[1] ELSE v[2] END, CASE WHEN v[4].y > v[3].y THEN v[3] ELSE v[4] END, CASE WHEN v[4].y > v[3].y THEN v[4] ELSE v[3] END, CASE WHEN v[2].y > v[1].y THEN v[2] ELSE v[1] END] AS q FROM s)
SELECT l_orderkey, l_linenumber, {_OUT8} FROM q""",
    "unclip_quads": f"WITH {_RECTS}, {_grown(1.5)} SELECT l_orderkey, l_linenumber, {_OUT8} FROM grown",
    "box_filter": f"""WITH {_RECTS}, {_grown(1.4)}, f AS (SELECT * FROM grown WHERE l_linenumber <= 5 AND least(2 * a, 2 * b) >= 3 AND ((l_orderkey * 3 + l_linenumber) % 10)::DOUBLE / 10.0::DOUBLE >= 0.45::DOUBLE AND least({_len('q', 1, 2)}, {_len('q', 1, 4)}) >= 5),
p AS (SELECT l_orderkey, l_linenumber, [{', '.join(f"{{'x': greatest(least(round_even(q[{i}].x / 600.0::DOUBLE * 150.0::DOUBLE, 0)::DOUBLE, 150.0::DOUBLE), 0.0::DOUBLE), 'y': greatest(least(round_even(q[{i}].y / 800.0::DOUBLE * 200.0::DOUBLE, 0)::DOUBLE, 200.0::DOUBLE), 0.0::DOUBLE)}}" for i in range(1, 5))}] AS c FROM f),
s AS (SELECT l_orderkey, l_linenumber, greatest(floor(greatest({_len('c', 1, 2)}, {_len('c', 3, 4)})), 1) AS w, greatest(floor(greatest({_len('c', 1, 4)}, {_len('c', 2, 3)})), 1) AS h FROM p WHERE {_len('c', 1, 2)} > 3 AND {_len('c', 1, 4)} > 3)
SELECT l_orderkey, l_linenumber, w::BIGINT AS w, h::BIGINT AS h, h / w >= 1.5 AS vertical FROM s""",
    "aspect_batches": """WITH s AS (SELECT p_brand, p_partkey AS pos, (p_partkey * 41 % 900 + 10)::DOUBLE / (p_size % 40 + 8)::DOUBLE AS ratio FROM part),
b AS (SELECT *, ((row_number() OVER (PARTITION BY p_brand ORDER BY ratio, pos) - 1) // 6)::BIGINT AS batch FROM s)
SELECT p_brand, batch, count(*) AS n, least(floor(48 * greatest(max(ratio), 320::DOUBLE / 48)), 3200)::BIGINT AS width, min(pos) AS first_pos FROM b GROUP BY ALL""",
    "reading_order": """WITH RECURSIVE b0 AS (SELECT l_orderkey, l_linenumber, 't' || l_linenumber || '-' || l_partkey AS text, ((l_linenumber * 7 + l_orderkey) % 3 * 120)::DOUBLE AS x, ((l_linenumber - 1) // 2 * 24 + (l_orderkey * l_linenumber) % 9 + CASE WHEN l_linenumber > 4 THEN 40 ELSE 0 END)::DOUBLE AS y FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y + 10, x, l_linenumber, text) AS rn FROM b0),
fold AS (SELECT l_orderkey, 0 AS rn, []::STRUCT(top DOUBLE, bot DOUBLE, cells STRUCT(x DOUBLE, t VARCHAR)[])[] AS rs FROM b WHERE rn = 1
UNION ALL SELECT f.l_orderkey, f.rn + 1, (CASE WHEN list_position(m, true) IS NULL OR list_position(m, true) = 0 THEN list_append(rs, {'top': y, 'bot': y + 20, 'cells': [{'x': x, 't': text}]})
    ELSE list_transform(rs, lambda r, i: CASE WHEN i = greatest(len(rs) - 2, 1) + list_position(m, true) - 1 THEN {'top': least(r.top, y), 'bot': greatest(r.bot, y + 20), 'cells': list_append(r.cells, {'x': x, 't': text})} ELSE r END) END)
  FROM (SELECT f0.l_orderkey, f0.rn, f0.rs, b1.y, b1.x, b1.text, list_transform(f0.rs[greatest(len(f0.rs) - 2, 1):len(f0.rs)], lambda r: least(b1.y + 20, r.bot) - greatest(b1.y, r.top) > 0.5 * least(20.0, r.bot - r.top)) AS m FROM fold f0 JOIN b b1 ON b1.l_orderkey = f0.l_orderkey AND b1.rn = f0.rn + 1) f),
done AS (SELECT l_orderkey, arg_max(rs, rn) AS rs FROM fold GROUP BY l_orderkey),
flat AS (SELECT l_orderkey, generate_subscripts(rs, 1) AS i, unnest(rs) AS r FROM done),
med AS (SELECT l_orderkey, list_sort(list(r.bot - r.top))[count(*) // 2 + 1] AS m FROM flat GROUP BY l_orderkey),
lined AS (SELECT l_orderkey, i, r, lag(r.bot) OVER (PARTITION BY l_orderkey ORDER BY r.top, i) AS prev, row_number() OVER (PARTITION BY l_orderkey ORDER BY r.top, i) AS k FROM flat)
SELECT l_orderkey, string_agg(CASE WHEN coalesce(r.top - prev > 0.9 * CASE WHEN m = 0 THEN 1 ELSE m END, false) THEN chr(10) ELSE '' END || array_to_string(list_transform(list_sort(r.cells), lambda c: c.t), ' '), chr(10) ORDER BY k) AS text FROM lined JOIN med USING (l_orderkey) GROUP BY l_orderkey""",
    "ctc_decode": f"""WITH {_MATRIX}, m AS (SELECT vec_id, t, list_position(r, list_max(r)) - 1 AS k, list_max(r)::DOUBLE AS p FROM mat), l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM m),
kept AS (SELECT * FROM l WHERE k <> 0 AND (prev IS NULL OR prev <> k)), s AS (SELECT vec_id, string_agg(({_CHARS})[k + 1], '' ORDER BY t) AS text, avg(p) AS score FROM kept GROUP BY vec_id)
SELECT e.vec_id, coalesce(text, '') AS text, round(coalesce(score, 0), 6) AS score FROM embeddings e LEFT JOIN s USING (vec_id)""",
    "softmax_guard": f"""WITH {_MATRIX}, bad AS (SELECT vec_id, bool_or(list_min(r) < 0 OR abs(list_sum(list_transform(r, lambda x: x::DOUBLE)) - 1) > 0.01001::DOUBLE) AS fix FROM mat GROUP BY vec_id),
e AS (SELECT vec_id, t, fix, r, list_transform(r, lambda x: exp(x::DOUBLE - list_max(r)::DOUBLE)) AS w FROM mat JOIN bad USING (vec_id))
SELECT vec_id, t::BIGINT AS t, (list_position(r, list_max(r)) - 1)::INT AS k, round(CASE WHEN fix THEN list_max(w) / list_sum(w) ELSE list_max(r)::DOUBLE END, 6) AS p FROM e""",
    "embedding_lookup": """WITH s AS (SELECT vec_id AS seq_id, unnest(range(0, vec_id % 7 + 3)) AS pos FROM embeddings), t AS (SELECT seq_id, pos, (seq_id * 17 + pos * 29) % (SELECT max(vec_id) + 1 FROM embeddings) AS token_id FROM s)
SELECT seq_id, pos::BIGINT AS pos, token_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INT AS width FROM t JOIN embeddings ON vec_id = token_id""",
    "embedding_splice": """WITH s AS (SELECT vec_id AS seq_id, unnest(range(0, vec_id % 7 + 3)) AS pos FROM embeddings), t AS (SELECT seq_id, pos, (seq_id * 17 + pos * 29) % (SELECT max(vec_id) + 1 FROM embeddings) AS tok FROM s),
k AS (SELECT *, CASE WHEN tok % 2 = 0 THEN row_number() OVER (PARTITION BY seq_id, tok % 2 ORDER BY pos) END AS k FROM t)
SELECT seq_id, pos::BIGINT AS pos, (CASE WHEN tok % 2 = 0 THEN 0 ELSE tok END)::BIGINT AS token_id, round(embedding[2]::DOUBLE, 6) AS second FROM k JOIN embeddings ON vec_id = coalesce(k, tok)""",
    "banned_tokens": f"""WITH {_EVENTS}, seqs AS (SELECT * FROM seqs0 UNION ALL {_given(SEQUENCES)}), w AS (SELECT user_id, seq, unnest(range(1, len(seq) - 2)) AS i FROM seqs WHERE len(seq) >= 4),
hit AS (SELECT DISTINCT user_id, seq[i + 3] AS token FROM w WHERE seq[i:i + 2] = seq[len(seq) - 2:len(seq)]), b AS (SELECT user_id, string_agg(token::VARCHAR, ',' ORDER BY token) AS banned FROM hit GROUP BY user_id)
SELECT seqs.user_id, coalesce(banned, '') AS banned FROM seqs LEFT JOIN b USING (user_id)""",
    "loop_detect": f"""WITH {_EVENTS}, seqs AS (SELECT * FROM seqs0 UNION ALL {_given(RUNS)}), p AS (SELECT user_id, seq, len(seq) AS n, unnest(range(2, 61)) AS p FROM seqs),
c AS (SELECT user_id, bool_or(n >= p * CASE WHEN p <= 12 THEN 6 ELSE 3 END AND seq[n - p * CASE WHEN p <= 12 THEN 6 ELSE 3 END + 1 + p:n] = seq[n - p * CASE WHEN p <= 12 THEN 6 ELSE 3 END + 1:n - p]) AS cyc FROM p GROUP BY user_id)
SELECT user_id, len(seq) >= 40 AND (len(list_distinct(seq[len(seq) - 39:len(seq)])) = 1 OR coalesce(cyc, false)) AS looping FROM seqs LEFT JOIN c USING (user_id)""",
}
ORACLES["onnx_tables"] = """SELECT 'lookup.onnx' AS path, 13::BIGINT AS opset, 't' AS lookup, 'no-logits' AS last_position, NULL::VARCHAR AS error, 'Gather' AS op, '2,2' AS dims
UNION ALL SELECT 'broken.onnx', NULL, NULL, NULL, 'ValueError: truncated message', NULL, NULL"""
