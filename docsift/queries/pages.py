"""Queries over web pages, inputs, manifests and model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators import graphs, images, integrity
from docsift.queries import sql as S
from docsift.queries.sql import table
from docsift.sources import inputs

HTML = [
    (1, "http://h.example/a/p.html", '<html><body><img src="logo.png" width=900 height=900><article><img src="a.png" width="10" height="10"><img src="/b.png" width="10px" height="10"><img src="c.png"></article></body></html>'),
    (2, "http://h.example/a/", '<body><main><p>no image here</p></main><img data-src="lazy.jpg"><img src="data:image/png;base64,AAAA" width=99 height=99></body>'),
    (3, "https://h.example/x?q=1", "<img src='//cdn.example/silicon.png' width=5 height=5><img src='../up.gif' height='3' width='4'><img data-original=\"o.png\" width=2 height=9>"),
    (4, "https://h.example/none", "<p>text</p>"),
    (5, "https://h.example/tie", '<img src="first.png" width="6" height="6"><img src="second.png" width="9" height="4">'),
]
ARGS = [
    (0, None, None, False), (1, "https://h/x.PNG", None, False), (2, "https://h/x.tif", None, False), (3, "https://h/page", "text/html", False), (4, "photo.jpg", None, True), (5, "http://h/a.png?x=1", "application/xml", False),
    (6, "http://h/img", "image/webp", False), (7, "nowhere", None, False), (8, "ftp://h/a.png", None, False), (9, "HTTPS://h/a.b/c.jpeg#f", "", False), (10, "https://h/dir.png/", None, False), (11, "https://h/a%20b+c.gif", "application/octet-stream", False),
]
MANIFEST = ["# digests", "", "  " + "A" * 64 + "  onnx/model.onnx", "b" * 64 + " *det/inference.onnx", "short", "c" * 64 + "\tname with blanks.bin  ", "d" * 64 + "  onnx/model.onnx", "not-hex  other.bin"]
REQUIRED = [("q8", f) for f in ("vision_q8.onnx", "decoder.onnx", "embedding.onnx", "tokenizer.json", "config.json")] + [("q4", f) for f in ("vision_q4.onnx", "decoder.onnx", "embedding.onnx", "tokenizer.json", "config.json")]
PRESENT = [("full", f) for f in ("vision_q8.onnx", "vision_q4.onnx", "decoder.onnx", "embedding.onnx", "tokenizer.json")] + [("part", f) for f in ("vision_q8.onnx", "decoder.onnx", "embedding.onnx", "tokenizer.json", "notes.txt")] + [("bare", "readme.md")]
CACHES = [f"{side}.{layer}.{kind}" for side in ("past_key_values", "present") for layer in (0, 1, 2, 10, 11) for kind in ("key", "value")] + ["present.12.key", "logits"]
NODES = [("embed", ["ids"], ["h0"]), ("attn", ["h0", "mask"], ["h1"]), ("add", ["h0", "h1"], ["h2"]), ("norm", ["h2"], ["h3", "stats"]), ("head", ["h3", "w"], ["logits"]), ("cast", ["logits"], ["out"])]
YML = [
    ("det", "Global:\n  model_name: d\nPostProcess:\n  name: DB\n  thresh: 0.2\n  box_thresh: 0.45\n  max_candidates: 3000\n  unclip_ratio: wide\n"),
    ("rec", "PostProcess:\n  name: CTC\n  character_dict:\n  - '!'\n  - ''''\n  - '#'\n  - $\n  - \\\n  - ~\n  - 　\n  - a\n  -\nOther:\n  thresh: 9\n"),
    ("none", ""),
]
DET_DEFAULTS = {"thresh": 0.3, "box_thresh": 0.6, "unclip_ratio": 1.5, "max_candidates": 1000}


def page_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.slug(title).alias("slug"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.links(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.col("idx").cast("long").alias("idx"), "href", images.url_join("url", "href").alias("target"))


def _html(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HTML, "page_id long, url string, html string")


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _html(spark).unionByName(table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("page_id"), "url", "html"))
    rows = images.image_candidates(pages)
    return rows.select("page_id", F.col("idx").cast("long").alias("idx"), "src", "area", images.url_join("url", "src").alias("target"))


def prominent_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of unsized images are stood in for by the length of their addresses."""
    rows = images.image_candidates(_html(spark))
    measured = rows.select("page_id", "src", F.length("src").alias("pixels"))
    return images.prominent_image(rows, measured)


def classify_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ARGS, "pos long, arg string, content_type string, is_file boolean")
    urls = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("pos"), F.col("url").alias("arg"), F.lit(None).cast("string").alias("content_type"), F.lit(False).alias("is_file"))
    rows = rows.unionByName(urls)
    return rows.select("pos", inputs.classify(F.col("arg"), F.col("content_type"), F.col("is_file")).alias("kind"), inputs.url_stem(F.col("arg")).alias("stem"))


def expand_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.expand_inputs(spark, [f"{sf_dir}/*.parquet", "https://h/x.png", "no-such-*.png"])


def _digests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"), F.sha2("text", 256).alias("actual"), "doc_id")
    pinned = docs.where("doc_id % 5 <> 0").select("name", F.when(F.col("doc_id") % 11 == 0, F.lit("placeholder")).when(F.col("doc_id") % 7 == 0, F.reverse("actual")).otherwise(F.upper("actual")).alias("sha256"))
    return docs.drop("doc_id"), pinned


def verify_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pinned = _digests(spark, sf_dir)
    return integrity.verify(files, pinned).select("name", "actual", "status")


def merge_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return integrity.merge_manifests(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0").withColumn("sha256", F.reverse("sha256")))


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.parse_manifest(spark.createDataFrame(list(enumerate(MANIFEST)), "line_no long, line string"))


def manifest_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").select(F.format_string("item-%05d.txt", "item_id").alias("name"), F.sha2("text", 256).alias("actual"))
    return integrity.manifest_lines(bench, "digests")


def kv_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.pair_caches(spark.createDataFrame([(n,) for n in CACHES], "name string"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer and consumers of every tensor of a graph."""
    return graphs.edges(spark.createDataFrame(NODES, "node string, ins array<string>, outs array<string>"))


def model_set_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.complete_sets(spark.createDataFrame(REQUIRED, "variant string, file string"), spark.createDataFrame(PRESENT, "folder string, file string"), ("config.json",))


def yaml_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.parameters(spark.createDataFrame(YML, "name string, text string"), DET_DEFAULTS).withColumn("characters", F.array_join("characters", " "))


def yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["''''", "'a''b'", " plain ", '"q\\u0041"', '"a\\nb"', "　", "'", "\t'x' "])], "id long, value string")
    return rows.select("id", X.yaml_scalar(F.col("value")).alias("scalar"))


QUERIES = {
    f.__name__: f
    for f in (page_slug, page_links, image_candidates, prominent_image, classify_inputs, expand_inputs, verify_checksums, merge_manifest, manifest_parse, manifest_write, kv_pairing, graph_edges, model_set_complete, yaml_params, yaml_scalars)
}

_HTML = S.values(HTML, "page_id, url, html")
_IMG = r"""<img\b((?:[^>"']|"[^"]*"|'[^']*')*)>"""


def _attr(name: str) -> str:
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return f"regexp_replace(regexp_extract(tag, {S.rx(pattern)}, 1), {S.rx(chr(92) + 'A[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']' + chr(92) + 'z')}, '', 'g')"


def _number(name: str) -> str:
    return f"coalesce(try_cast(regexp_extract({_attr(name)}, '(\\d+)', 1) AS BIGINT), 0)"


def _candidates(source: str) -> str:
    return f"""mains AS (SELECT *, regexp_extract_all(html, {S.rx('(?is)' + _IMG)}, 1) AS every_tag,
    regexp_extract_all(coalesce(nullif(regexp_extract(html, '(?is)<article\\b[^>]*>.*?</article>'), ''), regexp_extract(html, '(?is)<main\\b[^>]*>.*?</main>')), {S.rx('(?is)' + _IMG)}, 1) AS main_tags FROM {source}),
tags0 AS (SELECT page_id, url, CASE WHEN len(main_tags) > 0 THEN main_tags ELSE every_tag END AS tags FROM mains),
tags AS (SELECT page_id, url, generate_subscripts(tags, 1) - 1 AS idx, unnest(tags) AS tag FROM tags0),
srcs AS (SELECT page_id, url, idx, coalesce(nullif({_attr('src')}, ''), nullif({_attr('data-src')}, ''), {_attr('data-original')}) AS src, ({_number('width')} * {_number('height')})::BIGINT AS area FROM tags),
cands AS (SELECT * FROM srcs WHERE src <> '' AND NOT starts_with(src, 'data:') AND NOT regexp_matches(src, {S.rx(X.JUNK_IMAGE)}))"""


_EXTENSIONS = ", ".join(map(S.lit, X.IMAGE_EXTENSIONS))
_PATH = r"regexp_extract(arg, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
ORACLES = {
    "page_slug": rf"WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), s AS (SELECT page_id, substr(lower(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}_\-]+', '_', 'g'), '\A_+|_+\z', '', 'g')), 1, 60) AS slug FROM p) SELECT page_id, CASE WHEN slug = '' THEN 'webpage' ELSE slug END AS slug FROM s",
    "page_links": f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, {S.rx('(?is)' + _IMG.replace('<img', '<a'))}, 1) AS tags FROM pages), p AS (SELECT page_id, url, list_filter(list_transform(tags, lambda tag: {_attr('href')}), lambda x: x <> '') AS links FROM a), h AS (SELECT page_id, url, generate_subscripts(links, 1) - 1 AS idx, unnest(links) AS href FROM p)
SELECT page_id, idx::BIGINT AS idx, href, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS target FROM h""",
    "prominent_image": f"""WITH {_candidates('(SELECT * FROM ' + _HTML + ')')}, best AS (SELECT page_id, arg_max(src, area * 1000 - idx) AS src, max(area) AS area FROM cands GROUP BY page_id),
first AS (SELECT page_id, src, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS rn FROM cands WHERE page_id IN (SELECT page_id FROM best WHERE area = 0)),
seen AS (SELECT page_id, arg_max(src, len(src) * 1000 - rn) AS src FROM first WHERE rn <= 8 GROUP BY page_id)
SELECT page_id, src, area FROM best WHERE area > 0 UNION ALL SELECT page_id, src, 0::BIGINT FROM seen""",
    "classify_inputs": f"""WITH a AS (SELECT pos, arg, content_type, is_file FROM {S.values(ARGS, 'pos, arg, content_type, is_file')} UNION ALL SELECT page_id + 100, url, NULL, false FROM pages),
e AS (SELECT *, lower(coalesce(content_type, '')) AS ct, {_PATH} AS path, lower(regexp_extract({_PATH}, '[^/.](\\.[^./]+)$', 1)) AS ext, lower(regexp_extract(arg, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme FROM a),
n AS (SELECT *, url_decode(regexp_extract(path, '([^/]*)/*$', 1)) AS name FROM e),
s AS (SELECT *, CASE WHEN regexp_matches(name, '[^.]\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]+$', '') ELSE name END AS stem0 FROM n)
SELECT pos, CASE WHEN arg IS NULL THEN 'clipboard' WHEN is_file THEN 'file' WHEN scheme IN ('http', 'https') THEN CASE WHEN starts_with(ct, 'image/') THEN 'image_url' WHEN contains(ct, 'html') OR contains(ct, 'xml') THEN 'html_url' WHEN ext IN ({_EXTENSIONS}) THEN 'image_url' ELSE 'html_url' END END AS kind,
    CASE WHEN stem0 = '' THEN 'image' ELSE stem0 END AS stem FROM s""",
    "verify_checksums": """WITH d AS (SELECT 'doc-' || doc_id AS name, sha256(text) AS actual, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'placeholder' WHEN doc_id % 7 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS expected FROM documents)
SELECT name, actual, CASE WHEN expected IS NULL THEN 'skipped' WHEN expected = 'placeholder' THEN 'malformed' WHEN expected = actual THEN 'verified' ELSE 'mismatch' END AS status FROM d""",
    "merge_manifest": "SELECT 'doc-' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 2 = 0 THEN 'manifest' ELSE 'embedded' END AS origin FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0",
    "manifest_parse": rf"""WITH l AS (SELECT line_no, {S.strip('line')} AS t FROM {S.values(list(enumerate(MANIFEST)), 'line_no, line')}),
p AS (SELECT line_no, lower(regexp_extract(t, {S.rx(f'{chr(92)}A([^{X.WS}]+)')}, 1)) AS sha256, regexp_replace(regexp_extract(t, {S.rx(f'(?s){chr(92)}A[^{X.WS}]+[{X.WS}]+(.*){chr(92)}z')}, 1), '\A\*+', '') AS name FROM l WHERE t <> '' AND NOT starts_with(t, '#'))
SELECT name, arg_max(sha256, line_no) AS sha256 FROM p WHERE name <> '' GROUP BY name""",
    "manifest_write": "SELECT 0::BIGINT AS line_no, '# digests' AS line UNION ALL SELECT row_number() OVER (ORDER BY item_id), sha256(text) || '  item-' || lpad(item_id::VARCHAR, 5, '0') || '.txt' FROM benchmark",
    "kv_pairing": f"""WITH n AS (SELECT name, coalesce(try_cast(regexp_extract(name, '\\.(\\d+)\\.', 1) AS INT), -1) AS layer, CASE WHEN contains(name, 'value') THEN 'value' ELSE 'key' END AS kind FROM {S.values([(c,) for c in CACHES], 'name')})
SELECT coalesce(a.layer, b.layer) AS layer, coalesce(a.kind, b.kind) AS kind, a.name AS past, b.name AS present FROM (SELECT * FROM n WHERE starts_with(name, 'past')) a FULL JOIN (SELECT * FROM n WHERE starts_with(name, 'present')) b ON a.layer = b.layer AND a.kind = b.kind""",
    "graph_edges": f"""WITH n AS (SELECT * FROM {S.values(NODES, 'node, ins, outs')}), m AS (SELECT node AS producer, unnest(outs) AS tensor FROM n), u AS (SELECT node AS consumer, unnest(ins) AS tensor FROM n)
SELECT tensor, producer, consumer FROM m FULL JOIN u USING (tensor)""",
    "model_set_complete": f"""WITH r AS (SELECT * FROM {S.values(REQUIRED, 'variant, file')} WHERE file <> 'config.json'), p AS (SELECT * FROM {S.values(PRESENT, 'folder, file')})
SELECT folder, variant, count(p2.file) = count(*) AS complete FROM (SELECT DISTINCT folder FROM p) f CROSS JOIN r LEFT JOIN p p2 USING (folder, file) GROUP BY ALL""",
}
ORACLES["image_candidates"] = f"""WITH {_candidates("(SELECT * FROM " + _HTML + " UNION ALL SELECT -page_id - 1, url, html FROM pages)")}
SELECT page_id, idx::BIGINT AS idx, src, area, CASE WHEN starts_with(src, '//') THEN regexp_extract(url, '^[a-z]+:') || src WHEN starts_with(src, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || src
    WHEN starts_with(src, '../') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/' || substr(src, 4) ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)[^/?#]*', 1) || src END AS target FROM cands"""
#: Expected by hand from the files' texts above.
_PARAMETERS = [("det", 0.2, 0.45, 1.5, 3000, ""), ("rec", 0.3, 0.6, 1.5, 1000, "! ' # $ \\ ~ \u3000 a "), ("none", 0.3, 0.6, 1.5, 1000, "")]
ORACLES["yaml_params"] = f"SELECT name, thresh, box_thresh, unclip_ratio, max_candidates::INT AS max_candidates, characters FROM {S.values(_PARAMETERS, 'name, thresh, box_thresh, unclip_ratio, max_candidates, characters')}"
ORACLES["yaml_scalars"] = f"SELECT * FROM {S.values([(0, chr(39)), (1, chr(97) + chr(39) + chr(98)), (2, 'plain'), (3, 'qA'), (4, 'a' + chr(10) + 'b'), (5, chr(0x3000)), (6, chr(39)), (7, 'x')], 'id, scalar')}"
