"""Operator 7: n-gram Jaccard join through prefix trees.

Every whole text becomes its set of 5-word shingles (64-bit hashes of whole words, shipped in full); equal sets are one
class, named by a 96-bit hash of the set. Two given sets of n shingles share a hash by chance with probability n * n /
2**64, which is below one in ten thousand million for sets of 40,000.

1. Shingles are dealt by hash as packed blobs and counted: how many classes have each. Those that a single class has
   cannot be shared, so only the others go back to their classes, with their counts.
2. In the global order, rarest first, a set of n shingles that is similar to any other has a common one among its first
   n - ceil(0.75 n) + 1. Sets whose beginnings are theirs alone are done.
3. The rest, a small share, are gathered into candidate components by the tokens of their beginnings. Each is joined by
   a prefix tree (``triejoin``) in one task. Components beyond ``BLOCK_TOKENS`` are split by size into classes of a
   factor 4/3, so that only neighbouring classes can hold similar sets, and a class beyond that bound into blocks; each
   pair of blocks of the same or neighbouring classes is a task.
4. The links found give components; each document gets the least doc_id of its own.

No pair list of a group is ever made: a component of m classes gives at most m - 1 links a task. Exact copies collapse
before anything is compared. Nothing is sampled or capped.

Defined cases: null and empty texts have an empty set and link with nothing: component_id is their own doc_id; fewer than
five words are one shingle of their own kind; repeated rows share their component, and so do different texts of one
doc_id that are similar; different texts of one doc_id that are not keep components of their own, named alike; a null
doc_id takes the component of its class and is null if alone; empty input gives an empty result. Long texts are read
in slices; memory follows the longest text. Of extra columns ``near_duplicates`` reads none, and ``keep_one`` passes
all through, whatever their names (its own begin with two underscores).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import broadcast_if_small, cut, cut_narrow, join_per_key, shuffle_parts, small_batches, table
from docsift.llm.graph import components
from docsift.llm.kernel import U64, classes, hash_segments, mix64, release_memory, slices, windows, words_of
from docsift.llm.triejoin import links_within

WIDTH, PERCENT = 5, 75
#: Shingles of a component that one task holds; larger components are split into blocks.
BLOCK_TOKENS = 4_000_000
FLUSH_TOKENS = 500_000
#: Tokens of a bucket, about, and of a part of it that is sorted at a time; rows that a partition sends to a bucket hold
#: LEAST_SENT tokens or more on average, and FLUSH_TOKENS grows up to MOST_HELD for that.
BUCKET_TOKENS, SORT_TOKENS, LEAST_SENT, MOST_HELD = 2_000_000, 500_000, 16, 8_000_000
#: One class in a blob: its name in two parts, the size of its whole set, and how many tokens of the blob are its own.
_RUN = np.dtype([("hi", "<u8"), ("lo", "<u4"), ("n", "<u4"), ("count", "<u2")])
_NAME = np.dtype([("hi", ">u8"), ("lo", ">u4")])
MOST = 65_535  # of a run's tokens, and of a token's uses as far as they are told apart
#: Base of the classes of sizes: similar sets are of the same or of neighbouring ones. A little more than the greatest
#: ratio of their sizes, so that rounding cannot put two of exactly that ratio further apart.
SIZE_STEP = 100 / PERCENT * 1.001


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    blank = classes("blank")
    for part in slices(column):
        words = words_of(part, blank)
        hashes = hash_segments(part.data, words.starts, words.ends, lower=True)
        keys, at = windows(hashes, words.offsets, WIDTH)
        bounds = np.searchsorted(at, words.offsets)
        for r, n in enumerate(words.counts.tolist()):
            if n >= WIDTH:
                own = np.sort(keys[bounds[r] : bounds[r + 1]])
                yield part.lo + r, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:
                few = hashes[words.offsets[r] : words.offsets[r + 1]] * np.array([3, 5, 7, 11], U64)[:n]
                yield part.lo + r, mix64(np.array([few.sum(dtype=U64) + U64(n)], U64) ^ U64(0x5851F42D4C957F2D))
            else:
                yield part.lo + r, np.zeros(0, U64)


def set_name(tokens: np.ndarray) -> bytes:
    """Name of a class: 96 bits of a hash of its set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())[: _NAME.itemsize]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(0, None)] * batch.num_rows
        for row, tokens in shingle_sets(batch.column("text")):
            if len(tokens):
                found[row] = (len(tokens), set_name(tokens))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["doc_id", "n_shingles", "sig"])


def named_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig); sig is null for an empty set."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_names, "doc_id long, n_shingles long, sig binary")


def _ranges(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, np.int64)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs, given which tokens begin one; none is longer than MOST."""
    at = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at
    start = np.flatnonzero((at - start) % MOST == 0)
    return start, np.append(start[1:], len(new))


def _blob(runs: np.ndarray, *columns: np.ndarray) -> bytes:
    return b"".join((len(runs).to_bytes(8, "little"), runs.tobytes(), *(c.tobytes() for c in columns)))


def _unblob(blob, *types: str) -> list[np.ndarray]:
    """Runs and the columns of their tokens, without a copy."""
    raw = blob.as_buffer()
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    out, at = [np.frombuffer(raw, _RUN, n, 8)], 8 + n * _RUN.itemsize
    tokens = int(out[0]["count"].sum())
    for kind in types:
        out.append(np.frombuffer(raw, kind, tokens, at))
        at += tokens * np.dtype(kind).itemsize
    return out


def _blobs(parts: int):
    """Tokens of the partition's distinct sets, dealt to buckets by their upper bits."""

    flush_tokens = min(MOST_HELD, max(FLUSH_TOKENS, LEAST_SENT * parts))

    def flush(docs: dict[bytes, int], held: list[np.ndarray]) -> pa.RecordBatch:
        names, lengths = np.frombuffer(b"".join(docs), _NAME), np.array([len(h) for h in held])
        tokens = np.concatenate(held)
        bucket = ((tokens >> U64(32)) * U64(parts) >> U64(32)).astype(np.uint16 if parts <= 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        tokens, bucket, doc = tokens[order], bucket[order], np.repeat(np.arange(len(held)), lengths)[order]
        start, end = _runs(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]))))
        own, runs = doc[start], np.zeros(len(start), _RUN)
        runs["hi"], runs["lo"], runs["n"], runs["count"] = names["hi"][own], names["lo"][own], lengths[own], end - start
        spans = _ranges(bucket[start])
        blobs = [_blob(runs[a:b], tokens[start[a] : end[b - 1]]) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[start[a]]) for a, _ in spans], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs: dict[bytes, int] = {}
        tokens = 0
        for batch in batches:
            for _, own in shingle_sets(batch.column("text")):
                if len(own) and (name := set_name(own)) not in docs:
                    docs[name] = len(docs)
                    held.append(own)
                    tokens += len(own)
                    if tokens >= flush_tokens:
                        yield flush(docs, held)
                        held, docs, tokens = [], {}, 0
        if held:
            yield flush(docs, held)
        release_memory()

    return run


def _shared(parts: int):
    """Of one bucket: the tokens that two classes or more have, back to their classes. A bounded part of them at a time."""

    def run(_key: tuple, frame: pa.Table) -> pa.Table:
        given = [_unblob(blob, "<u8") for blob in frame.column("blob")]
        runs = np.concatenate([r for r, _ in given])
        base = np.cumsum([0, *(len(r) for r, _ in given)])
        slices_ = 1 << max(0, int(sum(len(t) for _, t in given) // SORT_TOKENS).bit_length())
        out = pa.concat_tables([_replies(*_slice(given, base, k, slices_), runs, parts) for k in range(slices_)])
        del given, runs
        release_memory()
        return out

    return run


def _slice(given: list, base: np.ndarray, k: int, slices_: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of which some of the lower bits are k, and the places of their classes."""
    tokens, docs = [], []
    for (runs, own), first in zip(given, base, strict=False):
        at = np.flatnonzero(own & U64(slices_ - 1) == U64(k))
        tokens.append(own[at])
        docs.append(np.searchsorted(np.cumsum(runs["count"], dtype=np.int64), at, side="right") + first)
    return np.concatenate(tokens), np.concatenate(docs)


def _replies(tok: np.ndarray, doc: np.ndarray, runs: np.ndarray, parts: int) -> pa.Table:
    order = np.argsort(tok)
    tok = tok[order]
    same = tok[1:] == tok[:-1]
    more = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(tok) else np.zeros(0, bool)
    tok, doc = tok[more], doc[order[more]]
    hi, lo = runs["hi"][doc], runs["lo"][doc]
    order = np.lexsort((lo, hi, tok))
    tok, doc, hi, lo = tok[order], doc[order], hi[order], lo[order]
    first = np.ones(len(tok), bool)
    first[1:] = (tok[1:] != tok[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    tok, doc, hi, lo = tok[first], doc[first], hi[first], lo[first]
    uses = np.array([b - a for a, b in _ranges(tok)], np.int64)
    df = np.repeat(uses, uses)
    keep = df > 1
    tok, doc, hi, lo, df = tok[keep], doc[keep], hi[keep], lo[keep], np.minimum(df[keep], MOST).astype("<u2")
    to = (hi % U64(parts)).astype(np.int32)
    order = np.lexsort((lo, hi, to))
    tok, doc, hi, lo, df, to = tok[order], doc[order], hi[order], lo[order], df[order], to[order]
    new = np.ones(len(tok), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    start, end = _runs(new)
    reply = np.zeros(len(start), _RUN)
    reply["hi"], reply["lo"], reply["n"], reply["count"] = hi[start], lo[start], runs["n"][doc[start]], end - start
    spans = _ranges(to[start])
    blobs = [_blob(reply[a:b], df[start[a] : end[b - 1]], tok[start[a] : end[b - 1]]) for a, b in spans]
    return pa.table({"bucket": pa.array([int(to[start[a]]) for a, _ in spans], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def beginning(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of the rarest tokens of a set of n must hold one of any similar set."""
    n = n.astype(np.int64)
    return n - (-(-percent * n // 100)) + 1


def _survivors(_key: tuple, frame: pa.Table) -> pa.Table:
    """Classes that share a token of their beginning: sig, n, k, tokens (rarest first) and their counts."""
    given = [_unblob(x, "<u2", "<u8") for x in frame.column("blob")]
    runs, df, tid = (np.concatenate([g[i] for g in given]) for i in range(3))
    hi, lo, n = (np.repeat(runs[c], runs["count"]) for c in ("hi", "lo", "n"))
    order = np.lexsort((tid, df, lo, hi))
    hi, lo, n, df, tid = hi[order], lo[order], n[order], df[order], tid[order]
    start = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    end = np.append(start[1:], len(tid))
    whole = n[start].astype(np.int64)
    k = beginning(whole) - (whole - (end - start))
    live = np.flatnonzero(k > 0)
    names = np.zeros(len(live), _NAME)
    names["hi"], names["lo"] = hi[start[live]], lo[start[live]]
    out = pa.table({
        "sig": pa.array([x.tobytes() for x in names], pa.binary()), "n": pa.array(whole[live], pa.int64()), "k": pa.array(k[live], pa.int64()),
        "tids": pa.array([tid[start[i] : end[i]].tobytes() for i in live], pa.binary()), "dfs": pa.array([df[start[i] : end[i]].tobytes() for i in live], pa.binary()),
    })
    del given, runs, hi, lo, n, df, tid
    release_memory()
    return out


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.column("k").to_numpy()
        tids = [np.frombuffer(x.as_buffer(), np.int64)[: k[i]] for i, x in enumerate(batch.column("tids"))]
        if tids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tids)), batch.column("sig").take(pa.array(np.repeat(np.arange(len(tids)), [len(t) for t in tids])))], ["tid", "sig"])


def stars(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Links as (member, least of its component), members that are the least included."""
    parent: dict[bytes, bytes] = {}

    def find(i: bytes) -> bytes:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [(i, find(i)) for i in list(parent)]


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component and pair of blocks; each such run is joined by one prefix tree."""
    key, sets, block = None, [], []

    def done() -> pa.RecordBatch:
        side = [int(b == key[2]) for b in block] if key[1] != key[2] else None
        links = stars(links_within(sets, side))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "sig", "n", "tids", "dfs")]
        for root, i, j, own, sig, n, tids, dfs in zip(*columns, strict=True):
            if key != (root, i, j):
                if key:
                    yield done()
                key, sets, block = (root, i, j), [], []
            sets.append((sig, n, np.frombuffer(tids, np.uint64), np.frombuffer(dfs, np.uint16)))
            block.append(own)
    if key:
        yield done()


def _block_tasks(placed: DataFrame, large: DataFrame, block_tokens: int) -> DataFrame:
    """The sets of large components (root), each with all pairs of blocks that its own block is compared in.

    A block is a hashed part of a class of sizes. Blocks are named by class and part, so that a pair is (i, j), i <= j.
    """
    sized = placed.join(broadcast_if_small(large), "root", "left_semi").withColumn("size", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("long"))
    classes_ = sized.groupBy("root", "size").agg(F.ceil(F.sum("tokens") / F.lit(block_tokens)).cast("long").alias("parts"))
    other = classes_.select(F.col("root").alias("r"), F.col("size").alias("z"), F.col("parts").alias("p"))
    near = cut(classes_.join(other, (F.col("root") == F.col("r")) & (F.abs(F.col("size") - F.col("z")) <= 1)).select("r", F.col("size").alias("s"), "z", "parts", "p"))
    dealt = sized.join(broadcast_if_small(near), (F.col("root") == F.col("r")) & (F.col("size") == F.col("s")))
    block = F.col("size") * F.lit(1 << 32) + F.pmod(F.xxhash64("sig"), F.col("parts"))
    dealt = dealt.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    dealt = dealt.withColumn("other", F.col("part") + F.col("z") * F.lit(1 << 32))
    return dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "n", "tids", "dfs")


def similar_components(docs: DataFrame, tokens: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(node, root): the classes that are similar to another one, with the least class of their component.

    tokens: how many shingles the documents have, about; they are dealt to as many buckets as that needs.
    """
    spark = docs.sparkSession
    parts, buckets = shuffle_parts(spark), max(8, -(-tokens // BUCKET_TOKENS))
    blobs = small_batches(docs).select("text").mapInArrow(_blobs(buckets), "bucket int, blob binary")
    reply = blobs.groupBy("bucket").applyInArrow(_shared(buckets), "bucket int, blob binary")
    live = cut(reply.groupBy("bucket").applyInArrow(_survivors, "sig binary, n long, k long, tids binary, dfs binary"))
    starts = cut(live.select("sig", "k", "tids").mapInArrow(_prefixes, "tid long, sig binary"))
    least = starts.groupBy("tid").agg(F.min("sig").alias("b"), F.count("*").alias("uses")).where("uses > 1")
    near = join_per_key(starts, least, "tid", starts.count(), F.xxhash64("sig")).where("sig <> b").select(F.col("sig").alias("a"), "b").distinct()
    groups = components(near)
    placed = live.join(groups, F.col("sig") == F.col("node")).select("root", "sig", "n", "tids", "dfs", (F.octet_length("tids") / 8).cast("long").alias("tokens"))
    large = cut_narrow(placed.groupBy("root").agg(F.sum("tokens").alias("all")).where(F.col("all") > block_tokens).select("root"), tokens // block_tokens)
    split = not large.isEmpty()
    one = F.lit(0).cast("long")
    whole = placed.join(broadcast_if_small(large), "root", "left_anti") if split else placed
    tasks = whole.select("root", one.alias("i"), one.alias("j"), one.alias("block"), "sig", "n", "tids", "dfs")
    if split:
        tasks = tasks.unionByName(_block_tasks(placed, large, block_tokens))
    tasks = tasks.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = cut_narrow(tasks.mapInArrow(_join_blocks, "a binary, b binary"), groups.count())
    if not split:  # every candidate component was joined by one task, whose stars are final
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return components(links)


def _found(docs: DataFrame, total: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document, of which there are total: doc_id, n_shingles, component_id, sig, and root, the least class of the component."""
    named = cut_narrow(named_sets(docs), total)
    classes_ = named.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("uses"))
    roots = similar_components(docs, named.agg(F.sum("n_shingles")).first()[0] or 0, block_tokens)  # of a cut
    reach = cut_narrow(classes_.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", "uses", F.coalesce("root", "sig").alias("root")), total)
    found = reach.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = reach.join(found, "root").select("sig", "root", "component_id", "uses")
    joined = join_per_key(named, ids, "sig", total, F.xxhash64("doc_id"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sig", "root")


def near_duplicates(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, sig (its class; null for an empty set)."""
    return _found(docs, docs.count(), block_tokens).drop("root")


def _with_names(docs: DataFrame) -> DataFrame:
    """docs with the class of each row as __sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [None] * batch.num_rows
            for row, tokens in shingle_sets(batch.column("text")):
                if len(tokens):
                    sig[row] = set_name(tokens)
            yield batch.append_column("__sig", pa.array(sig, pa.binary()))

    return small_batches(docs).mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("__sig", T.BinaryType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the least doc_id, and of the least class among rows of that id.

    A row is known by its doc_id and its class, never by its id alone. Documents without words are in no component and
    all stay. Where ids are whole and unique, which a count shows, the ids to drop are all that is joined to the texts;
    only rows whose doc_id is null or repeated are looked at again. The list is broadcast if a count shows it is small.
    """
    total = docs.count()
    found = cut_narrow(_found(docs, total).where("sig IS NOT NULL").select("doc_id", "sig", "root"), total)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("best"), F.count("*").alias("uses"))
    placed = join_per_key(found, best, "root", found.count(), F.xxhash64("doc_id", "sig"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sig") == F.col("best.sig"))
    placed = cut_narrow(placed.select("doc_id", "sig", stays.alias("stays")), total)
    twice = cut_narrow(placed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__twice"), F.lit(True).alias("__again")), total)
    single = placed.where("doc_id IS NOT NULL AND NOT stays")
    if twice.isEmpty():
        drop = broadcast_if_small(cut(single.select(F.col("doc_id").alias("__drop"))))
        return docs.join(drop, F.col("doc_id").cast("long") == F.col("__drop"), "left_anti")
    again = broadcast_if_small(twice)
    drop = broadcast_if_small(cut(single.join(again, F.col("doc_id") == F.col("__twice"), "left_anti").select(F.col("doc_id").alias("__drop"))))
    once = docs.join(again, F.col("doc_id").cast("long").eqNullSafe(F.col("__twice")), "left_anti").join(drop, F.col("doc_id").cast("long") == F.col("__drop"), "left_anti")
    repeated = _with_names(docs.join(again, F.col("doc_id").cast("long").eqNullSafe(F.col("__twice")), "left_semi"))
    empty = repeated.where("__sig IS NULL").drop("__sig")
    chosen = cut(placed.where("stays").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__class")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__sig") == F.col("__class"))
    full = repeated.where("__sig IS NOT NULL").join(broadcast_if_small(chosen), same, "left_semi").dropDuplicates(["doc_id", "__sig"]).drop("__sig")
    return once.unionByName(empty).unionByName(full)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("sig")


#: DuckDB: all pairs of different sets that share a shingle, and all that can be reached by their links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN ['= ' || array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
k AS (SELECT doc_id, len(sh)::BIGINT AS n, sh, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS name FROM s),
c AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM k WHERE name IS NOT NULL GROUP BY name),
t AS (SELECT rep, n, unnest(sh) AS x FROM c),
shared AS (SELECT rep, n, x FROM t WHERE x IN (SELECT x FROM t GROUP BY x HAVING count(*) > 1)),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS both_have FROM shared a JOIN shared b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * both_have >= 75 * (na + nb - both_have) UNION SELECT b, a FROM p WHERE 100 * both_have >= 75 * (na + nb - both_have)),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, k.n AS n_shingles, coalesce(component, doc_id) AS component_id FROM k LEFT JOIN c USING (name) LEFT JOIN m ON m.a = c.rep
"""
