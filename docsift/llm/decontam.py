"""Operator 4: benchmark decontamination by an FM-index per training shard.

Test phrases are the 10-word windows of the benchmark items (an item of fewer words is one window). A shard is about
``SHARD_BYTES`` of consecutive whole documents of a partition, gathered over Arrow batches. Its text is indexed as word
numbers: backward search runs all phrases at once through wavelet-matrix ranks, sampled suffix positions locate the
occurrences, and these merge into removal spans. A word that no phrase has cannot lie in an occurrence, so only runs of
phrase words that are as long as the shortest phrase are indexed; and a phrase with a word that the shard lacks cannot
occur in it, so only the others are searched. Neither drops an occurrence. Words are known by 64-bit hashes.

The benchmark is broadcast in chunks of at most ``CHUNK_WORDS`` words. Every shard is searched for each of them; a worker
keeps ``RESIDENT`` of them in memory and reads others anew from its disk. Nothing is shuffled.

Defined cases: a null text (of either side) has no words; an item without words has no window; a null item_id is named
by the empty string; equal item_ids are one item; a null doc_id stays null; repeated documents are judged alike; an empty
benchmark hits nothing; empty documents give an empty result; a text longer than a shard is one by itself, and its
indexed runs are searched a million words at a time. Extra columns, whatever their names, pass through ``remove_spans``;
``contamination`` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import small_batches, table
from docsift.llm.fmindex import FMIndex
from docsift.llm.kernel import U64, classes, hash_segments, mix64, release_memory, slices, words_of

WINDOW = 10
CHUNK_WORDS, SHARD_BYTES, SHARD_WORDS, OCCURRENCES = 2_000_000, 8 << 20, 1_000_000, 1_000_000
#: Chunks of the benchmark that a worker keeps.
RESIDENT = 4


@dataclass
class Phrases:
    """Distinct windows of a chunk of items, as places in one array of word numbers."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place plus 1
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item_from: np.ndarray  # items of window w: item_of[item_from[w] : item_from[w + 1]]
    item_of: np.ndarray
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.length.min(initial=WINDOW))


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """items: (item_id, text)."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    hashes, sizes, alnum = [], [], classes("alnum")
    for part in slices(pa.array([t for _, t in items], pa.large_string())):
        found = words_of(part, alnum)
        hashes.append(hash_segments(part.data, found.starts, found.ends, lower=True))
        sizes.append(found.counts)
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    vocabulary, words = np.unique(all_hashes, return_inverse=True)
    words = words.astype(np.int64) + 1
    n = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    size = np.minimum(n, window)
    windows_ = np.where(n > 0, n - size + 1, 0)
    first = np.repeat(np.cumsum(n) - n, windows_) + np.arange(int(windows_.sum())) - np.repeat(np.cumsum(windows_) - windows_, windows_)
    length, owner = np.repeat(size, windows_), np.repeat(np.array([number[i] for i, _ in items], np.int64), windows_)
    chosen, phrase = _distinct(words, first, length, window)
    pairs = np.unique(phrase * max(1, len(names)) + owner)
    item_from = np.searchsorted(pairs, np.arange(len(chosen) + 1) * max(1, len(names)))
    return Phrases(vocabulary, words, first[chosen], length[chosen], item_from.astype(np.int64), pairs % max(1, len(names)), names)


def _distinct(words: np.ndarray, first: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of one window of each kind, and the kind of every window. Kinds are told by two 64-bit hashes."""
    one, two = length.astype(U64), ~length.astype(U64)
    padded = np.concatenate((words, np.zeros(window, np.int64))).astype(U64)
    for i in range(window):
        word = np.where(i < length, padded[first + i], U64(0))
        one, two = mix64(one ^ word), mix64(two + word * U64(0x9E3779B97F4A7C15))
    order = np.lexsort((first, two, one))
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def chunked_phrases(benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> list[Broadcast]:
    """The whole benchmark as broadcasts of bounded size, read row by row."""
    sc, out, items, held = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    for row in rows.toLocalIterator():
        items.append((row.i, row.text))
        held += len(row.text) // 2 + 1  # a word and its end take two characters or more
        if held >= chunk_words:
            out.append(sc.broadcast(phrases(items)))
            items, held = [], 0
    if items or not out:
        out.append(sc.broadcast(phrases(items)))
    return out


@dataclass
class Hits:
    n_words: np.ndarray
    n_hit: np.ndarray
    spans: dict[int, list[tuple[int, int]]]  # row: first and end word of each removal span
    items: dict[int, set[str]]


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Word numbers, 0 for words outside the vocabulary. A bitmap of low bits spares most words the search."""
    out = np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(maybe[(hashes & U64(len(maybe) - 1)).astype(np.int64)])
    place = np.searchsorted(vocabulary, hashes[at])
    good = vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes[at]
    out[at[good]] = place[good] + 1
    return out


def _bitmap(vocabulary: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << max(16, int(len(vocabulary)).bit_length() + 4), bool)
    maybe[(vocabulary & U64(len(maybe) - 1)).astype(np.int64)] = True
    return maybe


def find(column: pa.Array, given: Phrases) -> Hits:
    """Occurrences of the phrases in the texts of one shard."""
    n, alnum, shortest = len(column), classes("alnum"), given.shortest
    maybe = _bitmap(given.vocabulary)
    hits = Hits(np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {})
    texts: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    firsts: list[np.ndarray] = []
    held = 0
    for part in slices(column):
        words = words_of(part, alnum)
        hits.n_words[part.lo : part.hi] = words.counts
        if not len(words.starts) or not len(given.start):
            continue
        numbers = _numbers(hash_segments(part.data, words.starts, words.ends, lower=True), given.vocabulary, maybe)
        known = np.concatenate(([False], numbers > 0, [False]))
        edge = np.zeros(len(known), bool)  # runs end where rows do
        edge[words.offsets[:-1] + 1] = True
        begin = np.flatnonzero(known[1:] & (~known[:-1] | edge[1:]))
        end = np.flatnonzero(known[:-1] & (~known[1:] | edge[1:]))
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            continue
        length = end - begin + 1
        base = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(base, length) + np.repeat(begin, length)
        text = np.where(np.arange(len(inside)) == np.repeat(base + length - 1, length), 0, np.concatenate((numbers, [0]))[inside])
        row = np.searchsorted(words.offsets, begin, side="right") - 1
        texts.append(text)
        rows.append(np.stack((row + part.lo, length), axis=1))
        firsts.append(begin - words.offsets[row])
        held += len(text)
        if held >= SHARD_WORDS:
            _search(texts, rows, firsts, given, hits)
            texts, rows, firsts, held = [], [], [], 0
    if held:
        _search(texts, rows, firsts, given, hits)
    return hits


def _search(texts, rows, firsts, given: Phrases, hits: Hits) -> None:
    text, (row, length), first = np.concatenate(texts), np.concatenate(rows).T, np.concatenate(firsts)
    starts = np.cumsum(length) - length
    here = np.zeros(len(given.vocabulary) + 1, bool)
    here[text] = True
    known = np.concatenate(([0], np.cumsum(here[given.words])))
    able = np.flatnonzero(known[given.start + given.length] - known[given.start] == given.length)  # all words are here
    if not len(able):
        return
    index = FMIndex(text, starts, len(given.vocabulary))
    low, high = np.zeros((2, len(given.start)), np.int64)
    low[able], high[able] = index.search(given.words, given.start[able], given.length[able])
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    step, pairs = np.zeros(len(text) + 1, np.int64), []
    uses = (high - low)[found]
    block = np.cumsum(uses) // OCCURRENCES  # bounded blocks of occurrences
    for b in np.unique(block):
        own = found[block == b]
        n = (high - low)[own]
        phrase = np.repeat(own, n)
        at = index.locate(np.repeat(low[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        np.add.at(step, at, 1)
        np.add.at(step, at + given.length[phrase], -1)
        pairs.append(np.unique(row[np.searchsorted(starts, at, side="right") - 1] * len(given.start) + phrase))
    covered = np.cumsum(step)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        run = int(np.searchsorted(starts, a, side="right")) - 1
        word = int(first[run]) + a - int(starts[run])
        hits.spans.setdefault(int(row[run]), []).append((word, word + b - a))
        hits.n_hit[row[run]] += b - a
    for pair in np.unique(np.concatenate(pairs)).tolist():
        doc, phrase = divmod(pair, len(given.start))
        hits.items.setdefault(doc, set()).update(given.names[i] for i in given.item_of[given.item_from[phrase] : given.item_from[phrase + 1]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_all(column: pa.Array, chunks: Iterable[Phrases]) -> Hits:
    """Hits of all chunks of the benchmark."""
    out = None
    for given in chunks:
        more = find(column, given)
        if out is None:
            out = more
            continue
        for row, spans in more.spans.items():
            out.spans[row] = merged(out.spans.get(row, []) + spans)
            out.n_hit[row] = sum(b - a for a, b in out.spans[row])
        for row, items in more.items.items():
            out.items.setdefault(row, set()).update(items)
    return out


def _values(chunks: list[Broadcast]) -> Iterator[Phrases]:
    """The chunks' values in turn; no more than RESIDENT of them stay in memory."""
    for k, chunk in enumerate(chunks):
        yield chunk.value
        if k >= RESIDENT:
            chunk.__dict__.pop("_value", None)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows, some SHARD_BYTES together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        start, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, before + SHARD_BYTES - size)) + 1)
            held.append(batch.slice(start, end - start))
            size, start = size + int(ends[end - 1]) - before, end
            if size >= SHARD_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _large(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string())


def contamination(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words)."""
    chunks = chunked_phrases(benchmark, chunk_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches):
            hits = find_all(_large(batch.column("text")), _values(chunks))
            items = [sorted(hits.items.get(i, ())) for i in range(batch.num_rows)]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            spans = pa.array([[{"first": a, "end": b} for a, b in hits.spans.get(i, ())] for i in range(batch.num_rows)], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits.n_words), pa.array(hits.n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(hits.n_hit > 0), spans], names)
        release_memory()

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,end:long>>")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from each span's first to its last word."""
    raw = text.encode()
    part = next(slices(pa.array([text], pa.large_string()), max_bytes=len(raw) + 1))
    words = words_of(part, classes("alnum"))
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : words.starts[a]])
        at = words.ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The documents with all occurrences cut out of their texts; documents left without a word by that go.

    Where a cut brings words together that make up a phrase, that goes, too: texts are searched again until none is left.
    All columns pass through.
    """
    chunks = chunked_phrases(benchmark, chunk_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches):
            hits = find_all(_large(batch.column("text")), _values(chunks))
            if not hits.spans:
                yield batch
                continue
            texts, gone, todo = batch.column("text").to_pylist(), set(), dict(hits.spans)
            while todo:
                rows = sorted(todo)
                for row in rows:
                    texts[row] = cut_words(texts[row], todo[row])
                again = find_all(pa.array([texts[r] for r in rows], pa.large_string()), _values(chunks))
                gone |= {rows[k] for k in range(len(rows)) if not again.n_words[k]}
                todo = {rows[k]: spans for k, spans in again.spans.items()}
            keep = pa.array([i not in gone for i in range(batch.num_rows)])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(keep)
        release_memory()

    return small_batches(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM bw),
dw0 AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key FROM dw0),
hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN win ON dw.size = win.size AND dw.key = win.key),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
