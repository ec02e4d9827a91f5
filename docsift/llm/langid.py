"""Operator 2: language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased text, spaces at their ends only. Each is hashed to a row of an
embedding table; the mean row of a text goes through a linear softmax. Table and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts (``SAMPLE_PER_LANG``, whole texts). As mean
and softmax input are linear, a text is scored by the mean of table @ weights, a table with one number per language.

Rejection is calibrated on texts that are not trained on, and on their beginnings as short texts: a temperature makes
scores probabilities, and for each class of lengths the threshold is the greatest that rejects no more than
``MAX_GOOD_REJECTED`` of the rightly predicted texts; where these are too few to hold that quantile, it is carried on from
the lowest tenth. A text without a letter is ``und`` and rejected.

Defined cases: null, empty and letterless texts are ``und`` with score 0; very long texts are scored whole, a slice of
rows or one long text at a time; with no labelled text all are ``und``; a null
doc_id counts as held out; ties go to the language that sorts first; repeated rows get equal results; empty input gives
an empty result. Extra columns, whatever their names, pass through ``keep_identified``; ``identify`` reads doc_id and
text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import small_batches, table
from docsift.llm.kernel import release_memory, slices

#: Bound of the sample that the model is fitted on.
SAMPLE_PER_LANG = 500
#: Bound of the further texts a language that rejection is calibrated on, each with its beginnings of 4 to 79 words.
HELD_PER_LANG = 1000
#: Bound of the languages that are learned: those with most labelled texts, ties by name. Labels beyond it are not learned.
MOST_LANGS = 256
BUCKET_BITS, DIMENSIONS, EPOCHS, RATE = 15, 16, 6, 0.5
MAX_GOOD_REJECTED, CALIBRATION_SHARE = 0.001, 0.25
#: Classes of lengths, by subwords; a class with fewer right texts than LEAST_HELD takes those of shorter ones in.
LENGTHS, LEAST_HELD = np.array([64, 128, 256, 512, 1024]), 1000
_FACTOR = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def _padded(column: pa.Array) -> pa.Array:
    """Lower-cased texts between two spaces."""
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket at every byte, and which bytes start a subword."""
    clean = _CLEAN[data]
    space = clean == 0x20
    wide = np.concatenate((clean, np.full(3, 0x20, np.uint8))).astype(np.uint32)
    n = len(clean)
    value = wide[:n].copy()
    good = np.ones(n, bool)
    good[ends - 1] = False
    blank_inside = np.zeros(n, bool)
    for size in (2, 3, 4):
        value |= wide[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1))
        if size == 2:
            ok = good & ~(space & np.concatenate((space[1:], [True])))
        else:
            last = ends - (size - 1)
            good[last[last >= starts]] = False
            blank_inside |= np.concatenate((space[size - 2 :], np.ones(size - 2, bool)))
            ok = good & ~blank_inside
        yield (value * _FACTOR[size]) >> np.uint32(32 - BUCKET_BITS), ok


def bucket_counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their numbers of subwords, two bytes each: numbers beyond that are scaled down together."""
    out = []
    for part in slices(_padded(column)):
        found = list(subwords(part.data, part.starts, part.ends))
        for a, b in zip(part.starts, part.ends, strict=True):
            counts = sum(np.bincount(bucket[a:b][ok[a:b]], minlength=1 << BUCKET_BITS) for bucket, ok in found)
            used = np.flatnonzero(counts)
            scale = max(1.0, counts.max(initial=0) / 65_535)
            out.append((used.astype(np.uint16), np.ceil(counts[used] / scale).astype(np.uint16)))
    return out


def shares_of(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of its subwords."""
    return at, (counts / max(1, int(counts.sum()))).astype(np.float32)


def bucket_shares(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [shares_of(at, n) for at, n in bucket_counts(column)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (buckets + 1, langs): embeddings @ softmax weights; the last row is empty
    bias: np.ndarray
    temperature: float = 1.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LENGTHS) + 1))  # by class of lengths

    def logits(self, shares: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.weights[i].T @ w for i, w in shares]).reshape(-1, len(self.langs)) + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        n = len(column)
        best, score, lettered, least = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n)
        for part in slices(_padded(column)):
            rows = slice(part.lo, part.hi)
            ascii_letter = (part.data >= 0x61) & (part.data <= 0x7A)
            lettered[rows] = np.logical_or.reduceat(ascii_letter, part.starts)
            if not self.langs:
                continue
            sums, counts = np.zeros((part.rows, len(self.langs))), np.zeros(part.rows)
            for bucket, ok in subwords(part.data, part.starts, part.ends):
                bucket = np.where(ok, bucket, np.uint32(1 << BUCKET_BITS))
                for k in range(len(self.langs)):
                    sums[:, k] += np.add.reduceat(self.weights[:, k][bucket], part.starts, dtype=np.float64)
                counts += np.add.reduceat(ok, part.starts, dtype=np.int64)
            p = _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
            best[rows], score[rows], least[rows] = p.argmax(axis=1), p.max(axis=1), self.thresholds[np.searchsorted(LENGTHS, counts, "right")]
        for i in np.flatnonzero(~lettered):  # few: texts without a-z
            lettered[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
        if not self.langs:
            lettered[:] = False
        score = np.where(lettered, np.clip(score, 0, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score, ~lettered | (score < least)


def train(langs: list[str], shares: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5, more: tuple[list, np.ndarray] = ([], np.zeros(0, np.int64))) -> LanguageModel:
    """target: place of each text's language in langs. more: shares and target of further texts to calibrate on."""
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(shares))
    held = order[: int(len(order) * CALIBRATION_SHARE)]
    used = order[len(held) :] if len(order) > len(held) else order
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            pace = rate * (1 - done / steps)
            done += 1
            at, share = shares[i]
            if not len(at):
                continue
            mean = share @ table_[at]
            slope = _softmax(mean @ weights + bias)
            slope[target[i]] -= 1
            back = weights @ slope
            weights -= pace * np.outer(mean, slope)
            bias -= pace * 0.1 * slope
            # shares are small: rows move as if the shares summed to the number of rows a text touches
            table_[at] -= pace * np.outer(share * min(len(at), 200), back)
    full = np.concatenate((table_ @ weights, np.zeros((1, len(langs)), np.float32)))
    model = LanguageModel(langs, np.ascontiguousarray(full), bias)
    calibrate(model, [shares[i] for i in held] + more[0], np.concatenate((target[held], more[1])))
    return model


def calibrate(model: LanguageModel, shares: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> None:
    if not shares:
        return
    logits = model.logits(shares)

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
    p = _softmax(logits / model.temperature)
    right = p.argmax(axis=1) == target
    size = np.searchsorted(LENGTHS, np.array([round(1 / w.min()) if len(w) else 0 for _, w in shares]), "right")
    for k in range(len(LENGTHS) + 1):
        low = k
        while low and np.sum(right & (size >= low) & (size <= k)) < LEAST_HELD:
            low -= 1
        model.thresholds[k] = lower_bound(p.max(axis=1)[right & (size >= low) & (size <= k)])


def lower_bound(scores: np.ndarray) -> float:
    """The score that MAX_GOOD_REJECTED of the texts lie below. If they are too few for that quantile, an exponential
    tail of the log-odds below their lowest tenth gives it."""
    if not len(scores):
        return 0.0
    scores = np.sort(scores)
    if len(scores) * MAX_GOOD_REJECTED >= 1:
        return float(scores[int(len(scores) * MAX_GOOD_REJECTED)])
    odds = np.log(np.maximum(scores, 1e-12) / np.maximum(1 - scores, 1e-12))
    tail = odds[: max(2, len(odds) // 10)]
    bound = tail[-1] - float(tail[-1] - tail.mean()) * np.log(len(tail) / len(odds) / MAX_GOOD_REJECTED)
    return float(min(scores[0], 1 / (1 + np.exp(-bound))))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; a null id counts as fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(1))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learn from text and non-null lang of the documents outside fold 1."""
    known = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    if not counts:
        return LanguageModel([], np.zeros(((1 << BUCKET_BITS) + 1, 0), np.float32), np.zeros(0, np.float32))
    place_of = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))

    def share(rows: int) -> Column:
        return F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 30) * min(1.0, rows / n)))])[F.col("lang")]

    sample = known.where(F.col("lang").isin(list(counts)) & (place_of < share(per_lang + HELD_PER_LANG))).withColumn("held", place_of >= share(per_lang))
    words = F.split(F.trim("text"), r"\s+", 90)
    short = [F.concat_ws(" ", F.slice(words, 1, (least + F.pmod(F.xxhash64("doc_id", F.lit("short")), F.lit(least))).cast("int"))) for least in (4, 10, 20, 40)]
    texts = F.when(F.col("held"), F.array("text", *short)).otherwise(F.array("text"))
    sample = sample.select("doc_id", "lang", "held", F.explode(texts).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = bucket_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("held"), pa.array([at.tobytes() for at, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())], ["doc_id", "lang", "held", "at", "n"])

    measured = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "held", "text").mapInArrow(measure, "doc_id long, lang string, held boolean, at binary, n binary")
    rows = measured.toArrow().combine_chunks()
    ids, names, parts = rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist(), rows.column("held").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], names[i], rows.column("at")[i].as_py()))
    langs = sorted(set(names))
    place = {lang: k for k, lang in enumerate(langs)}

    def taken(held: bool) -> tuple[list, np.ndarray]:
        own = [i for i in order if parts[i] == held]
        return [shares_of(np.frombuffer(rows.column("at")[i].as_buffer(), np.uint16), np.frombuffer(rows.column("n")[i].as_buffer(), np.uint16)) for i in own], np.array([place[names[i]] for i in own], np.int64)

    return train(langs, *taken(False), more=taken(True))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. One pass over the texts, no shuffle."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the table: buckets times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = given.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~given.value.predict(batch.column("text"))[2]))
        release_memory()

    return small_batches(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
