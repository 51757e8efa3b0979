"""LM scoring by cross-entropy difference: matched bigram models of a target and a background over one vocabulary.

The vocabulary is CLASSES hash classes of words, the same for both models and at every size of input, so that what must be known of
single words is an array of fixed size. All words and all bigrams of all texts count. A bigram's probability is
(n(h, w) + PRIOR * p(w)) / (n(h) + PRIOR), with p(w) = (n(w) + ADD) / (n + ADD * CLASSES) and n(h) the number of words that follow h.

Bigrams of both corpora and of the documents to score go through one shuffle, in blocks: a task packs the bigrams of some hundred texts into one row
for each bucket of bigrams. A bucket's task adds up the counts of its bigrams and sends back what they cost each document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm._common import WORD, ship, split_words
from millrace.llm.partenum import grouped, mix

#: Words of the shared vocabulary (a power of two).
CLASSES = 1 << 20
BITS = CLASSES.bit_length() - 1
PRIOR, ADD = 100.0, 0.5
#: The context of a text's first word; no word has this code.
START = CLASSES
#: Bigrams of at least this share of a sample are counted apart and broadcast, at most 1 / HOT of them, so that no bucket gets a row for each document.
#: That changes no result.
HOT = 2e-6
#: Texts of the sample (about).
SAMPLE = 40_000
#: Texts and words that are packed together, bigrams to a bucket, and words whose class a worker remembers.
TEXTS, WORDS, BUCKET, REMEMBERED = 1024, 400_000, 1_000_000, 150_000
#: Counts of so many classes make a row.
STRETCH = 4096
#: Losses are added up as whole numbers of 1 / UNIT nats, so that no order of adding changes them.
UNIT = 1 << 20
#: What the bigrams of a block are for.
TARGET, BACKGROUND, SCORED = 1, 2, 4


@dataclass
class Models:
    """Both corpora as (text) tables, and what is known of their words: for target and background each, words by class, words by the class
    before them, and the counts of the hot bigrams. All arrays are of fixed or bounded size."""

    target: DataFrame
    background: DataFrame
    words: np.ndarray
    contexts: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray

    def word_parts(self) -> tuple[np.ndarray, np.ndarray]:
        """PRIOR * p(w) and n(h) + PRIOR, of either model."""
        p = (self.words + ADD) / (self.words.sum(1, keepdims=True) + ADD * CLASSES)
        return (PRIOR * p).astype(np.float32), (self.contexts + PRIOR).astype(np.float32)


def word_class(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & CLASSES - 1


class _Classes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        c = word_class(word)
        if len(word) <= 64:
            self[word] = c
        return c


_known = _Classes()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Of at most TEXTS texts (the first column) at once, and not many more than WORDS words: the rows, the words of each text, and of all words that
    are not in one text's end the text's number and the key of the bigram: the class before, shifted, and the class."""
    rows, codes, starts = [], [], []

    def out():
        t, at = np.array(codes, np.int64), np.array(starts, np.int64)
        n = np.diff(np.append(at, len(t))) - 1
        real = t[1:] != START
        return rows, n, np.repeat(np.arange(len(at)), n), (t[:-1][real] << BITS) | t[1:][real]

    for batch in batches:
        from_ = 0
        for i, text in enumerate(batch.column(0).cast(pa.binary())):
            starts.append(len(codes))
            codes.append(START)
            codes.extend(map(_known.__getitem__, split_words(text.as_py() or b"")))
            if len(starts) == TEXTS or len(codes) > WORDS:
                rows.append(batch.slice(from_, i + 1 - from_))
                yield out()
                rows, codes, starts, from_ = [], [], [], i + 1
        if from_ < batch.num_rows:
            rows.append(batch.slice(from_))
    if starts:
        yield out()


def _hot_bigrams(texts: DataFrame) -> np.ndarray:
    """Sorted keys of the bigrams that hold at least HOT of all in ``texts``. What is rare in a task's share isn't reported."""

    def run(batches):
        for _, _, _, keys in _chunks(batches):
            found, n = np.unique(keys, return_counts=True)
            often = n >= max(2, HOT * len(keys) / 4)
            yield pa.RecordBatch.from_arrays([pa.array([0, *found[often]], pa.int64()), pa.array([len(keys), *n[often]], pa.int64())], names=["key", "n"])

    counts = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = counts.where("key = 0").first()
    hot = counts.where((F.col("key") > 0) & (F.col("n") >= HOT * total["n"])).select("key").toPandas() if total else None
    return np.sort(hot["key"].to_numpy(np.int64)) if hot is not None else np.empty(0, np.int64)


def fit(target: DataFrame, background: DataFrame, text_col: str = "text") -> Models:
    """Counts all words of both tables by class, and the hot bigrams that a sample of both names. Other bigrams are counted in ``score``."""
    spark = background.sparkSession
    ship(spark)
    sides = [d.select(F.col(text_col).alias("text")) for d in (target, background)]
    some = [d.sample(min(1.0, SAMPLE / max(n, 1)), 7) if n > SAMPLE else d for d, n in ((d, d.count()) for d in sides)]
    hot = _hot_bigrams(some[0].unionByName(some[1]))
    sent = spark.sparkContext.broadcast(hot)

    def run(batches):
        hot = sent.value
        words, contexts, hits = np.zeros(CLASSES, np.int64), np.zeros(CLASSES + 1, np.int64), np.zeros(len(hot), np.int64)
        for _, _, _, keys in _chunks(batches):
            np.add.at(words, keys & CLASSES - 1, 1)
            np.add.at(contexts, keys >> BITS, 1)
            at, hit = _find(hot, keys)
            np.add.at(hits, at[hit], 1)
        n, c = np.concatenate([words, [0], hits]), np.append(contexts, np.zeros(len(hot), np.int64))
        for stretch in range(0, len(n), STRETCH):
            part = n[stretch : stretch + STRETCH], c[stretch : stretch + STRETCH]
            if part[0].any() or part[1].any():
                yield pa.RecordBatch.from_arrays([pa.array([stretch]), pa.array([pack((part[0], 8), (part[1], 8))], pa.binary())], names=["stretch", "data"])

    def add_up(batches):
        key, sums = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.stack(unpack(data.as_py(), 8, 8))
                if k == key:
                    sums += found
                else:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sums.tobytes()], pa.binary())], names=["key", "data"])
                    key, sums = k, found
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sums.tobytes()], pa.binary())], names=["key", "data"])

    counted = [d.mapInArrow(run, "stretch long, data binary").select((F.col("stretch") * 2 + m).alias("key"), "data") for m, d in enumerate(sides)]
    rows = counted[0].unionByName(counted[1]).repartition("key").sortWithinPartitions("key").mapInArrow(add_up, "key long, data binary")
    n, c = (np.zeros((2, CLASSES + 1 + len(hot)), np.int64) for _ in range(2))
    for key, data in rows.collect():  # a row for each stretch of both tables, whatever their size
        found = np.frombuffer(data, np.int64).reshape(2, -1)
        at = slice(key // 2, key // 2 + found.shape[1])
        n[key % 2, at], c[key % 2, at] = found
    return Models(*sides, n[:, :CLASSES].copy(), c[:, : CLASSES + 1].copy(), hot, n[:, CLASSES + 1 :].copy())


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _losses(keys: np.ndarray, counts: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cost of bigrams that occur ``counts`` times in target and background, in units, for both models."""
    w, h = parts[0][:, keys & CLASSES - 1], parts[1][:, keys >> BITS]
    return np.rint(-np.log((counts + w.astype(np.float64)) / h) * UNIT).astype(np.int64)


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of whole numbers with their widths in bytes, all first bytes before all second ones, which compresses well."""
    return b"".join(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for x, width in columns)


def unpack(data: bytes, *widths: int) -> list[np.ndarray]:
    """The columns that ``pack`` made (of numbers that aren't negative, or 8 bytes wide)."""
    planes = np.frombuffer(data, np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for width in widths:
        x = np.zeros((planes.shape[1], 8), np.uint8)
        x[:, :width] = planes[at : at + width].T
        out.append(x.view("<i8").ravel())
        at += width
    return out


#: Widths of a block's columns (key, text, times) and of a reply's (text, target loss, background loss).
BLOCK, REPLY = (6, 2, 4), (2, 8, 8)


def _blocks(docs: DataFrame, role: int, first: int, sent, buckets: int, id_type: str) -> DataFrame:
    """Rows of (bucket, origin, role, data) with the bigrams of some texts, and one row for the texts themselves, which has no data. ``first``
    keeps the origins of several tables apart."""

    def run(batches):
        hot, hot_losses = sent.value[:2]
        task = first + (TaskContext.get().partitionId() << 28)
        for number, (rows, n_words, text, keys) in enumerate(_chunks(batches)):
            at, hit = _find(hot, keys)
            if role & SCORED:
                ids = pa.concat_arrays([r.column(1) for r in rows])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                sums = [np.bincount(text[hit], hot_losses[m, at[hit]], len(ids)).astype(np.int64) for m in (0, 1)]
                lists += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(x, pa.int64())) for x in (n_words, *sums)]
                yield pa.RecordBatch.from_arrays([pa.array([number % buckets]), pa.array([task + number]), pa.array([role], pa.int32()), pa.nulls(1, pa.binary()), *lists], names=names)
            keys, text = keys[~hit], text[~hit] * bool(role & SCORED)
            order = np.argsort(bucketed := keys | _bucket(keys, buckets) << 2 * BITS + 1, kind="stable")
            bucketed, text = bucketed[order], text[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucketed[1:] != bucketed[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            times, bucketed, text = np.diff(np.append(at, len(order))), bucketed[at], text[at]
            bucket = bucketed >> 2 * BITS + 1
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
            keys = bucketed & (1 << 2 * BITS + 1) - 1
            data = [pack((keys[a:b], 6), (text[a:b], 2), (times[a:b], 4)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])]
            if data:
                none = [pa.nulls(len(data), x) for x in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(np.full(len(data), task + number)), pa.array(np.full(len(data), role, np.int32)), pa.array(data, pa.binary()), *none], names=names)

    names = ["bucket", "origin", "role", "data", "ids", "n", "t", "b"]
    kinds = [pa.list_(to_arrow_type(docs.schema["id"].dataType)), *[pa.list_(pa.int64())] * 3]
    return docs.select("text", "id").mapInArrow(run, f"bucket long, origin long, role int, data binary, ids array<{id_type}>, n array<long>, t array<long>, b array<long>")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _replies(t: pa.Table, parts) -> tuple[list[int], list[bytes]]:
    """Of one bucket's blocks: what the bigrams of each scored block cost its texts."""
    roles, origins = t.column("role").to_numpy(), t.column("origin").to_numpy()
    columns = [unpack(x.as_py(), *BLOCK) for x in t.column("data")]
    block = np.repeat(np.arange(len(columns)), [len(c[0]) for c in columns])
    keys, text, times = (np.concatenate(x) for x in zip(*columns))
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.concatenate(([True], in_order[1:] != in_order[:-1]))
    starts = np.flatnonzero(new)
    counts = np.stack([np.add.reduceat(times[order] * (roles[block[order]] & m > 0), starts) for m in (TARGET, BACKGROUND)])
    costs = _losses(in_order[starts], counts, parts)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    scored = np.flatnonzero(roles[block] & SCORED)
    if not len(scored):
        return [], []
    place = block[scored] << 16 | text[scored]
    order = np.argsort(place, kind="stable")
    scored, place = scored[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    sums = [np.add.reduceat(times[scored] * costs[m, which[scored]], starts) for m in (0, 1)]
    place = place[starts]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] >> 16 != place[:-1] >> 16))).tolist()
    data = [pack((place[a:b] & 65535, 2), (sums[0][a:b], 8), (sums[1][a:b], 8)) for a, b in zip(cuts, [*cuts[1:], len(place)])]
    return origins[place[cuts] >> 16].tolist(), data


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document: mean losses by token, in nats, and their difference;
    a low score means a text that is more like the target than the background is. Null, empty and blank texts have no tokens and null
    losses. Repeated rows are scored each; other columns don't pass; no documents give no rows, and empty corpora give uniform models.

    The documents may be the background itself or any other table. Hot bigrams cost what was counted in ``fit``, at once; all others are shuffled
    twice, packed: to their bucket, of about BUCKET bigrams, and what they cost back to their texts."""
    spark = docs.sparkSession
    ship(spark)
    id_type = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    tokens = int(models.words.sum())
    corpora = [(models.target, TARGET)]
    if docs.select(F.col(text_col).alias("text")).sameSemantics(models.background):
        corpora.append((own, BACKGROUND | SCORED))
    else:
        tokens += own.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
        corpora += [(models.background, BACKGROUND), (own, SCORED)]
    parts = models.word_parts()
    sent = spark.sparkContext.broadcast((models.hot, _losses(models.hot, models.hot_counts, parts), parts))
    buckets = 1 + tokens // BUCKET
    rows = None
    for k, (d, role) in enumerate(corpora):
        d = d if "id" in d.columns else d.select("text", F.lit(None).cast(id_type).alias("id"))
        more = _blocks(d, role, k << 60, sent, buckets, id_type)
        rows = more if rows is None else rows.unionByName(more)

    def meet(batches):
        for _, t in grouped(batches):
            whole = t.column("data").is_null()
            if pc.any(whole).as_py():
                yield from t.filter(whole).select(names).to_batches()
            t = t.filter(pc.invert(whole))
            if t.num_rows:
                origins, data = _replies(t, sent.value[2])
                none = [pa.nulls(len(data), t.column(c).type) for c in names[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(origins, pa.int64()), pa.array(data, pa.binary()), *none], names=names)

    def gather(batches):
        for _, t in grouped(batches):
            at = int(np.flatnonzero(t.column("data").is_null().to_numpy())[0])
            ids, n, *sums = (t.column(c)[at].values for c in names[2:])
            sums = np.array([x.to_numpy() for x in sums])
            for x in t.column("data").drop_null():
                text, *more = unpack(x.as_py(), *REPLY)
                sums[:, text] += more
            yield pa.RecordBatch.from_arrays([ids, n, *(pa.array(x / UNIT) for x in sums)], names=[id_col, "n_tokens", "t", "b"])

    names = ["origin", "data", "ids", "n", "t", "b"]
    lists = f"ids array<{id_type}>, n array<long>, t array<long>, b array<long>"
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"origin long, data binary, {lists}")
    found = met.repartition("origin").sortWithinPartitions("origin").mapInArrow(gather, f"`{id_col}` {id_type}, n_tokens long, t double, b double")
    mean = lambda m: F.when(F.col("n_tokens") > 0, F.col(m) / F.col("n_tokens"))
    found = found.select(id_col, "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
