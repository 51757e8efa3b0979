"""N-gram Jaccard join by PartEnum signatures: near-duplicate classes of word shingle sets.

Two sets of sizes a <= b with 100 * |A & B| >= t * |A | B| differ in at most k elements, k following from the sizes. The domain of
all shingles is cut into more parts than k, so similar sets agree in whole parts; the hash of a set's elements in one part is a signature.
A band of k differences has so many parts that similar sets share at least ``needed`` of its signatures. So each set is enumerated in the
subsets of its parts that leave out the ``needed - 1`` most common ones: a pair still shares one of the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import checkpoint, join_small, ship
from millrace.llm.components import connected_components

#: Members of a signature group of which all pairs are passed on, a fixed number; larger groups are compared in tiles.
PAIRED = 16
#: Sets to one side of a tile, and of those as many as are compared with the other side at once.
CHUNK, STRIP = 2048, 128
#: Partners of a set to one group of pairs that are verified together.
PARTNERS = 512
#: Rows of one signature that a task holds; a larger group comes in pieces.
HELD = 100_000
#: Names of sets that a task remembers, so as not to sign copies again.
SEEN = 200_000
#: Bits of the filter that tells which sets are needed whole (2 MB, whatever the input).
FILTER_BITS = 1 << 24
#: Bytes of text that are hashed at once.
BLOCK = 1 << 17
U = np.uint64
#: What word polynomials are of, modulo 2 ** 64.
BASE = 0xD6E8FEB86659FD93
MULT, MULT2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ U(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * MULT
        x = (x ^ (x >> U(32))) * MULT2
        return x ^ (x >> U(29))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only), white space, and powers of an odd number and of its inverse modulo 2 ** 64."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    powers = lambda p: np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(BLOCK + 1, p, U))))
    with np.errstate(over="ignore"):
        return low, space, powers(BASE), powers(pow(BASE, -1, 1 << 64))


def word_sums(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block of at most BLOCK bytes the polynomial sum, the length and the start: differences of one running polynomial."""
    low, space, power, inverse = _tables()
    raw = np.frombuffer(block, np.uint8)
    word = np.concatenate(([False], ~space[raw], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U), np.cumsum((low[raw].astype(U) + U(1)) * power[: len(raw)], dtype=U)))
        return (sums[ends] - sums[starts]) * inverse[starts], ends - starts, starts


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a block of at most BLOCK bytes, and where each word starts."""
    sums, lengths, starts = word_sums(block)
    with np.errstate(over="ignore"):
        return mix(sums + lengths.astype(U) * MULT2), starts


def long_word_hashes(text: bytes) -> np.ndarray:
    """The same hashes of a text of any length. A word that a block's end cuts goes on in the next block: its sum and length so far are carried."""
    all_sums, all_lengths = [], []
    carried, length = 0, 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        sums, lengths, starts = word_sums(block)
        if length and len(starts) and starts[0] == 0:
            sums[0] = U((carried + int(sums[0]) * pow(BASE, length, 1 << 64)) % (1 << 64))
            lengths[0] += length
        elif length:
            sums, lengths = np.concatenate((np.array([carried], U), sums)), np.concatenate(([length], lengths))
        length = 0
        if len(starts) and not block[-1:].isspace() and at + BLOCK < len(text):
            carried, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        all_sums.append(sums)
        all_lengths.append(lengths)
    with np.errstate(over="ignore"):
        return mix(np.concatenate(all_sums) + np.concatenate(all_lengths).astype(U) * MULT2)


def shingle_sets(texts: Iterable[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Of each text its distinct k-word shingles as sorted 64-bit hashes. A text of fewer words than k is one shingle; one without words
    has none. Texts are hashed together in blocks, long ones block by block; words may be longer than a block."""

    def combine(h: np.ndarray, size: int) -> np.ndarray:
        n = max(len(h) - size + 1, 0)
        x = np.full(n, U(size))
        with np.errstate(over="ignore"):
            for j in range(size):
                x = (x ^ (x >> U(31))) * MULT + h[j : j + n]
        return mix(x)

    def whole(parts: list[bytes]) -> Iterator[np.ndarray]:
        h, starts = word_hashes(b"\n".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts])
        bounds = [0, *np.searchsorted(starts, ends).tolist()]
        x = combine(h, k)
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= k:
                yield np.unique(x[lo : hi - k + 1])
            else:
                yield combine(h[lo:hi], hi - lo) if hi > lo else np.empty(0, U)

    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if len(text) + 1 + size > BLOCK and held:
            yield from whole(held)
            held, size = [], 0
        if len(text) < BLOCK:
            held.append(text)
            size += len(text) + 1
            continue
        h = long_word_hashes(text)
        yield np.unique(combine(h, min(k, len(h)))) if len(h) else np.empty(0, U)
    if held:
        yield from whole(held)


def parity(shingles: np.ndarray) -> bytes:
    """A bit map of three to six bits an element, in which each element turns one bit over. Maps of two sets differ in no more bits than
    the sets do in elements, also after the larger one is folded to the other's size."""
    bits = max(64, 1 << int(3 * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles, 99) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def parity_differences(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits the maps of two bounded groups differ (left by right), after folding all to the width of the narrowest; so many
    bits at once that memory doesn't grow with the texts."""
    width = min(map(len, left + right))
    a, b = (np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps]) for maps in (left, right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, 128):
        x, y = (np.unpackbits(rows[:, at : at + 128], axis=1).astype(np.float32) for rows in (a, b))
        out += x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)
    return out


def differences(n: np.ndarray, maps: list[bytes], other_n: np.ndarray, other_maps: list[bytes], percent: int) -> np.ndarray:
    """At least so many elements differ between the sets of two bounded groups (a matrix); infinite where sizes or maps rule a link out."""
    total = n[:, None] + other_n[None, :]
    most = total - 2 * -(-percent * total // (100 + percent))
    fits = 100 * np.minimum(n[:, None], other_n[None, :]) >= percent * np.maximum(n[:, None], other_n[None, :])
    apart = parity_differences(maps, other_maps)
    return np.where(fits & (apart <= most + 0.5), apart, np.float32(np.inf))


def close_pairs(n: np.ndarray, maps: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differences at least) of the members i of ``left`` and j of ``right`` whose labels differ and that sizes and maps don't rule out. Strips
    of the matrix are made one by one, so that memory holds a strip and what is left."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    right_maps = [maps[j] for j in right]
    for lo in range(0, len(left), STRIP):
        x = left[lo : lo + STRIP]
        apart = differences(n[x], [maps[i] for i in x], n[right], right_maps, percent)
        apart[label[x][:, None] == label[right][None, :]] = np.inf
        i, j = np.nonzero(np.isfinite(apart))
        out.append((x[i], right[j], apart[i, j].astype(np.float32)))
    return tuple(map(np.concatenate, zip(*out)))


def forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) make a least spanning forest; nodes with equal labels count as joined already. In each turn every tree takes
    its nearest edge."""
    order = np.argsort(apart, kind="stable")
    tree = np.unique(label, return_inverse=True)[1]
    out = []
    while len(order):
        ends = np.stack([tree[i[order]], tree[j[order]]], 1)
        apart_still = ends[:, 0] != ends[:, 1]
        order, ends = order[apart_still], ends[apart_still]
        taken = np.unique(np.unique(ends.ravel(), return_index=True)[1] // 2)
        to = np.arange(len(tree))
        for x, y in ends[taken].tolist():
            while to[x] != x:
                x = to[x]
            while to[y] != y:
                y = to[y]
            to[max(x, y)] = min(x, y)
        while not np.array_equal(to, to[to]):
            to = to[to]
        tree = to[tree]
        out.append(order[taken])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of all of it."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), ">i8")[0])


@lru_cache(maxsize=None)
def band_start(i: int, percent: int) -> int:
    """The smallest size of band i."""
    if i == 0:
        return 1
    low = band_start(i - 1, percent)
    return max(low + 1, -(-low * 100 // percent))


@lru_cache(maxsize=None)
def band(i: int, percent: int) -> tuple[int, int, int]:
    """(parts, most empty parts, needed) of band i; no parts if its sets only link to equal ones. In it the larger set of a pair lies. A pair of
    sizes that sum up to s shares at least percent * s / (100 + percent) elements. Parts are more than the differences by
    the number of signatures to be shared and of empty parts that go unsigned."""
    high = band_start(i + 1, percent) - 1
    most = max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(2, 2 * high - 40), 2 * high + 1))
    least = -(-percent * band_start(i, percent) // 100)
    if most <= 0:
        return 0, 0, 0
    needed = 1 + most // 10
    spare = 0
    for _ in range(8):
        parts = most + needed + spare
        empty = parts * (1 - 1 / parts) ** least
        spare = int(empty + 1.5 * empty**0.5)
    return most + needed + spare, spare, needed


def bands_of(n: int, percent: int) -> list[int]:
    """The band of a size, and the later ones whose sets it may be the smaller partner of."""
    i = max(0, int(np.log(max(n, 1)) / np.log(100 / percent)) - 3)
    while band_start(i, percent) > n and i:
        i -= 1
    while band_start(i + 1, percent) <= n:
        i += 1
    out = [i]
    while -(-percent * band_start(out[-1] + 1, percent) // 100) <= n:
        out.append(out[-1] + 1)
    return out


def part_sums(shingles: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that hold elements, and a hash of the elements in each."""
    x = np.sort(mix(shingles, seed))
    part = (x >> U(32)) * U(parts) >> U(32)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    with np.errstate(over="ignore"):
        return part[starts], np.add.reduceat(mix(x, 77), starts)


#: Partitions of one band; in the last one empty parts are signed, too.
LEVELS = 8


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set; the lowest eight bits are the band's number.

    A set leaves its empty parts unsigned. If one set of a similar pair has no more empty parts than the band spares, the pair
    shares ``needed`` signatures of parts that hold elements. A set with more empty parts goes on to a second partition, and so on: a pair
    meets in the first partition in which one of the two has few enough.
    """
    out = []
    with np.errstate(over="ignore"):
        for i in bands_of(len(shingles), percent):
            parts, spare, _ = band(i, percent)
            if not parts:
                continue
            tag = mix(np.array([i + 1], U), 5)[0]
            for level in range(LEVELS):
                held, sums = part_sums(shingles, parts, i + 1000 * level)
                found = mix(sums + (held + U(1)) * MULT2 + tag, level)
                few = parts - len(held) <= spare
                if not few and level == LEVELS - 1:
                    found = np.concatenate([found, mix(np.setdiff1d(np.arange(parts, dtype=U), held) * MULT + tag, 9)])
                out.append(found & ~U(255) | U(i & 255))
                if few:
                    break
    return np.concatenate(out) if out else np.empty(0, U)


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """Groups of rows with equal values in the first column, of a stream sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if rest and rest[0].column(0)[0].as_py() != keys[lo]:
                yield rest[0].column(0)[0].as_py(), pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield rest[0].column(0)[0].as_py(), pa.Table.from_batches(rest)


def _shingle_rows(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, name, maps = [], [], []
            for s in shingle_sets((t.as_py() for t in batch.column(1).cast(pa.binary())), k):
                n.append(len(s))
                name.append(fingerprint(s) if len(s) else None)
                maps.append(parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(maps, pa.binary())], names=[id_col, "n_shingles", "fp", "map"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_shingles long, fp long, map binary")


def _once(batches, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a task's texts, copies only once (as far as the memory of names reaches)."""
    seen = set()
    for batch in batches:
        for s in shingle_sets((t.as_py() for t in batch.column(0).cast(pa.binary())), k):
            if len(s):
                name = fingerprint(s)
                if name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    yield name, s


def _signature_rows(docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    def run(batches):
        sigs, names, size = [], [], 0
        for name, s in _once(batches, k):
            found = signatures(s, percent)
            sigs.append(found.view(np.int64))
            names.append(np.full(len(found), name, np.int64))
            size += len(found)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(names))], names=["sig", "fp"])
                sigs, names, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(names))], names=["sig", "fp"])

    return docs.select(text_col).mapInArrow(run, "sig long, fp long")


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """(sig, fp) of signatures that two or more sets have, without those that similar pairs can do without: of each set and band the
    ``needed - 1`` most common ones. A pair that shares ``needed`` keeps the least common one that it shares, as all sets take signatures in the same order."""

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for sig, fp, piece in _runs(batches, HELD):
            if piece:
                size, keep = np.full(len(sig), HELD), slice(None)
            else:
                starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                size = np.repeat(np.diff(np.append(starts, len(sig))), np.diff(np.append(starts, len(sig))))
                keep = size > 1
            out.append((sig[keep], fp[keep], np.minimum(size[keep], HELD)))
            held += len(out[-1][0])
            if held > 20_000:
                yield batch(out)
                out, held = [], 0
        if held:
            yield batch(out)

    def batch(out):
        sig, fp, size = (np.concatenate(x) for x in zip(*out))
        needed = [band(i, percent)[2] for i in range(int((sig & 255).max()) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp), pa.array(size, pa.int32()), pa.array(np.array(needed, np.int32)[sig & 255])], names=["sig", "fp", "size", "needed"])

    found = rows.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(run, "sig long, fp long, size int, needed int")
    common = W.partitionBy("fp", F.col("sig").bitwiseAND(255)).orderBy(F.desc("size"), "sig")
    return found.withColumn("place", F.row_number().over(common)).where("place >= needed").select("sig", "fp")


def _groups(rows: DataFrame) -> DataFrame:
    """What signature groups of two or more sets say, as distinct (a, b, size).

    Of a group of up to PAIRED sets all pairs (a, b), with size 0. In a larger group each set is paired with the first one only, and all
    sets are passed on as (group, set) with the group's size; the group is named by its members, so that one which many signatures
    find is compared once. Of a group that comes in pieces the size is only known to be large.
    """

    def run(batches):
        left, right, size, held = [], [], [], 0
        for sig, fp, piece in _runs(batches, HELD):
            if piece:
                for x, n in ((np.full(len(fp), piece[0]), 0), (sig, max(HELD, CHUNK + 1))):
                    left.append(x)
                    right.append(fp)
                    size.append(np.full(len(fp), n))
                held += len(fp)
            else:
                starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                sizes = np.diff(np.append(starts, len(sig)))
                for m in np.unique(sizes[sizes > 1]).tolist():
                    at = starts[sizes == m]
                    i, j = np.triu_indices(m, 1) if m <= PAIRED else (np.zeros(m - 1, np.int64), np.arange(1, m))
                    left.append(fp[at[:, None] + i].ravel())
                    right.append(fp[at[:, None] + j].ravel())
                    size.append(np.zeros(len(left[-1]), np.int64))
                    if m > PAIRED:
                        every = (at[:, None] + np.arange(m)).ravel()
                        names = [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in fp[every].reshape(-1, m)]
                        left.append(np.repeat(np.array(names, np.int64), m))
                        right.append(fp[every])
                        size.append(np.full(len(every), m))
                    held += len(at) * m
            if held > 20_000:
                yield _batch(left, right, size)
                left, right, size, held = [], [], [], 0
        if held:
            yield _batch(left, right, size)

    return rows.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(run, "a long, b long, size long").where("size > 0 or a <> b").distinct()


def _batch(left, right, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right, size)], names=["a", "b", "size"])


def _runs(batches, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int] | None]]:
    """Distinct rows (signature, set) of a sorted stream, cut between signatures. A group of more than ``held`` rows comes in pieces, each with
    (the group's first set,); else that is None."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    piece = None

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for x, _ in rest]), np.concatenate([x for _, x in rest])

    last_sig = last_fp = piece_sig = None
    for batch in batches:
        sig, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
        new[:1] &= not (len(sig) and sig[0] == last_sig and fp[0] == last_fp)
        sig, fp = sig[new], fp[new]
        if not len(sig):
            continue
        last_sig, last_fp = sig[-1], fp[-1]
        if rest and rest[-1][0][-1] != sig[0]:  # the open group has ended
            yield *joined(), piece
            rest, piece = [], None
        elif piece and not rest and piece_sig != sig[0]:
            piece = None
        end = int(np.searchsorted(sig, sig[0], "right"))
        rest.append((sig[:end], fp[:end]))
        if end < len(sig):
            yield *joined(), piece
            last = int(np.searchsorted(sig, sig[-1]))
            if end < last:
                yield sig[end:last], fp[end:last], None
            rest, piece = [(sig[last:], fp[last:])], None
        elif sum(len(x) for x, _ in rest) > held:
            piece = piece or (int(rest[0][1][0]),)
            piece_sig = int(rest[0][0][0])
            yield *joined(), piece
            rest = []
    if rest:
        yield *joined(), piece


def _whole_sets(docs: DataFrame, names: DataFrame, k: int, text_col: str) -> DataFrame:
    """(fp, shingles) of the named sets. A bit filter of fixed size lets few others through the scan; the join then keeps exactly the
    ones asked for."""
    spark = docs.sparkSession
    bit = F.pmod(F.col("fp"), F.lit(FILTER_BITS))
    words = names.groupBy(F.floor(bit / 32).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(fp, {FILTER_BITS}) % 32 as int))")).alias("bits"))
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toPandas()
    held[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint64).astype(np.uint32)
    filter_ = spark.sparkContext.broadcast(held)

    def run(batches):
        bits = filter_.value
        out, data, size = [], [], 0
        for name, s in _once(batches, k):
            at = name % FILTER_BITS
            if bits[at // 32] >> np.uint32(at % 32) & 1:
                out.append(name)
                data.append(s.tobytes())
                size += len(data[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(data, pa.binary())], names=["fp", "shingles"])
                    out, data, size = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(data, pa.binary())], names=["fp", "shingles"])

    sets = docs.select(text_col).mapInArrow(run, "fp long, shingles binary")
    return sets.join(names, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _survivors(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and maps allow a link."""
    side = lambda c: classes.select(F.col("fp").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("map").alias(f"map_{c}"))

    def run(batches):
        for batch in batches:
            n = np.stack([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()], 1)
            maps = zip(batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist())
            keep = [bool(np.isfinite(differences(n[i, :1], [x], n[i, 1:], [y], percent)[0, 0])) for i, (x, y) in enumerate(maps)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, k: int, text_col: str) -> DataFrame:
    """The distinct pairs that link. Pairs are grouped by one end, whose set comes once; a set with very many partners is dealt over several groups."""
    pairs = checkpoint(pairs)
    names = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sizes = pairs.groupBy("a").count()
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / PARTNERS))
    dealt = pairs.join(sizes, "a").select("a", "b", F.xxhash64("a", part).alias("gid"))
    rows = dealt.select("gid", F.col("b").alias("fp"), F.lit(1).alias("side")).unionByName(dealt.select("gid", F.col("a").alias("fp"), F.lit(0).alias("side")).distinct())
    sets = _whole_sets(docs, names, k, text_col)

    def run(batches):
        key = head = None
        a, b = [], []
        for batch in batches:
            for gid, fp, side, raw in zip(*(batch.column(c).to_pylist() for c in ("gid", "fp", "side", "shingles"))):
                s = np.frombuffer(raw, U)
                if side == 0:
                    key, head = gid, (fp, s)
                elif gid == key:
                    o = len(np.intersect1d(head[1], s, assume_unique=True))
                    if 100 * o >= percent * (len(head[1]) + len(s) - o):
                        a.append(head[0])
                        b.append(fp)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []

    return rows.join(sets, "fp").repartition("gid").sortWithinPartitions("gid", "side").mapInArrow(run, "a long, b long")


def _within_big(big: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, few: bool) -> DataFrame:
    """Pairs (gid, a, b) inside larger groups to verify next: those that sizes and maps allow and that aren't in one component yet.

    Sets of a group's most frequent component need no comparison with each other; the others are compared with all. A group of up to CHUNK sets
    is one task's tile. Of a larger one, each pair of a chunk of others and a chunk of all sets is a tile, so no task holds more
    than two chunks of maps. With ``few`` a tile gives the edges of a forest that would join all it can, so the pairs grow with the
    rows; else all pairs.
    """
    rows = checkpoint(big.join(labels, big["fp"] == labels["node"], "left").select("gid", "fp", "size", F.coalesce("component", "fp").alias("label")))
    heads = rows.groupBy("gid").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.mode("label").alias("head")).where("l0 < l1").select("gid", "head")
    rows = rows.join(heads, "gid").select("gid", "fp", "size", "label", (F.col("label") != F.col("head")).alias("other"))
    many = rows.where(F.col("size") > CHUNK)
    counts = many.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.count_if("other").alias("others"))
    many = many.join(counts, "gid")
    chunks = lambda n: F.floor((F.col(n) - 1) / CHUNK) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n)
    data, zero = ["gid", "fp", "label"], F.lit(0).cast("long")
    whole = rows.where(F.col("size") <= CHUNK).select(*data, zero.alias("x"), zero.alias("y"), F.when(F.col("other"), 2).otherwise(1).alias("side"))
    asks = many.where("other").select(*data, own(chunks("others"), 1).alias("x"), every(chunks("m")).alias("y"), F.lit(0).alias("side"))
    answers = many.select(*data, every(chunks("others")).alias("x"), own(chunks("m"), 2).alias("y"), F.lit(1).alias("side"))

    def run(batches):
        for _, t in grouped(batches):
            side, fp, label, n = (t.column(c).to_numpy() for c in ("side", "fp", "label", "n_shingles"))
            maps = t.column("map").to_pylist()
            x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: asks and answers
            if not len(x) or not len(y):
                continue
            i, j, apart = close_pairs(n, maps, label, x, y, percent)
            if few:
                taken = forest(i, j, apart, label)
                i, j = i[taken], j[taken]
            if len(i):
                a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t.column("gid")[0].as_py())), pa.array(a), pa.array(b)], names=["gid", "a", "b"])

    tiles = whole.unionByName(asks).unionByName(answers).withColumn("tile", F.xxhash64("gid", "x", "y")).join(classes.select("fp", "n_shingles", "map"), "fp")
    return tiles.select("tile", "gid", "side", "fp", "label", "n_shingles", "map").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "gid long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its distinct k-word shingles, or its whole
    word sequence if shorter. Documents link when 100 * intersection >= percent * union; a component is named by its smallest
    doc_id. Null, empty and blank texts have no shingles and link with nothing. Equal sets are one node from the start. Ids may
    repeat; each row gets its text's component. No component is lost: signatures cover all pairs, and every candidate that isn't in one component
    already is verified. Other columns of ``docs`` aren't read; an empty table gives no rows.
    """
    return _components(docs, percent, k, id_col, text_col).drop("fp", "label")


def _components(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``near_duplicates``, the name of the set and the least one of its component; both null if the set is empty."""
    ship(docs.sparkSession)
    slim = checkpoint(_shingle_rows(docs, k, id_col, text_col))
    classes = slim.where("fp is not null").groupBy("fp").agg(F.first("n_shingles").alias("n_shingles"), F.first("map").alias("map"), F.min(id_col).alias("first"))
    groups = checkpoint(_groups(_shared(_signature_rows(docs, k, percent, text_col), percent)))
    big = groups.where("size > 0").select(F.col("a").alias("gid"), F.col("b").alias("fp"), "size")
    tried = _survivors(groups.where("size = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), classes, percent)
    links = checkpoint(_verified(docs, tried, percent, k, text_col))
    labels = connected_components(links)
    for few in (True, False):  # most groups are joined by the first forests; the second turn compares whatever is left
        more = checkpoint(_within_big(big, classes, labels, percent, few))
        if more.isEmpty():
            break
        found = checkpoint(_verified(docs, more.select("a", "b").distinct(), percent, k, text_col))
        failed = more.join(found, ["a", "b"], "left_anti")
        big = big.join(failed.select("gid").distinct(), "gid", "left_semi")  # in all other groups the forest's links have settled every pair
        if not found.isEmpty():
            links = checkpoint(links.unionByName(found))
            labels = connected_components(links)
    classes = classes.select("fp", "first").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    names = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = classes.join(names, "label").select("fp", "component_id", "label")
    return slim.join(named, "fp", "left").select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"), "fp", "label")


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, but of each component only one: that with the smallest doc_id (of several sets with that id the one of the smallest name).
    Texts without words all stay, and so do all different sets of a component without any id.

    Ids to leave out are usually few; only if they are many are the texts shuffled. Rows whose id is null or repeated are decided by their
    sets, which are made again for them: a text that links with nothing stays whatever its id."""
    found = checkpoint(_components(docs, percent, k, id_col, text_col).select(F.col(id_col).alias("id"), "fp", "label"))
    heads = found.where("fp is not null and id is not null").groupBy(F.col("label").alias("l")).agg(F.min(F.struct("id", "fp")).alias("head"))
    rows = found.join(heads, F.col("label") == F.col("l"), "left")
    stays = F.col("head").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("fp") == F.col("head.fp")))
    judged = checkpoint(rows.select("id", "fp", stays.alias("stays")))
    again = checkpoint(judged.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias(id_col)))
    gone = checkpoint(judged.where(~F.col("stays")).select(F.col("id").alias(id_col)).distinct())
    once = join_small(join_small(docs, again, [id_col], "left_anti"), gone, [id_col], "left_anti")
    if again.isEmpty():
        return once
    at = docs.columns.index(text_col)

    def named(batches):
        for batch in batches:
            sets = shingle_sets((t.as_py() for t in batch.column(at).cast(pa.binary())), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())], names=[*batch.schema.names, "__fp"])

    several = join_small(docs, again, [id_col], "left_semi")
    several = several.mapInArrow(named, T.StructType([*several.schema.fields, T.StructField("__fp", T.LongType())]))
    kept = checkpoint(judged.where("stays and fp is not null").select(F.col("id").alias(id_col), F.col("fp").alias("__fp")).distinct())
    chosen = join_small(several.where("__fp is not null"), kept, [id_col, "__fp"], "left_semi")
    first = W.partitionBy(id_col, "__fp").orderBy(F.xxhash64(*docs.columns))
    chosen = chosen.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.unionByName(chosen.select(*docs.columns)).unionByName(several.where("__fp is null").select(*docs.columns))


#: The same in DuckDB SQL, for op8's parameters.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY ALL
"""
