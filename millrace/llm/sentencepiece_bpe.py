"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from millrace.llm._common import ship

SPACE = "▁"
#: Distinct segments (a word with the spaces before it) and token pairs that a worker remembers; then it starts afresh. Only what comes up a second
#: time is remembered, as far as a map of ONCE bytes tells.
SEGMENTS, PAIRS, LONGEST, ONCE = 200_000, 100_000, 48, 1 << 20


def read_vocabulary(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte, control or unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())]


class PieceCodec:
    """Encoder and decoder of one vocabulary: leading space added, spaces kept as they are, bytes for unknown characters."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.text = [p.replace(SPACE, " ") for p, _, _ in vocabulary]
        self.kind = [k for _, _, k in vocabulary]
        self.score = [s for _, s, _ in vocabulary]
        self.ids = {self.text[i]: i for i, k in enumerate(self.kind) if k == "normal"}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("pieces with a space after other characters aren't supported")
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == "unknown"), None)
        self.as_bytes = [b"" if k == "control" else bytes([int(p[1:-1], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else t.encode() for (p, _, k), t in zip(vocabulary, self.text)]
        self.as_text = [str(i) for i in range(len(vocabulary))]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pairs_seen = _Seen()
        self.automaton = ahocorasick.Automaton()
        #: The next shorter piece that starts like this one; only pieces that merging can make are candidates.
        self.shorter: dict[int, int] = {}
        self.size = [len(t) for t in self.text]
        made = self.made = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merge(t) == [i]}
        for t, i in made.items():
            self.automaton.add_word(t, i)
            self.shorter[i] = next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1)
        if made:
            self.automaton.make_automaton()
        self.known = set(t for t in self.ids if len(t) == 1)
        self.segments = self._segments()
        self.cache = _Cache(self)

    def _segments(self) -> re.Pattern:
        """Cuts text where no piece can reach across: before spaces, at line ends, and between letters and other characters,
        so far as the vocabulary has no piece that does."""
        line = "" if any("\n" in t for t in self.ids) else "\n"
        alpha = {c for c in self.known if c.isalpha()}
        mixed = any((x in alpha) != (y in alpha) and x != " " for t in self.ids for x, y in zip(t, t[1:]))
        if mixed or not alpha:
            parts = [rf" *[^ {line}]+", " +"]
        else:
            letters = "".join(sorted(map(re.escape, alpha)))
            parts = [rf" *[{letters}]+", rf" *[^ {line}{letters}]+", " +"]
        return re.compile("|".join(["\n"] * bool(line) + parts))

    def merge(self, text: str) -> list[int]:
        """The model's own definition: join the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their joined text is merged again."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merge(self.text[a] + self.text[b]) == [a, b]
            if self.pairs_seen.again((a, b)):
                if len(self.pairs) >= PAIRS:
                    self.pairs.clear()
                self.pairs[a, b] = found
        return found

    def encode_run(self, run: str) -> list[int]:
        """Tokens of a run of known characters. A sequence of tokens is the merge result if each adjacent pair is compatible,
        so: take the longest match at each place, fall back to shorter ones, and remember the places from which none led on."""
        whole = self.made.get(run)
        if whole is not None:
            return [whole]
        n, size, shorter, pairs = len(run), self.size, self.shorter, self.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(run):  # at each end the longer matches come first, at later ends the longer still
            at = end - size[token] + 1
            longest[at] = token
        failed, tokens, at, last = 0, [], 0, -1
        token = longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not failed >> end & 1:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token < 0:
                failed |= 1 << at
                token = tokens.pop()
                last = tokens[-1] if tokens else -1
                at -= size[token]
                continue
            tokens.append(token)
            last, at = token, end
            token = longest[at] if at < n else -1
        return tokens

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        if self.known.issuperset(segment):
            return tuple(self.encode_run(segment))
        out: list[int] = []
        start = 0
        for k, c in enumerate(segment):
            if c not in self.known:
                if start < k:
                    out += self.encode_run(segment[start:k])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                start = k + 1
        if start < len(segment):
            out += self.encode_run(segment[start:])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        segments = self.segments.findall(" " + text.replace(SPACE, " "))
        return list(chain.from_iterable(map(self.cache.__getitem__, segments)))

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = b"".join(map(self.as_bytes.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != "control"), None)
        if first is not None and self.kind[first] == "normal" and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # broken byte tokens, which encode() never makes: one mark for each bad byte
            out = []
            while raw:
                n = next((n for n in (1, 2, 3, 4) if _valid(raw[:n])), 0)
                out.append(raw[:n].decode() if n else "�")
                raw = raw[n or 1 :]
            return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


class _Seen:
    """Tells what has come up before, by a map of fixed size that is emptied when half full; now and then wrongly."""

    def __init__(self):
        self.marks, self.n = bytearray(ONCE), 0

    def again(self, key) -> bool:
        at = hash(key) % ONCE
        if self.marks[at]:
            return True
        if self.n >= ONCE // 2:
            self.marks, self.n = bytearray(ONCE), 0
        self.marks[at] = 1
        self.n += 1
        return False


class _Cache(dict):
    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self.seen = _Seen()

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.codec.encode_segment(segment)
        if len(segment) <= LONGEST and self.seen.again(segment):
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = ids
        return ids


_codecs: dict[tuple[int, int], PieceCodec] = {}


def _codec(vocabulary: Broadcast) -> PieceCodec:
    """One codec to a Python worker, used by all its tasks."""
    key = (vocabulary._jbroadcast_id if hasattr(vocabulary, "_jbroadcast_id") else 0, hash(tuple(vocabulary.value[-64:])))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(vocabulary.value)
    return _codecs[key]


def send_vocabulary(spark: SparkSession, model_file: str) -> Broadcast:
    """The vocabulary (a fixed file, some tens of thousands of pieces) read on the driver and broadcast."""
    ship(spark)
    return spark.sparkContext.broadcast(read_vocabulary(model_file))


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode them again, and return (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    A null text counts as empty: no tokens, and the digests of nothing. Repeated rows are encoded each. Other columns of
    ``docs`` don't pass; an empty table gives no rows. Texts stream through in Arrow batches of bounded bytes; there is no shuffle.
    """
    vocabulary = send_vocabulary(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, sha, decoded, all_ids = [], [], [], []
                for text in part.column(1):
                    ids = codec.encode(text.as_py() or "")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join(map(codec.as_text.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(pa.array(ids, pa.int32()))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = pa.array([0, *_running(n)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total
