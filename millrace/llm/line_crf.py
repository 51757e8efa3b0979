"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import labelled_sample, ship, split_words

UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
#: Documents that the field is fitted on at most, all lines of each, and lines of a sequence: longer ones are cut into consecutive pieces.
FIT_DOCS, FIT_LINES = 1000, 64
N_FEATURES = 14
#: States: 0 content, 1 boilerplate.


def _drop(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    """What a line looks like. ``seen``: it repeats an earlier line of the text."""
    n, size = len(words), max(len(line), 1)
    upper, symbols, digits = _drop(line, UPPER) / size, _drop(line, SYMBOLS) / size, _drop(line, DIGITS) / size
    bangs = line.count(b"!") / max(n, 1)
    variety = len(set(words)) / max(n, 1)
    mean = size / max(n, 1)
    return [
        1.0, min(n, 40) / 40, float(n == 0), float(n < 4), min(upper, 0.5) * 2, float(upper > 0.3), min(symbols, 0.2) * 5, float(symbols > 0.05),
        min(digits, 0.3) * 3, min(bangs, 1.0), float(n >= 8 and variety < 0.35), variety if n >= 8 else 0.7, float(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')), float(seen) + min(mean, 30) / 30,
    ]


def lines_of(text: bytes) -> tuple[list[list[bytes]], np.ndarray, int]:
    """Words and features of each line that has a word, and the number of lines that equal an earlier one."""
    words, features, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        own = split_words(line)
        if own:
            again = line in seen
            repeats += again
            seen.add(line)
            words.append(own)
            features.append(line_features(line, own, again))
    return words, np.array(features, dtype=np.float64).reshape(-1, N_FEATURES), repeats


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best sequence of two states; of equal ones, content."""
    if not len(emissions):
        return []
    (t00, t01), (t10, t11) = transitions.tolist()
    rows = emissions.tolist()
    a, b = rows[0]
    back = []
    for e0, e1 in rows[1:]:
        from0, from1 = (0, 1)[b + t10 > a + t00], (0, 1)[b + t11 > a + t01]
        back.append((from0, from1))
        a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
    state = int(b > a)
    path = [state]
    for pair in reversed(back):
        state = pair[state]
        path.append(state)
    return path[::-1]


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.3, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by gradient ascent, all sequences at once (padded). Returns emission weights and transitions."""
    weights, transitions = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not sequences:
        weights[:, 1] = -1e-9
        return weights, transitions
    longest = max(len(y) for _, y in sequences)
    x = np.zeros((len(sequences), longest, N_FEATURES))
    y = np.zeros((len(sequences), longest), dtype=np.int64)
    mask = np.zeros((len(sequences), longest), dtype=bool)
    for k, (f, s) in enumerate(sequences):
        x[k, : len(s)], y[k, : len(s)], mask[k, : len(s)] = f, s, True
    real = np.eye(2)[y] * mask[..., None]
    pair_mask = mask[:, 1:]
    real_pairs = np.einsum("kti,ktj,kt->ij", np.eye(2)[y[:, :-1]], np.eye(2)[y[:, 1:]], pair_mask)
    total = mask.sum()
    for _ in range(steps):
        e = x @ weights
        forward = np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            forward[:, t] = e[:, t] + np.logaddexp(forward[:, t - 1, :1] + transitions[0], forward[:, t - 1, 1:] + transitions[1])
        backward = np.zeros_like(e)
        for t in range(longest - 2, -1, -1):
            step = e[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(transitions[:, 0] + step[:, :1], transitions[:, 1] + step[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        joint = forward + backward
        z = np.logaddexp(joint[..., 0], joint[..., 1])
        marginal = np.exp(joint - z[..., None]) * mask[..., None]
        pairs = forward[:, :-1, :, None] + transitions + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
        pairs = np.exp(pairs - z[:, :1, None, None]) * pair_mask[..., None, None] if longest > 1 else np.zeros((len(x), 0, 2, 2))
        weights += rate * (np.einsum("ktf,kts->fs", x, real - marginal) / total * 4 - ridge * weights)
        transitions += rate * ((real_pairs - pairs.sum((0, 1))) / total * 4 - ridge * transitions)
    return weights, transitions


def training_sequences(sample: list[tuple[int, str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Line sequences with labels: those of good documents are content, those of bad ones boilerplate (but for a bad document's
    lines that look like any good one's, which the fit evens out). Each bad document stands between two halves of a good one,
    so that the field learns how runs of either kind follow each other. All lines are used; a sequence has at most FIT_LINES of them."""
    good, bad = ([(d, lines_of(t.encode())[1]) for d, t, label in sample if label == want] for want in (1, 0))
    good, bad = ([f for _, f in x if len(f)] for x in (good, bad))
    out = []
    for k, f in enumerate(bad):
        host = good[k % len(good)] if good else f[:0]
        half = (len(host) + 1) // 2
        out.append((np.concatenate([host[:half], f, host[half:]]), np.repeat([0, 1, 0], [half, len(f), len(host) - half])))
    out += [(f, np.zeros(len(f), dtype=np.int64)) for f in good[len(bad) : 3 * len(bad) + 50]]
    return [(f[at : at + FIT_LINES], y[at : at + FIT_LINES]) for f, y in out for at in range(0, len(y), FIT_LINES)]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    a = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    base = len(codes)
    if base < 2_000_000:
        windows = (a[:-2] * base + a[1:-1]) * base + a[2:]
    else:
        windows = np.unique(a[:-2] * base + a[1:-1], return_inverse=True)[1] * base + a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``limit`` labelled documents (labels: doc_id, quality 0 or 1). Without labels of both kinds the field
    knows nothing and calls every line content."""
    sample = labelled_sample(docs, labels, "quality", limit)
    both = len({label for _, _, label in sample}) == 2
    return fit(training_sequences(sample) if both else [])


def judge_lines(docs: DataFrame, weights: np.ndarray, transitions: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_words: int = 50, repeat_percent: int = 50, min_share: float = 0.5) -> DataFrame:
    """Base counts and the verdict for every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, content_share, kept, and the columns of ``carry``.

    A document is kept if it passes the base rules and content lines hold at least ``min_share`` of its words. Null and empty
    texts have zeros, fail the base rules and aren't kept. Repeated rows are judged each; an empty table gives no rows. Columns of ``carry`` with a result's
    name are left out. No shuffle; texts stream in batches.
    """
    ship(docs.sparkSession)
    carry = tuple(c for c in carry if c not in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).cast(pa.binary()):
                text = value.as_py() or b""
                lines, features, dup = lines_of(text)
                words = text.split()
                n = len(words)
                chars = len(b"".join(words).decode())
                repeat = repeated_words(words)
                path = viterbi(features @ weights, transitions)
                content = sum(len(w) for w, state in zip(lines, path) if not state)
                share = content / n if n else 0.0
                failed = n < min_words or 100 * repeat > repeat_percent * n
                rows.append((n, chars, _drop(text, SYMBOLS), dup, repeat, failed, len(lines), share, not failed and share >= min_share))
            columns = [list(c) for c in zip(*rows)] or [[] for _ in kinds]
            fixed = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fixed, *(batch.column(2 + k) for k in range(len(carry)))], names=names)

    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.bool_()]
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "content_share", "kept"]
    carry = tuple(c for c in carry if c not in made)
    types = dict(docs.dtypes)
    names = [id_col, *made, *carry]
    schema = ", ".join([f"`{id_col}` {types[id_col]}", *(f"{c} {t}" for c, t in zip(made, ["long"] * 5 + ["boolean", "long", "double", "boolean"])), *(f"`{c}` {types[c]}" for c in carry)])
    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, weights: np.ndarray, transitions: np.ndarray, text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that judge_lines keeps, whole and with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    min_words, repeat_percent, min_share = rules.get("min_words", 50), rules.get("repeat_percent", 50), rules.get("min_share", 0.5)

    def keeps(text: bytes) -> bool:
        words = text.split()
        if len(words) < min_words or 100 * repeated_words(words) > repeat_percent * len(words):
            return False
        lines, features, _ = lines_of(text)
        path = viterbi(features @ weights, transitions)
        return sum(len(w) for w, state in zip(lines, path) if not state) >= min_share * len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keeps(v.as_py() or b"") for v in batch.column(at).cast(pa.binary())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
