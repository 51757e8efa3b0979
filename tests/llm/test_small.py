"""Nulls, empty texts, ties, repeated rows, empty tables and extra columns, for every operator; exact expectations on small tables."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import block_knn, components, line_crf, lm_scoring, mixing, partenum, preference, sentencepiece_bpe, site_quality, url_filter, wordpiece_count

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, target string, p double, label int, component_id long, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward documents: columns of clashing names, null ids and texts, copies, blanks, one long text."""
    long = " ".join(f"w{i % 977} and" for i in range(30_000)) + ".\n"
    texts = [None, "", " \n\t", "one", "a b c d e f g h.", "a b c d e f g h.", "A b C d e f g h.", "\x00é 中\u3000x ▁ <s>", long, "word " * 80]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, 7, "x", "y", 0.5, 1, 3, "z") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here at all", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# ---- op1


def test_pieces_as_the_library_makes_them(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = sentencepiece_bpe.PieceCodec(sentencepiece_bpe.read_vocabulary(PIECES))
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeinrst  \n\t▁é<>0x1AFß中\u200b😀thng.,'") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for t in [*texts, "a" * 3000, "the" * 2000, " " * 500, "\x00", "\r\n"]:
        ids = sp.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
    assert codec.decode([1, 0, 2]) == sp.decode([1, 0, 2])
    out = sentencepiece_bpe.encode_documents(docs, PIECES, with_ids=True).collect()
    assert len(out) == docs.count()
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in out:
        ids = sp.encode(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(none, PIECES).count() == 0


# ---- op2


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "extra") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, side string")


def test_prompt_is_the_longest_common_prefix(spark):
    pairs = spark.createDataFrame(
        [(1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "q2"),
         (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", ""), (3, "chosen", 0, "user", "only"), (4, "chosen", 0, "user", "a"), (4, "chosen", 1, "user", "b"), (4, "rejected", 1, "user", "b"), (None, "chosen", 0, "user", "x")],
        "pair_id long, side string, turn long, role string, text string",
    )
    show = lambda *turns: "".join(f"<|{r}|>\n{x}\n" for r, x in turns)
    out = sorted(map(tuple, preference.format_pairs(pairs).collect()))
    length = lambda *turns: len(show(*turns))
    good, bad, more, a, b = ("assistant", "good"), ("assistant", "bad"), ("user", "q2"), ("user", "a"), ("user", "b")
    assert out == [
        (1, 0, show(("user", "q")), show(good), show(bad, more), f"{length(good)}:1", f"{length(bad)}:1,{length(more)}:0"),
        (2, 0, show(("user", "")), "", "", "", ""),
        (3, 0, "", show(("user", "only")), "", f"{length(('user', 'only'))}:0", ""),
        (4, 0, "", show(a, b), show(b), f"{length(a)}:0,{length(b)}:0", f"{length(b)}:0"),
    ]


def test_turns_agree_by_all_their_rows(spark):
    """Rows of one turn number agree if both sides have the same ones; no text is lost, and role and text don't run together."""
    rows = [(1, "chosen", 0, "user", x) for x in "abc"] + [(1, "rejected", 0, "user", x) for x in "axc"]
    rows += [(2, "chosen", 0, "user", x) for x in "ab"] + [(2, "rejected", 0, "user", x) for x in "bba"]
    rows += [(3, "chosen", 0, "a\x01b", "c"), (3, "rejected", 0, "a", "b\x01c")]
    out = {r["pair_id"]: r for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert out[1]["prompt"] == "" and out[1]["chosen"].count("<|user|>") == out[1]["rejected"].count("<|user|>") == 3 and "x" in out[1]["rejected"]
    assert out[2]["prompt"] == "<|user|>\na\n<|user|>\nb\n" and out[2]["chosen"] == out[2]["rejected"] == ""
    assert out[3]["prompt"] == "" and out[3]["chosen"] != out[3]["rejected"]


def test_long_pairs_come_in_blocks(spark):
    rows = [(1, side, i, "assistant" if i % 2 else "user", f"{side if i > 100 else ''}{i}") for side in ("chosen", "rejected") for i in range(150)]
    out = sorted((r["block"], r["prompt"], r["chosen"], r["rejected"], r["chosen_mask"]) for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect())
    assert [r[0] for r in out] == [0, 1, 2]
    show = lambda side: "".join(f"<|{'assistant' if i % 2 else 'user'}|>\n{side if i > 100 else ''}{i}\n" for i in range(150))
    assert "".join(r[1] for r in out) + "".join(r[2] for r in out) == show("chosen") and "".join(r[1] for r in out) + "".join(r[3] for r in out) == show("rejected")
    lengths = [tuple(map(int, x.split(":"))) for r in out if r[4] for x in r[4].split(",")]
    assert sum(n for n, _ in lengths) == sum(len(r[2]) for r in out) and [m for _, m in lengths] == [i % 2 for i in range(101, 150)]


def test_negative_replies(spark):
    t = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (5, 0, "user", "p"), (5, 1, "assistant", "r2"), (5, 2, "user", "thanks"), (9, 0, "user", "alone"), (None, 0, "user", "x"), (1, 0, "user", "q")])
    rows = sorted((r["pair_id"], r["side"], r["turn"], r["text"]) for r in preference.with_negative_replies(t).collect())
    assert rows == [(1, "chosen", 0, "q"), (1, "chosen", 0, "q"), (1, "chosen", 1, "r1"), (1, "rejected", 0, "q"), (1, "rejected", 0, "q"), (1, "rejected", 1, "r2"), (5, "chosen", 0, "p"), (5, "chosen", 1, "r2"), (5, "chosen", 2, "thanks"), (5, "rejected", 0, "p"), (5, "rejected", 1, "r1"), (9, "chosen", 0, "alone"), (9, "rejected", 0, "alone")]
    assert preference.format_pairs(preference.with_negative_replies(t.limit(0))).count() == 0
    many = turns(spark, [(i * 7, 0, "assistant", f"r{i}") for i in range(60)])
    out = preference.with_negative_replies(many, bucket_rows=9).where("side = 'rejected'").collect()
    assert len(out) == 60 and len({r["text"] for r in out}) == 60 and sum(r["text"] == f"r{r['pair_id'] // 7}" for r in out) <= 3


# ---- op3


def test_sites_shrink_to_their_parents(spark, docs, none):
    model = site_quality.fit_logistic(np.array([site_quality.features(t) for t in (b"Good text here. " * 9, b"A fine line.\n" * 4, b"BUY!! NOW!! " * 9, b"x | y | z | " * 9)]), np.array([1.0, 1, 0, 0]))
    out = by_id(site_quality.classify(docs, model, F.col("source"), F.col("lang")))
    assert len(out) == docs.count() and all(0 <= r["quality"] <= 1 and r["kept"] == (r["quality"] >= 0.5) for r in out)
    assert site_quality.classify(none, model, F.col("source"), F.col("lang")).count() == 0
    flat = by_id(site_quality.classify(docs, None, F.col("source"), F.col("lang")))
    assert {round(r["quality"], 6) for r in flat} == {0.5}
    assert site_quality.filter_documents(docs, None, F.col("source"), F.col("lang")).columns == docs.columns


def test_posteriors_equal_plain_sums(spark):
    """Many sparse sites, null ones and repeated rows, held against sums over lists."""
    rng = random.Random(21)
    texts = ["A good line of plain words stands here and goes on for a while.", "BUY!! NOW!! CHEAP!! PILLS!!", "half a text", "x | y | z", None]
    hosts = [rng.choice([None, "big", "big", f"h{rng.randrange(60)}"]) for _ in range(400)]
    rows = [(i // 2 if i % 9 == 0 else i, texts[0] if rng.random() < (0.95, 0.05)[len(h or "") % 2] else rng.choice(texts), h, rng.choice([None, "en", "de"])) for i, h in enumerate(hosts)]
    model = site_quality.fit_logistic(np.array([site_quality.features((t or "").encode()) for t in texts[:1] * 20 + texts[1:] * 5]), np.array([1.0] * 20 + [0.0] * 20))
    out = site_quality.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3), model, F.col("source"), F.col("lang")).collect()
    w, mean, dev = model
    odds = [float(np.clip((np.array(site_quality.features((t or "").encode())) - mean) / dev @ w, -site_quality.CLIP, site_quality.CLIP)) for _, t, _, _ in rows]
    p = [1 / (1 + np.exp(-x)) for x in odds]
    overall = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)

    def totals(keys):
        out = {}
        for key, x in zip(keys, p):
            n, total = out.get(key, (0, 0.0))
            out[key] = n + 1, total + x
        return out

    def strength(sites, parent):
        n = sum(n for n, _ in sites.values())
        between = sum(m * (t / m - parent(k)) ** 2 for k, (m, t) in sites.items())
        chance = sum(t / m * (1 - t / m) for m, t in sites.values())
        unit = sum(m * parent(k) * (1 - parent(k)) for k, (m, _) in sites.items())
        return min(max(unit / n / max((between - chance) / n, 1e-6) - 1, 1.0), 1000.0)

    hosts, paths = totals([h for _, _, h, _ in rows]), totals([(h, x) for _, _, h, x in rows])
    m_host = strength(hosts, lambda _: overall)
    m_path = strength(paths, lambda k: (hosts[k[0]][1] + m_host * overall) / (hosts[k[0]][0] + m_host))
    inside = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    want = []
    for (i, _, h, x), own, odd in zip(rows, p, odds):
        host = inside((hosts[h][1] - own + m_host * overall) / (hosts[h][0] - 1 + m_host))
        path = inside((paths[h, x][1] - own + m_path * host) / (paths[h, x][0] - 1 + m_path))
        quality = 1 / (1 + np.exp(-(odd + np.log(path / (1 - path)) - np.log(overall / (1 - overall)))))
        want.append((i, own, host, path, quality))
    for got, expected in zip(sorted((r["doc_id"], r["doc_prob"], r["host_prior"], r["path_prior"], r["quality"]) for r in out), sorted(want)):
        assert got == pytest.approx(expected, rel=1e-9)
    assert 1 < m_host < 1000 or 1 < m_path < 1000


def test_rows_are_rejected_by_themselves(spark):
    """Of one id only the bad text goes, and a bad text without id goes too."""
    good, bad = "A good line of plain words stands here and goes on for a while. " * 5, "BUY!! NOW!! CHEAP!! PILLS!! " * 12
    model = site_quality.fit_logistic(np.array([site_quality.features(t) for t in (good.encode(), b"A fine line.\n" * 4, bad.encode(), b"x | y | z | " * 9)]), np.array([1.0, 1, 0, 0]))
    rows = [(1, good), (1, bad), (None, bad), (None, good), (2, good)]
    kept = site_quality.filter_documents(spark.createDataFrame(rows, "doc_id long, text string"), model, F.lit("h"), F.lit("p"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, good), (None, good), (2, good)], key=str)


# ---- op4


def plain_losses(corpus, words):
    """The mean loss of some words by a model that is counted with plain dictionaries."""
    code = lambda text: [lm_scoring.word_class(w.encode()) for w in text]
    corpus, words = [code(t) for t in corpus], code(words)
    uni, bi, before = collections.Counter(), collections.Counter(), collections.Counter()
    for t in corpus:
        uni.update(t)
        bi.update(zip([None, *t], t))
        before.update([None, *t][: len(t)])
    p = lambda w: (uni[w] + lm_scoring.ADD) / (sum(uni.values()) + lm_scoring.ADD * lm_scoring.CLASSES)
    return -sum(np.log((bi[h, w] + lm_scoring.PRIOR * p(w)) / (before[h] + lm_scoring.PRIOR)) for h, w in zip([None, *words], words)) / len(words)


@pytest.mark.parametrize("hot, bucket", [(2e-6, 1_000_000), (2.0, 5), (0.05, 3)])
def test_losses_equal_plain_counts(spark, docs, none, monkeypatch, hot, bucket):
    """With and without hot bigrams, in one bucket and in many, over the background itself and over other documents."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", f"r{rng.randrange(400)}"]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(150)] + [None, "", " ", "once only", "a b " * 300, "once only"]
    ground = spark.createDataFrame([(None if i == 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    goal = ["a b r1 r2 c", "a b a b c", None]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    other = spark.createDataFrame([("x", "a b unseen c r3"), ("y", None), ("x", "once only")], "doc_id string, text string")
    split = lambda rows: [(t or "").split() for t in rows]
    models = lm_scoring.fit(target, ground)
    for df, want in ((ground, texts), (other, ["a b unseen c r3", None, "once only"])):
        out = lm_scoring.score(df, models).collect()
        assert len(out) == len(want)
        expected = []
        for r in df.collect():
            w = (r["text"] or "").split()
            expected.append((str(r["doc_id"]), len(w), *((plain_losses(split(goal), w), plain_losses(split(texts), w)) if w else (-1, -1))))
        found = [(str(r["doc_id"]), r["n_tokens"], *((r["target_loss"], r["background_loss"]) if r["n_tokens"] else (-1, -1))) for r in out]
        for x, y in zip(sorted(found), sorted(expected)):
            assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-5)
        assert all(r["score"] is None if not r["n_tokens"] else r["score"] == r["target_loss"] - r["background_loss"] for r in out)


def test_models_of_awkward_tables(docs, none):
    models = lm_scoring.fit(none, docs)
    assert lm_scoring.score(docs, models).count() == docs.count() and lm_scoring.score(none, models).count() == 0
    out = lm_scoring.score(docs, lm_scoring.fit(none, none)).collect()
    assert len(out) == docs.count() and {round(r["target_loss"], 4) for r in out if r["n_tokens"]} == {round(float(np.log(lm_scoring.CLASSES)), 4)}


def test_packed_columns():
    x, y, z = np.array([0, 1, (1 << 41) - 1]), np.array([0, 65535, 7]), np.array([-5, 2**62, 0])
    assert all(map(np.array_equal, lm_scoring.unpack(lm_scoring.pack((x, 6), (y, 2), (z, 8)), 6, 2, 8), (x, y, z)))


# ---- op5


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[50:120] = v[7]
    rows = [(i, x.tolist(), "q") for i, x in enumerate(v)] + [(1000, None, "q"), (1001, [], "q"), (1002, [0.0] * 8, "q"), (1003, [float("nan")] * 8, "q"), (1004, [None] + [1.0] * 7, "q"), (1005, [float("inf")] * 8, "q"), (None, [1.0] * 8, "q"), (1100, [1.0, 2.0], "q"), (1200, [1.0, 3.0], "q"), (5, v[5].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    out = {}
    for r in block_knn.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x, ids = np.concatenate([v, v[5:6]]).astype(np.float64), [*range(400), 5]
    for q in (0, 100, 200, 300):
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x[q], x[j])))), ids[j]) for j in range(401) if ids[j] != q)[:10]
        assert [(i, s) for _, i, s in sorted(out[q])] == [(i, s) for s, i in d]
    assert [i for _, i, _ in out[1100]] == [1200] and set(out) == {0, 100, 200, 300, 1100, 1200}
    assert block_knn.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    for a_scale, b_scale in ((1.0, 100.0), (1e200, 1e200), (1e-200, 1.0), (1e150, 1e-150)):
        a, b = rng.normal(size=(30, 1500)) * a_scale, rng.normal(size=(40, 1500)) * b_scale
        b[:5] = a[:5] * (1 + 1e-9) if a_scale == b_scale else b[:5]
        q, x = block_knn.quantise(a), block_knn.quantise(b)
        unit = max(a_scale, b_scale)
        true = np.sqrt(((a[:, None] / unit - b[None] / unit) ** 2).sum(2)) * unit
        low, high = block_knn.distance_bounds(q, x)
        assert (block_knn.products(q[0], x[0]) == q[0].astype(np.int64) @ x[0].astype(np.int64).T).all()
        assert (low <= true).all() and (true <= high).all() and np.isfinite(low).all()


def test_bounds_are_merged_without_loss():
    """A stream of candidates in order of their lower bounds keeps all that may be among the nearest."""
    rng = random.Random(5)
    for _ in range(300):
        true = sorted(rng.randrange(50) for _ in range(rng.randint(1, 40)))
        rows = sorted((d - rng.randrange(4), d + rng.randrange(4), d) for d in true)
        merge = block_knn.Merge(5)
        kept = sorted(d for low, high, d in rows if merge.admits(low, high))
        assert kept[:5] == true[:5]


def test_large_components_and_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(block_knn, "TILE_CANDIDATES", 40)
    monkeypatch.setattr(block_knn, "TILE_QUERIES", 2)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(220, 6))
    v[:110] *= 1e120  # squares of these are near the end of doubles
    v[110:] *= 1e-120
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1e200] * 6), (901, [1.0e200] * 5 + [0.0])]
    found = {}
    for r in block_knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0, k=7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    with np.errstate(over="ignore"):
        for q in [*range(0, 220, 30), 900]:
            own = dict(rows)[q]
            want = sorted((float(np.sqrt(sum(np.float64((a - b) * (a - b)) for a, b in zip(own, x)))), i) for i, x in rows if i != q)[:7]
            assert [(s, i) for _, i, s in sorted(found[q])] == want


# ---- op6


def naive_count(word, initial, continuing):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (initial if not at else continuing)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n if len(word) <= wordpiece_count.MAX_CHARS else 0


def test_counts_equal_greedy_matching(docs, none):
    rng = random.Random(5)
    for _ in range(60):
        initial = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        continuing = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)}
        m = wordpiece_count.LongestMatch(initial, continuing)
        for n in range(7):
            for w in itertools.islice(map("".join, itertools.product("abc", repeat=n)), 300):
                assert m.count(w) == naive_count(w, initial, continuing), (w, initial, continuing)
    initial, continuing = wordpiece_count.pieces_of((p, k) for p, _, k in sentencepiece_bpe.read_vocabulary(PIECES))
    out = wordpiece_count.count_word_pieces(docs, initial, continuing).collect()
    want = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    a, b = set(initial), set(continuing)
    for r in out:
        counts = [naive_count(w.decode(), a, b) for w in want[r["doc_id"]]]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    assert len(out) == docs.count() and wordpiece_count.count_word_pieces(none, initial, continuing).count() == 0


def test_long_words_are_cut_too(spark):
    """Words of any length are their pieces; only what can't be cut is unknown."""
    assert wordpiece_count.LongestMatch({"ab"}, {"abc", "b"}).count("ab" + "abcb" * 50_000) == 100_001
    df = spark.createDataFrame([(1, "ab" + "abc" * 40 + " ab" + "abc" * 40 + "z ab")], "doc_id long, text string")
    assert [tuple(r) for r in wordpiece_count.count_word_pieces(df, ["ab"], ["abc"]).collect()] == [(1, 3, 43, 1)]


# ---- op7


def test_mix_meets_targets(spark, docs, none):
    out = mixing.systematic_mix(docs).collect()
    assert len(out) == docs.count() and sum(r["size"] for r in out) == sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert mixing.systematic_mix(none).count() == 0
    rng = np.random.default_rng(4)
    rows = [(int(i), "w " * int(rng.integers(0, 60)), None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.systematic_mix(df, cell_rows=200).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect())) for _ in range(2))
    assert a == b
    sums = {}
    for _, source, size, source_size, target, copies, taken in a:
        assert taken == copies * size and copies <= 3
        s = sums.setdefault(source, [0, 0, target, source_size])
        s[0] += taken
        s[1] += size
    total = sum(s[1] for s in sums.values())
    weight = {k: i % 3 + 1 for i, k in enumerate(sorted((k for k in sums if k is not None)))}
    weight[None] = len(weight) % 3 + 1
    want, left, rest = {}, total, dict(weight)
    while True:  # stop at the limit, share the rest again
        share = {k: left * w / sum(rest.values()) for k, w in rest.items()}
        over = [k for k in rest if share[k] > 3 * sums[k][1]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sums[k][1]
            left -= want[k]
            del rest[k]
    for k, (taken, size, target, source_size) in sums.items():
        assert source_size == size and target == pytest.approx(want[k]) and abs(taken - target) <= 130
    clash = df.withColumn("size", F.lit("own")).withColumn("target", F.lit(-1)).withColumn("taken", F.lit("t"))
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.expand(clash).collect()} == {("own", -1, "t")} and mixing.expand(clash).columns == clash.columns
    mixed = mixing.expand(df)
    assert mixed.columns == df.columns and mixed.count() == mixing.systematic_mix(df).agg(F.sum("copies")).first()[0]


# ---- op8


def brute_components(rows, percent=80, k=5):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(sets)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def near_texts(rng, n, groups):
    out = []
    for g in range(groups):
        base = [f"t{g}x{rng.randint(0, 10**9)}" for _ in range(rng.choice([3, 6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(rng.randint(1, n)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"n{rng.randint(0, 10**9)}"] * rng.randint(0, 2)
                w = w or ["z"]
            out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark, docs, none):
    rng = random.Random(8)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = near_texts(rng, 7, 40) + [passage + " " + " ".join(f"p{i}q{j}" for j in range(20)) for i in range(60)] + [None, "", " ", "a b", "A B", "a b c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect())
    assert out == brute_components(rows)
    found = partenum.near_duplicates(docs)
    assert found.count() == docs.count() and partenum.near_duplicates(none).count() == 0
    assert {r["doc_id"]: r["component_id"] for r in found.where("doc_id between 3 and 7").collect()} == {3: 3, 4: 4, 5: 4, 6: 4, 7: 7}
    a, b, near = (" ".join(f"{x}{i}" for i in range(60)) for x in "aby")
    near = a.replace("a59", "other")
    rows = [(5, a, 1), (5, b, 2), (5, b, 3), (7, near, 4), (None, near, 5), (None, "lone words here", 6), (None, None, 7), (9, "", 8), (8, b, 9), (5, "five is alone", 10)]
    single = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert {r["row"] for r in single} - {2, 3} == {1, 6, 7, 8, 10} and len({r["row"] for r in single} & {2, 3}) == 1
    once = partenum.keep_one(docs)
    assert sorted(r["doc_id"] for r in once.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 7, 8, 9] and once.columns == docs.columns


def test_large_signature_groups(spark, monkeypatch):
    """Groups of near copies larger than one chunk, so that tiles and their second pass work."""
    monkeypatch.setattr(partenum, "CHUNK", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(150):  # a chain of drifting copies and a crowd around the first
        w = list(base)
        for k in range(i // 10 if i < 75 else rng.randint(0, 3)):
            w[(k * 11 + i // 10) % 70] = f"x{i // 10}y{k}"
        rows.append((i, " ".join(w) + f" e{i % 9}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect())
    assert out == brute_components(rows)


def test_forests_join_what_can_be_joined():
    rng = np.random.default_rng(1)
    for _ in range(100):
        m = int(rng.integers(1, 14))
        i, j = np.nonzero(np.triu(rng.random((m, m)) < 0.25, 1))
        label = rng.integers(0, 9, m)
        apart = rng.integers(1, 9, len(i)).astype(float)
        taken = partenum.forest(i, j, apart, label)

        def parts(pairs):
            group = list(range(m))
            for x, y in pairs:
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]  # noqa: B023
            return [[g == h for h in group] for g in group]

        same = [(x, y) for x in range(m) for y in range(m) if label[x] == label[y]]
        edges = list(zip(i.tolist(), j.tolist()))
        assert parts([*same, *(edges[t] for t in taken)]) == parts([*same, *edges])
        trees = len({tuple(x) for x in parts(same)}) - len({tuple(x) for x in parts([*same, *edges])})
        assert len(taken) == trees


def similar_pairs(rng):
    """Pairs of sets of many sizes, at the threshold and around it."""
    for n in [*range(4, 40)] * 12 + [60, 100, 250] * 40 + [900, 4000] * 4:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        more = int(rng.integers(0, n // 3 + 2))
        b = np.unique(np.concatenate((a[: n - int(rng.integers(0, more + 1))], rng.integers(0, 2**63, more, dtype=np.uint64))))
        a = np.unique(a)
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= 80 * (len(a) + len(b) - o) and o < max(len(a), len(b)):
            yield a, b, o


def test_similar_sets_share_signatures(monkeypatch):
    for levels in (partenum.LEVELS, 1):  # 1: empty parts are signed at once
        monkeypatch.setattr(partenum, "LEVELS", levels)
        tried = 0
        for a, b, o in similar_pairs(np.random.default_rng(6)):
            tried += 1
            shared = np.intersect1d(partenum.signatures(a, 80), partenum.signatures(b, 80))
            bands, counts = np.unique(shared & np.uint64(255), return_counts=True)
            assert any(c >= partenum.band(int(i), 80)[2] for i, c in zip(bands, counts))
            sizes = np.array([len(a), len(b)])
            assert partenum.differences(sizes[:1], [partenum.parity(a)], sizes[1:], [partenum.parity(b)], 80)[0, 0] <= len(a) + len(b) - 2 * o
        assert tried > 100


def test_common_signatures_are_left_out_safely(spark):
    """Among many sets, each pair that shares ``needed`` signatures of a band keeps a common one."""
    rng = random.Random(12)
    needed = partenum.band(12, 80)[2]
    assert needed > 1
    sets = {f: {rng.choice([rng.randrange(8), rng.randrange(60)]) for _ in range(rng.randint(2, 25))} for f in range(60)}
    rows = [(256 * x + 12, f) for f, s in sets.items() for x in s for _ in range(rng.randint(1, 2))]
    left = {}
    for r in partenum._shared(spark.createDataFrame(rows, "sig long, fp long"), 80).collect():
        left.setdefault(r["fp"], set()).add(r["sig"])
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= needed]
    assert pairs and all(left[a] & left[b] for a, b in pairs)
    assert sum(map(len, left.values())) < sum(map(len, sets.values()))


@pytest.mark.parametrize("held", [7, 40])
def test_groups_in_pieces(spark, monkeypatch, held):
    """Groups too large for a task's memory come in pieces; the components stay the same."""
    monkeypatch.setattr(partenum, "HELD", held)
    monkeypatch.setattr(partenum, "CHUNK", 16)
    cut = [x for x in partenum._runs(iter([pa.record_batch([pa.array([1] * 50 + [2] * 3), pa.array([*range(49), 48, 1, 2, 2])], names=["sig", "fp"]), pa.record_batch([pa.array([2, 3]), pa.array([2, 9])], names=["sig", "fp"])]), held)]
    assert [f for sig, fp, _ in cut for f in zip(sig.tolist(), fp.tolist())] == [*((1, i) for i in range(49)), (2, 1), (2, 2), (3, 9)]
    rng = random.Random(10)
    base = [f"b{i}" for i in range(70)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{i}" for w in base) + f" e{i % 9}") for i in range(140)]
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect())
    assert out == brute_components(rows)


def test_shingles_of_long_texts():
    rng = random.Random(1)
    text = "".join(rng.choice(["Ab ", "cd\n", "é\t", "x" * 30 + " "]) + (str(i) if i % 50 == 0 else "") for i in range(400_000)).encode()
    words = text.lower().split()
    assert len(text) > 2 * partenum.BLOCK and len(next(partenum.shingle_sets([text], 5))) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_words_longer_than_blocks():
    """A word is one, wherever blocks end in it; near copies share its shingles."""
    size = lambda text: len(next(partenum.shingle_sets([text], 5)))
    long = (b"0123456789aBcDeF" * (3 << 16))[: 3 * partenum.BLOCK - 77]
    assert size(b"a b c " + long) == size(b"a b c " + long + b" ") == 1 and size(b"a b c d " + long + b" e") == 2
    words = [f"w{i}".encode() for i in range(20)]
    a, b = partenum.shingle_sets([b" ".join([*words, long]), b" ".join([b"w0x", *words[1:], long])], 5)
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (17, 17, 16)
    for n in range(partenum.BLOCK - 3, partenum.BLOCK + 4):  # words that end, start and stand alone around the end of a block
        text = b"x" * n + b" yy " + b"z" * partenum.BLOCK + b"\tq r s t"
        assert size(text) == 3 and len(np.intersect1d(next(partenum.shingle_sets([text], 5)), next(partenum.shingle_sets([b"p " + text], 5)))) == 3


def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for small in (components.SMALL, 0):
        out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(3), small=small).collect()}
        assert out == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op9


def test_url_rules_and_vocabulary(spark):
    urls = [
        ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/porn", "m.example.com", "/en/porn", "example.com/en/", "block"),
        ("https://a.com/porn", "a.com", "/porn", "com/", "allow"),
        ("https://a.com?x", "a.com", "", None, "allow"),
        ("https://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("https://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("https://xnet/fr/", "xnet", "/fr/", None, "allow"),
        ("https://a.org/xxx", "a.org", "/xxx", None, "block"),
        ("https://a.org/xxxx", "a.org", "/xxxx", None, "allow"),
        ("https://a.org/casino", "a.org", "/casino", None, "allow"),
        ("https://a.org/casino/casino", "a.org", "/casino/casino", None, "allow"),
        ("https://a.org/casino-POKER", "a.org", "/casino-POKER", None, "block"),
        ("no scheme/porn", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a://b#c/d", "b", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in by_id(url_filter.filter_urls(df), "page_id")] == [u[1:] for u in urls]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.filter_urls(df, (), {}).where("verdict = 'block'").count() == 0
    weights = url_filter.read_weights(spark.createDataFrame([("Odd", 40), ("odd", 30), ("even", 60), ("", 9), ("none", 0)], "term string, weight int"))
    assert weights == {"odd": 40, "even": 60}
    found = by_id(url_filter.filter_urls(spark.createDataFrame([(1, "http://x/odd/odd"), (2, "http://x/odd-EVEN"), (3, "http://x/evens/odd")], "page_id long, url string"), (), weights), "page_id")
    assert [(r["verdict"], r["n_strict"], r["n_soft"], r["weight"]) for r in found] == [("allow", 0, 1, 40), ("block", 0, 2, 100), ("allow", 0, 1, 40)]


# ---- op10


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        e, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        worth = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert worth(line_crf.viterbi(e, t)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=n))))
    assert line_crf.viterbi(np.zeros((0, 2)), np.zeros((2, 2))) == [] and line_crf.viterbi(np.zeros((3, 2)), np.zeros((2, 2))) == [0, 0, 0]


def test_base_counts(spark, docs, none):
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        assert line_crf.repeated_words(w) == len(covered)
    weights, transitions = line_crf.fit([])
    out = by_id(line_crf.judge_lines(docs, weights, transitions))
    assert len(out) == docs.count() and line_crf.judge_lines(none, weights, transitions).count() == 0
    for r, (text,) in zip(out, [(r["text"] or "",) for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))]):
        words = text.encode().split()
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), len(b"".join(words).decode()), sum(text.count(c) for c in "#*$%&|<>"))
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    lines = spark.createDataFrame([(1, "x y\nx y\n\n \nz\nx y")], "doc_id long, text string")
    assert line_crf.judge_lines(lines, weights, transitions).first()["n_dup_lines"] == 2
    kept = line_crf.filter_documents(docs, weights, transitions)
    judged = line_crf.judge_lines(docs, weights, transitions)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged.where("kept").collect())


def test_fit_follows_the_likelihood(monkeypatch):
    """The gradient is that of the likelihood, which all label sequences of small cases are summed up for."""
    rng = np.random.default_rng(9)
    sequences = [(rng.normal(size=(n, line_crf.N_FEATURES)), rng.integers(0, 2, n)) for n in (1, 2, 3, 5)]

    def likelihood(weights, transitions):
        out = 0.0
        for x, y in sequences:
            e = x @ weights
            worth = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            out += worth(y) - np.log(sum(np.exp(worth(p)) for p in itertools.product((0, 1), repeat=len(y))))
        return out / sum(len(y) for _, y in sequences) * 4

    w1, t1 = line_crf.fit(sequences, steps=1, rate=1.0, ridge=0.0)
    w2, t2 = line_crf.fit(sequences, steps=2, rate=1.0, ridge=0.0)
    for at, (dw, dt) in (((np.zeros_like(w1), np.zeros((2, 2))), (w1, t1)), ((w1, t1), (w2 - w1, t2 - t1))):
        for which, gradient in ((0, dw), (1, dt)):
            for k in np.ndindex(gradient.shape):
                up, down = ([m.copy() for m in at] for _ in range(2))
                up[which][k] += 1e-5
                down[which][k] -= 1e-5
                assert gradient[k] == pytest.approx((likelihood(*up) - likelihood(*down)) / 2e-5, abs=1e-6)
    assert likelihood(*line_crf.fit(sequences, ridge=0.0)) > max(likelihood(w2, t2), likelihood(w1, t1))


def test_labelled_samples_are_bounded(spark):
    from millrace.llm._common import LONGEST, labelled_sample

    rows = [(1, "b"), (1, "a"), (2, "x" * (LONGEST + 1)), (3, None), (4, "four"), (None, "n")]
    labels = spark.createDataFrame([(i, 1 if i == 1 else 0) for i in (1, 1, 2, 3, 4, None, 99)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert labelled_sample(docs, labels, "quality", 10) == [(1, "a", 1), (4, "four", 0)]
    assert len(labelled_sample(docs, labels, "quality", 1)) <= 1


def test_all_lines_of_the_sample_are_fitted():
    """Late lines of long documents are in the sequences, cut into consecutive pieces of bounded length."""
    good = [f"A plain line of words number {i} ends here." for i in range(700)]
    bad = [f"BUY {i} NOW" for i in range(900)]
    sequences = line_crf.training_sequences([(1, "\n".join(good), 1), (2, "\n".join(bad), 0), (3, "\n".join(good), 1)] + [(i, "\n".join(good), 1) for i in range(4, 6)])
    labels = np.concatenate([y for _, y in sequences])
    assert (labels == 1).sum() == 900 and (labels == 0).sum() == 4 * 700 and max(len(y) for _, y in sequences) <= 64
    found = np.concatenate([f for f, _ in sequences])
    want = [line_crf.lines_of("\n".join(x).encode())[1] for x in (good, bad)]
    assert np.array_equal(found[:1600], np.concatenate([want[0][:350], want[1], want[0][350:]]))
