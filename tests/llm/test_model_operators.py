import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from normweave.llm import bpe, langid, packing, quality, topk
from normweave.llm.components import components
from normweave.llm.common import Scratch

PARTS = ["a", "b", "é", "日本", "😀", " ", "  ", "\n", "\n ", "\t", "1", "23", "'s", "'ll", "...", "\x1c", "\x85", " the", " of", "　", "-", "\r\n", "<|endoftext|>"]


def test_bpe_matches_the_library():
    codec = bpe.Codec(bpe.default_ranks()["ranks"], bpe.default_ranks()["pattern"])
    want = tiktoken.Encoding("own", pat_str=bpe.default_ranks()["pattern"], mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    for text in ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]:
        ids, back = codec.coded(text)
        assert ids == ",".join(map(str, want.encode_ordinary(text))) and back == text.encode()
    for text in ("a" * 20_000, "ab" * 10_000, "".join(rng.choice("abcdeé") for _ in range(20_000))):
        assert codec.merge(text.encode()) == want.encode_ordinary(text)


def test_bpe_query(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Héllo  wörld"), (3, "Héllo  wörld")], "doc_id long, text string")
    rows = bpe.round_trip(df, **bpe.default_ranks()).collect()
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[2] == rows[3]
    assert bpe.encode_column(df, **bpe.default_ranks()).where("doc_id = 1").first()["ids"] == []


def test_packing_ids_match_the_library():
    path = packing.default_tokenizer()
    encode, whole = packing.encoder(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    for text in ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1000)]:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best(counts, capacity):
    """The least number of sequences, by search over all packings of a small instance."""
    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    least = len(items)

    def go(i, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if i == len(items):
            least = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                now = list(rooms)
                now.remove(r)
                go(i + 1, [*now, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return least


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.randint(1, 9)):
        s = rng.randint(1, 20)
        counts[s] = counts.get(s, 0) + 1
    fixed, left = packing.reduce_dominated(counts, 20)
    assert sum(n for _, n in fixed) + best(left, 20) == best(counts, 20)
    packed = packing.packing(counts, 20)
    seen = {}
    for sizes, n in packed:
        assert sum(sizes) <= 20
        for s in sizes:
            seen[s] = seen.get(s, 0) + n
    assert seen == counts and sum(n for _, n in packed) >= packing.lower_bound(counts, 20)


def test_packing_places(spark):
    rng = random.Random(9)
    texts = [" ".join("word" for _ in range(rng.randint(0, 400))) for _ in range(150)] + [None, "", "word " * 2500, "same text"] + ["same text"] * 20
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string")
    rows = packing.pack(df, tokenizer=packing.default_tokenizer(), part=7, with_ids=True).collect()
    assert {r.doc_id for r in rows} == {*range(len(texts)), None}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    counts = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(by) <= packing.lower_bound(counts, 1024) * 1.05 + 1
    assert packing.pack(df.where("false"), tokenizer=packing.default_tokenizer()).count() == 0


def test_language_spans(spark):
    en, de = "the house and the street are with this", "der Garten und die Straße sind nicht für"
    rows = [(i, " ".join(random.Random(i).sample(en.split(), 6)), "en") for i in range(60)] + [(i + 100, " ".join(random.Random(i).sample(de.split(), 6)), "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "text", "lang")
    asked = spark.createDataFrame([(1, f"{en} {en} {de} {de}", 1.0), (2, None, 2.0), (3, "123 !", 3.0), (4, "", 1.0), (5, "Γειά", 1.0), (6, en, 0.0), (7, "x\u00b2 \u00b9\u00b2 \u00bd", 0.0), (8, "\u00b9\u00b2 \u00bd 7", 0.0)], "doc_id long, text string, lang_score double")
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 6, 8)] == ["und", "und", "und", "en", "und"] and got[7].lang_pred != "und" and got[2].lang_score == 0 and got[5].lang_pred in ("en", "de")
    spans = [r for r in langid.spans(asked, model).collect() if r.doc_id == 1]
    assert [s.lang for s in spans] == ["en", "de"] and spans[1].start == 2 * len(en) + 2
    assert langid.identify(asked.where("false"), model).count() == 0
    nothing = langid.fit(df.where("false"), "text", "lang")
    assert {r.lang_pred for r in langid.identify(asked, nothing).collect()} == {"und"}


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_optimal(seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    scores = [rng.normal(size=(n, 3)) for n in (0, 5, 1, 6)]
    for s, p in zip(scores, langid.viterbi([x.astype(np.float32) for x in scores], 0.7)):
        worth = lambda q: sum(s[i, k] for i, k in enumerate(q)) - 0.7 * sum(a != b for a, b in zip(q, q[1:]))
        assert not len(s) or worth(p) == pytest.approx(max(map(worth, product(range(3), repeat=len(s)))), abs=1e-5)


def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["well", "written", "prose", "here"]) for _ in range(30)) + "." for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "###"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad)) + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i < 60) for i in range(100)) and 0 <= got[500] <= 1 and got[500] == got[501]
    none = quality.fit(df, labels.where("quality = 1"))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.where("false"), model).count() == 0


def test_quality_fit_takes_all_rows_and_pairs(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(14_000) < 0.9).astype(int)
    x = rng.normal(size=(len(y), quality.FEATURES)) + 0.3 * y[:, None] * (np.arange(quality.FEATURES) % 3)
    x[0] = 40.0  # a strength far from the others
    found = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, features array<double>")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, quality int")
    scratch = Scratch(spark, "test")
    model = quality.fit_features(found, labels, scratch=scratch)
    scratch.clear()
    # the gradient over every pair, pair by pair, is that of the ridge alone
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    miss = 1 / (1 + np.exp(z[y == 1] @ model.weights[:, None] - (z[y == 0] @ model.weights)[None]))
    pull = (miss.sum(1) @ z[y == 1] - miss.sum(0) @ z[y == 0]) / miss.size
    assert np.abs(pull - 1e-3 * model.weights).max() < 1e-7 and np.abs(model.weights).max() > 0.1
    assert model.threshold == pytest.approx(np.quantile(model.strengths(x), (y == 0).mean()), abs=1e-9)


def brute_topk(rows, k=5, every=50):
    width = max(len(v) for _, v in rows)
    good = [(i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, width - len(v))).astype(int)) for i, v in rows]
    out = []
    for q, x in {(i, tuple(x)) for i, x in good if i % every == 0}:
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-int(np.array(x) @ v), i) for i, v in good if i != q)[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(2)
    bad = [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [])]
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(450, [0.1] * 8), (451, [0.1] * 8), (452, [0.1] * 8), (450, [0.2] * 8), (450, [0.2] * 8), (500, [0.5, -3.0]), (7, [9.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows + bad], "vec_id long, embedding array<float>, id string, score double")
    got = lambda d, **how: sorted(tuple(r) for r in topk.top_k(d, "vec_id", "embedding", **how).collect())
    assert got(df, pivots=16, chunk=20, ask=3) == got(df) == brute_topk(rows)
    assert got(df.where("false")) == [] and len(got(df.where("vec_id IN (50, 51)"))) == 1
    doubles = spark.createDataFrame([(50 * i, [0.001 * i, 1e9 + i / 7]) for i in range(9)], "vec_id long, embedding array<double>")
    assert len(got(doubles)) == 45


def test_topk_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=16) * 0.05]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, counts = topk.routed(df, "vec_id", "embedding", k=5, every=50, pivots=None, chunk=100, ask=65536)
    assert sorted(tuple(r) for r in out.collect()) == brute_topk(rows)
    assert counts["queries"] == 60 and counts["sent"] <= 0.3 * counts["queries"] * counts["groups"]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 499)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 500: 499, 499: 499}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
