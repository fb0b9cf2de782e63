import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from normweave.llm import exact_dedup, line_dedup, pii, simhash, substring_dedup

CLASH = "doc_id long, text string, id long, h string, line string, kept string, `a.b` int"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


LONG = "  This Line is certainly more than forty code points long, é.\t"


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    at = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                at.setdefault(key(x), set()).add(d)
    low = lambda d: -(2**70) if d is None else d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(at.get(key(x), ())) >= 5 and d != max(at[key(x)], key=low))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    pool = [LONG, LONG.lower() + "x", "short", "", "Zeile mit Ä Umlaut und noch viel mehr Text dahinter hier", "b" * 40, "B" * 40 + " ", "c" * 39]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(40, None), (None, LONG), (3, LONG), (3, LONG)]
    got = line_dedup.dedup_lines(docs(spark, rows), batches=batches).select("doc_id", "line_dedup.*").collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute_lines(rows)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    got = line_dedup.dedup_lines(docs(spark, [(1, LONG, 5, "h", "l", "k", 1)] * 2, CLASH))
    assert got.count() == 2 and {"a.b", "h", "line_dedup"} <= set(got.columns)
    again = line_dedup.dedup_lines(got)
    assert again.count() == 2 and again.columns.count("line_dedup") == 1


def test_line_dedup_needs_its_anti_join(spark, monkeypatch):
    rows = [(i, f"{LONG}\n{LONG}{i % 4}") for i in range(60)]
    run = lambda: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).select("doc_id", "line_dedup.*").collect()), key=repr)
    assert run() == brute_lines(rows)
    monkeypatch.setattr(line_dedup.LineIndex, "fresh", staticmethod(lambda batch, _: batch))
    assert run() != brute_lines(rows)


def test_line_dedup_of_a_long_text(spark):
    own = [f"{LONG.strip()} number {i}" for i in range(30_000)]
    rows = [(i, "\n".join(own) if i in (1, 9) else "\n".join(own[k] for k in range(i, 30_000, 7))) for i in range(1, 10)]
    got = line_dedup.dedup_lines(docs(spark, rows), min_docs=2).select("doc_id", "line_dedup.*").collect()
    assert {r.doc_id: r.n_lines - r.n_dropped for r in got}[9] == 30_000 and sum(r.n_lines - r.n_dropped for r in got) == 30_000


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab"), (3, " a\tb\n"), (9, None), (8, ""), (7, " "), (1, "x"), (1, "x"), (None, "y"), (4, "y"), (6, "ab" * 50_000)]
    got = exact_dedup.dedup_exact(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert by[5][0].keep_id == 3 and by[3][0].kept and by[5][0].group_size == 3 and not by[2][0].kept
    assert by[8][0].keep_id == 7 and by[7][0].kept
    assert sum(r.kept for r in by[1]) == 1 and by[1][0].group_size == 2
    assert by[None][0].keep_id == 4
    assert by[6][0].text_sha256 == hashlib.sha256(b"ab" * 50_000).hexdigest()
    assert exact_dedup.dedup_exact(docs(spark, [])).count() == 0
    assert exact_dedup.dedup_exact(docs(spark, [(1, "t", 5, "h", "l", "k", 1)], CLASH)).count() == 1


def brute_pii(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans(spark):
    rng = random.Random(1)
    parts = ["@", ".", "a", "b9", "1", "25", "256", "4111 1111 1111 1111", " ", "-", "+1", "(", "555", "é", "😀", "\n", "4111111111111111", "10.0.0.1", "x@y.z", "00", "+44 20 7946 0958", "_", "c@"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "1" * 20_000, "a" * 20_000 + "@", "1 " * 10_000, "a.b@" * 2000 + "c.d", "a@b." * 500, "+" * 2000]
    got = {r.doc_id: r for r in pii.detect(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i].pii_spans if s["base"]] == brute_pii(t), repr(t)[:100]


def test_pii_adds_and_masks(spark):
    got = pii.detect(docs(spark, [(1, "call 212-555-0199 or a@b.co é"), (2, "nothing here")]))
    rows = got.select("doc_id", pii.masked(F.col("text"), F.col("pii_spans")).alias("m")).orderBy("doc_id").collect()
    assert [r.m for r in rows] == ["call [PHONE] or [EMAIL] é", "nothing here"]
    assert pii.detect(docs(spark, [])).count() == 0
    assert pii.detect(docs(spark, [(1, "a@b.co", 5, "h", "l", "k", 1)], CLASH)).count() == 1


def test_pii_of_many_matches(spark):
    mails, mixed = "a.b@c.de " * 100_000, "x@y.zz 212-555-0199, " * 20_000
    got = pii.detect(docs(spark, [(1, mails), (2, mixed), (2, mixed)])).select("doc_id", "pii_spans", pii.masked(F.col("text"), F.col("pii_spans")).alias("m")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 3 and [(s["start"], s["end"]) for s in by[1].pii_spans] == [(9 * k, 9 * k + 8) for k in range(100_000)]
    assert by[1].m == "[EMAIL] " * 100_000 and by[2].m == "[EMAIL] [PHONE], " * 20_000


def test_pii_added_spans_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["212-555-0199", "(212) 555 0199", "a [at] b dot com", "a[at]b.com", "4111 1111 1111 111", "3782 822463 10005", "2001:db8:0:0:0:0:0:1", "x@y.zz", "10.0.0.1", "call ", "card ", " ", ", ", "word", "\n", "+1 212 555 0199"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    for r in pii.candidates(docs(spark, list(enumerate(texts)))).collect():
        base = {(c["kind"], c["start"], c["end"]) for c in r.pii if c["base"]}
        wide = set()
        for kind, p in pii.WIDE.items():
            if kind == "email" and not re.search(r"[\[(]at[\])]", r.text.lower()) or kind == "ip" and ":" not in r.text:
                continue
            wide |= {(kind, *m.span()) for m in re.finditer(p, r.text)}
        free = {w for w in wide if not any(b[1] < w[2] and w[1] < b[2] for b in base)}
        assert {(c["kind"], c["start"], c["end"]) for c in r.pii if not c["base"]} == free, r.text


def brute_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    c = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, seed=42)
        for k in range(64):
            c[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * c[k] > len(s))


def brute_components(fps):
    par = {i: i for i in fps}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \t", "One", "one", "One two", "ONE  two", "a b c"] + [b if rng.random() < 0.3 else b.replace("a", "b", 1) for b in base for _ in range(5)]
    got = {r.doc_id: r for r in simhash.near_dedup(docs(spark, list(enumerate(texts)))).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: got[i].fp & (2**64 - 1) for i in got} == fps
    assert {i: got[i].component_id for i in got} == brute_components(fps)
    assert simhash.near_dedup(docs(spark, [])).count() == 0
    assert simhash.near_dedup(docs(spark, [(1, "a b", 5, "h", "l", "k", 1), (1, "a b", 5, "h", "l", "k", 1), (None, None, 1, None, None, None, None)], CLASH)).count() == 3


@pytest.mark.parametrize("bucket", [1024, 30, 3])
def test_links_in_large_buckets(spark, bucket):
    rng = random.Random(2)
    base, fps = [rng.getrandbits(64) for _ in range(12)], {}
    for i in range(300):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps[i] = (x & ~0xFFFFFFFF) | 0x1234ABCD if i % 3 == 0 else x
    df = docs(spark, [(i, simhash._signed(x)) for i, x in fps.items()], "id long, fp long")
    found = simhash.links(df.select("fp").distinct(), simhash.Scratch(spark, "test"), bucket).collect()
    par = {simhash._signed(x): simhash._signed(x) for x in fps.values()}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for e in found:
        assert (e.a ^ e.b).bit_count() <= 3 or ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 3
        par[find(e.a)] = find(e.b)
    groups = {}
    for i, x in fps.items():
        groups.setdefault(find(simhash._signed(x)), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == brute_components(fps)


def test_near_copies(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b = words(200), words(200)
    edited = a[:100] + ["new"] + a[101:]
    texts = [" ".join(a), " ".join(b), " ".join(edited), " ".join(a).upper(), " ".join(a[:100] + b[100:]), "", None, "tiny text", "tiny text"]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}
    assert simhash.near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [100, 400])
def test_near_copies_of_an_original_that_is_not_the_smallest(spark, copies):
    rng = random.Random(copies)
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}

    def edited(base, n):
        out = list(base)
        for k in rng.sample(range(300), n):
            out[k] = f"x{rng.randrange(10**9)}"
        return " ".join(out)

    texts = []
    for n in (copies, copies // 4):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [edited(base, 5) for _ in range(n)] + [" ".join(base)]
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts += [edited(base, 5) for _ in range(30)]  # without their original most stay apart
    sets, par = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("n", [1, 16, 255, 256, 5000])
def test_wide_fingerprint_is_a_plain_count(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    counts = [0] * (64 * simhash.WIDE)
    for w, salt in enumerate(simhash._WIDE_SALTS):
        x = h + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for bit in range(64):
            counts[64 * w + bit] = int(((x >> np.uint64(bit)) & np.uint64(1)).sum())
    want = [sum((2 * counts[64 * w + bit] > n) << bit for bit in range(64)) for w in range(simhash.WIDE)]
    assert simhash.wide_fingerprint(h).tolist() == want


@pytest.mark.parametrize("n", [18, 25, 45, 180, 900])
def test_wide_fingerprint_keeps_links_within_its_budget(n):
    """Sets of a similarity of just 0.8 or more: one in the other, or of equal size."""
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        both = -(-8 * n // 9)
        for b in (a[: -(-4 * n // 5)], np.concatenate([a[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)])):
            assert np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum() <= simhash.WIDE_FAR


def test_near_copies_of_a_group_not_all_alike_sends_few_candidates(spark, monkeypatch):
    """Copies of one text of which most are below 0.8 to each other: same components as all pairs, far fewer candidates."""
    rng, counted, verified = random.Random(9), [], simhash._verified
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(200)], []
    for _ in range(500):
        out = list(base)
        for k in rng.sample(range(200), rng.choice([2, 4, 5, 6, 7])):
            out[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(out))
    sets, par = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts], list(range(500))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(500):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)

    def counting(pairs, sets, similarity):
        counted.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(simhash, "_verified", counting)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: find(i) for i in range(500)}
    assert len(counted) > 1 and sum(counted) < 0.2 * 500 * 499 / 2


def test_pipeline_keeps_one_blank_document(spark):
    rows = [(4, ""), (2, None), (3, " \n"), (5, "one text"), (6, "another text"), (7, "one text"), (None, "")]
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs(spark, rows), "").collect()]
    assert sorted(kept, key=repr) == [2, 5, 6, None]


def test_substring_dedup(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = words(55)
    texts = [f"{words(80)} {passage} {words(60)}", f"{words(33)} {passage}\n{words(90)}", words(200), None, "", "x" * 100_000, "  "]
    df = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in substring_dedup.repeats(df).collect()}
    assert got[0].n_dropped == 0 and got[2].n_dropped == 0 and got[3].n_chunks == 0
    assert got[1].first_ids == [0] and sum(s.end - s.start for s in got[1].spans) >= len(passage) * 0.5
    start = texts[1].index(passage)
    assert all(start <= s.start and s.end <= start + len(passage) + 1 for s in got[1].spans)
    kept = {r.doc_id: r.text for r in substring_dedup.cut(df).collect()}
    assert kept[0] == texts[0] and len(kept[1]) < len(texts[1]) and kept[3] is None
    assert substring_dedup.repeats(docs(spark, [])).count() == 0
    assert substring_dedup.repeats(docs(spark, [(1, words(50), 5, "h", "l", "k", 1)] * 2, CLASH)).where("n_dropped = 0").count() == 2


def brute_spans(rows, min_words):
    """(spans, first ids) of each distinct row, from its chunks and a dictionary of their first holders."""
    unique = sorted({(d, k, t) for d, k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, out = {}, {}
    for n, (_, _, t) in enumerate(unique):
        for piece in substring_dedup.chunks(t or "")[0]:
            first.setdefault(piece, n)
    for n, (d, k, t) in enumerate(unique):
        runs, last = [], None
        for piece, a, size, words in zip(*substring_dedup.chunks(t or "")):
            if first[piece] == n:
                continue
            if last is not None and runs[-1][1] == a:
                runs[-1][1:] = [a + size, runs[-1][2] + words, runs[-1][3] | {first[piece]}]
            else:
                runs.append([a, a + size, words, {first[piece]}])
            last = piece
        good = [r for r in runs if r[2] >= min_words]
        out[d, k] = [(int(r[0]), int(r[1])) for r in good], sorted({unique[i][0] for r in good for i in r[3]}, key=lambda x: (x is None, x))
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(11)
    passages = [" ".join(f"p{rng.randrange(400)}" for _ in range(rng.randint(30, 90))) for _ in range(6)]
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))
    rows = [(rng.randrange(25), " ".join(x for _ in range(3) for x in (own(), rng.choice(passages)))) for _ in range(60)]
    rows += [(None, passages[0] + " " + own()), (None, own()), (3, None)] + rows[:6]
    df = docs(spark, rows)
    keys = [tuple(r) for r in df.select("doc_id", substring_dedup.row_key(F.col("text")), "text").collect()]
    want = brute_spans(keys, 20)
    got = substring_dedup.repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ([tuple(s) for s in r.spans], r.first_ids) == want[r.doc_id, r.row_key]
    texts = {(d, k): t for d, k, t in keys}
    for r in substring_dedup.cut(df).select("doc_id", "text").collect():
        left = [(d, k) for (d, k), t in texts.items() if d == r.doc_id]
        cuts = []
        for w in left:
            t = texts[w]
            for a, b in reversed(want[w][0]):
                t = t[:a] + t[b:]
            cuts.append(t)
        assert r.text in cuts


def test_substring_dedup_tells_rows_of_an_id_apart(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, other = words(80), words(300)
    rows = [(1, p), (7, words(50) + " " + p), (7, other)]
    kept = [r.text for r in substring_dedup.cut(docs(spark, rows)).collect()]
    assert other in kept and p in kept and rows[1][1] not in kept


def test_substring_dedup_of_a_long_text(spark):
    text = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(200_000))
    got = {r.doc_id: r for r in substring_dedup.repeats(docs(spark, [(1, text), (2, text + " "), (3, text[:1000])])).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped >= got[2].n_chunks - 1 and len(got[2].spans) == 1 and got[2].first_ids == [1]


@pytest.mark.parametrize("text", ["", " ", "a", "word " * 500, "é" * 70_000, "a b c\n\nd"])
def test_chunks_are_whole(text):
    pieces, start, size, words = substring_dedup.chunks(text)
    assert sum(size) <= len(text) and "".join("".join(p.decode().split()) for p in pieces) == "".join(text.encode().replace(b"\x0b", b" ").decode().split()) or " " in text
    assert all(text[a : a + n].encode().strip(b" \t\n\x0b\x0c\r") == p for p, a, n in zip(pieces, start, size))


def common_run(a, b, passage):
    """Most words in consecutive chunks of a, within the passage, that b has as well."""
    kept, lo = set(substring_dedup.chunks(b)[0]), a.index(passage)
    pieces, start, size, words = substring_dedup.chunks(a)
    best = now = 0
    for p, s, n, w in zip(pieces, start, size, words):
        now = now + w if p in kept and lo <= s and s + n <= lo + len(passage) + 1 else 0
        best = max(best, now)
    return best


@pytest.mark.parametrize("pool", [1, 3, 12, 40, 5000])
def test_passages_of_51_words_give_a_run(pool):
    rng = random.Random(pool)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(1, 10))) for _ in range(6000)]
    words = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    runs = []
    for _ in range(1500):
        passage = words(51, rng.sample(vocabulary, pool))
        a, b = (f"{words(rng.randint(20, 60), vocabulary)} {passage} {words(rng.randint(20, 60), vocabulary)}" for _ in range(2))
        runs.append(common_run(a, b, passage))
    assert min(runs) >= 12 and sum(r >= 20 for r in runs) >= 0.995 * len(runs)
