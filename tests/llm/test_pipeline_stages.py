"""Each stage of the pipeline against brute force or its defined results on odd inputs."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from normweave.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(rng, n, pool=5000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def brute_kept(rows):
    """(id, text) of the rows that stay: components of sets of 5 words at 0.8, by all pairs of distinct rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else ({tuple(w)} if w else set())

    sets, par = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return rows, [find(i) for i in range(len(rows))], least


def test_near_copies_keeps_rows_with_repeated_ids(spark):
    rng = random.Random(3)
    p, other = words(rng, 60), words(rng, 70)
    kept = lambda rows: sorted(tuple(r) for r in corpus_pipeline.near_copies(spark, docs(spark, rows), "").collect())
    assert kept([(1, p), (7, p), (7, other)]) == sorted([(1, p), (7, other)])
    assert kept([(7, p), (7, p)]) == [(7, p)]
    assert len(kept([(7, p), (7, p.upper()), (7, other)])) == 2
    assert kept([]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bases, rows = [words(rng, rng.choice([3, 8, 40, 200])) for _ in range(15)], []
    for _ in range(150):
        t = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((rng.choice([rng.randrange(60), rng.randrange(10**6)]), " ".join(t)))
    rows += [(None, bases[0]), (None, "alone here"), (3, None), (4, ""), (5, " \n")] + rows[:10]
    got = corpus_pipeline.near_copies(spark, docs(spark, rows), "").collect()
    unique, group, least = brute_kept(rows)
    of = dict(zip(unique, group))
    kept = [tuple(r) for r in got]
    assert len(kept) == len(set(kept)) and set(kept) <= set(unique)
    with_id = [r for r in kept if r[0] is not None]
    # one row of each group that has an id, and it has the group's least id; every distinct row without an id
    assert sorted((of[r], r[0]) for r in with_id) == sorted(least.items())
    assert sorted(map(repr, (r for r in kept if r[0] is None))) == sorted(repr(r) for r in unique if r[0] is None)


def test_large_buckets_are_dealt_in_parts(spark):
    rng = random.Random(9)
    base = words(rng, 120).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(120), k=200))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows), block=16).collect()}
    assert set(got.values()) == {0} and len(got) == 200


def test_ring_is_a_consequence_of_the_budget(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randint(0, 40) for _ in range(4)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").withColumn("fine", simhash.in_ring([F.col(c) for c in "abcd"], 72))
    got = df.collect()
    assert all(r.fine == (r.a + r.b + r.c + r.d <= 72) for r in got) and {r.fine for r in got} == {True, False}


def test_stages_on_odd_rows(spark):
    en = "the house and the street are with this and that"
    line = "This shared line is certainly more than forty code points long."
    clash = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, `a.b` int, lang_pred string, pii string"
    more = (5, "h", 1, "x", "p")
    rows = [(i, f"{line}\n{en} {i} mail a@b.co", "en", "s", 1, *more) for i in range(1, 8)]
    rows += [(8, None, None, None, None, *more), (9, "", "en", "s", 0, *more), (3, rows[2][1], "en", "s", 1, *more), (None, en, "en", "s", 1, *more), (10, f"{en} " * 20_000, "en", "s", 1, *more)]
    df = docs(spark, rows, clash)
    run = lambda stage, of=df: stage(spark, of, "")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert run(stage).columns == df.columns and run(stage, df.where("false")).count() == 0
    assert sorted(r.doc_id or 0 for r in run(corpus_pipeline.language).collect()) == [0, 1, 2, 3, 3, 4, 5, 6, 7, 10]
    lines = {r.doc_id: r for r in run(corpus_pipeline.lines).collect()}
    assert line in lines[7].text and line not in lines[3].text and lines[8].text == "" and lines[7].n_chars == len(lines[7].text)
    assert {r.text.count("[EMAIL]") for r in run(corpus_pipeline.personal_data).where("doc_id < 8").collect()} == {1}
    packed = run(corpus_pipeline.pack).collect()
    assert {r.doc_id for r in packed} == {*range(1, 11), None} and max(r.offset + r.length for r in packed) <= 1024
