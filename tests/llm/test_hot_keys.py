"""Keys that most rows have: the joins deal them out and the results stay."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.llm import components, embeddings, lines, minhash, scratch


@pytest.fixture
def hot(monkeypatch):
    """Any key with more than five rows is hot; which joins were dealt out is told."""
    dealt = []
    plain = scratch.salted_join

    def join(rows, unique, on, n, salt_by, how="inner", known=None):
        most = (known or unique.agg(F.sum(n), F.max(n)).first())[1]
        if (most or 0) > scratch.HOT_LEAST:
            dealt.append(tuple(on))
        return plain(rows, unique, on, n, salt_by, how, known)

    monkeypatch.setattr(scratch, "HOT_LEAST", 5)
    monkeypatch.setattr(scratch, "HOT_SHARE", 10**9)
    for module in (components, lines, minhash):
        monkeypatch.setattr(module, "salted_join", join)
    return dealt


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_equal_plain_ones(spark, hot, how):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i % 7) for i in range(200)], "i int, k int")
    unique = rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    got = scratch.salted_join(rows, unique, ["k"], "n", ["i"], how)
    assert sorted(map(str, got.select("i", "k", "m").collect())) == sorted(map(str, rows.join(unique.drop("n"), "k", how).select("i", "k", "m").collect()))


def test_hubs_and_chains(spark, hot):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(500, 2000 + i) for i in range(30)] + [(2005, 1010), (7, 7)]
    rng.shuffle(edges)
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected(d, scratch.Scratch(spark, "t")).collect()}
    want = {**{i: 0 for i in range(60)}, **{1000 + i: 500 for i in range(41)}, 500: 500, **{2000 + i: 500 for i in range(30)}}
    assert got == want and ("u",) in hot


def test_near_copies_of_one_line(spark, hot):
    base = "a line that very many documents hold with one change in it"
    texts = [base] + [base[: 5 + i % 40] + "XYZ"[i % 3] + base[6 + i % 40 :] for i in range(60)] + ["another line of more than twenty four characters"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in lines.removed_lines(d).collect()}
    assert got == set(range(1, 61)) and ("d0", "l0") in hot


def words(n, change=()):
    return " ".join(f"z{i}" if i in change else f"w{i}" for i in range(n))


def test_near_duplicates_of_one_text(spark, hot):
    texts = [words(200)] + [words(200, (i,)) for i in range(1, 60)] + [words(200, (3 * i, 3 * i + 60)) for i in range(1, 20)] + ["nothing like the others " * 9]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    found = list(map(sets, texts))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(found[i] & found[j])
            if 100 * both >= 85 * (len(found[i]) + len(found[j]) - both) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    for rounds in (0, 2):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, minhash.Near(shingle=3, percent=85, star_rounds=rounds)).collect()}
        assert [got[i] for i in range(len(texts))] == root
    assert {("lead",), ("comp",)} <= set(hot) or {("lead",), ("key",)} <= set(hot)


def test_tiles_of_the_grid(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(90)] + [(200 + i, [1.0, 2.0]) for i in range(20)]
    got = {r.vec_id: r.n_links for r in embeddings.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5

    assert got == {i: sum(j != i and len(x) == len(y) and cos(x, y) >= 0.9 for j, y in rows) for i, x in rows}
