"""The Jaccard join against brute force over all pairs, and its query against SQL."""

import random

import duckdb
import pytest
from tests_support import by_id
from tracklake.llm import jaccard_join
from tracklake.llm.jaccard_join import Rule
from tracklake.llm.oracles import SQL
from tracklake.llm.queries import QUERIES


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def planted():
    """Chains of texts that drift apart, a passage in very many texts, boundary cases, hard rows."""
    out = []
    for seed in range(14):
        text = words(seed, 7 + 40 * seed)
        for k in range(7):  # each is similar to the one before, not to the first
            out.append(" ".join(text))
            for at in random.Random(97 * seed + k).sample(range(len(text)), max(1, len(text) // 60)):
                text[at] = f"e{seed}x{k}x{at}"
    passage = words(500, 150)
    out += [" ".join(words(600 + k, k) + passage + words(700 + k, k)) for k in range(0, 60, 2)]
    for n in range(1, 60):  # sets that differ in the first or last words: similarities on both sides of the limit
        base = words(900 + n, n + 3)
        out += [" ".join(base), " ".join(["first"] + base[1:]), " ".join(base + ["last"]), " ".join(base[:-1] + ["other"]), " ".join(["more", "of"] + base)]
    return out + ["", None, " \t", "one", "One", "one two three", "one two three four", "ÄÖ É ñ x", "a" * 6000, "to be " * 500]


def brute(texts, rule):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + rule.width]) for i in range(max(1, len(w) - rule.width + 1))} if w else set())
    root = list(range(len(texts)))
    holders = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders.get(g, ())}:
            if rule.den * len(s & sets[j]) >= rule.num * len(s | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
        for g in s:
            holders.setdefault(g, []).append(i)
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("rule", "many", "block"), [(Rule(), 30, 2000), (Rule(), 0, 3), (Rule(5, 4, 5), 0, 5)])
def test_equals_brute_force(spark, texts, monkeypatch, rule, many, block):
    """Also with pivot rounds for every key and blocks of a few units."""
    monkeypatch.setattr(jaccard_join, "MANY", many)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    own = planted() + [t for _, t in texts]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(own)], "doc_id long, text string, unit int, key string").repartition(5)
    got = sorted(map(tuple, jaccard_join.jaccard_components(df, rule).collect()))
    want = brute(own, rule)
    assert got == want
    assert len({r for *_, r in want}) < len(want) - 60


def test_hard_rows(spark, docs, texts, empty):
    got = by_id(jaccard_join.jaccard_components(docs), "n_shingles", "component_id")
    same = {}
    for i, (_, _, root) in enumerate(brute([t for _, t in texts], Rule())):
        same.setdefault(root, []).append(i)
    want = []
    for members in same.values():
        ids = [texts[i][0] for i in members if texts[i][0] is not None]
        for i in members:
            n = brute([texts[i][1]], Rule())[0][1]
            key = texts[i][0]
            want.append((key is None, key or 0, n, min(ids, default=None) if n else key))
    assert got == sorted(want, key=repr)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(SQL["op11_jaccard_join"])
    got = QUERIES["op11_jaccard_join"](spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_a_unit_meets_its_nearest_pivot(spark):
    """Of the pivots of a unit's keys the one with the least different parities is compared, as it is the likeliest link: fewer units are left for the last round."""
    bits = lambda n: [(1 << n) - 1] + [0] * (jaccard_join.PARITIES // 64 - 1)
    row = lambda key, unit, at, n: (key, (unit, 147, at, True, bits(n), unit))
    rows = [row(k, 1000 + k, 0, 9 - k) for k in range(9)] + [row(key, unit, 1, 0) for key in range(9) for unit in range(30)]
    rooted = spark.createDataFrame(rows, "key long, y struct<unit long, n int, at int, head boolean, bits array<long>, root long>")
    live = spark.createDataFrame([(k, 31, 1000 + k) for k in range(9)], "key long, c long, main long")
    got = jaccard_join._pivots(rooted, live, Rule(), 0).select("y.unit", "x.unit").collect()
    assert {y: x for y, x in got if y < 30} == dict.fromkeys(range(30), 1008)
