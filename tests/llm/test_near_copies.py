"""Near copies against brute force over all pairs, and planted ones in the pipeline's stage."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests_support import prose
from tracklake.llm import jaccard_join, near_copies, simhash


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def planted():
    """Texts with copies that differ in one word, at the ends or inside, of 20 to 900 words."""
    out = []
    for seed in range(12):
        base = words(seed, 20 + 80 * seed)
        for k in range(4):
            text = list(base)
            for at in random.Random(100 * seed + k).sample(range(len(base)), k * len(base) // 120):
                text[at] = f"edit{k}"
            out.append(" ".join(text))
        out.append(" ".join(base[3:] + ["tail"]))
    return out + ["", None, "one", "One ", "one two three"]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def found(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = {}
    for r in near_copies.groups_of(df).collect():
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    return {frozenset(g) for g in groups.values()}


def test_groups_equal_brute_force(spark, texts):
    own = planted() + [t for _, t in texts]
    want = brute(own)
    assert found(spark, own) == want
    assert Counter(map(len, want)).most_common()[0][0] == 1 and max(map(len, want)) > 3


def test_pivot_rounds_give_the_same_components(spark, monkeypatch):
    want = found(spark, planted())
    for rounds, many in ((0, 30), (1, 0), (3, 0)):
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "MANY", many)
        assert found(spark, planted()) == want


def test_pairs_at_the_limit(spark):
    """Sets of 9 k shingles of which k differ at the front have a similarity of exactly 0.8."""
    own = []
    for k in range(1, 7):
        shared = words(40 + k, 8 * k + 4)
        own += [" ".join([f"a{k}x{i}" for i in range(k)] + shared), " ".join([f"b{k}x{i}" for i in range(k)] + shared)]
    got = found(spark, own)
    assert got == brute(own) == {frozenset((2 * k, 2 * k + 1)) for k in range(6)}


def test_the_stage_keeps_one_of_planted_near_copies(spark, small):
    base = words(1, 200)
    near = base[:100] + ["other"] + base[101:]
    far = base[:100] + words(2, 100)
    rows = [(7, " ".join(base)), (3, " ".join(near)), (5, " ".join(far)), (9, prose(4, 90))]
    df = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, small)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [3, 5, 9]
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), small).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
def test_rows_with_one_id_or_none_are_not_lost(spark, keep_one):
    a, b, c, d, e = (" ".join(words(20 + k, 60)) for k in range(5))
    rows = [(None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in keep_one(df).collect())
    assert got == Counter([(None, a), (None, b), (1, c), (2, d), (2, e)])


def test_covering_simhash_gives_the_first_groups(spark, monkeypatch):
    """Sets within the radius meet by the covering tables, and their links are groups before a pivot is chosen; without any round of the join the closest copies are together."""
    base = words(3, 900)
    own = [" ".join(base), " ".join(base[:450] + ["edit"] + base[451:]), " ".join(base + ["tail"]), " ".join(words(5, 90))]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    fps = {t: simhash.fingerprint(t.encode(), 5) for t in own}
    near = sum((fps[a] ^ fps[b]).bit_count() <= 2 for i, a in enumerate(own) for b in own[:i])
    monkeypatch.setattr(jaccard_join, "_blocks", lambda rooted, live, rule: rooted.select(F.col("y").alias("x"), "y").limit(0))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    groups = Counter(r["root"] for r in near_copies.groups_of(df).collect())
    assert near and max(groups.values()) > 1
    assert len(groups) > 1
