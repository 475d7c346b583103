"""Files with several or changed notices, against aligning every template with the whole file."""

import random
import re

import pytest
from tracklake.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GPL = "This work is licensed under the GNU General Public License, version 3."


def edits_by_end(template, words):
    """Fewest edits of the template against a stretch that ends at each place, by the plain recurrence."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(template, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return row[1:]


def plain_labels(words):
    labels = set()
    for label, keys, wording in licenses.TEMPLATES:
        template = wording.encode().split()
        m, k = len(template), int(0.3 * len(template) + 1e-9)
        for end, d in enumerate(edits_by_end(template, words), 1):
            part = words[max(0, end - m - k) : end]
            if d <= k and any(part[i : i + len(key)] == key for key in (x.encode().split() for x in keys) for i in range(len(part))):
                labels.add(label)
                break
    return labels


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}


def test_no_notice_hides_another(spark):
    cases = {
        f"{MIT}\n{GPL} All rights reserved.": "gpl-3,mit,proprietary",
        f"Licensed under CC BY-NC 4.0. {GPL} All rights reserved.": "cc-by-nc,gpl-3,proprietary",
        " ".join(w for _, _, w in licenses.TEMPLATES): ",".join(sorted({label for label, _, _ in licenses.TEMPLATES})),
    }
    got = scan(spark, list(cases))
    assert [got[i]["labels"] for i in range(len(cases))] == list(cases.values())


def test_a_word_put_in_loses_no_label(spark):
    texts, want = [], []
    for label, keys, wording in licenses.TEMPLATES:
        words = wording.split()
        if len(words) > 4:
            at = next(i for i in range(len(words) // 2, len(words)) if not any(k in " ".join(words[max(0, i - 9) : i + 9]) and k not in " ".join(words[:i]) and k not in " ".join(words[i:]) for k in keys))
            texts.append(" ".join([*words[:at], "really", *words[at:]]))
            want.append(label)
    got = scan(spark, texts)
    assert len(want) > 15 and all(label in got[i]["labels"].split(",") for i, label in enumerate(want))
    assert all(0 < got[i]["score"] <= 1 for i in range(len(want)))


def test_labels_equal_aligning_everything():
    rng = random.Random(8)
    vocabulary = licenses.vocabulary()
    short = [t for t in licenses.TEMPLATES if len(t[2].split()) < 45]
    for nr in range(150):
        index = licenses.LicenseIndex({w: rng.randrange(1000) for w in vocabulary}, 1000)
        words = []
        for _ in range(rng.randrange(1, 5)):
            notice = rng.choice(short)[2].split()
            for _ in range(rng.choice([0, 1, 1, len(notice) // 4, len(notice) // 3])):
                at = rng.randrange(len(notice))
                how = rng.randrange(3)
                notice[at : at + (how != 0)] = [] if how == 1 else [rng.choice([*vocabulary, "other"])]
                notice = notice or ["x"]
            words += notice + rng.choices([*vocabulary, "x", "y"], k=rng.randrange(8))
        words = [w.encode() for w in words]
        _, base, labels, _ = index.scan(words)
        assert labels == base | plain_labels(words), nr


@pytest.mark.parametrize("seed", range(3))
def test_base_places_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    bag = "under the mit license apache version 2 cc by nc x".split()
    texts = [" ".join(rng.choice(bag) for _ in range(rng.randrange(0, 120))) for _ in range(40)] + ["", None, "under the mit license " * 30]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")
        at = sorted((s, label) for phrase, label in licenses.BASE.items() for s in range(len(words)) if words[s : s + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
