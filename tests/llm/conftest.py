import os
import sys

import pytest
from pyspark.sql import Row

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_support import prose  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty, ties, repeated rows, copies, near copies, shared passages, a very long text."""
    passage = prose(77, 120)
    long = prose(5, 6000)
    out = [(i, prose(i, 20 + 15 * i)) for i in range(1, 25)]
    out += [(30, None), (31, ""), (32, " \t\n"), (33, "one"), (34, "one two"), (35, "ÄÖÜ É ñ x"), (36, "a" * 3000), (37, "To " * 400)]
    out += [(40, out[9][1]), (41, out[9][1]), (42, out[20][1] + " tail"), (43, "head " + out[20][1])]
    out += [(50, passage + " " + prose(501, 90)), (51, prose(511, 90) + " " + passage), (52, prose(521, 40) + passage + prose(522, 40))]
    out += [(60, long), (61, long[:9000]), (62, out[3][1]), (62, out[3][1]), (None, prose(700, 80)), (None, None), (63, "x\x00y \x0b z")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    # columns that clash with names the operators use themselves
    rows = [
        Row(doc_id=i, text=t, lang="en" if n % 5 else None, source="hot" if n % 3 else None, n_chars=len(t or ""), shard=9, slot=9, fp=1, k=2, h=3, h1=4, lead=5)
        for n, (i, t) in enumerate(texts)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, fp long, k long, h long, h1 long, lead long"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
