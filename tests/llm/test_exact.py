"""Exact dedup against brute force, its stages under weak digests, and its defined cases."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from strataframe.llm import exact, oracles, queries
from test_operators import DATA, docs_of, edge_texts, text_of  # noqa: F401

GONE = str.maketrans("", "", " \t\n\v\f\r")


def by_brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(GONE)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for g in groups.values():
        g.sort()
        out += [(i, g[0][3], len(g), k == 0) for k, (_, _, _, i) in enumerate(g)]
    return Counter(out)


def spaced(rng, text):
    return "".join(c if c != " " else " \t\n\r\v\f"[rng.integers(6)] * int(rng.integers(1, 4)) for c in text)


def found_by(df):
    return Counter((r.id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def variants(rng):
    base = [text_of(rng, 30) for _ in range(6)]
    texts = [(k, spaced(rng, base[k % 6])) for k in range(60)]
    return texts + [(-5, base[0]), (None, base[1]), (None, base[1]), (70, base[2] + "  "), (70, base[2] + "  "), (-(2**63), base[3]), (2**63 - 1, base[3])]


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(exact.sha256(c), 1, 0), lambda c: F.unhex(F.hex(F.crc32(c) % 3))])
def test_contents_are_compared_under_any_digest(spark, edge_texts, digest):  # noqa: F811
    texts = edge_texts + variants(np.random.default_rng(4))
    docs = docs_of(spark, texts).repartition(9)
    found = exact.equal_texts(docs, **({"digest": digest} if digest else {}))
    assert found_by(found) == by_brute(texts)


def test_no_bound_on_digests(spark, monkeypatch):
    monkeypatch.setattr(exact, "FEW", 2)
    texts = variants(np.random.default_rng(6)) + [(100 + k, "hot text") for k in range(300)]
    assert found_by(exact.equal_texts(docs_of(spark, texts).repartition(20))) == by_brute(texts)


def test_a_hot_content_reaches_nobody_whole(spark):
    """400 tasks hold copies of one text: no task of the later stages gets more rows of it than salts or tasks a salt."""
    docs = docs_of(spark, [(k, "hot text") for k in range(2000)]).repartition(400)
    rows = docs.select(F.col("doc_id").alias("id"), F.char_length("text").alias("n"), F.col("text").alias("content"), exact.sha256(F.col("text")).alias("digest"))
    dealt = rows.select((F.spark_partition_id() % 21).alias("salt"), F.spark_partition_id().alias("task")).distinct().groupBy("salt").count()
    assert dealt.agg(F.max("count")).first()[0] <= 20 and found_by(exact.equal_texts(docs)) == by_brute([(k, "hot text") for k in range(2000)])


def test_empty(spark):
    assert exact.equal_texts(docs_of(spark, [])).collect() == []


def test_same_rows_as_sql(spark, duck):
    found = queries.op13_salted_exact_duplicates(spark, DATA)
    cursor = duck.execute(oracles.EQUAL_TEXTS)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
