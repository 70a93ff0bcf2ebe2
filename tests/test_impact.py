import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import impact, index


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """3,000 texts in which "common" stands nearly everywhere, with index, counts and totals for two reference lengths."""
    rng = random.Random(5)
    words = ["w%d" % k for k in range(400)]
    rows = []
    for k in range(3000):
        body = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        body += ["common"] * rng.choice([0, 1, 1, 1, 2, 3, 9]) + ["rare"] * (k % 500 == 7) + ["half"] * (k % 2)
        rng.shuffle(body)
        rows.append((k, " ".join(body)))
    rows += [(3000 + k, rows[11][1]) for k in range(30)]  # ties
    docs = spark.createDataFrame([*rows, (4000, None), (4001, "")], "id long, text string")
    folder = str(tmp_path_factory.mktemp("impact"))
    index.postings(docs).write.parquet(f"{folder}/posting")
    postings = spark.read.parquet(f"{folder}/posting")
    totals = index.stats(index.lengths(docs))
    out = {}
    for reference in (8.0, 33.0, 900.0):
        impact.levelled(postings, reference).write.parquet(f"{folder}/index-{reference}")
        levels = spark.read.parquet(f"{folder}/index-{reference}")
        out[reference] = levels, impact.counted(levels, reference), totals
    return postings, totals, out


def ranked(postings, totals, terms, k):
    return [tuple(r) for r in index.bm25(postings, totals, terms).orderBy(F.desc("score"), "id").limit(k).collect()]


@pytest.mark.parametrize("reference", [8.0, 33.0, 900.0])
def test_same_rows_as_the_full_ranking(built, monkeypatch, reference):
    monkeypatch.setattr(impact, "FIRST", 64)
    postings, totals, made = built
    for terms, k in ((["common"], 10), (["common", "rare"], 10), (["common", "half", "w3"], 25), (["rare", "rare", "absent"], 3), (["w1", "w2", "common", "half"], 1)):
        assert [tuple(r) for r in impact.top(*made[reference], terms, k).collect()] == ranked(postings, totals, terms, k)


def test_a_frequent_word_is_not_read_whole(built, monkeypatch):
    monkeypatch.setattr(impact, "FIRST", 64)
    postings, totals, made = built
    log = []
    impact.top(*made[33.0], ["common"], 10, log).collect()
    assert log[-1] * 3 < postings.filter("term = 'common'").count()
    log.clear()
    impact.top(*made[33.0], ["common", "rare"], 3, log).collect()
    assert log[-1] * 3 < postings.filter("term in ('common', 'rare')").count()


def test_levels_reach_the_scan(built):
    found, _, _ = built[2][33.0]
    plan = found.filter(impact._any([(F.col("term") == t) & (F.col("level") >= 20) for t in ("common", "rare", "half")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(level,20)" in text.split("PushedFilters")[1]


def test_no_hits_and_no_terms(built):
    made = built[2][33.0]
    assert impact.top(*made, ["absent"], 5).collect() == impact.top(*made, [], 5).collect() == impact.top(*made, ["common"], 0).collect() == []
    assert impact.top(made[0].limit(0), made[1].limit(0), made[2], ["common"], 5).collect() == []
