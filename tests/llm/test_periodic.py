"""Periodic runs against brute force, the parts of the search, and defined cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.llm import periodic, queries
from strataframe.llm._words import Words
from test_operators import DATA, WORD, docs_of, edge_texts, text_of  # noqa: F401


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute(w):
    """All runs of a list of words, by each period's stretches of equal words."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def found_in(texts):
    words = Words(pa.array([" ".join(t) for t in texts]))
    found, of = periodic.runs_of(words)
    out = [[] for _ in texts]
    for (s, e, q), t in zip(found.tolist(), of.tolist()):
        out[t].append((s - int(words.first[t]), e - s, q))
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def power(rng, depth, letters="ab"):
    """Repetitions of repetitions."""
    w = "".join(rng.choice(list(letters), int(rng.integers(1, 6))))
    for _ in range(depth):
        w = w * int(rng.integers(1, 7)) + "".join(rng.choice(list(letters), int(rng.integers(0, 4))))
    return w[:400]


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = [list(rng.choice(list("abc"[: 1 + seed % 3]), int(rng.integers(0, 120)))) for _ in range(150)]
    texts += [list(power(rng, int(rng.integers(1, 5)), "abc"[: 1 + int(rng.integers(1, 3))])) for _ in range(250)]
    assert found_in(texts) == [brute(t) for t in texts]


def test_known_texts():
    thue = [format(k, "b").count("1") % 2 for k in range(300)]
    texts = ["a" * n for n in (5, 6, 7, 100, 333)] + [fibonacci(300), "ab" * 3 + "a", "aab" * 40 + "ab" * 30, ("aaaab" * 9 + "c") * 8, ("a" * 31 + "b") * 5, ("a" * 9 + "b" + "a" * 8 + "c") * 5]
    texts = [list(t) for t in texts] + [[f"x{k}" for k in thue]]
    assert found_in(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("q", [*range(1, 40), 63, 64, 65, 100])
def test_each_period_at_each_place(q):
    rng = np.random.default_rng(q)
    texts = []
    for shift in range(0, 2 * q, max(1, q // 5)):
        unit = [f"u{k}" for k in rng.integers(0, 3, q)]
        n = max(6, 4 * q) + int(rng.integers(0, q))
        texts.append([f"l{k}" for k in range(shift)] + (unit * (n // q + 1))[:n] + ["r"] * int(rng.integers(0, 3)))
    assert found_in(texts) == [brute(t) for t in texts]


def test_successors():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    left, right = np.sort(rng.integers(0, 301, (2, 2000)), axis=0)
    least = rng.integers(0, 320, 2000)
    wanted = [min((v for v in values[a:b] if v >= x), default=300) for a, b, x in zip(left, right, least)]
    assert periodic.Wavelets(values).successor(left, right, least).tolist() == wanted


def test_ranks():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 2, 200), 9)
    ranks = periodic.Ranks(text, 5)
    starts = [tuple(text[k : k + 32]) for k in range(201)]
    assert all(starts[a] <= starts[b] for a, b in zip(ranks.order, ranks.order[1:]))
    for k in range(6):
        blocks = [tuple(text[i : i + (1 << k)]) for i in range(201)]
        assert [min(j for j in range(201) if blocks[ranks.order[j]] == b) for b in blocks] == ranks.levels[k][:201].tolist()


def test_stretches_lose_no_run_and_leave_prose():
    rng = np.random.default_rng(3)
    prose = text_of(rng, 5000, 900)
    assert len(periodic.stretches(np.array([0, 5000]), Words(pa.array([prose])).hashes())) < 500


def test_edges(spark, edge_texts):  # noqa: F811
    rng = np.random.default_rng(5)
    texts = edge_texts + [(50, "a  b\ta b\n" * 9), (51, " ".join(["z"] * 300)), (52, " ".join(["tick", "tock"] * 4000)), (53, text_of(rng, 30000, 40)), (53, "é é é é é é")]
    docs = docs_of(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("none", F.lit(None))
    found = periodic.find_runs(docs)
    assert found.columns.count("n_words") == 1 and "text" not in found.columns
    wanted = []
    for i, t in texts:
        w = WORD.findall(t or "")
        r = brute(w)
        wanted.append((i, len(w), tuple(r), kept(w, r)))
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()) == Counter(wanted)
    assert periodic.find_runs(docs_of(spark, [])).collect() == []


def test_query(spark):
    """The whole table against brute force, rearranged as the query does it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    wanted, planted = {}, 0
    for i, t in docs:
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        r = brute(w)
        best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in r)
        wanted[i] = (len(r), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept(w, r).encode()).hexdigest())
    found = {r[0]: tuple(r)[1:] for r in queries.op11_internal_pattern_runs(spark, DATA).collect()}
    assert planted > 5 and found == wanted
