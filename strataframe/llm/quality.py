"""Quality scores learned from preferences, in the Bradley-Terry model.

A labelled document of quality 1 is preferred to one of quality 0; the chance of that is the logistic function of the
difference of their scores, a score is linear in ``NAMES``, and the weights minimise the logistic loss over pairs. The
threshold is a quantile of the scores of all training rows: the share of quality 0 among them. A score s is returned as
logistic(s - threshold + logit(``CUT``)), so that ``CUT`` is the threshold whatever the corpus.

The fit takes at most ``SAMPLE`` labelled rows of each quality, those of the least hash of their id; scores, the threshold
and the share of each quality cover all rows. The quantile's rank is off by a part of 1 / ``ACCURACY`` of the rows at most. Only the text is an input of a score.

Defined cases: null and empty texts have all features of an empty text and a score; a text of any length is scored whole;
null labels and labels of no document aren't learned from; an id counts once for each quality in the fit, by the least
features of its rows, and in the threshold as often as its labels and its documents repeat; if one quality has no row to learn from, all scores are 0.5; scores equal to the threshold pass; a null id is not
held out; an empty table gives an empty result. Of input columns that bear the name of an added one, the added one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ._store import materialise, small_batches
from ._words import Words, column, slices

SAMPLE = 6000
PAIRS = 120_000
CUT = 0.3
FOLDS = 5
RIDGE = 1.0
ACCURACY = 1_000_000
SEED = 7

#: Kinds of bytes: what is in none of these is 0.
KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "beyond": bytes(range(0xC0, 0x100)),
         "pipe": b"|", "bang": b"!", "symbol": b"#$%&*~^_=+<>@/\\{}[]", "stop": b".?", "mark": b",;:'\"()-", "line": b"\n"}
RATIOS = (*KINDS, "adjacent", "second", "distinct", "short", "long")
NAMES = (*(f"{n}_ratio" for n in RATIOS), *(f"{n}_log" for n in RATIOS), "words", "adjacent_count", "word_bytes", "bytes")

_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(KINDS.values(), 1):
    _KIND[np.frombuffer(_bytes, np.uint8)] = _k


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    words = Words(texts)
    raw, offsets = column(texts)
    n, counts, size = len(offsets) - 1, words.counts, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * (len(KINDS) + 1) + _KIND[raw], minlength=n * (len(KINDS) + 1))
    kinds = kinds.reshape(n, -1)[:, 1:]
    hashes, owner = words.hashes(), np.repeat(np.arange(n), counts)

    def same(step: int) -> np.ndarray:
        equal = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        return np.bincount(owner[step:][equal], minlength=n)

    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n)
    length = words.end - words.start
    of_words = np.stack([same(1), same(2), distinct, np.bincount(owner[length < 3], minlength=n), np.bincount(owner[length > 15], minlength=n)], 1)
    ratios = np.hstack([kinds / np.maximum(size, 1)[:, None], of_words / np.maximum(counts, 1)[:, None]])
    more = [np.log1p(counts), np.log1p(of_words[:, 0]), np.bincount(owner, length, minlength=n) / np.maximum(counts, 1), np.log1p(size)]
    return np.hstack([ratios, np.log(ratios + 1e-3), np.stack(more, 1)])


def loss(x: np.ndarray, w: np.ndarray, ridge: float) -> float:
    """Of preferences with feature differences ``x``: the logistic loss, and the ridge that bounds separable data."""
    return float(np.logaddexp(0, -(x @ w)).sum() + ridge / 2 * w @ w)


def fit(good: np.ndarray, bad: np.ndarray, share: float, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> dict:
    """The model from feature rows of either quality; share: of quality 0 among labelled rows."""
    if not len(good) or not len(bad):
        return {"centre": np.zeros(len(NAMES)), "weights": np.zeros(len(NAMES)), "threshold": float(np.log(CUT / (1 - CUT)))}
    both = np.vstack([good, bad])
    centre, scale = both.mean(0), both.std(0) + 1e-9
    rng = np.random.default_rng(seed)
    x = (good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method; a step that doesn't lower the loss is halved
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (1 - p) - ridge * w)
        before = loss(x, w, ridge)
        while loss(x, w + step, ridge) > before and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w /= scale
    scores = (both - centre) @ w
    weight = np.concatenate([np.full(len(good), (1 - share) / len(good)), np.full(len(bad), share / len(bad))])
    order = np.argsort(scores, kind="stable")
    upto = min(int(np.searchsorted(np.cumsum(weight[order]), share)), len(order) - 1)
    below = scores[order][max(upto - 1, 0)]
    return {"centre": centre, "weights": w, "threshold": float((below + scores[order][upto]) / 2)}


def scores(model: dict, rows: np.ndarray) -> np.ndarray:
    z = (rows - model["centre"]) @ model["weights"] - model["threshold"] + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """The model from labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "text", "label")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(list(found), pa.list_(pa.float64()))], ["id", "label", "x"])

    key = StructField("id", docs.schema[id_col].dataType)
    each = rows.mapInArrow(find, StructType([key, StructField("label", IntegerType()), StructField("x", ArrayType(DoubleType()))]))
    found = each.groupBy("id", "label").agg(F.min("x").alias("x")).select("label", "x").toPandas()  # 2 * sample rows at most, however often ids repeat
    found = found.assign(key=[tuple(x) for x in found["x"]]).sort_values("key", kind="stable")
    sides = [np.array(found.loc[found["label"] == k, "x"].tolist(), float).reshape(-1, len(NAMES)) for k in (1, 0)]
    model = fit(*sides, count.get(0, 0) / max(1, sum(count.values())))
    if not all(map(len, sides)):
        return model

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                z = (features(part.column("text")) - model["centre"]) @ model["weights"]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(z)], ["id", "z"])

    ids = StructType([key, StructField("z", DoubleType())])
    placed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(place, ids)
    placed = materialise(placed.join(known, "id").select("z", "label"), "training-scores")
    n, bad = placed.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    around = [max(0.0, (bad - back) / n) for back in (1.5, 0.5)]  # between two rows, as in ``fit``
    model["threshold"] = float(np.mean(placed.agg(F.percentile_approx("z", around, ACCURACY)).first()[0]))
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``; an input column of that name is replaced."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "score"))
    at = rows.columns.index(text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = pa.array(scores(model, features(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "score"])

    return rows.mapInArrow(find, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
