import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from strataframe.llm._store import materialise

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], DATA), name))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5]) and "doc_id" in stages[5].columns


def test_each_stage_takes_effect(stages):
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] > ids[1] > ids[2] >= ids[3] >= ids[4] == ids[5]
    texts = [dict(s.select("doc_id", "text").collect()) for s in stages[:4]]
    assert all(texts[0][i] == t for i, t in texts[2].items())
    assert any(texts[2][i] != t for i, t in texts[3].items()) or len(texts[3]) == len(texts[2])


def test_repeated_rows_stay_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    twice = docs.union(docs).union(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    found = [r[0] for r in corpus_pipeline.drop_near_duplicates(spark, twice, DATA).select("doc_id").collect()]
    assert len(found) == len(set(found)) and None in found


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[5].count()


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, size long, kept string, id string, __n int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_defined_cases_of_each_stage(spark, name, stage):
    long = " ".join(f"w{k % 7919} x{k}" for k in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"), (5, long), (None, "alone"), (None, None), (6, "tie " * 40), (7, "tie " * 40)]
    rows = [(i, t, "en", None if k % 2 else "s", len(t or ""), "r", "x", 9, "y", "z", 1) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, EXTRA)
    found = stage(spark, docs, DATA).collect()
    ids = [r["doc_id"] for r in found]
    if name == "packing":
        sizes = sum(len((t or "").split()) for _, t in texts)
        assert sum(r["words"] for r in found) == sizes and set(ids) == {i for i, _ in texts}
    else:
        assert found and list(found[0].asDict()) == docs.columns and all((r["row"], r["score"], r["size"], r["kept"], r["id"], r["__n"]) == ("r", "x", 9, "y", "z", 1) for r in found)
    if name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6] and ids.count(None) == 2
    if name == "repeated_passages":
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 4, 5] and {r["text"] for r in found if r["doc_id"] == 5} == {long}
    assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", ["op4_systematic_mixing", "op6_pivot_near_vectors", "op8_minmax_near_duplicates", "op10_difference_cover_repeats"])
def test_sql(spark, duck, name):
    from conftest import rows_of

    from strataframe.llm import queries

    found = queries.QUERIES[name](spark, DATA)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == wanted
