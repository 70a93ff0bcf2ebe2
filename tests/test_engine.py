import datetime as dt
import json

import pytest

from strataframe import cli, config, schemas, server, tools
from strataframe.engine import Engine
from strataframe.sources import markdown
from strataframe.store import Conflict, Store
from strataframe.streaming import ingest

PNG = bytes.fromhex("89504E470D0A1A0A") + b"pixels"


@pytest.fixture(scope="module")
def bundle(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    (root / "sub").mkdir()
    (root / "intro.md").write_text(
        "---\ntitle: Intro\ntags: [a, b]\ncustom: 42\ntimestamp: 2024-01-01T00:00:00Z\n---\n\n# Intro\n\nHello world, see [x](sub/deep.md) and [[missing]].\n\n![fig](pic.png)\n\n- one\n- two\n"
    )
    (root / "sub" / "deep.MARKDOWN").write_text("# Deep\n\nGraph search over vectors. [[intro]]\n\n```py\ncode\n```\n")
    (root / "pic.png").write_bytes(PNG)
    (root / "notes.rst").write_text("not a source")
    return root


@pytest.fixture(scope="module")
def engine(spark, bundle, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.import_bundle(str(bundle)) == ["intro", "sub/deep"]
    return e


def test_second_import_finds_nothing(engine, bundle):
    assert engine.import_bundle(str(bundle)) == []


def test_metadata(engine):
    found = engine.get_by_id("intro")
    assert found["title"] == "Intro" and found["tags"] == ["a", "b"] and found["custom"] == "42" and found["type"] == "note"
    assert found["timestamp"] == dt.datetime(2024, 1, 1)
    assert engine.get_by_id("sub/deep")["title"] == "deep"
    assert engine.get_by_id("none") is None


def test_chunks_and_reconstruction(engine):
    kinds = [r.block_type for r in engine.get_chunks("sub/deep").collect()]
    assert kinds == ["Heading", "Paragraph", "CodeBlock"]
    assert engine.reconstruct_document("intro").rstrip() == engine.get_by_id("intro")["body"].rstrip()
    assert engine.reconstruct_document("none") is None


def test_links_paths_and_directories(engine):
    assert [r.target_id for r in engine.list_broken_links().collect()] == ["missing"]
    assert engine.find_path("intro", "sub/deep") == ["intro", "sub/deep"]
    assert engine.find_path("intro", "nowhere") == []
    assert engine.find_path("intro", "intro") == ["intro"]
    assert [(r.id, r.depth) for r in engine.traverse("intro").collect()] == [("sub/deep", 1)]
    assert [(r.id, r.type) for r in engine.list_directory().collect()] == [("sub", "Directory"), ("intro", "note")]
    assert engine.ancestry("a/b/c") == ["a", "a/b"]
    with pytest.raises(ValueError):
        engine.traverse("intro", "EATS")


def test_search(engine):
    assert engine.search_hybrid("graph vectors").first().id == "sub/deep"
    assert engine.search_hybrid("graph", tags=["a"]).first().id == "intro"
    chunks = engine.search_chunks("hello world", limit=3, max_chunks_per_doc=1).collect()
    assert chunks[0].parent_doc_id == "intro" and len({c.parent_doc_id for c in chunks}) == len(chunks)
    assert engine.search_chunks_with_hub_score("hello", limit=2).count() == 2
    assert engine.search_hybrid("graph", include_chunks=True).first().chunks


def test_images(engine):
    (image,) = engine.list_images("intro").collect()
    assert image.mime_type == "image/png" and image.caption == "fig" and image.embed_route == "text"
    assert engine.get_image_data(image.id) == PNG
    assert engine.search_images("fig").first().id == image.id


def test_export(engine, tmp_path):
    assert engine.export_bundle(str(tmp_path)) == ["intro", "sub/deep"]
    text = (tmp_path / "intro.md").read_text()
    assert 'title: "Intro"' in text and "## Cited By\n\n- [deep](sub/deep.md)" in text and "See Also" not in text
    assert "[deep](deep.md)" in (tmp_path / "sub" / "index.md").read_text()
    again = markdown.parse(text)
    assert again["title"] == "Intro" and again["tags"] == ["a", "b"] and again["extra"] == {"custom": "42"}


def test_tools(engine):
    listed = tools.schemas()
    assert len(listed) == 16 and {t["name"] for t in listed} == {*tools.READ, *tools.WRITE}
    assert json.loads(tools.call(engine, "find_path", {"start_id": "intro", "end_id": "sub/deep"})) == ["intro", "sub/deep"]
    assert json.loads(tools.call(engine, "get_chunks", {"concept_id": "intro"}))[0]["id"] == "intro#chunk:0"
    with pytest.raises(ValueError):
        tools.call(engine, "no_such_tool", {})


def test_server(engine):
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
           {"id": 3, "method": "tools/call", "params": {"name": "find_path", "arguments": {"start_id": "intro", "end_id": "sub/deep"}}},
           {"id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 5, "method": "what"}]
    got = {r["id"]: r for r in server.answers(engine, [*map(json.dumps, ask), "", "{"])}
    assert len(got[2]["result"]["tools"]) == 16 and json.loads(got[3]["result"]["content"][0]["text"]) == ["intro", "sub/deep"]
    assert got[4]["result"]["isError"] and "error" in got[5] and got[None]["error"]["code"] == -32700


def test_previews_and_missing_library(engine, bundle):
    (image,) = engine.list_images("intro").collect()
    assert [r.id for r in engine.concepts_including(image.id).collect()] == ["intro"]
    row = engine.preview("intro").first()
    assert row.label.startswith("Intro [note] # Intro") and bytes(row.data) == PNG
    assert ("path", "string") in engine.table_info("file_hash")
    with pytest.raises(markdown.MissingConverter):
        engine.ingest_pdf(str(bundle / "intro.md"), reader="no_such_library:pages")


def test_changes_deletes_and_recovery(spark, tmp_path):
    root = tmp_path / "b"
    root.mkdir()
    for name in ("x", "y"):
        (root / f"{name}.md").write_text(f"# {name}\n\n[[z]]\n")
    e = Engine(spark, str(tmp_path / "s"))
    assert e.import_bundle(str(root)) == ["x", "y"]
    broken = e.list_broken_links()
    (root / "x.md").write_text("# x changed\n")
    (root / "y.md").unlink()
    (root / "z.md").write_text("# z\n")
    assert e.import_bundle(str(root)) == ["x", "z"]
    assert sorted(r.id for r in e.concepts().collect()) == ["x", "z"]
    assert {r.parent_doc_id for r in e.chunks().collect()} == {"x", "z"}
    assert e.repair_links(broken) == 1 and e.list_broken_links().count() == 0
    now = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    assert e.soft_delete("x", now) and not e.soft_delete("x", now)
    assert e.list_deleted(now + dt.timedelta(hours=1)).first().recoverable
    assert e.recover("x") == "x" and e.list_deleted().count() == 0
    assert e.soft_delete("x", now) and e.purge_expired(now + dt.timedelta(hours=25)) == 1
    assert e.purge("z") and not e.purge("z")
    assert e.is_dirty() and e.reindex() and not e.is_dirty() and not e.reindex()
    thought = e.ingest_thoughts("deep thing", "My Topic", now=now)
    assert thought.startswith("thought_my_topic_20240501000000_")
    kept = e.get_by_id(thought)
    assert kept["tags"] == ["My Topic", "reasoning", "thought"] and kept["description"] == "Reasoning about My Topic"
    assert kept["body"].startswith('---\ntitle: "Thought: My Topic"\ntype: thought\nthought_type: reasoning\ntopic: My Topic\ntags: [thought, reasoning, My Topic]\ncreated: 2024') and kept["body"].endswith("---\n\ndeep thing\n")
    (root / "n b.md").write_text("---\nsummary: short\ntags: [q]\n---\n# N  \n\n\n\n\ntext")
    assert e.ingest_md(str(root / "n b.md"), tags=["p", "q"]) == "n_b"
    got = e.get_by_id("n_b")
    assert got["description"] == "short" and got["tags"] == ["p", "q"] and "\n\n\n" not in got["body"]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("p", "h")], "path string, hash string")
    store.commit({"file_hash": schemas.migrated(rows, "file_hash")})
    other = Store(spark, str(tmp_path), timeout=0.3)
    assert other.table("file_hash").first().concept_id is None
    other.manifest = lambda m=store.manifest(): m | {"number": 0}
    with pytest.raises(Conflict):
        other.commit({}, {"x": 1})
    with store.writing(), pytest.raises(Conflict):  # waits, but not for ever
        other.commit({}, {"x": 1})
    store.commit({"file_hash": store.table("file_hash")})
    assert store.vacuum() == 1 and store.table("file_hash").count() == 1
    with pytest.raises(ValueError):
        schemas.checked_dimension(31)


def test_store_changes_merge(spark, tmp_path, monkeypatch):
    from strataframe import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    store, want = Store(spark, str(tmp_path)), {}
    for k in range(7):
        rows = {f"p{j}": f"h{k}" for j in range(k, k + 3)}
        gone = {*rows, f"p{k - 1}"}
        want = {p: h for p, h in want.items() if p not in gone} | rows
        change = (spark.createDataFrame([*rows.items()], "path string, hash string").selectExpr("path", "hash", "path concept_id"), spark.createDataFrame([(g,) for g in gone], "key string"))
        with store.pinned():
            store.commit({"file_hash": change})
            assert store.manifest()["number"] == k  # the pin stays
        assert {r.path: r.hash for r in store.table("file_hash").collect()} == want
    assert max(len(p) for p in store.manifest()["tables"].values()) <= 3
    store.commit({"file_hash": (None, spark.createDataFrame([("p8",)], "key string"))})
    assert "p8" not in {r.path for r in store.table("file_hash").collect()}


def test_a_change_costs_its_own_size(spark, tmp_path):
    root = tmp_path / "b"
    root.mkdir()
    for k in range(60):
        (root / f"n{k}.md").write_text(f"# n{k}\n\n" + f"words of number {k} " * 200)
    e = Engine(spark, str(tmp_path / "s"))
    e.import_bundle(str(root))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s" / "tables").rglob("*.parquet"))
    whole = size()
    (root / "n7.md").write_text("# n7 changed\n")
    assert e.import_bundle(str(root)) == ["n7"]
    assert size() - whole < 0.6 * whole and e.get_by_id("n7")["body"] == "# n7 changed\n"
    changed = [p[-1] for n, p in e.store.manifest()["tables"].items() if n == "concept"]
    rows = spark.read.parquet(f"{e.store.path}/{changed[0]['rows']}")
    assert [r.id for r in rows.select("id").collect()] == ["n7"]


def test_traverse_takes_the_type_before_the_limit(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    kinds = {f"c{k:03}": "chapter" if k >= 120 else "note" for k in range(150)}
    rows = [("hub", "note"), *kinds.items()]
    concept = spark.createDataFrame(rows, "id string, type string").selectExpr("id", "type", "id title", "cast(null as string) description", "cast(null as string) resource", "array('t') tags", "cast(null as timestamp) timestamp", "'' body", "cast(null as array<float>) embedding", "cast(null as map<string,string>) extra")
    e.store.commit({"concept": concept, "link_raw": spark.createDataFrame([("hub", k) for k in kinds], "src string, target string")})
    assert [r.id for r in e.traverse("hub", node_type="chapter").collect()] == [f"c{k:03}" for k in range(120, 150)]
    assert [r.id for r in e.traverse("hub").collect()] == [f"c{k:03}" for k in range(100)]
    assert [r.id for r in e.traverse("hub", limit=3, node_type="note").collect()] == ["c000", "c001", "c002"]


def test_empty_files_are_concepts(spark, tmp_path):
    root = tmp_path / "b b"
    root.mkdir()
    (root / "full.md").write_text("# x\n")
    (root / "empty+1 %20.md").write_bytes(b"")
    e = Engine(spark, str(tmp_path / "s"))
    assert e.import_bundle(str(root)) == ["empty+1 %20", "full"]
    (root / "full.md").write_bytes(b"")
    assert e.import_bundle(str(root)) == ["full"] and e.get_by_id("full")["body"] == ""
    assert e.import_bundle(str(root)) == []


def test_remote_images_behind_the_list(spark, tmp_path):
    (tmp_path / "b").mkdir()
    urls = ["https://cdn.example.com/a.png", "https://evil.example.net/b.png", "http://10.0.0.1/c.png"]
    (tmp_path / "b" / "x.md").write_text("".join(f"![]({u})\n" for u in urls))
    for remote in (True, False):
        settings = config.Config(remote_images=remote, allowed_domains=("*.example.com",))
        e = Engine(spark, str(tmp_path / f"s{remote}"), settings, fetch=lambda url: b"GIF89a" + url.encode())
        e.import_bundle(str(tmp_path / "b"))
        found = {r.file_name: r.id for r in e.list_images("x").collect()}
        data = {n: e.get_image_data(i) for n, i in found.items()}
        assert data == {"a.png": b"GIF89ahttps://cdn.example.com/a.png" if remote else None, "b.png": None, "c.png": None}


def test_imports_in_proportion(spark, tmp_path):
    """The least path of an id, files that fail, directories by their children, hashes that aren't made again."""
    import os

    from strataframe.operators import merkle

    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.md", "# A md"), ("a.txt", "# A txt"), ("bad.md", "---\ntitle: [x\n---\nbody"), ("sub/c.md", "# C")):
        (root / name).write_text(text)
        os.utime(root / name, (1, 1))
    e = Engine(spark, str(tmp_path / "store"))
    assert e.import_bundle(str(root)) == ["a", "sub/c"]
    assert e.get_by_id("a")["body"].strip() == "# A md" and [r.path for r in e.import_errors().collect()] == ["bad.md"]
    hashes = e.store.table("file_hash")
    dirs = {r.path: (r.hash, r.files) for r in e.store.table("dir_hash").collect()}
    assert dirs == {r.path: (r.hash, f) for r in merkle.directories(hashes).collect() for f in [sorted(x.path for x in hashes.collect() if x.path.rpartition("/")[0] == r.path)]}
    (root / "a.md").unlink()
    (root / "bad.md").write_text("# Good now")
    assert e.import_bundle(str(root)) == ["a", "bad"] and e.get_by_id("a")["body"].strip() == "# A txt" and e.import_errors().count() == 0
    after = {r.path: r.hash for r in e.store.table("dir_hash").collect()}
    assert after["sub"] == dirs["sub"][0] and after[""] != dirs[""][0]
    known = e.store.table("file_hash").selectExpr("path", "'kept' hash", "concept_id", "size", "modified")
    assert {r.path: r.hash == "kept" for r in markdown.snapshot(markdown.scan(spark, str(root)), known).collect()} == {"a.txt": True, "bad.md": False, "sub/c.md": True}


def same_graph(engine):
    """Kept edges and hub counts against what the other tables say."""
    from strataframe.operators import rank

    kept, derived = (sorted(map(tuple, f().collect())) for f in (engine.edges, engine.derived_edges))
    hubs = sorted(map(tuple, rank.hub_scores(engine.derived_edges()).collect()))
    assert "adjacency" in engine.store.manifest()["tables"] and kept == derived and sorted(map(tuple, engine.hubs().collect())) == hubs
    return len(kept)


def test_edges_are_kept(spark, tmp_path):
    """After random imports, purges, deletions and recoveries."""
    import random

    rng = random.Random(5)
    root = tmp_path / "notes"
    names = [f"{d}n{k}" for k, d in enumerate(["", "a/", "a/", "a/b/", "c/", "c/d/e/"])]
    for d in ("a/b", "c/d/e"):
        (root / d).mkdir(parents=True)
    (root / "pic.png").write_bytes(PNG)
    e, sizes = Engine(spark, str(tmp_path / "store")), []
    for turn in range(3):
        for n in names:
            if rng.random() < (0.8 if turn == 0 else 0.4):
                links = " ".join(f"[[{rng.choice(names)}]]" for _ in range(3))
                (root / f"{n}.md").write_text(f"# {n}\n\n{links} {turn}\n\n![p](pic.png)\n")
            elif turn and rng.random() < 0.4:
                (root / f"{n}.md").unlink(missing_ok=True)
        e.import_bundle(str(root))
        sizes.append(same_graph(e))
    there = sorted(r.id for r in e.concepts().select("id").collect())
    assert e.purge(there[0]) and e.soft_delete(there[1])
    sizes.append(same_graph(e))
    assert e.recover(there[1]) == there[1]
    same_graph(e)
    assert e.reindex(force=True) and len({*sizes}) > 1
    same_graph(e)


def test_image_encoding_with_reuse(spark, tmp_path):
    """Images routed to the image encoder get vectors of their bytes; those whose content stays aren't encoded again."""
    root, log = tmp_path / "notes", tmp_path / "encoded"
    root.mkdir()
    for n, body in (("a", b"aaaa" * 9), ("b", b"bcbc" * 9), ("c", b"xyz" * 9)):
        (root / f"{n}.png").write_bytes(PNG + body)
    write = lambda extra: (root / "n.md").write_text(f"# N{extra}\n\n![](a.png) ![](b.png) ![said](c.png)\n")
    write("")

    def make():
        class Logged:
            dim = 64

            def encode(self, values):
                from strataframe.functions.vectors import HashedBytes

                with open(log, "a") as f:
                    f.writelines("1\n" for v in values if isinstance(v, bytes))
                return HashedBytes(64).encode(values)

        return Logged()

    count = lambda: len(log.read_text().split()) if log.exists() else 0
    e = Engine(spark, str(tmp_path / "store"), config.Config(image_mode="optional"), image_encoder=make)
    e.import_bundle(str(root))
    stored = {r.file_name: r for r in e.store.table("image_asset").collect()}
    assert count() == 2 and [stored[f"{n}.png"].embed_route for n in "abc"] == ["omni", "omni", "text"]
    assert any(stored["a.png"].embedding) and stored["a.png"].embedding != stored["b.png"].embedding
    assert e.search_images("bcbcbcbcbcbc", use_text_model=False).first().file_name == "b.png"
    assert e.search_images("said").first().file_name == "c.png"
    write(" again")
    e.import_bundle(str(root))
    assert count() == 2 and {r.file_name: r.embedding for r in e.store.table("image_asset").collect()} == {n: r.embedding for n, r in stored.items()}
    (root / "b.png").write_bytes(PNG + b"new bytes")
    write(" and again")
    e.import_bundle(str(root))
    changed = {r.file_name: r.embedding for r in e.store.table("image_asset").collect()}
    assert count() == 3 and changed["b.png"] != stored["b.png"].embedding and changed["a.png"] == stored["a.png"].embedding


def planted(dim, n=24000, groups=20):
    """Unit vectors, ten of them near each of some bases; the bases."""
    import numpy as np

    rng = np.random.default_rng(dim)
    x, base = rng.normal(size=(n, dim)), rng.normal(size=(groups, dim))
    for k in range(groups):
        x[k * 10 : k * 10 + 10] = base[k] + 0.45 * rng.normal(size=(10, dim))
    x = x[rng.permutation(n)]
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    return unit(x).astype(np.float32), unit(base)


@pytest.mark.parametrize("dim", [64, 256])
def test_vector_index(spark, tmp_path, dim):
    """On by default: recall at ten over 0.95, and below a tenth of the vectors' bytes read for a search."""
    import numpy as np
    import pyarrow as pa

    from strataframe.operators import quantised as Q

    x, base = planted(dim)
    e = Engine(spark, str(tmp_path), config.Config(dimension=dim))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))
    rows = spark.createDataFrame(pa.table({"id": [f"c{k}" for k in range(len(x))], "embedding": vectors}))
    concept = rows.selectExpr("id", "'note' type", "id title", "'' description", "cast(null as string) resource", "array('t') tags", "cast(null as timestamp) timestamp", "'' body", "embedding", "cast(null as map<string,string>) extra")
    e.store.commit({"concept": concept})
    assert e.reindex() and not e.reindex()
    quantiser, index = e._quantiser("concept"), e.store.table("concept_cell")
    assert quantiser.books.shape == (dim // 8, 256, 8) and index.count() == len(x) and e.model_info()["cells"] == {"concept": 155, "chunk": 0}
    right, read = 0, 0
    for q in base[:6]:
        want = np.argsort(-(x.astype(float) @ q), kind="stable")[:10]
        found = e._near("concept", q.tolist(), 10)
        got = {r.id: r.sim for r in found.collect()}
        right += len({f"c{k}" for k in want} & {*got})
        assert all(abs(got[f"c{k}"] - float(x[k].astype(float) @ q)) < 1e-6 for k in want if f"c{k}" in got)  # ranked exactly
        read += Q.rows_scanned(Q.about(index, quantiser, q, 64)) * (dim // 8 + 4 + 6) + Q.rows_scanned(found) * 4 * dim
    assert right >= 0.95 * 60 and read / 6 < 0.1 * len(x) * 4 * dim
    assert e.purge(e._near("concept", base[0].tolist(), 1).first().id) and e._quantiser("concept") is not None
    assert e.store.table("concept_cell").count() == len(x) - 1
    exact = Engine(spark, str(tmp_path), config.Config(dimension=dim, probes=0))
    assert [r.id for r in exact._near("concept", base[1].tolist(), 5).collect()] == [r.id for r in e._near("concept", base[1].tolist(), 5).collect()]


def test_quantiser_defined_cases(spark):
    from strataframe.operators import quantised as Q

    assert Q.fit(spark.createDataFrame([], "id string, embedding array<float>")) is None
    rows = spark.createDataFrame([("a", [1.0] * 9), ("b", None), ("c", [0.5]), ("d", [None] + [0.0] * 8), ("e", [])], "id string, embedding array<float>")
    q = Q.fit(rows)
    found = Q.coded(rows, q)
    assert q.centres.shape[1] == 9 and {r.id for r in found.collect()} == {"a", "d"}
    assert [(r.id, r.sim) for r in Q.nearest(found, q, [1.0] * 9, 5).collect()] == [("a", 9.0), ("d", 0.0)]
    cells, books = q.rows()
    again = Q.Quantiser.of_rows(cells[::-1], books[::-1])
    assert (again.centres == q.centres).all() and (again.books == q.books).all()


def test_compressed_query_is_exact_among_close_vectors(spark, tmp_path):
    """3,000 vectors whose inner products differ by less than what their codes leave out."""
    import numpy as np

    from strataframe.plans import registry

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3001, 64))
    x[1:] -= np.outer(x[1:] @ x[0], x[0]) / (x[0] @ x[0])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = 0.9 - 1e-5 * rng.permutation(3000)
    x[1:] = near[:, None] * x[0] + np.sqrt(1 - near**2)[:, None] * x[1:]
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(9000, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, wanted = (registry.queries()[n](spark, str(tmp_path)).collect() for n in ("vector_topk_compressed", "vector_topk"))
    assert [tuple(r) for r in found] == [tuple(r) for r in wanted[:10]]


def test_pages_become_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from strataframe.operators import convert

    def reader(content):
        table = "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"
        yield content.decode()
        yield {"text": "α" * 40 + " x 2", "formulas": [{"read": "x 2", "latex": "x^2"}]}
        yield {"text": "", "images": ["p.png"], "regions": [{"kind": "table", "box": [0.0, 0.0, 9.0, 9.0], "text": table, "src": None}]}

    files = spark.createDataFrame([("a/x.pdf", b"one"), ("a/x.docx", b"two")], "path string, content binary")
    pages = markdown.read_pages(files, reader)
    got = {r.path: r for r in convert.documents(pages, "auto", spark.createDataFrame([("b.md",)], "path string")).collect()}
    maths = "α" * 40
    want = f"{{}}\n\n---\n\n{maths} $$\nx^2\n$$\n\n---\n\n| A |\n| --- |\n| 1 |\n\n![](p.png)"
    assert {p: (r.target, r.text) for p, r in got.items()} == {"a/x.docx": ("a/x.md", want.format("two")), "a/x.pdf": ("a/x_v2.md", want.format("one"))}
    routes = [r.route for r in convert.assembled(pages.filter("path = 'a/x.pdf'"), "auto").orderBy("page").select(F.col("route")).collect()]
    assert routes == ["fast", "heavy", "heavy"]
    never = convert.documents(pages, "never").filter("path = 'a/x.pdf'").first().text
    assert never.startswith(f"one\n\n---\n\n{maths} x 2\n\n---\n\n")


def test_config(tmp_path):
    (tmp_path / "strataframe.toml").write_text("dimension = 128\nchunk_overlap = 9\n")
    found = config.load({"chunk_overlap": 0}, str(tmp_path), {"STRATAFRAME_DIMENSION": "256", "STRATAFRAME_ALLOWED_DOMAINS": "a.b,c.d"})
    assert found.dimension == 256 and found.chunk_overlap == 0 and found.allowed_domains == ("a.b", "c.d")
    with pytest.warns(UserWarning):
        config.load({"hub_weight": 2.0}, env={})


def test_command_line(engine, capsys):
    p = cli.parser()
    show = lambda *a: (cli.show(cli.run(engine, p.parse_args([engine.store.path, *a]))), capsys.readouterr().out)[1]
    assert json.loads(show("get", "intro"))["title"] == "Intro"
    assert json.loads(show("path", "intro", "sub/deep")) == ["intro", "sub/deep"]
    assert "sub/deep" in show("search", "graph", "--limit", "3")
    assert json.loads(show("init"))["dimension"] == 64
    info = json.loads(show("model-info"))
    assert info["encoder"] == "hashed words" and info["image_mode"] == "text" and info["cells"] == {"concept": 0, "chunk": 0}
    with pytest.raises(SystemExit):
        p.parse_args([engine.store.path, "nothing"])


def test_bad_front_matter_is_an_error_row(spark, tmp_path):
    (tmp_path / "bad.md").write_text("---\na: [\n---\nbody")
    (tmp_path / "empty.md").write_text("\n")
    rows = {r.id: r for r in markdown.concepts(markdown.scan(spark, str(tmp_path))).collect()}
    assert rows["bad"].error and rows["empty"].error is None and rows["empty"].body.strip() == ""


def test_missing_converter(spark):
    with pytest.raises(markdown.MissingConverter):
        markdown.convert_pages(spark.createDataFrame([], "path string, content binary"), "no_such_library:pages")


def test_stream_import(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# A\n\nalpha\n")
    e = Engine(spark, str(tmp_path / "s"))
    for _ in range(2):
        ingest.import_stream(e, str(src), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.id for r in e.concepts().collect()] == ["a"]
    counts = ingest.event_counts(spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "x", 2.0)], "ts timestamp, event_type string, value double"))
    assert counts.first().n == 1
