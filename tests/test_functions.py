import hashlib
import math
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataframe.functions import images, security, text, vectors
from strataframe.operators import chunks, convert, graph, maintain, rank
from strataframe.plans import registry


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_ids_and_titles(spark):
    got = one(spark, a=text.concept_id(F.lit("a/b/c.markdown")), t=text.default_title(F.lit("my_first-note")), s=text.slug(F.lit("Some Long Topic " * 3)))
    assert got.a == "a/b/c" and got.t == "my first note" and got.s == "some_long_topic_some_long_topi"


def test_links(spark):
    body = "[a](./missing.md) [[ sub/x ]] [b](../../up.md) [c](other.txt) [a](missing.md)"
    assert one(spark, t=text.link_targets(F.lit(body), strict=True)).t == ["missing", "up", "sub/x"]
    assert one(spark, t=text.link_targets(F.lit(body))).t == ["missing", "up", "other.txt) [a](missing", "sub/x"]


def test_images(spark):
    body = '![alt](a.png) ![](b.jpg "title") [no](c.png) ![x](<https://x.com/a/b/c.jpg?v=2#frag>)'
    got = one(spark, r=images.references(F.lit(body))).r
    assert [(r.alt, r.src) for r in got] == [("alt", "a.png"), ("", "b.jpg"), ("x", "https://x.com/a/b/c.jpg?v=2#frag")]
    names = one(spark, a=images.file_name(F.lit("https://x.com/a/b/c.jpg?v=2#frag")), b=images.file_name(F.lit("with%20space.png")), c=images.file_name(F.lit("https://x.com/")))
    assert names == ("c.jpg", "with space.png", "image")


@pytest.mark.parametrize(
    "head, name, kind",
    [("89504E470D0A1A0A", "x", "image/png"), ("FFD8FFE0", "x", "image/jpeg"), (None, "pic.gif", "image/gif"), ("00FF", "noext", "application/octet-stream"),
     ("524946460000000057454250", "x", "image/webp"), ("0000001C6674797061766966", "x", "image/avif"),
     *((f"0000001C66747970{brand.encode().hex()}", "x", "image/heic") for brand in ("heic", "heix", "heim", "heis", "mif1"))],
)
def test_mime(spark, head, name, kind):
    data = F.unhex(F.lit(head)) if head else F.lit(None).cast("binary")
    assert one(spark, m=images.mime(data, F.lit(name))).m == kind


def test_asset_id_is_a_name_based_uuid(spark):
    got = one(spark, a=images.asset_id(F.lit("c/d"), F.lit(2), F.lit("p.png")), b=images.asset_id(F.lit("c"), F.lit(1), F.lit("asset://img_7")))
    assert got.a == f"img_{uuid.uuid5(images.NAMESPACE, 'c/d:2:p.png')}" and got.b == "img_7"


def test_modes():
    assert images.mode("Text-Only") == "text" and images.mode("hybrid") == "optional" and images.mode("full") == images.mode("multimodal") == "omni"
    with pytest.raises(ValueError):
        images.mode("loud")


@pytest.mark.parametrize("mode, alt, has, route", [("text", "", True, "text"), ("optional", "", True, "omni"), ("optional", "", False, "text"), ("optional", "a", True, "text"), ("omni", "a", True, "omni"), ("omni", "a", False, "text")])
def test_routes(spark, mode, alt, has, route):
    got = one(spark, r=images.route(mode, F.lit(alt), F.lit(has)), c=images.caption(mode, F.lit(alt), F.lit(has), F.lit("fallback")))
    assert got.r == route and got.c == (None if route == "omni" else alt or "fallback")


def test_private_addresses(spark):
    got = one(spark, **{f"h{k}": security.is_private(F.lit(h)) for k, h in enumerate(("169.254.169.254", "172.31.255.255", "8.8.8.8", "256.1.1.1", "localhost"))})
    assert tuple(got) == (True, True, False, False, True)


def test_containment():
    assert security.contained("a/../b.png", "/root/x") and not security.contained("../b.png", "/root/x") and not security.contained("/root/xy", "/root/x")


def test_truncated_vectors(spark):
    got = one(spark, a=vectors.truncated(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2), b=vectors.truncated(F.array(F.lit(2.0)), 3), c=vectors.truncated(F.array(F.lit(0.0)), 2))
    assert got.a == [0.6, 0.8] and got.b == [1.0, 0.0, 0.0] and got.c == [0.0, 0.0]


def test_last_token(spark):
    states = F.array(*(F.array(F.lit(float(k))) for k in range(3)))
    masks = ([1, 1, 0], [0, 1, 1], [0, 0, 0])
    got = one(spark, **{f"m{k}": vectors.last_token(states, F.array(*map(F.lit, m))) for k, m in enumerate(masks)})
    assert tuple(got) == ([1.0], [2.0], None)


def test_hashed_words(spark):
    words = "The quick brown fox; the dog"
    got = one(spark, v=vectors.hashed(F.lit(words), 32), e=vectors.hashed(F.lit(""), 32), n=vectors.hashed(F.lit(None).cast("string"), 32))
    assert got.v == pytest.approx(vectors.hashed_query(words, 32)) and sum(x * x for x in got.v) == pytest.approx(1)
    assert got.e == got.n == [0.0] * 32


def test_blocks_keep_their_bytes():
    body = "# Tîtle\n\npara one\nstill\n\n- a\n- b\n\n> q\n\n| x |\n|---|\n\n```mermaid\ng\n\nh\n```\nafter\n"
    got = chunks.blocks(body)
    assert [k for _, k, _, _ in got] == ["Heading", "Paragraph", "List", "Blockquote", "Table", "Diagram", "Paragraph"]
    assert all(body.encode()[a:b].decode() == t for t, _, a, b in got)
    assert chunks.blocks("") == []


def test_tables():
    assert convert.pipe_table("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table>").splitlines() == ["| A | B |", "| --- | --- |", "| 1 | 2\\|3 |"]
    spanned = "<table><tr><td colspan=2>x</td></tr></table>"
    assert convert.pipe_table(spanned) == spanned


def test_fonts_and_maths(spark):
    got = one(spark, a=convert.is_math_font(F.lit("ABC+CMMI10")), b=convert.is_fixed_font(F.lit("DejaVu Sans Mono")), c=convert.is_fixed_font(F.lit("Times")), n=convert.math_chars(F.lit("αΩ∫⨌𝐀→x²⟀⦀")))
    assert tuple(got) == (True, True, False, 7)


def test_staging_and_geometry():
    new, found = convert.staged("![a](p.png) ![b](gone.png)", "doc", {"p.png": b"x"})
    assert new.startswith(f"![a](asset://{found[0][0]})") and "gone.png" in new and len(found) == 1
    assert convert.merged_boxes([(0, 0, 10, 10), (9, 0, 20, 10), (50, 0, 60, 10)]) == [(0, 0, 20, 10), (50, 0, 60, 10)]
    assert convert.replaced_loosely("a b\n c d", "b c", "X") == "a X d"
    assert convert.latex("$x$", inline=True) == "$x$"
    with pytest.raises(ValueError):
        convert.route("sometimes", F.lit(1), F.lit(1), F.lit(1))


def test_directory_hash_ignores_order(spark):
    rows = [("a/z.md", "1"), ("a/a.md", "2"), ("b/c/d.md", "3")]
    get = lambda r: {x.dir: (x.hash, x.n) for x in maintain.directory_hashes(spark.createDataFrame(r, "path string, hash string")).collect()}
    assert get(rows) == get(rows[::-1]) and set(get(rows)) == {"a", "b/c"}


def test_walks_and_distinct(spark):
    edges = spark.createDataFrame([("LINKS_TO", a, b, "Concept") for a, b in ("ab", "ac", "bd", "cd")], "rel string, src string, dst string, dst_label string")
    assert sorted(tuple(r) for r in graph.traverse(edges, "a", "LINKS_TO", depth=2).collect()) == [("b", 1), ("c", 1), ("d", 2)]
    assert graph.traverse(edges, "a", "LINKS_TO", depth=2, walks=True).count() == 4
    assert graph.find_path(graph.steps_of(edges), "a", "d") == ["a", "b", "d"]


def test_directory_hashes_keep_up(spark):
    """Changes alone give the hashes of a build from nothing; directories without a change below aren't touched."""
    import random

    from strataframe.operators import merkle

    rng = random.Random(2)
    frame = lambda files: spark.createDataFrame([*files.items()], "path string, hash string")
    told = lambda df: {r.path: (r.hash, r.n) for r in df.collect()}
    names = [f"{d}f{k}" for d in ("", "a/", "a/b/", "a/b/c/d/", "e/", "g/h/") for k in range(3)]
    files = {n: f"{rng.random()}" for n in names}
    kept = merkle.directories(frame(files)).cache()
    assert {*told(kept)} == {"", "a", "a/b", "a/b/c", "a/b/c/d", "e", "g", "g/h"}
    for turn in range(3):
        before = dict(files)
        for n in rng.sample(names[:12] if turn else [x for x in names if x.startswith("g/")], 3):
            if turn and n in files and rng.random() < 0.5:
                del files[n]
            else:
                files[n] = f"{rng.random()}"
        changed = [(n, before.get(n), files.get(n)) for n in {*before, *files} if before.get(n) != files.get(n)]
        moved = merkle.changes(kept, spark.createDataFrame(changed, "path string, was string, now string")).cache()
        assert turn or {*told(moved)} == {"", "g", "g/h"}
        now = kept.join(moved, "path", "left_anti").union(moved.filter("hash is not null")).cache()
        built = merkle.directories(frame(files))
        assert told(now) == told(built)
        assert {r.path for r in merkle.differing(kept, now).collect()} == {*told(moved)} and merkle.differing(now, built).count() == 0
        kept = now


def test_two_sided_paths(spark):
    """The path of the one-sided walk, from fewer rows."""
    import random

    rng = random.Random(3)
    star = [("hub", f"leaf{k}") for k in range(60)] + [("a", "m1"), ("m1", "m2"), ("m2", "b"), ("b", "hub"), ("a", "n1"), ("n1", "m2"), ("s", "x"), ("x", "hub"), ("hub", "y"), ("y", "t")]
    loose = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(45)]
    edges = spark.createDataFrame([("LINKS_TO", a, b, "Concept") for a, b in star + loose], "rel string, src string, dst string, dst_label string")
    steps = graph.steps_of(edges).distinct().cache()
    near = {}
    for a, b in star + loose:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walked(a, b, most):
        level, at = {a: 0}, [a]
        while at and b not in level:
            at = sorted({y for x in at for y in near.get(x, ()) if y not in level})
            level |= {y: level[min((x for x in near[y] if x in level), key=level.get)] + 1 for y in at}
        if b not in level or level[b] > most:
            return []
        path = [b]
        while path[-1] != a:
            path.append(min(x for x in near[path[-1]] if level.get(x) == level[path[-1]] - 1))
        return path[::-1]

    pairs = [("a", "leaf3", 6), ("leaf1", "leaf2", 6), ("a", "b", 2), ("a", "b", 3), ("a", "a", 3), ("a", "v1", 6), ("v1", "nobody", 4), *((f"v{k}", f"v{k + 7}", 6) for k in (0, 5))]
    assert [graph.find_path(steps, *p) for p in pairs] == [walked(*p) for p in pairs]
    (there, back), one = graph.two_sided(steps, "s", "t", 6), graph.distances(steps, "s", 6, goal="t")
    assert sum(x.count() for x in there + back) < sum(x.count() for x in one) / 3


def test_fusion_against_ranking_everything(spark):
    near = spark.createDataFrame([(k, 1 - k / 10) for k in range(4)], "id int, sim double")
    hits = spark.createDataFrame([(k, float(k % 5)) for k in range(40)], "id int, score double")
    vr = {r.id: k for k, r in enumerate(sorted(near.collect(), key=lambda r: (-r.sim, r.id)), 1)}
    fr = {r.id: k for k, r in enumerate(sorted(hits.collect(), key=lambda r: (-r.score, r.id)), 1)}
    score = {i: round(sum(1 / (60 + m[i]) for m in (vr, fr) if i in m), 8) for i in {*vr, *fr}}
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    assert [(r.id, r.rrf) for r in rank.fuse(near, hits, 7).collect()] == want[:7]
    allowed = hits.filter("id % 2 = 1").select("id")
    assert [(r.id, r.rrf) for r in rank.fuse(near, hits, 7, allowed).collect()] == [x for x in want if x[0] % 2][:7]


@pytest.mark.parametrize("prefix", [3, 1024])
def test_capped_fusion_against_ranking_everything(spark, monkeypatch, prefix):
    """Caps and filters, where the first hits are enough and where they aren't."""
    import random

    monkeypatch.setattr(rank, "PREFIX", prefix)
    rng = random.Random(prefix)
    for cap, share in ((1, 1.0), (2, 0.3), (3, 0.05)):
        home = {k: f"p{rng.choice([0, 0, 0, 0, rng.randrange(40)])}" for k in range(200)}
        scores = {k: float(rng.randrange(30)) for k in range(200) if rng.random() < 0.7}
        sims = {k: rng.random() for k in rng.sample(range(200), 12)}
        may = {k: p for k, p in home.items() if rng.random() < share}
        vr = {i: k for k, i in enumerate(sorted(sims, key=lambda i: (-sims[i], i)), 1)}
        fr = {i: k for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)), 1)}
        ranked = sorted(((-round(sum(1 / (60 + m[i]) for m in (vr, fr) if i in m), 8), i) for i in may if i in vr or i in fr))
        taken, want = Counter(), []
        for s, i in ranked:
            taken[may[i]] += 1
            want += [(i, may[i], -s)] if taken[may[i]] <= cap else []
        near = spark.createDataFrame([*sims.items()], "id int, sim double")
        hits = spark.createDataFrame([*scores.items()], "id int, score double")
        allowed = spark.createDataFrame([*may.items()], "id int, parent string")
        assert [tuple(r) for r in rank.fuse(near, hits, 8, allowed, "parent", cap).collect()] == want[:8]


def test_wide_vectors_give_the_same_neighbours(spark):
    from strataframe.operators import index

    rows = [(k, [float((k * j) % 7) for j in range(5)]) for k in range(40)] + [(40, None), (41, [0.0] * 5)]
    vectors_ = spark.createDataFrame(rows, "id int, embedding array<double>")
    for query in ([1.0, 0.0, -2.0, 0.0, 0.5], [0.0] * 5, [0.1, 0.2, 0.3, 0.4, 0.5]):
        want = [(r.id, r.sim) for r in rank.knn(vectors_.filter("embedding is not null"), query, 9).collect()]
        assert [(r.id, r.sim) for r in index.knn_wide(index.wide(vectors_.filter("embedding is not null"), 5), query, 9).collect()] == want


def test_lint_errors(spark):
    body = "# a\n### b\ntext\n```\ncode\n```\nmore <b>x</b>\n\n~~~\nq\n~~~\n"
    got = one(spark, j=text.heading_jumps(F.lit(body)), f=text.crowded_fences(F.lit(body)), h=text.inline_html(F.lit(body)), n=text.heading_jumps(F.lit("")), e=text.crowded_fences(F.lit("")))
    assert tuple(got) == (1, 2, 2, 0, 0)
    assert one(spark, p=text.preview(F.lit("T"), F.lit("note"), F.lit("a\n\nb"))).p == "T [note] a b"


def test_pages(tmp_path):
    def broken():
        raise RuntimeError("no")

    failed = []
    assert convert.first_text([broken, lambda: " ", lambda: "x"], failed) == "x" and failed == ["broken: no"]
    assert convert.cropped((10, 10, 20, 20), (100, 50), 2.0) == (16, 56, 44, 84)
    assert convert.surgical_page("let x 2 be", [("x 2", "x^2"), ("gone", None)]) == "let $$\nx^2\n$$ be"
    regions = [{"kind": "text", "box": (0, 50, 9, 60), "text": "b"}, {"kind": "title", "box": (0, 0, 9, 9), "text": "A"}, {"kind": "figure", "box": (0, 90, 9, 99), "src": "f.png"}]
    assert convert.structured_page(regions, str) == "## A\n\nb\n\n![](f.png)" and convert.structured_page([], lambda: "w") == "w"
    assert convert.version("v1.2") == (1, 2, 0) and convert.tolerated("1.4.0", "1.2") and not convert.tolerated("2.0", "1.2")
    (tmp_path / "m.bin").write_bytes(b"x")
    assert security.verified(str(tmp_path / "m.bin"), {}) and not security.verified(str(tmp_path / "m.bin"), {"m.bin": "00"})


def test_versioned_names(spark):
    names = spark.createDataFrame([("a/x.pdf",), ("a/x.docx",), ("b.pdf",)], "path string")
    taken = spark.createDataFrame([("b.md",)], "path string")
    assert sorted(tuple(r) for r in convert.versioned_names(names, taken).collect()) == [("a/x.docx", "a/x.md"), ("a/x.pdf", "a/x_v2.md"), ("b.pdf", "b_v2.md")]


def test_encode_hash_takes_every_document(spark, tmp_path):
    texts = {1: "The thou, the OREN", 7: "one_two one", 99: None, 100: "the", 101: "...", 250: "é ü é x1"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc_id, said in texts.items():
        counts = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64 for t in re.findall(r"[^\W_]+", (said or "").lower()))
        length = math.sqrt(sum(n * n for n in counts.values()))
        want |= {(doc_id, k, round(n / length, 6)) for k, n in counts.items()}
    assert {tuple(r) for r in registry.queries()["encode_hash"](spark, str(tmp_path)).collect()} == want
