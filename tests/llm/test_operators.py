"""Each operator against a brute-force version on small tables, and its defined cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strataframe.llm import html_template, licenses, minmax, mixing, mpeg_audio, packing, pivots, quality, queries, simple8b, substrings

DATA = "/root/testdata/sf0.001"
TOKENIZER = simple8b.public_tokenizer("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, kept string, id string, row string"


def docs_of(spark, texts, sources=None):
    """A documents table with extra columns whose names clash with what operators use."""
    rows = [(k, t, "en", (sources or {}).get(k, "s"), 1, "x", "y", "z", "w", "v") for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def text_of(rng, n, vocabulary=400):
    return " ".join(f"W{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def edge_texts():
    rng = np.random.default_rng(3)
    long = text_of(rng, 6000, 5000)
    base = text_of(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, long), (7, long), (8, base), (9, " ".join(near)), (10, base.upper()),
            (11, "a b c d"), (12, "a b c d"), (13, "é ü　x \x1c y"), (None, base), (None, None), (8, base), (14, text_of(rng, 34)), (15, "loop again " * 60)]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_by_brute(texts):
    sets = defaultdict(list)
    for i, t in texts:
        if i is not None:
            sets[i].append(shingles(t))
    linked = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    return components_of(sets, linked)


def test_near_duplicates_edges(spark, edge_texts):
    found = minmax.near_duplicates(docs_of(spark, edge_texts)).collect()
    want = near_by_brute(edge_texts)
    assert len(found) == len(edge_texts)
    assert Counter((r.id, r.n_shingles) for r in found) == Counter((i, len(shingles(t))) for i, t in edge_texts)
    assert all(r.component_id == want.get(r.id) and r.kept == (r.id is None or r.id == r.component_id) for r in found)


def test_near_duplicates_real(spark, real):
    texts = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert {r.id: r.component_id for r in minmax.near_duplicates(real).collect()} == near_by_brute(texts)


def test_near_duplicates_chain_and_large_group(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(80):
        w = list(words)
        for at in rng.choice(300, 9, replace=False):
            w[at] = f"x{rng.integers(10**9)}"
        texts.append((k, " ".join(w)))
    assert {r.id: r.component_id for r in minmax.near_duplicates(docs_of(spark, texts)).collect()} == near_by_brute(texts)


def removed_by_brute(texts, window=35):
    words = [WORD.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def test_repeats_edges(spark, edge_texts):
    rng = np.random.default_rng(8)
    passage = text_of(rng, 40)
    more = [(20 + k, f"{text_of(rng, 11 + k)} {passage} {text_of(rng, 9)}") for k in range(23)]  # all distances modulo the period
    exact = " ".join(passage.split()[:35])
    more += [(50, f"{exact} end"), (51, " ".join(passage.split()[:34]) + " other")]
    texts = [*edge_texts, *more]
    found = substrings.remove_repeats(docs_of(spark, texts))
    assert found.columns.count("kept") == 1 and "source" in found.columns
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == removed_by_brute(texts)


def test_repeats_real(spark, real):
    texts = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    found = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(real).collect())
    assert found == Counter({(*k[:3], hashlib.sha256(k[3].encode()).hexdigest()): n for k, n in removed_by_brute(texts).items()})


def test_cover():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def test_mixing(spark, edge_texts):
    rng = np.random.default_rng(2)
    texts = [*edge_texts, *((100 + k, text_of(rng, int(rng.integers(1, 60)))) for k in range(300))]
    sources = {k: (None if k % 7 == 0 else f"s{k % 5}") for k, _ in texts if k is not None}
    mixed = mixing.mix(docs_of(spark, texts, sources))
    rows = mixed.collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free, rest = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while True:  # reshare by weight until none is above
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest, free = rest - sum(3 * sizes[s] for s in over), free - over
    target |= share
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in sizes)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs_of(spark, texts[::-1], sources)).collect()))
    assert mixing.emitted(mixed).count() == sum(r.copies for r in rows)


def test_packing(spark, edge_texts):
    rows = packing.pack(docs_of(spark, edge_texts)).collect()
    sizes = Counter((i, len(WORD.findall(t or ""))) for i, t in edge_texts)
    whole = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        assert r.words <= packing.LENGTHS[-1] and r.bin_length in packing.LENGTHS and r.first_word == r.piece * packing.LENGTHS[-1]
        whole[r.doc_id] += r.words
        bins[r.bin_id].append(r)
    assert sum(whole.values()) == sum(n * c for (_, n), c in sizes.items())
    for members in bins.values():
        used = sum(m.words for m in members)
        assert used == members[0].bin_used <= members[0].bin_length and (members[0].bin_length == 512 or used > members[0].bin_length // 2)
        spans = sorted((m.bin_offset, m.bin_offset + m.words) for m in members)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))


def test_packing_is_no_worse_than_one_length():
    sizes = np.random.default_rng(1).integers(1, 3000, 500)
    found = packing.pack_shard(sizes)
    total = sum(dict(zip(found["bin"].tolist(), found["bin_length"].tolist())).values()) + packing.OVERHEAD * len(set(found["bin"].tolist()))
    ordered = sorted(sizes.tolist(), reverse=True)
    assert total <= min(packing.cost(packing.best_fit(ordered, packing.LENGTHS, p)[1], packing.LENGTHS) for p in packing.LENGTHS)
    assert sizes.sum() <= total <= 1.2 * sizes.sum()


def least_cost(sizes, lengths, overhead):
    """The optimum, over all ways to divide the items into bins."""
    def divided(items):
        if not items:
            yield []
            return
        first, rest = items[0], items[1:]
        for parts in divided(rest):
            yield [[first], *parts]
            for k in range(len(parts)):
                yield [*parts[:k], [first, *parts[k]], *parts[k + 1 :]]

    fine = (p for p in divided(sizes) if all(sum(b) <= lengths[-1] for b in p))
    return min(packing.cost([sum(b) for b in p], lengths, overhead) for p in fine)


def test_packing_against_the_optimum():
    rng = np.random.default_rng(12)
    total = optimum = exact = 0
    for _ in range(60):
        lengths, overhead = (8, 12, 20), int(rng.integers(0, 4))
        sizes = rng.integers(1, 21, int(rng.integers(1, 8)))
        found = packing.pack_shard(sizes, lengths, overhead)
        bins = dict(zip(found["bin"].tolist(), found["bin_length"].tolist()))
        mine, best = sum(bins.values()) + overhead * len(bins), least_cost(sizes.tolist(), lengths, overhead)
        assert best <= mine
        total, optimum, exact = total + mine, optimum + best, exact + (mine == best)
    assert total <= 1.03 * optimum and exact >= 45


def test_packing_opens_lengths_jointly():
    sizes = [600] * 10 + [400] * 10 + [500] * 7
    ordered = sorted(sizes, reverse=True)
    alone = [packing.cost(packing.best_fit(ordered, packing.LENGTHS, p)[1], packing.LENGTHS) for p in packing.LENGTHS]
    joint = packing.cost(packing.best_fit(ordered, packing.LENGTHS)[1], packing.LENGTHS)
    assert joint <= min(alone) and joint <= 10 * (1024 + 8) + 3 * (1024 + 8) + (512 + 8)


def test_packing_divides_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rows = packing.pack(docs_of(spark, [*((None, "") for _ in range(900)), *((k, "a b c") for k in range(100))])).collect()
    assert len(rows) == 1000 and sum(r.words for r in rows) == 300
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    assert all(sum(m.words for m in b) == b[0].bin_used for b in bins.values()) and len(bins) > 20


def test_simple8b_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 255, 256, 257, 2000):
        for most in (1, 2, 300, 50_000, 2**20, 2**60 - 1, 2**64 - 1):
            x = rng.integers(0, most, n, dtype=np.uint64, endpoint=most == 1)
            x[n // 3 : n // 2] = 0
            ids, lengths = simple8b.read_segment(simple8b.segment(x, np.array([n])))
            assert (ids == x).all() and lengths.tolist() == [n]
    with pytest.raises(ValueError):
        simple8b.read_segment(bytes(simple8b.HEADER.size))


def tokens_by_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_tokens(spark, edge_texts):
    odd = ["a  b", "x\ny z", " lead", "trail ", "\n\n a", "<|endoftext|> hi", "it's  'll ok", "é à×, ÷.", "a b c", "w\t q", " a b\n\nc  d e.", "x,y.z!\nA", "日本 語、 ok"]
    texts = [*edge_texts, *((100 + k, t) for k, t in enumerate(odd))]
    found = simple8b.read_tokens(simple8b.write_tokens(docs_of(spark, texts), TOKENIZER)).collect()
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _), ids in zip(texts, tokens_by_library([t for _, t in texts])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))


def test_tokens_real(spark, real):
    texts = [(r.doc_id, r.text) for r in real.orderBy("doc_id").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_simple8b_tokens(spark, DATA).collect()}
    at = 0
    for (i, _), ids in zip(texts, tokens_by_library([t for _, t in texts])):
        assert found[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_of_another_pre_tokenizer(spark, edge_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert simple8b.chunkable(TOKENIZER) and not simple8b.chunkable(path)
    t = Tokenizer.from_file(path)
    want = Counter((i, 1 + len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in edge_texts)
    found = simple8b.read_tokens(simple8b.write_tokens(docs_of(spark, edge_texts), path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want


def test_tokens_of_a_table_that_forgets():
    encoder = simple8b.Encoder(TOKENIZER)
    encoder.table.most = 300
    rng = np.random.default_rng(6)
    for _ in range(12):
        texts = [f"the the {text_of(rng, 200, 4000)}, and\nthe end." for _ in range(3)]
        ids, lengths = encoder(pa.array(texts))
        want = [x[:-1] for x in tokens_by_library(texts)]
        assert ids.tolist() == [*itertools.chain(*want)] and lengths.tolist() == [*map(len, want)]
    assert encoder.table.n < 1000


def test_tokens_of_equal_rows_divide(spark):
    rows = [(None if k % 3 else k, "same text") for k in range(3000)]
    found = simple8b.read_tokens(simple8b.write_tokens(docs_of(spark, rows).repartition(8), TOKENIZER)).collect()
    assert sorted(r.start for r in found) == [3 * k for k in range(3000)]
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None] * 2000 + [k for k in range(3000) if k % 3 == 0]


def test_media(spark, edge_texts):
    found = mpeg_audio.read_media(mpeg_audio.write_media(docs_of(spark, edge_texts))).collect()
    want = Counter()
    for i, t in edge_texts:
        raw = (t or "").encode()
        want[i, len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))] += 1
    assert Counter((r.id, r.n_bytes, bytes(r.payload)) for r in found) == want
    assert all(r.bad_checksums == r.junk == 0 and r.table_frames == r.frames and r.duration == r.frames * 1152 / 48000 for r in found)


def test_media_with_tag_in_the_payload():
    for n in [*range(1, 400), 1500, 3000]:
        for at in range(0 if n < 300 else n - 200, n - 2, 1 if n < 140 else 7):
            payload = mpeg_audio.pad(b"x" * at + b"TAG" + b"y" * (n - at - 3))
            data = mpeg_audio.store(payload, n)
            for media in (data, data + b"TAG" + bytes(125)):
                found = mpeg_audio.parse(media)
                assert b"".join(found["bodies"])[: len(payload)] == payload and found["junk"] == 0


def test_media_resynchronises():
    payload = mpeg_audio.pad(b"some text " * 500)
    data = mpeg_audio.store(payload, 5000)
    head = data[:10]
    size = int.from_bytes(head[8:10], "big") + 10
    broken = bytearray(data[:size] + b"\xff\xfbjunk" + data[size:] + b"TAG" + bytes(125))
    found = mpeg_audio.parse(bytes(broken))
    assert found["junk"] == 6 and b"".join(found["bodies"])[: len(payload)] == payload
    clean = mpeg_audio.parse(data)
    hurt = bytearray(data)
    hurt[clean["offsets"][1] + 10] ^= 1
    assert mpeg_audio.parse(bytes(hurt))["bad_checksums"] == 1
    assert mpeg_audio.parse(None)["samples"] == 0 and mpeg_audio.parse(b"\xff" * 50)["offsets"] == []


def stream_of(payload):
    data = mpeg_audio.store(mpeg_audio.pad(payload), len(payload))
    return data, mpeg_audio.parse(data)


@pytest.mark.parametrize("junk", [b"\xff\xfa\x94\x00" + b"j" * 50, b"\xff\xfb\x94\x00" * 9, b"j" * 700 + b"\xff", b"\xff" * 100, b"\xff\xf3\x84\xc4" + b"x" * 999])
@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_media_reads_on_after_false_headers(junk, at):
    payload = mpeg_audio.pad(b"some text " * 400)
    data, clean = stream_of(payload)
    place = [*clean["offsets"], len(data)][at]
    found = mpeg_audio.parse(data[:place] + junk + data[place:])
    assert found["junk"] == len(junk) and len(found["offsets"]) == len(clean["offsets"]) and b"".join(found["bodies"])[: len(payload)] == payload


def test_media_counts_a_frame_that_the_end_cuts_off():
    data, clean = stream_of(b"some text " * 400)
    found = mpeg_audio.parse(data[:-10])
    assert found["offsets"] == clean["offsets"][:-1] and found["junk"] == len(data) - 10 - clean["offsets"][-1]


def crc_by_bits(bits):
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 & 1
        crc = crc << 1 & 0xFFFF
        if top != bit:
            crc ^= 0x8005
    return crc


def test_media_checksums_of_other_layers():
    def bits_of(data):
        return [b >> k & 1 for b in data for k in range(7, -1, -1)]

    # Layer I, 48 kHz stereo: 256 bits of allocation; Layer II, 192 kbit/s stereo: table a, 88 bits a channel pair
    rest = bytes(range(1, 251))
    one = b"\xff\xfe\x64\x00"
    two = b"\xff\xfc\xa4\x00"
    widths = [w for w in mpeg_audio.ALLOCATION["a"] for _ in (0, 1)]
    stream, at, used = bits_of(rest), 0, 0
    for w in widths:
        used += any(stream[at : at + w])
        at += w
    for header, n in ((one, 256), (two, at + 2 * used)):
        size = mpeg_audio.frame_of(header)[3]
        crc = crc_by_bits(bits_of(header[2:4]) + stream[:n])
        frame = (header + crc.to_bytes(2, "big") + rest).ljust(size, b"\0")[:size]
        assert mpeg_audio.checksum_right(frame) is True
        for k in (0, n - 1):
            hurt = bytearray(frame)
            hurt[6 + k // 8] ^= 128 >> k % 8
            assert mpeg_audio.checksum_right(bytes(hurt)) is False
        assert mpeg_audio.parse(frame * 3)["bad_checksums"] == 0 and len(mpeg_audio.parse(frame * 3)["offsets"]) == 3


def test_media_reads_the_other_table():
    size = mpeg_audio._sizes()[9]
    body = b"VBRI" + bytes(6) + (4321).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\0\2\0\3\0\2\0\1" + b"\0\5\1\0"
    head = (mpeg_audio._header(9)[:1] + b"\xfb" + mpeg_audio._header(9)[2:]).ljust(36, b"\0")
    plain = (head[:4]).ljust(size, b"\0")
    found = mpeg_audio.parse((head + body).ljust(size, b"\0") + plain * 2)
    assert found["table"] == {"frames": 7, "bytes": 4321, "points": [15, 768]} and found["offsets"] == [size, 2 * size]


def test_media_of_long_texts_and_repeated_rows(spark):
    texts = [(1, "é long " * 700_000), (1, "é long " * 700_000), (2, None), (None, "x")]
    found = mpeg_audio.read_media(mpeg_audio.write_media(docs_of(spark, texts))).select("id", "n_bytes", "payload", "junk").collect()
    want = Counter((i, hashlib.sha256(mpeg_audio.pad((t or "").encode())).hexdigest()) for i, t in texts)
    assert Counter((r.id, hashlib.sha256(bytes(r.payload)).hexdigest()) for r in found) == want and all(r.junk == 0 for r in found)


def test_quality(spark, real):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    again = quality.train(docs, labels)
    assert np.allclose(model["weights"], again["weights"])
    out = docs.select("doc_id", quality.held_out(docs["doc_id"]).alias("h")).first()
    assert out.h == (zlib.crc32(str(out.doc_id).encode()) % 5 == 0)
    scored = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(quality.held_out(labels["doc_id"])).collect()
    right = sum((r.score >= quality.CUT) == (r.quality == 1) for r in scored)
    assert right >= 0.93 * len(scored)


def test_quality_threshold_is_of_all_training_rows(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(real, labels, sample=4)
    rows = quality.score(real, model).join(labels, "doc_id").filter(~quality.held_out(queries.F.col("doc_id"))).select("score", "quality").collect()
    below, bad = sum(r.score < quality.CUT for r in rows), sum(r.quality == 0 for r in rows)
    assert bad > 4 and below == bad - 1


def test_quality_fit_against_plain_gradient_descent():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(size=(500, len(quality.NAMES))) + 0.1, rng.normal(size=(400, len(quality.NAMES)))
    model = quality.fit(good, bad, 0.4, pairs=4000)
    scale = np.vstack([good, bad]).std(0) + 1e-9
    rows = np.random.default_rng(quality.SEED)
    x = (good[rows.integers(500, size=4000)] - bad[rows.integers(400, size=4000)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w += 5e-4 * (x.T @ (1 / (1 + np.exp(x @ w))) - quality.RIDGE * w)
    mine = quality.loss(x, model["weights"] * scale, quality.RIDGE)
    assert mine <= quality.loss(x, w, quality.RIDGE) + 1e-6
    assert np.allclose(model["weights"] * scale, w, atol=5e-3)


def test_quality_features_against_brute_force(edge_texts):
    texts = [t for _, t in edge_texts if t is None or len(t) < 5000]
    for text, row in zip(texts, quality.features(pa.array(texts, pa.string()))):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        got = dict(zip(quality.NAMES, row))
        for name, kind in quality.KINDS.items():
            assert got[f"{name}_ratio"] == pytest.approx(sum(b in kind for b in raw) / max(1, len(raw)))
        counts = {"adjacent": sum(a == b for a, b in zip(words, words[1:])), "second": sum(a == b for a, b in zip(words, words[2:])), "distinct": len(set(words)),
                  "short": sum(len(w) < 3 for w in words), "long": sum(len(w) > 15 for w in words)}
        for name, n in counts.items():
            assert got[f"{name}_ratio"] == pytest.approx(n / max(1, len(words)))
        assert got["words"] == pytest.approx(np.log1p(len(words))) and got["bytes"] == pytest.approx(np.log1p(len(raw)))


def test_signatures_keep_pairs_at_the_limit():
    """The cuts before full sets are compared keep pairs of similarity 0.75 (measured)."""
    rng = np.random.default_rng(4)
    met = kept = further = 0
    for _ in range(60):
        shared = rng.integers(0, 2**63, 300, dtype=np.uint64)
        sets = [np.sort(np.concatenate((shared, rng.integers(0, 2**63, 50, dtype=np.uint64)))) for _ in range(2)]
        both, offsets = np.concatenate(sets), np.array([0, 350, 700])
        keys, short = minmax.signatures(both, offsets)
        met += bool((keys[0] == keys[1]).any())

        def agree(planes):
            differ = [a ^ b for a, b in zip(*planes)]
            return sum(64 - int(differ[k] | differ[k + 1] | differ[k + 2] | differ[k + 3]).bit_count() for k in range(0, len(differ), 4))

        kept += agree(short) >= minmax.AGREE
        longer = minmax._planes(np.array([*minmax._ends(both, offsets, range(minmax.PERMUTATIONS, minmax.PERMUTATIONS + minmax.FURTHER))]))
        further += agree(longer) >= minmax.AGREE_FURTHER
    assert met == kept == further == 60


def test_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(13)
    long = text_of(rng, 500_000, 60_000)
    texts = [(1, long), (2, long + " end"), (3, long.split(" ", 1)[0]), (None, None)]
    docs = docs_of(spark, texts)
    found = {r.id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(docs).collect()}
    assert found == {1: (len(shingles(long)), 1), 2: (len(shingles(long + " end")), 1), 3: (1, 3), None: (0, None)}
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert removed == {1: 500_000, 2: 500_000, 3: 0, None: 0}
    model = quality.train(docs, spark.createDataFrame([(1, 1), (3, 0), (1, None)], "doc_id long, quality int"))
    assert quality.score(docs, model).filter("score between 0 and 1").count() == 4
    tokens = simple8b.read_tokens(simple8b.write_tokens(docs, TOKENIZER)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in tokens) == Counter((i, len(ids)) for (i, _), ids in zip(texts, tokens_by_library([t for _, t in texts])))


def test_quality_edges(spark, edge_texts):
    docs = docs_of(spark, edge_texts)
    none = quality.train(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    scored = quality.score(docs, none)
    assert scored.columns.count("score") == 1 and [r.score for r in scored.collect()] == [0.5] * len(edge_texts)
    assert quality.features(pa.array([None, "", "x"], pa.string())).shape == (3, len(quality.NAMES))


@pytest.mark.parametrize("piece", ['<a "', "<b>x", "<a '\"", "<script", "<!-", "<div class='long-name-of-a-class'>x", "</b>", "<p><b>x", "<a<", "<script>x</script", '<i class="a>', "<li>x"])
def test_hostile_pages_take_time_in_proportion(piece):
    """Some megabyte of each parses within seconds, and keeps the text that it shows."""
    import time

    began = time.process_time()
    page = html_template.Page("<p>Before</p>" + piece * ((1 << 20) // len(piece)))
    assert time.process_time() - began < 15 and page.blocks[0][0][1] == "Before"


def test_tokens_against_a_pattern():
    """The tokens of a pattern that tries each place anew."""
    pattern = re.compile(
        r"""<!--.*?(?:-->|\Z)|<(script|style|title)\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</\1\s*>|\Z)"""
        r"""|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>"'<]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|([^<]+|<)""", re.S | re.I)  # fmt: skip
    rng = np.random.default_rng(21)
    parts = ["<", ">", '"', "'", "a", " ", "/", "<b>", "</b>", "<script>", "</script >", "<!--", "-->", "<!d>", "<a x='", '<i y="', "=", "<title", "text & more"]
    for _ in range(3000):
        source = "".join(parts[k] for k in rng.integers(len(parts), size=rng.integers(1, 14)))
        want = [(c, t, a, x) for _, c, t, a, x in pattern.findall(source) if t or x]
        assert [*html_template.tokens(source)] == want, source


def test_licenses(spark, edge_texts):
    extra = [
        (30, "Under the MIT License, and under  the-MIT license. CC BY-NC 4.0"),
        (31, "Licensed under the Apache License, Version 2.0."),
        (32, "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and associated documentation files to deal in the Software"),
        (33, "under the mit"),
        (34, "the mit license under"),
    ]
    texts = [*edge_texts, *extra]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.id: r for r in rows if r.id and r.id >= 30}
    assert [(p.start, p.label) for p in got[30].phrases] == [(0, "mit"), (5, "mit"), (9, "cc-by-nc")]
    assert [(p.start, p.last) for p in got[31].phrases] == [(3, 6)]
    assert not got[32].phrases and [s.label for s in got[32].spans] == ["mit"] and licenses.LEAST <= got[32].spans[0].share < 1
    assert not got[33].phrases and not got[34].phrases


def test_licenses_real(spark, real):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for r in real.collect():
        w = word.findall(r.text.translate(LOWER))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want[r.doc_id] = (len(w), sorted(places))
    assert {r.id: (r.n_words, sorted((p.start, p.label) for p in r.phrases)) for r in licenses.scan(real).collect()} == want


NOTICES = [
    ("Licensed under the GNU Lesser General Public License.", {"lgpl"}),
    ("licensed under the GNU Affero General Public License", {"agpl"}),
    ("licensed under the GNU General Public License", {"gpl"}),
    ("Apache License, Version 1.1", {"apache-1.1"}),
    ("Apache License, Version 2.0", {"apache-2"}),
    ("CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
    ("Licensed under CC-BY-NC-SA 3.0", {"cc-by-nc-sa"}),
    ("CC BY-ND", {"cc-by-nd"}),
    ("CC BY-SA 4.0", {"cc-by-sa"}),
    ("CC BY 4.0", {"cc-by"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
    ("Copyright 2023 Acme. All rights reserved.", {"all-rights-reserved"}),
    ("it was kindly licensed unter cc by 4.0 by them", {"cc-by"}),
    ("the license of the software is not known to the public", set()),
    ("all of the rights were reserved", set()),
    ("the code is licensed under the foo license today", set()),
    ("licensed under the eclipse license", set()),
    ("released under the x11 license", set()),
    ("apache license version 1 0", set()),
    ("licensed under the mozilla public license version 1 1", set()),
    ("the european general public license", set()),
    *((f"licensed under the {name} license", set()) for name in ("artistic", "eupl", "wtfpl", "ofl", "json", "postgresql", "ncsa", "python", "vim", "php")),
    *((f"released under the {name} license and nothing else", set()) for name in ("beerware", "x11", "openssl", "ruby", "hippocratic")),
    ("GNU Free Documentation License", set()),
    ("Academic Free License Version 3.0", set()),
    ("Boost Software License", set()),
    ("Apache License, Version 3.0", set()),
    ("Creative Commons Sampling Plus 1.0 License", set()),
]


def test_licenses_of_notices(spark):
    rng = np.random.default_rng(9)
    texts = [(k, f"{text_of(rng, 30)} {notice} {text_of(rng, 30)}") for k, (notice, _) in enumerate(NOTICES)]
    texts += [(100 + k, notice) for k, (notice, _) in enumerate(NOTICES)]
    found = {r.id: {s.label for s in r.spans} for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert {k: found[k] for k, _ in texts} == {k: NOTICES[k % 100][1] for k, _ in texts}


def test_licenses_of_changed_passages(spark):
    rng = np.random.default_rng(10)
    texts, want = [], {}
    for number, label, text, phrase in licenses.templates():
        words = licenses.words_of(text)
        if phrase or len(words) < 12:
            continue
        for kind in range(3):  # as it is, words changed, words put in
            given = list(words)
            for at in rng.choice(len(words) - 2, len(words) // 12, replace=False) if kind else ():
                given[at + 1] = "changed" if kind == 1 else f"{given[at + 1]} more"
            texts.append((len(texts), f"{text_of(rng, 25)} {' '.join(given)} {text_of(rng, 25)}"))
            want[len(texts) - 1] = (label, kind)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        label, kind = want[r.id]
        assert label in {s.label for s in r.spans}, (r, label, kind)
        assert kind or (max(s.share for s in r.spans) == 1.0 and len(r.spans) == 1)


def test_licenses_of_long_and_repeated_texts(spark):
    rng = np.random.default_rng(11)
    long = f"{text_of(rng, 400_000, 9000)} CC BY-NC 4.0 {text_of(rng, 300_000, 9000)}"
    texts = [(1, long), (1, long), (None, "CC BY-NC 4.0"), (None, None), *((5, "CC BY-NC 4.0") for _ in range(500))]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    assert Counter((r.id, r.n_words, len(r.phrases), tuple(s.label for s in r.spans)) for r in rows) == Counter(
        {(1, 700_005, 1, ("cc-by-nc",)): 2, (None, 5, 1, ("cc-by-nc",)): 1, (None, 0, 0, ()): 1, (5, 5, 1, ("cc-by-nc",)): 500}
    )


def vectors_by_brute(rows, dims=(8,)):
    """Links and components; of rows that repeat an id the least vector counts."""
    fine, kind = {}, np.float32
    for i, v in rows:
        if i is not None and v is not None and len(v) in dims and None not in v and np.isfinite(v).all() and np.any(v):
            fine[i] = min(fine.get(i, v), v)
    ids = sorted(fine)
    n, linked = Counter(), []
    for d in dims:
        mine = [i for i in ids if len(fine[i]) == d]
        if not mine:
            continue
        x = np.array([fine[i] for i in mine], kind).astype(float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.9
        linked += [(mine[a], mine[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
        n.update({i: int(k) - 1 for i, k in zip(mine, near.sum(1)) if k > 1})
    return n, components_of({i for i, _ in rows if i is not None}, linked)


VECTORS = "vec_id long, embedding array<float>, id long, key string, n int, kept string, vector string"


def vectors_of(spark, rows):
    """With extra columns whose names clash with what the operator uses."""
    return spark.createDataFrame([(i, v, 1, "k", 2, "x", "y") for i, v in rows], VECTORS)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 256)
    monkeypatch.setattr(pivots, "TILE", 64)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, (np.array(rows[0][1]) + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for k in range(700)]  # over a block
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7), (1004, [None] * 8), (1005, []), (None, rows[0][1]), (1006, [float("inf")] + [1.0] * 7)]
    rows += [(1100, [2.0] * 7), (1101, [1.0, 0.0, 0.0]), (3, rows[3][1]), (4, [1.0] * 8), (1200, [1e-38] * 8), (1201, [1e38] * 8), (1202, [-0.0] + [1.0] * 7), (1203, [0.0] + [1.0] * 7)]
    rows += [(1300 + k, rows[9][1]) for k in range(300)]  # copies
    found = pivots.near_vectors(vectors_of(spark, rows)).collect()
    n, component = vectors_by_brute(rows, (3, 7, 8))
    assert len(found) == len(rows)
    links = {r.id: r.n_links for r in found if r.id is not None}
    assert 0.95 * sum(n.values()) <= sum(links.values()) and all(k <= n[i] for i, k in links.items())
    assert all(r.component_id == component.get(r.id) and r.kept == (r.id is None or r.id == r.component_id) for r in found if r.id is None or r.id >= 200)
    assert links[1003] == links[1100] == 1 and links[1300] >= 300 and all(links[k] == 0 for k in (1000, 1001, 1002, 1004, 1005, 1006, 1101))
    assert links[1200] == links[1201] == n[1200]
    empty = pivots.near_vectors(vectors_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("noise, n", [(0.0, 3), (0.15, 600), (0.3, 200)])
def test_vectors_in_a_narrow_cone(spark, noise, n):
    rng = np.random.default_rng(5)
    base = np.full(8, 8**-0.5)
    rows = [(k, (base + rng.normal(size=8) * noise).astype(np.float32).tolist()) for k in range(n)]
    found = pivots.near_vectors(vectors_of(spark, rows)).collect()
    links, component = vectors_by_brute(rows)
    assert links and {r.id: (r.n_links, r.component_id, r.kept) for r in found} == {k: (links[k], component[k], component[k] == k) for k, _ in rows}


@pytest.mark.parametrize("d, cone", [(8, 0.0), (64, 0.0), (64, 1.0), (256, 0.0)])
def test_vectors_recall_of_planted_pairs(spark, d, cone):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(3000, d)) + cone
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(400, d))
    side -= (side * x[:400]).sum(1)[:, None] * x[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.901, 0.92, (400, 1))
    rows = [*enumerate(x.astype(np.float32).tolist()), *((5000 + k, v) for k, v in enumerate((c * x[:400] + np.sqrt(1 - c * c) * side).astype(np.float32).tolist()))]
    want, _ = vectors_by_brute(rows, (d,))
    got = {r.id: r.n_links for r in pivots.near_vectors(vectors_of(spark, rows)).collect()}
    assert sum(want.values()) >= 800 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.95 * sum(want.values())


def test_vectors_of_doubles(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e199]), (2, [0.9, (1 - 0.81) ** 0.5]), (3, [0.0, -1.0])]
    found = pivots.near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    cosine = {(a, b): np.dot(x, y) / np.hypot(*x) / np.hypot(*y) for (a, x), (b, y) in itertools.combinations([(i, np.array(v) / max(map(abs, v))) for i, v in rows], 2)}
    want = Counter(i for pair, c in cosine.items() if c >= 0.9 for i in pair)
    assert {r.id: r.n_links for r in found} == {i: want[i] for i, _ in rows}


def test_pivot_meetings_are_counts_and_orders():
    rng = np.random.default_rng(2)
    a, b = (np.array([rng.permutation(14)[: pivots.NEAREST] for _ in range(500)]) for _ in range(2))
    found = pivots.meeting(a, b)
    assert (found == pivots.meeting(b, a)).all()
    for x, y, got in zip(a.tolist(), b.tolist(), found):
        shared = [(x.index(p) + y.index(p), p) for p in x if p in y]
        best = min(shared, default=(0, -1))[1]
        asked = best >= 0 and min(x.index(best), y.index(best)) < pivots.ASK
        assert got == (best if len(shared) >= pivots.SHARED and asked else -1)


PAGE = """<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>side {k}</aside>
<article><h1>Head {k}</h1><p>First <b>bo</b>ld &amp; para {k}<br>line<p>Second   {k}</p><span class="ad">Buy {k}</span><form>q {k}</form>
<section class="comments"><p>Comment {k}</p></section></article><!-- gone --><footer>&copy; foot</footer></body></html>"""


def test_pages(spark):
    rows = [(k, "http://a.example/x" if k < 12 else f"http://h{k}.example/", PAGE.format(k=k)) for k in range(15)]
    rows += [(20, None, None), (21, "nonsense", ""), (22, "http://a.example/", "plain text only"), (23, "http://a.example/", "<p>unclosed <!-- x"), (0, "http://a.example/x", PAGE.format(k=0)), (None, "http://a.example/x", PAGE.format(k=9))]
    table = spark.createDataFrame([(*r, "n", "t") for r in rows], "page_id long, url string, html string, n_chars string, text string")
    found = html_template.main_text(table)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = defaultdict(list)
    for r in found.collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    for k in range(15):
        assert got[k] == [f"Head {k} First bold & para {k} line Second {k}"] * (2 if k == 0 else 1)
    assert got[20] == got[21] == [""] and got[22] == ["plain text only"] and got[23] == ["unclosed"]


WRAPPED = {
    "sidebar": '<div class="layout has-sidebar"><div class="sidebar">side {k}</div><article><h1>Head {k}</h1><p>Some text {k}</p></article></div>',
    "comments": '<div class="comments-open"><article><h1>Head {k}</h1><p>Some text {k}</p></article><div class="comments"><p class="comment">Me {k}</p></div></div>',
    "main": '<main><div class="has-sidebar"><article><h1>Head {k}</h1><p>Some text {k}</p></article></div><div class="related"><article>Other {k}</article><article>More {k}</article></div></main>',
    "plain": '<div id="no-sidebar"><div class="menu">m {k}</div><h1>Head {k}</h1><p>Some text {k}, and so much of it that it is nearly all of the page</p></div>',
    "form": '<form id="page"><article><h1>Head {k}</h1><p>Some text {k}</p></article></form>',
    "title": '<h1>Head {k}</h1><div class="lead"><p>Some text {k}</p></div><div class="text"><p>%s {k}</p></div>' % ("and the rest of it " * 20).strip(),
}


@pytest.mark.parametrize("name", WRAPPED)
@pytest.mark.parametrize("n", [1, 5, 40])
def test_pages_in_marked_wrappers(name, n):
    rest = {"plain": ", and so much of it that it is nearly all of the page", "title": " and the rest of it" * 20}.get(name, "")
    found = html_template.extract(f"<html><body><nav>Home</nav>{WRAPPED[name].format(k=k)}<div class='footer'>foot</div></body></html>" for k in range(n))
    assert found == [f"Head {k} Some text {k}{rest}{f' {k}' if name == 'title' else ''}" for k in range(n)]


def test_marked_elements_beside_an_article_stay_out():
    page = "<html><body><article><p>Text {k}</p></article><div class='comments'><p>%s {k}</p></div></body></html>" % ("long comment " * 50)
    assert html_template.extract(page.format(k=k) for k in range(10)) == [f"Text {k}" for k in range(10)]


NOTICE = "all of this is here for members of the club and nobody else may read it"


@pytest.mark.parametrize("n", [4, 5, 30])
@pytest.mark.parametrize("inside", [True, False])
def test_constant_texts_of_the_template_go(n, inside):
    a, b = ("", f"<p>{NOTICE}</p>") if inside else (f"<div><p>{NOTICE}</p></div>", "")
    page = "<html><body>%s<article><h1>Head {k}</h1>%s<p>Text {k}</p><ul><li><b>Read it here in full, with all that belongs to it: </b></li></ul></article></body></html>" % (a, b)
    assert html_template.extract(page.format(k=k) for k in range(n)) == [f"Head {k} Text {k}" for k in range(n)]


def test_constant_texts_of_nested_classes_go():
    def page(k):
        box = f"<div class='x'><p>{NOTICE}</p><p>Own {k}</p></div>" if k % 3 == 0 else ""
        items = "".join(f"<li><p>Item {k} {i}</p><p class='more'>Read this item in full on its own page at once</p></li>" for i in range(k % 4))
        return f"<html><body><article><p>Text {k}</p>{box}<ul>{items}</ul></article></body></html>"

    want = [" ".join([f"Text {k}", *[f"Own {k}"] * (k % 3 == 0), *(f"Item {k} {i}" for i in range(k % 4))]) for k in range(24)]
    assert html_template.extract(map(page, range(24))) == want


WRAPPERS = ("layout no-sidebar", "has-sidebar wrap", "social-science", "post-header-image", "search-results-page", "body-alert-text")


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_named_like_boilerplate_keep_their_text(wrapper, tag):
    page = "<html><body><nav>Home</nav><div class='%s'><%s><h1>Head {k}</h1><p>Some text {k}</p></%s></div><footer>f</footer></body></html>" % (wrapper, tag, tag)
    assert html_template.extract(page.format(k=k) for k in range(8)) == [f"Head {k} Some text {k}" for k in range(8)]


def test_short_lines_of_the_article_stay():
    page = "<html><body><div>All of this site</div><article><p>Intro</p><p>By Staff</p><p>Text {k} and more</p></article><ul><li>Home</li></ul></body></html>"
    assert html_template.extract(page.format(k=k) for k in range(8)) == [f"Intro By Staff Text {k} and more" for k in range(8)]


@pytest.mark.parametrize("outer", ["body", "main"])
def test_all_blocks_stay(outer):
    page = "<html><body><%s><div class=a><p>%s {k}</p></div><div class=b><p>Tail {k}</p></div></%s></body></html>" % (outer, "long " * 60, outer)
    assert html_template.extract(page.format(k=k) for k in range(8)) == ["long " * 60 + f"{k} Tail {k}" for k in range(8)]


def test_classes_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        parts = ["<p>one {k}</p>", "<p>two</p>", "<div class='c'><p>two</p><b>three</b></div>", "<ul><li>four</li><li>four</li></ul>", "six"]
        pages = [html_template.Page("".join(parts[i] for i in rng.integers(len(parts), size=rng.integers(1, 8))).format(k=k)) for k in range(6)]

        def n(page, token):
            path, words = token
            return sum(p == path for p in page.paths) if not words else sum((p, w) == token for p, w, _ in page.words())

        tokens = {(p, "") for x in pages for p in x.paths} | {(p, w) for x in pages for p, w, _ in x.words()}
        found = html_template.classes(pages)
        assert {t for some in found.values() for t in some} == tokens and sum(map(len, found.values())) == len(tokens)
        for a, b in itertools.combinations(sorted(tokens), 2):
            same = all(n(x, a) == n(x, b) for x in pages)
            assert same == any(a in some and b in some for some in found.values())


def test_pages_that_repeat_without_end_divide(spark, monkeypatch):
    monkeypatch.setattr(html_template, "GROUP", 8)
    rows = [(None, None, PAGE.format(k=1))] * 700 + [(k, "http://a.example/", PAGE.format(k=k)) for k in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in html_template.main_text(table).collect())
    want = "Head {k} First bold & para {k} line Second {k}"
    assert got == Counter({(None, want.format(k=1)): 700} | {(k, want.format(k=k)): 1 for k in range(40)})


def test_equal_texts_in_changing_pages_stay():
    pages = [f"<html><body><article id='a{k}'><p>{NOTICE}</p></article></body></html>" for k in range(10)]
    assert html_template.extract(pages) == [NOTICE] * 10
    assert html_template.extract([*pages, "<html><body><article><p>Other</p></article></body></html>"]) == [NOTICE] * 10 + ["Other"]


def test_pages_real(spark):
    import html

    found = {r.page_id: r.text for r in queries.op1_template_main_text(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        assert found[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert minmax.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert mixing.mix(none).count() == 0 and packing.pack(none).count() == 0
    assert simple8b.read_tokens(simple8b.write_tokens(none, TOKENIZER)).count() == 0
    assert mpeg_audio.read_media(mpeg_audio.write_media(none)).count() == 0
    assert licenses.scan(none).count() == 0
    assert html_template.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(none, model).count() == 0


def test_quality_fit_takes_an_id_once_a_quality(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first = labels.filter(~quality.held_out(queries.F.col("doc_id")) & queries.F.col("quality").isin(0, 1)).orderBy("doc_id").first()
    copies = real.filter(queries.F.col("doc_id") == first.doc_id).withColumn("n", queries.F.explode(queries.F.sequence(queries.F.lit(1), queries.F.lit(500)))).drop("n")
    plain, hot = (quality.train(docs, labels) for docs in (real, real.union(copies)))
    assert np.array_equal(plain["weights"], hot["weights"]) and np.array_equal(plain["centre"], hot["centre"])


def test_ranges_of_tokens_are_bounded():
    assert simple8b.range_count(0, 8) == 8 and simple8b.range_count(1 << 30, 8) == 16
    assert simple8b.range_count(100 << 40, 200) == simple8b.MOST_RANGES
