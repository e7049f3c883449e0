"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows, an empty table and
columns with clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.llm import embedding, langid, media, minhash, mixing, pieces, quality, substring, tokencount, warc
from flowspark.llm._common import components, cut, heavy_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(name):
    P = pytest.importorskip("public_tokenizers")
    return P.path(name)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def multiset(rows):
    return Counter(map(tuple, rows))


# ---------------------------------------------------------------- helpers


def test_heavy_join_keeps_hot_and_rare_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = heavy_join(rows, groups, "key", "n", "inner")
    assert got.count() == 5000 and got.where("key = 0").select("least").distinct().collect()[0][0] == 0


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 205), (201, 205), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[100] == 100 and got[205] == got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_warc_round_trip(spark):
    rows = [(k, f"http://x/{k}\r\nEvil: 1", f"<html>{k % 4}</html>" * 30) for k in range(200)] + [(500, None, None), (501, "u", ""), (None, "u", "alone"), (3, "u", "same id"), (900, "u", "日本\r\n\r\n"), (7, "http://x/7\r\nEvil: 1", "<html>3</html>" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    bundles = warc.write_bundles(pages)
    got = warc.read_bundles(bundles, payloads=True).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for k, _, h in rows:
        groups[h or ""].append(k)
    least = {h: min((k for k in ks if k is not None), default=None) for h, ks in groups.items()}
    want = []
    for k, _, h in rows:
        first = least[h or ""]
        kind = "response" if k == first or len(groups[h or ""]) == 1 else "revisit"
        want.append((k, len((h or "").encode()), warc.payload_digest((h or "").encode()), kind, first if kind == "revisit" else None))
    assert multiset((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == multiset(want)
    assert {r["payload"].decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in rows}
    found = warc.look_up(bundles, spark.createDataFrame([(900,)], "page_id long")).collect()
    assert [r["payload"].decode() for r in found] == ["日本\r\n\r\n"]


def test_warc_small_payloads_stay_responses_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read_bundles(warc.write_bundles(pages, min_bytes=3)).collect()} == {"response"}
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_bundles_are_seekable_zstandard(tmp_path, spark):
    import zstandard

    w = warc.BundleWriter()
    for k in range(500):
        w.add(k, b"record %d " % k * 100)
    content = w.finish()
    reader = warc.BundleReader(content)
    assert len(reader.places) > 3
    for identifier, frame, offset, length in w.index[::37]:
        assert reader.record(frame, offset, length) == b"record %d " % identifier * 100
    start, packed, size, _ = reader.places[2]
    assert len(zstandard.ZstdDecompressor().decompress(content[start : start + packed])) == size
    damaged = bytearray(content)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        warc.BundleReader(bytes(damaged))
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    done = warc.export_bundles(warc.write_bundles(pages), f"file://{tmp_path}/out").collect()
    assert len(done) == 1 and (tmp_path / "out" / f"{done[0]['bundle']}.warc.zst").stat().st_size == done[0]["bytes"]


# ---------------------------------------------------------------- 2


def plain_repeats(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((w, gone))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup(docs, rows, window):
    got = substring.word_report(docs.withColumn("spans", F.lit(1)).withColumn("mark", F.lit(2)), window).collect()
    want = [(r[0], len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for r, (w, g) in zip(rows, plain_repeats([r[1] for r in rows], window))]
    assert multiset((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == multiset(want)
    assert sum(w[2] for w in want) > 0


def test_substring_dedup_with_hot_passages(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = say(48)
    texts = [" ".join(say(15) + passage + say(15)) for _ in range(300)] + ["a b " * 200, "same " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring.word_report(docs).collect()}
    for k, (w, g) in enumerate(plain_repeats(texts, 35)):
        assert got[k] == (sum(g), sha(" ".join(x for x, y in zip(w, g) if not y)))
    assert substring.word_report(docs.limit(0)).count() == 0


def test_removal_leaves_clean_texts_alone(docs, rows):
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    want = []
    for r, (w, g) in zip(rows, plain_repeats([r[1] for r in rows], 35)):
        kept = [x for x, y in zip(w, g) if not y]
        want.append((r[0], r[1] if not any(g) else tuple(kept)))
    have = [(r["doc_id"], r["text"]) for r in got.collect()]
    changed = {k for k, v in want if isinstance(v, tuple)}
    assert changed
    assert multiset((k, tuple(WORD.findall(t)) if k in changed else t) for k, t in have) == multiset(want)


def test_wavelet_ranks_and_intervals():
    r = np.random.default_rng(2)
    symbols = r.integers(0, 37, 500)
    tree = substring.WaveletMatrix(symbols, 6)
    for c in (0, 5, 36):
        i = r.integers(0, 501, 40)
        got = tree.descend(np.full(40, c), i) - tree.descend(np.full(40, c), np.zeros(40, np.int64))
        assert got.tolist() == [int((symbols[:k] == c).sum()) for k in i]
    pieces_ = [r.integers(0, 4, n).astype(np.uint32) for n in (9, 14, 3, 20)]
    weights = np.array([1, 1, 2, 1])
    index = substring.FMIndex(np.concatenate(pieces_), np.array([len(p) for p in pieces_]), weights)
    for n, p in enumerate(pieces_):
        for e in range(1, len(p) + 1):
            s = int(index.reach(np.array([index.first[n] + e]), np.array([index.first[n]]))[0] - index.first[n])
            times = lambda x: sum(w * sum(np.array_equal(q[k : k + len(x)], x) for k in range(len(q) - len(x) + 1)) for q, w in zip(pieces_, weights))
            assert s == e or times(p[s:e]) >= 2
            assert s == 0 or times(p[s - 1 : e]) < 2


# ---------------------------------------------------------------- 3


def test_embedding_links(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 64))
    near = base[:20] + r.normal(size=(20, 64)) * 0.3
    x = np.concatenate([base, near, base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * 64)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).repartition(3)
    got = {q["vec_id"]: q for q in embedding.near_duplicates(vectors).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.9
    label = embedding._stars(*np.nonzero(linked), len(x))
    for k in range(len(x)):
        assert got[k]["n_links"] == linked[k].sum() - 1 and got[k]["component_id"] == label[k] and got[k]["kept"] == (label[k] == k)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1006]["component_id"] == 1005 and got[1005]["n_links"] == 1
    assert embedding.near_duplicates(vectors.limit(0)).count() == 0


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 16)
    r = np.random.default_rng(1)
    x = np.concatenate([np.tile(r.normal(size=64), (80, 1)) + r.normal(size=(80, 64)) * 0.2, r.normal(size=(40, 64))])
    vectors = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q["vec_id"]: q["n_links"] for q in embedding.near_duplicates(vectors).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [got[k] for k in range(120)] == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()


# ---------------------------------------------------------------- 4, 9


def test_pieces_equal_the_library(docs, rows):
    path = tables("piece_bpe_32k.model")
    sp = pieces.ChunkTable(path).sp
    got = pieces.encode_decode(docs, path).collect()
    want = []
    for r in rows:
        ids = [*sp.encode(r[1] or ""), sp.eos_id()]
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert multiset((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == multiset(want)
    whole = pieces.encode_decode(docs.where("doc_id = 7"), path, keep_ids=True).first()
    assert sp.decode(whole["ids"]) == whole["decoded"]
    assert pieces.encode_decode(docs.limit(0), path).count() == 0


def test_piece_table_on_odd_texts():
    words = pieces.ChunkTable(tables("piece_bpe_32k.model"), kept=50)
    import random

    r = random.Random(3)
    texts = ["", " ", "  ", "▁", "a ", " a", "\n", "<s></s>", "a\0b", "日本 語▁▁x"] + ["".join(r.choice("ab ▁\n日é😀\0") for _ in range(r.randint(0, 25))) for _ in range(600)]
    for t in texts * 2:
        ids = [*words.sp.encode(t), words.end]
        assert words.encode(t) == ids and words.both(t)[1] == words.sp.decode(ids)


def test_token_counts_equal_the_library(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = tables("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = tokencount.count_tokens(docs, path, limit=100).collect()
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert multiset((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == multiset((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 100) for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got[:40]:
        runs = (texts[r["doc_id"]] or "").split()
        assert count(" ".join(runs[: r["fit_runs"]])) <= 100 and (r["fit_runs"] == len(runs) or count(" ".join(runs[: r["fit_runs"] + 1])) > 100)


def test_token_counts_of_odd_texts_and_prefixes():
    tokenizers = pytest.importorskip("tokenizers")
    path = tables("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), tokencount.PrefixCounter(path, kept=20)
    for t in ["it's I'LL 'S!!'s", "<|endoftext|>a<|startoftext|> <|x|>", "ΑΣ ΟΔΟΣ İ ß", "a\x1cb \x85c", "²½Ⅷ 12345", "日本語", "é"]:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    word = "understandinglyness"
    assert own.prefix_counts(word) == [len(lib.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]


# ---------------------------------------------------------------- 5


def test_media_columns(docs, rows):
    stored = cut(media.text_media(docs), "media")
    got = media.media_features(stored, keep=("n_bytes",)).collect()
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        padded = raw + bytes((-len(raw)) % 64 if raw else 64)
        want.append((r[0], len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:])))
    assert multiset((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == multiset(want)
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())


def test_image_formats_decode_alike():
    r = np.random.default_rng(0)
    grey, rgb = r.integers(0, 256, (5, 7), dtype=np.uint8), r.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.array_equal(media.decode_image(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode_image(media.encode_ppm(rgb)), rgb) and np.array_equal(media.decode_image(media.encode_bmp(rgb)), rgb)
    text = "P2\n# note\n7 5\n255\n" + "\n".join(" ".join(map(str, row)) for row in grey)
    assert np.array_equal(media.decode_image(text.encode()), grey)
    deep = grey.astype(np.uint16) * 200
    assert np.array_equal(media.decode_image(b"P5 7 5 65535\n" + deep.astype(">u2").tobytes()), deep)
    assert media.decode_image(b"P1 3 2\n1 0 1\n010").tolist() == [[0, 1, 0], [1, 0, 1]] == media.decode_image(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist()
    for bad in (None, b"", b"P5 7 5 255\nshort", b"BM" + bytes(60), b"GIF89a", b"P5 x y z\n"):
        assert media.decode_image(bad) is None and media.media_row(bad)[0] is None


def test_area_resize_keeps_the_mean():
    r = np.random.default_rng(1)
    for shape in ((1, 64), (9, 7), (30, 64)):
        x = r.random(shape)
        small = media.resize_area(x, 8, 9)
        assert small.shape == (8, 9) and abs(small.mean() - x.mean()) < 1e-9
    assert np.allclose(media.resize_area(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.load(__import__("io").BytesIO(media.npy_tile(np.full((3, 5), 7, np.uint8)))).tolist() == [[7] * 16] * 16


# ---------------------------------------------------------------- 6


def plain_targets(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, target = set(order), {}
    total = float(sum(sizes.values()))
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in left}
        target |= {s: most * sizes[s] for s in over}
        left -= over
    return target


def test_mixture(docs, rows):
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("size")).withColumn("other", F.lit("x"))
    got = mixing.mix(sized).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= max(3 * longest, 0.2 * target[s]) for s in sizes)
    assert multiset((r["doc_id"], r["size"], r["copies"]) for r in mixing.mix(sized.repartition(2)).collect()) == multiset((r["doc_id"], r["size"], r["copies"]) for r in got)
    assert mixing.mix(sized.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def plain_near(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = {r[0]: r[0] for r in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                label[b] = a
    return [(r[0], len(s), root(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, empty, k):
    got = minhash.near_duplicates(docs.withColumn("kept", F.lit("clash")), k=k).collect()
    want = plain_near(rows, k, 80)
    assert multiset((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == multiset(want)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert len({w[2] for w in want}) < len(want) - 10
    assert minhash.near_duplicates(empty, k=k).count() == 0


def test_groups_without_a_common_center(spark, monkeypatch):
    """Chains of small edits: members far from the smallest id still link through each other."""
    monkeypatch.setattr(minhash, "TILE", 8)
    import random

    r = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows, body = [], words[:60]
    for k in range(60):
        body = list(body)
        body[r.randrange(60)] = r.choice(words) + str(k)
        rows.append((k, " ".join(body), None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert multiset((x["doc_id"], x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(docs, k=4).collect()) == multiset(plain_near(rows, 4, 80))


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        found = []
        for _ in range(40):
            n = 1000
            both = r.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)]) * np.uint64(2) + np.uint64(1)) for _ in range(2))
            x, y = (minhash.registers(s, np.array([0, len(s)])) for s in (a, b))
            used, equal = minhash.estimate(x, y, np.array([len(a)]), np.array([len(b)]))
            found.append(equal[0] / used[0])
        assert abs(np.mean(found) - share) < 0.03


# ---------------------------------------------------------------- 8, 10


def test_gradient_through_time():
    r = np.random.default_rng(0)
    net = langid.Network(["a", "b"], size=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(0, 5, (6, 4)).astype(np.int16), np.array([0, 1, 1, 0])
    x[4:, 0] = langid.PAD
    _, g = net.gradient(x, y)
    for name, p in net.p.items():
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(4)] + ([(2, 1)] if "table" in name else []):
            step, kept = 1e-3, p[at]
            p[at] = kept + step
            up = net.gradient(x, y)[0]
            p[at] = kept - step
            down = net.gradient(x, y)[0]
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


def test_languages_are_told_apart(spark, docs, rows):
    import random

    r = random.Random(2)
    make = {"xx": "aeiou", "yy": "bcdfg", "zz": "äöüßé"}
    known = [(k, " ".join("".join(r.choice(make[lang]) for _ in range(5)) for _ in range(20)), lang) for k, lang in enumerate(list(make) * 40)]
    table = spark.createDataFrame(known, "doc_id long, text string, lang string")
    net = langid.train(table.where("doc_id % 3 <> 1 OR doc_id > 60"), steps=120)
    got = langid.identify(table.withColumn("score", F.lit("clash")), net).collect()
    assert sum(q["lang_pred"] == q["lang"] for q in got) > 0.95 * len(got) and all(0 <= q["score"] <= 1 for q in got)
    odd = {q["doc_id"]: q for q in langid.identify(docs.select("doc_id", "text"), net).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (120, 121, 122))
    assert len(langid.identify(docs, net).collect()) == len(rows) and langid.train(table.limit(0)) is None
    assert {q["lang_pred"] for q in langid.identify(table, None).collect()} == {"und"}


def test_quality_grades(spark, docs, rows, empty):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdeou") for _ in range(4)) for _ in range(100)]
    body = lambda n: [r.choice(words) for _ in range(n)]
    texts = [(" ".join(body(40)), 1, 0) if k % 3 == 0 else (" ".join(w.upper() + "!!" for w in body(40)), 0, 0) if k % 3 == 1 else (" ".join(body(20) + ["nasty"] + body(20)), 1, 1) for k in range(900)]
    table = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, t) for k, (_, q, t) in enumerate(texts) if k % 2] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_labels(table, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {q["doc_id"]: q for q in quality.grade(table.withColumn("kept", F.lit("clash")), model).collect()}
    assert sum(got[k]["kept"] == (k % 3 == 0) for k in range(0, 900, 2)) > 430
    assert all(0 <= q["expected_grade"] <= 2 and 0 <= q["tail_probability"] <= 1 for q in got.values())
    assert len(quality.grade(docs, model).collect()) == len(rows) and quality.grade(empty, model).count() == 0
    none = quality.fit_labels(table, labels.limit(0))
    assert all(q["kept"] is not None for q in quality.grade(table, none).collect())


def test_ordinal_gradient_fits_ordered_grades():
    r = np.random.default_rng(0)
    dense = np.zeros((300, quality.SHAPES + quality.EXTRA))
    dense[:, 3] = r.normal(size=300)
    grade = (dense[:, 3] > -0.5).astype(int) + (dense[:, 3] > 0.7)
    model = quality.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), dense, grade)
    score = dense @ model.shares
    assert ((score > model.thresholds[0]).astype(int) + (score > model.thresholds[1]) == grade).mean() > 0.95
    assert pa.array(["x"]) is not None
