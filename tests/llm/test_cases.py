"""Null ids, ties, clashing names, empty tables and hot keys of the operators, and plain versions of both models."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.llm import _common, embedding, langid, media, minhash, mixing, pieces, quality, substring, tokencount

from .test_operators import multiset, plain_near, plain_repeats, sha, tables


def as_rows(df):
    return Counter(map(str, df.collect()))


CLASH = ["_id", "_found", "_key", "_row", "_mark", "spans", "mark", "target", "source_size", "copies", "n", "size", "_n", "kept", "_text", "_order"]


def clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---------------------------------------------------------------- shared folder, components


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_folder(Session())


def test_components_with_a_centre_of_most_rows(spark):
    """One node has over 90 % of all links; two others hang a chain on it."""
    edges = spark.range(1, 4000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(200).select((F.col("id") + 3999).alias("a"), (F.col("id") + 4000).alias("b"))).union(spark.createDataFrame([(9000, 9001)], "a long, b long"))
    got = {r["node"]: r["component"] for r in _common.components(edges).collect()}
    assert len(got) == 4202 and all(c == (9000 if k >= 9000 else 0) for k, c in got.items())


# ---------------------------------------------------------------- 2


def test_repeats_with_null_ids_and_clashing_names(spark, docs, rows):
    odd = clashing(docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))))
    got = substring.remove_repeats(odd)
    assert got.columns == odd.columns
    want = Counter((None if r[0] is None or r[0] % 3 else r[0], tuple(x for x, y in zip(w, g) if not y)) for r, (w, g) in zip(rows, plain_repeats([r[1] for r in rows], 35)))
    import re

    assert Counter((r["doc_id"], tuple(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in got.collect()) == want


@pytest.mark.parametrize("many", [False, True])
def test_hot_anchors_stay_within_a_bound(spark, monkeypatch, many):
    """Nearly all rows, or many keys alike, share an anchor in other surroundings; shards are tiny."""
    monkeypatch.setattr(substring, "KEY_ROWS", 20)
    monkeypatch.setattr(substring, "SHARD", 600)
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    shared = [say(12) for _ in range(40 if many else 1)]
    texts = [" ".join(say(30) + r.choice(shared) + say(30)) for _ in range(400)]
    texts += texts[:60] + [" ".join(say(20) + texts[0].split()[5:60])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in substring.word_report(docs).collect()}
    for k, (w, g) in enumerate(plain_repeats(texts, 35)):
        assert got[k] == (sum(g), sha(" ".join(x for x, y in zip(w, g) if not y)))


def test_equal_runs_of_many_tasks_are_one():
    table = pa.table({"key": [2, 1, 2, 2], "r1": [5, 6, 5, 7], "r2": [0, 0, 0, 0], "words": [b"aaaa", b"bbbb", b"aaaa", b"cccc"], "n": [1, 2, 4, 1]})
    assert substring._combined(table).to_pylist() == [{"key": 1, "r1": 6, "r2": 0, "words": b"bbbb", "n": 2}, {"key": 2, "r1": 5, "r2": 0, "words": b"aaaa", "n": 5}, {"key": 2, "r1": 7, "r2": 0, "words": b"cccc", "n": 1}]


# ---------------------------------------------------------------- 3


def test_vectors_of_any_length_and_null_ids(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e195]), (3, [1e-200, 0.0]), (4, [0.0, 3e-310]), (None, [1.0, 0.0]), (6, [0.0, 5.0]), (6, [0.0, 5.0])]
    got = embedding.near_duplicates(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert multiset((r["vec_id"], r["n_links"] if r["vec_id"] else 0, r["component_id"], r["kept"]) for r in got) == multiset([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (None, 0, None, True), (6, 2, 4, False), (6, 2, 4, False)])


# ---------------------------------------------------------------- 4, 5, 9


def test_readers_of_texts_with_clashing_names_and_without_rows(spark, docs, empty):
    odd = docs
    for name in ("n_tokens", "ids", "media", "feature", "n_bytes", "tile", "fit_runs", "decoded"):
        odd = odd.withColumn(name, F.lit("clash"))
    piece, word = tables("piece_bpe_32k.model"), tables("word_bpe_49k.json")
    for f in (lambda d: pieces.encode_decode(d, piece), lambda d: tokencount.count_tokens(d, word), lambda d: media.media_features(media.text_media(d))):
        assert as_rows(f(odd)) == as_rows(f(docs)) and sum(as_rows(f(docs)).values()) == docs.count() and f(empty).count() == 0


def test_truncation_at_any_character_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tables("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), tokencount.PrefixCounter(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    r = random.Random(5)
    texts = ["it's I'LL 'S!!'s don't we've", "a<|endoftext|>b!<|startoftext|> !!<|x|> <|endoftext|>", "ΑΣ ΟΔΟΣ İ ß é", "a\x1cb \x85c　d", "²½Ⅷ 12345", "日本語 x日本"]
    texts += [" ".join("".join(r.choice("aeinorst'é!3") for _ in range(r.randint(1, 14))) for _ in range(30)) for _ in range(20)]
    for t in texts:
        norm = "".join(x for x, _ in own.parts(t))
        for p in {0, 1, len(norm), *(r.randint(0, len(norm)) for _ in range(25))}:
            assert own.prefix_count(t, p) == count(norm[:p]), (t, p)
        counts = own.runs(t)
        for budget in range(0, sum(counts), 3):
            runs, chars = own.fitting(t, counts, budget)
            assert count(norm[:chars]) <= budget and sum(counts[:runs]) <= budget < sum(counts[: runs + 1])
            if "<|" not in t:
                assert all(count(norm[:q]) > budget for q in range(chars + 1, len(norm)) if not norm[q - 1].isspace())


def test_decoded_text_comes_from_the_pieces():
    words = pieces.ChunkTable(tables("piece_bpe_32k.model"))
    changed = 0
    for t in ["a　b", "ﬁne ½", "x​y", "tab\there", "日本 語", "ＡＢＣ", "é é"]:
        ids = [*words.sp.encode(t), words.end]
        assert words.encode(t) == ids and words.both(t)[1] == words.sp.decode(ids)
        words.known = {c: (i, d.upper()) for c, (i, d) in words.known.items()}
        changed += words.both(t)[1] != words.sp.decode(ids)
        words.known = {}
    assert changed


# ---------------------------------------------------------------- 6


def test_mixture_with_clashing_names_ties_and_null_ids(spark):
    rows = [(None if k % 2 else k // 4, f"s{k % 3}", 1 + k % 7, f"text {k % 40}") for k in range(600)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, size long, body string").drop("size").withColumn("z", F.lit(1))).drop("size")
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, body string")
    for name in ("target", "source_size", "copies", "_key", "_row", "_n", "_mark", "odd name: x"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = mixing.mix(docs)
    assert sorted(got.columns) == sorted(docs.columns) and "_key" in got.columns
    assert dict(got.dtypes)["target"] == "double" and got.where("`_key` = 'clash' AND `odd name: x` = 'clash'").count() == 600
    again = mixing.mix(docs.repartition(9, "body").sortWithinPartitions(F.rand(3)))
    assert as_rows(got) == as_rows(again.select(got.columns)) and len({r["copies"] for r in got.collect()}) > 1
    maps = docs.withColumn("m", F.create_map(F.lit("a"), F.col("body")))
    assert mixing.mix(maps).count() == 600


def test_the_number_of_buckets_changes_nothing(spark, docs, monkeypatch):
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("size"))
    want = as_rows(mixing.mix(sized))
    monkeypatch.setattr(mixing, "ROWS", 1)
    monkeypatch.setattr(mixing, "LEAST_BITS", 0)
    assert as_rows(mixing.mix(sized)) == want


# ---------------------------------------------------------------- 7


def test_without_the_estimate_every_pair_is_compared(spark, docs, rows):
    got = minhash.near_duplicates(docs, k=4, slack=None).collect()
    assert multiset((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == multiset(plain_near(rows, 4, 80))


def test_the_estimate_rules_no_pair_out():
    """Pairs at the threshold itself: both sketches leave all of them possible."""
    r = np.random.default_rng(1)
    lost = 0
    for n in (30, 200, 2000):
        for _ in range(300):
            both = r.integers(0, 2**63, math.ceil(n * 0.8), dtype=np.uint64)
            extra = [r.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, e]) * np.uint64(2) + np.uint64(1)) for e in extra)
            for sketch in (minhash.registers, minhash.fine_registers):
                x, y = (sketch(s, np.array([0, len(s)])) for s in (a, b))
                lost += not minhash._possible(x, y, np.array([float(len(a))]), np.array([float(len(b))]), 0.8)[0]
    assert lost == 0


# ---------------------------------------------------------------- 8


def scalar_probabilities(net, block):
    """The network's output at each position of one block, number by number."""
    s, n = net.size, len(block)
    sig = lambda x: 1 / (1 + math.exp(-x))
    both = [[0.0] * (2 * s) for _ in range(n)]
    for way in (0, 1):
        table, inner, h = net.p[f"table{way}"], net.p[f"inner{way}"], [0.0] * s
        for t in range(n) if not way else range(n - 1, -1, -1):
            a = [float(v) for v in table[block[t]]]
            b = [sum(h[i] * float(inner[i, j]) for i in range(s)) for j in range(3 * s)]
            new = []
            for u in range(s):
                z, r = sig(a[u] + b[u]), sig(a[s + u] + b[s + u])
                c = math.tanh(a[2 * s + u] + r * b[2 * s + u])
                new.append((1 - z) * c + z * h[u])
            h = new
            both[t][way * s : way * s + s] = h
    out = []
    for v in both:
        raw = [sum(v[i] * float(net.p["out"][i, k]) for i in range(2 * s)) + float(net.p["bias"][k]) for k in range(len(net.languages))]
        e = [math.exp(x - max(raw)) for x in raw]
        out.append([x / sum(e) for x in e])
    return out


def test_documents_equal_the_scalar_network():
    net = langid.Network(["a", "b", "c"], size=4, seed=3)
    texts = ["", "x", "abcdefgh" * 30, "ünï日本 " * 11, "q" * 64, "q" * 65]
    got = net.documents(pa.array(texts))
    for text, have in zip(texts, got):
        raw = text.encode()
        positions = []
        for k in range(0, len(raw), langid.BLOCK):
            part = list(raw[k : k + langid.BLOCK])
            positions += scalar_probabilities(net, part + [langid.PAD] * (langid.BLOCK - len(part)))[: len(part)]
        want = np.mean(positions, axis=0) if positions else np.zeros(3)
        assert np.allclose(have, want, atol=1e-4)


def test_training_sees_one_row_an_id_rare_languages_and_whole_texts(spark, monkeypatch):
    rows = [(k, "x" * 10, "big") for k in range(3000)] + [(5000 + k, "y" * 10, "small") for k in range(20)] + [(7, f"copy {k}", "big") for k in range(500)] + [(9000, "z" * 10_000, "long")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.chosen(known, 200).collect()
    count = Counter(r["lang"] for r in got)
    assert count["small"] == 20 and count["long"] == 1 and 100 < count["big"] < 260 and len({r["doc_id"] for r in got}) == len(got)
    seen = []

    def train(self, x, y, weight, steps):
        seen.append((x.shape, int((x == ord("z")).sum())))
        return self

    monkeypatch.setattr(langid.Network, "train", train)
    langid.train(known, 200)
    assert seen[0][1] == 10_000


def test_every_block_is_learned_from():
    net = langid.Network(["a", "b"], size=2)
    seen = Counter()
    real = net.gradient
    net.gradient = lambda x, y: (seen.update(x[0].tolist()), real(x, y))[1]
    x = np.arange(200, dtype=np.int16)[None, :].repeat(3, axis=0)
    net.train(x, np.arange(200) % 2, steps=2, lanes=16)
    assert set(seen) == set(range(200))


# ---------------------------------------------------------------- 10


def scalar_loss(theta, rows, grade, top):
    """Cumulative-link negative log-likelihood a row, with its penalty, number by number."""
    n = len(rows[0])
    w, cuts = theta[:n], [theta[n]]
    for gap in theta[n + 1 :]:
        cuts.append(cuts[-1] + math.exp(gap))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    total = 0.0
    for x, g in zip(rows, grade):
        s = sum(a * b for a, b in zip(w, x))
        low = logistic(cuts[g - 1] - s) if g > 0 else 0.0
        high = logistic(cuts[g] - s) if g < top else 1.0
        total -= math.log(high - low)
    return total / len(rows) + 0.5e-4 * sum(a * a for a in w)


def test_the_fit_is_the_plain_optimum():
    """No step from the fitted weights and thresholds lowers the plain loss."""
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 2))
    grade = np.digitize(x @ [1.0, -0.7] + r.normal(size=60), [-0.6, 0.8])
    dense = np.zeros((60, quality.SHAPES + quality.EXTRA))
    dense[:, [3, 9]] = x
    model = quality.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), dense, grade, steps=3000)
    theta = [float(model.shares[3]), float(model.shares[9]), float(model.thresholds[0]), math.log(model.thresholds[1] - model.thresholds[0])]
    best = scalar_loss(theta, x.tolist(), grade.tolist(), 2)
    for k in range(4):
        for step in (-0.02, 0.02):
            other = list(theta)
            other[k] += step
            assert scalar_loss(other, x.tolist(), grade.tolist(), 2) > best - 1e-6


def test_scores_equal_the_scalar_model():
    texts = ["Good words here, good words.", "", "ABC abc 12", "é é x"]
    row, word, dense = quality.features(pa.array(texts))
    r = np.random.default_rng(2)
    model = quality.Ordinal(r.normal(size=quality.WIDTH), r.normal(size=quality.SHAPES + quality.EXTRA), np.array([-0.5, 0.9]))
    got = model.tails(pa.array(texts))
    for i in range(len(texts)):
        s = sum(float(model.words[w]) for k, w in zip(row, word) if k == i) + sum(float(a) * float(b) for a, b in zip(dense[i], model.shares))
        want = [1 / (1 + math.exp(-(s - t))) for t in model.thresholds]
        assert np.allclose(got[i], want, atol=1e-6)


def test_fitting_sees_one_row_an_id(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    seen = []
    real = quality.fit
    quality.fit = lambda rows, words, dense, grade, **more: (seen.append(len(grade)), real(rows, words, dense, grade, **more))[1]
    try:
        quality.fit_labels(docs, labels)
    finally:
        quality.fit = real
    assert seen == [2]
