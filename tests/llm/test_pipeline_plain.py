"""The whole pipeline against a plain version, stage by stage and as a whole."""

import hashlib
import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from flowspark.llm import quality  # noqa: E402

from .conftest import SCHEMA  # noqa: E402
from .test_operators import WORD, plain_near, plain_repeats, plain_targets, tables  # noqa: E402


def plain_good(rows, model):
    out = []
    for r in rows:
        row, word, dense = quality.features(pa.array([r[1]], pa.string()))
        score = sum(float(model.words[w]) for w in word) + sum(float(a) * float(b) for a, b in zip(dense[0], model.shares))
        if 1 / (1 + math.exp(-(score - float(model.thresholds[-1])))) >= 0.5:
            out.append(r)
    return out


def plain_once(rows):
    rows = list({(r[0], r[1]): r for r in rows}.values())
    label = plain_near(rows, 5, 80)
    return [r for r, (k, _, c) in zip(rows, label) if k == c]


def plain_thin(rows):
    out = []
    for r, (words, gone) in zip(rows, plain_repeats([r[1] for r in rows], 35)):
        text = r[1]
        if any(gone):
            spots = [m.span() for m in WORD.finditer(text)]
            cut = [(a, spots[k + 1][0] if k + 1 < len(spots) else len(text)) for k, (a, _) in enumerate(spots) if gone[k]]
            text = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in cut))
        out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def plain_mix(rows):
    sizes, by = Counter(), {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        octave = len(f"{n:b}")
        by.setdefault(r[3], []).append((n if n < 8 else octave * 8 + (n >> (octave - 4)) % 8, hashlib.md5(str(r[0]).encode()).hexdigest(), n, r))
    target, out = plain_targets(dict(sizes)), []
    for source, docs in by.items():
        key = "" if source is None else "=" + source
        u = (int(hashlib.md5(f"17{key}".encode()).hexdigest()[:5], 16) + 0.5) / (1 << 20)
        step = target[source] / sizes[source] if sizes[source] else 0.0
        for rank, (*_, r) in enumerate(sorted(docs, key=lambda x: x[:3]), 1):
            out += [r] * min(3, math.floor(u + step * rank) - math.floor(u + step * (rank - 1)))
    return out


def test_pipeline_equals_the_plain_one(spark, rows, tmp_path):
    import sentencepiece

    rows = [r for r in rows if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(0, 120, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 4, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = [lambda x: plain_good(x, quality.fit_labels(docs, labels)), plain_once, plain_thin, plain_mix]
    now, want = docs, rows
    for (name, stage), same in zip(corpus_pipeline.STAGES, plain):
        want = same(want)
        got = [tuple(r) for r in stage(spark, now, str(tmp_path)).collect()]
        assert Counter(got) == Counter(want), name
        now = spark.createDataFrame(got, SCHEMA)
    assert 10 < len(want) != len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=tables("piece_bpe_32k.model"))
    ids = [(r[0], [*sp.encode(r[1] or ""), sp.eos_id()]) for r in want]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    final = Counter((k, len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for k, x in ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == final
