"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into blocks of BLOCK bytes, all of them, each with a fresh state. A forward and a
backward GRU of SIZE units read each block; from both states every position gets a probability of each language.
The document's probabilities are the means over all its positions. The network is trained in numpy, on the driver,
by backpropagation through time with Adam, on about SAMPLE documents with a known language (a parameter): those of
each language with the smallest hashes of doc_id, up to an equal share of SAMPLE, and of what is left over by rarer
languages. All blocks of their whole texts are learned from, each at least once: the number of steps is STEPS, or
what one pass over all blocks takes. The driver holds the texts of the sample. All documents are labelled.

`und` with score 0 is the label of null texts, of texts without a letter, and of all texts where no document has a
known language. Repeated rows are labelled alike; of several rows with one doc_id training sees one. Other columns are
passed on, but for lang_pred and score, whose place the operator's columns take. An empty table gives an empty result.
Texts are worked on a block at a time after they are laid out, with some bytes of memory for each of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pieces_of, schema_with, table

BLOCK, SIZE, SAMPLE = 64, 8, 3000
STEPS, BATCH, LANES = 300, 384, 2048
#: Stands behind a block's last byte.
PAD = 256


def blocks_of(texts: pa.Array, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of all texts (block x lanes, PAD behind short ones) and the row of each block's text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, where, body = texts.buffers()
    off = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    count = -(-np.diff(off) // block)
    row = np.repeat(np.arange(n), count)
    start = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * block
    at = start[None, :] + np.arange(block)[:, None]
    out = np.full(at.shape, PAD, np.int16)
    inside = at < off[row + 1][None, :] if n else at < 0
    out[inside] = data[at[inside]]
    return out, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * np.float32(0.5))
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Network:
    """table: what each byte adds to the gates (257 x 3 size), inner: from the state to the gates (size x 3 size),
    for both directions; out, bias: from both states to the languages."""

    def __init__(self, languages: list[str], size: int = SIZE, seed: int = 5):
        r, k = np.random.default_rng(seed), len(languages)
        draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        self.languages, self.size = languages, size
        self.p = {"table0": draw(257, 3 * size), "inner0": draw(size, 3 * size), "table1": draw(257, 3 * size), "inner1": draw(size, 3 * size), "out": draw(2 * size, k), "bias": np.zeros(k, np.float32)}

    def read(self, x: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States after each position: block x lanes x size. way 1 reads from the end. keep gets what backward() needs."""
        s, table, inner = self.size, self.p[f"table{way}"], self.p[f"inner{way}"]
        h = np.zeros((x.shape[1], s), np.float32)
        states = np.empty((*x.shape, s), np.float32)
        for t in range(len(x)) if not way else range(len(x) - 1, -1, -1):
            a, b = table[x[t]], h @ inner
            gates = _sigmoid(a[:, : 2 * s] + b[:, : 2 * s])
            z, r = gates[:, :s], gates[:, s:]
            n = np.tanh(a[:, 2 * s :] + r * b[:, 2 * s :])
            if keep is not None:
                keep.append((t, h, z, r, n, b[:, 2 * s :]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language at each position."""
        return _softmax(self.read(x, 0) @ self.p["out"][: self.size] + self.read(x, 1) @ self.p["out"][self.size :] + self.p["bias"])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradient, through time."""
        s, g = self.size, {}
        kept: tuple[list, list] = ([], [])
        both = np.concatenate([self.read(x, way, kept[way]) for way in (0, 1)], axis=2)
        prob = _softmax(both @ self.p["out"] + self.p["bias"])
        real = (x != PAD).astype(np.float32)
        total = real.sum()
        truth = np.eye(len(self.languages), dtype=np.float32)[y]
        loss = -(np.log(np.maximum((prob * truth).sum(axis=2), 1e-9)) * real).sum() / total
        d = (prob - truth) * real[:, :, None] / total
        g["out"] = np.einsum("tbs,tbk->sk", both, d, optimize=True)
        g["bias"] = d.sum(axis=(0, 1))
        dboth = d @ self.p["out"].T
        for way in (0, 1):
            inner, dh = self.p[f"inner{way}"], np.zeros((x.shape[1], s), np.float32)
            dinner, dgates = np.zeros_like(inner), np.zeros((*x.shape, 3 * s), np.float32)
            for t, h, z, r, n, bn in reversed(kept[way]):
                dh = dh + dboth[t, :, way * s : way * s + s]
                dn = dh * (1 - z) * (1 - n * n)
                da = dgates[t]
                da[:, :s] = dh * (h - n) * z * (1 - z)
                da[:, s : 2 * s] = dn * bn * r * (1 - r)
                da[:, 2 * s :] = dn
                db = da.copy()
                db[:, 2 * s :] *= r
                dinner += h.T @ db
                dh = dh * z + db @ inner.T
            flat, codes = dgates.reshape(-1, 3 * s), x.ravel()
            g[f"inner{way}"] = dinner
            g[f"table{way}"] = np.stack([np.bincount(codes, flat[:, j], 257) for j in range(3 * s)], axis=1)
        return float(loss), g

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = STEPS, lanes: int = BATCH, rate: float = 0.02, seed: int = 9) -> "Network":
        """Adam over mini-batches of lanes blocks. Blocks (columns of x, of the documents' languages y) come in shuffled
        passes, every block in each; with weight, further batches up to steps are drawn by it."""
        r, n = np.random.default_rng(seed), x.shape[1]
        passes = -(-n // lanes)
        order = r.permutation(n)
        batches = [order[k * lanes : (k + 1) * lanes] for k in range(passes)]
        while len(batches) < steps:
            batches.append(r.choice(n, lanes, p=weight))
        batches = [batches[k] for k in r.permutation(len(batches))]
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step, at in enumerate(batches, 1):
            _, g = self.gradient(x[:, at].astype(np.int16), y[at])
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (len(batches) + 1)))
            for k, p in self.p.items():
                q = g[k].astype(np.float32) * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                p -= np.float32(now) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-7))
        return self

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean over each text's positions of their probabilities; zeros for empty texts."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        x, row = blocks_of(texts)
        for lo in range(0, x.shape[1], LANES):
            part, rows = np.ascontiguousarray(x[:, lo : lo + LANES]), row[lo : lo + LANES]
            real = part != PAD
            sums = np.einsum("tbk,tb->bk", self.positions(part), real.astype(np.float32), optimize=True)
            for k in range(sums.shape[1]):
                total[:, k] += np.bincount(rows, sums[:, k], len(texts))
            count += np.bincount(rows, real.sum(axis=0), len(texts))
        return total / np.maximum(count, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def chosen(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang, text of about sample documents: of each doc_id one row, of each language those with the smallest
    hashes. Nothing is sorted as a whole: a language's share of its rows bounds the hash."""
    known = known.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long").alias("_hash"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}  # a row a language
    left, quota = sample, {}
    for k, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        quota[lang] = min(sizes[lang], -(-left // (len(sizes) - k)))
        left -= quota[lang]
    if not quota:
        return known.limit(0).drop("_hash")
    share = known.sparkSession.createDataFrame([(lang, int((1 << 32) * min(1.0, q / sizes[lang]))) for lang, q in quota.items()], "lang string, _most long")
    near = known.join(F.broadcast(share), "lang").where("_hash <= _most")
    return near.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.struct("lang", F.xxhash64("text"))).alias("_one")).select("doc_id", "_one.lang", "_one.text")


def train(known: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """A network from known (doc_id, text, lang), or None where nothing is known."""
    got = chosen(known, sample).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id").combine_chunks()
    x, row = blocks_of(got.column("text").combine_chunks())
    if not x.shape[1]:
        return None
    lang = got.column("lang").to_numpy()[row].astype(str)
    languages, y = np.unique(lang, return_inverse=True)
    weight = 1.0 / np.bincount(row, minlength=got.num_rows)[row]  # further batches hold the documents alike
    return Network(languages.tolist()).train(x, y, weight / weight.sum(), steps)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score, which take the place of columns of these names; only the text is looked at."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def identified(batches):
        for batch in batches:
            for part in pieces_of(batch, at):
                texts = part.column(at)
                letters = np.array([any(map(str.isalpha, t.as_py() or "")) for t in texts])
                if network is None:
                    pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    prob = network.documents(texts)
                    best = prob.argmax(axis=1)
                    pred = [network.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(identified, schema_with(docs, ("lang_pred", T.StringType()), ("score", T.DoubleType())))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    network = train(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), network).drop("text")
