"""Near-duplicate documents by HyperMinHash.

1. Sketch: each document's set of distinct k-word shingles is hashed to 64 bits. The top 7 bits pick one of 128
   registers, which keeps the smallest remainder, stored as its number of leading zeros and the 10 bits after the
   first one (16 bits a register, 0 for none).
2. Classes: documents with the same set (size and two sums of mixed hashes) are one class, whose smallest doc_id
   stands for it from here on. Thousands of copies cost one row each and nothing more.
3. Bands: 32 bands of 4 registers; a band that is empty throughout is no key. Two sets that differ in fewer than 32
   shingles share a band for certain; with Jaccard 0.8 and more the chance to share none is below 1e-7.
4. Star round: in each bucket every member pairs with the smallest, so a bucket of n costs n - 1 pairs. Pairs pass
   the collision-corrected Jaccard estimate of their registers (SLACK standard deviations below the threshold), then the exact
   comparison of their whole sets.
5. Rest round: members of buckets that still hold several components are compared across components by a second
   sketch of 512 registers of 8 bits, tile by tile; likely pairs are verified like the others, so no link is lost.
6. Components of the links, carried from classes to their members.

Hot keys: buckets and classes with over a thousandth of all rows meet their group by a broadcast of fewer than 1000
rows; texts that many pairs need are salted.

Nulls and empty texts have no shingles: they link with nothing and are kept. A null doc_id links with nothing, has a
null component and is kept. Equal rows are in one class; doc_id is taken to name one text. An empty table gives an
empty result. Only doc_id and text are read, so other columns may be called anything. Whole texts are compared; a text
is worked on in one piece, with some tens of bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, components, cut, drop_cut, grams, heavy_join, hot_keys, long_of, mix64, pieces_of, table

BUCKET_BITS, MANTISSA, ROWS = 7, 10, 4
REGISTERS = 1 << BUCKET_BITS
BANDS = REGISTERS // ROWS
#: Standard deviations below the expected number of equal registers at which a pair is ruled out (a parameter of
#: near_duplicates, where None rules out none), and rows of a tile.
SLACK, TILE = 4.5, 512
#: The second sketch, for buckets of several components: number of registers, and how often two that differ look alike.
FINE_BITS, FINE_CHANCE = 9, 0.0104


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, back to back, and where each text's begin."""
    w = Words(texts, lower)
    n = np.diff(w.first)
    g = grams(w.h, k)
    whole = w.inside(k)
    doc, g = w.doc[: len(g)][whole], g[whole]
    for short in range(1, k):
        rows = np.flatnonzero(n == short)
        if len(rows):
            doc = np.concatenate([doc, rows])
            g = np.concatenate([g, mix64(grams(w.h, short)[w.first[rows]] + np.uint64(short))])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _least(g: np.ndarray, first: np.ndarray, bits: int, mantissa: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set's 2**bits registers in use: place, leading zeros and mantissa of the smallest remainder."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    place = (doc << bits) + (g >> np.uint64(64 - bits)).astype(np.int64)
    least = np.ones(len(g), bool)
    least[1:] = place[1:] != place[:-1]  # hashes ascend within a set, so the first of a bucket is its smallest
    rest = (g[least] << np.uint64(bits)) & ~np.uint64(0x7FF)
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 64 - bits, 64 - exponent).astype(np.uint64)
    return place[least], zeros, (rest << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa)


def registers(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of the sets, one row each."""
    place, zeros, mantissa = _least(g, first, BUCKET_BITS, MANTISSA)
    out = np.zeros((len(first) - 1) * REGISTERS, np.uint16)
    out[place] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out.reshape(-1, REGISTERS)


def fine_registers(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """More registers of fewer bits: three of the number of zeros, five of the mantissa, 0 for none."""
    place, zeros, mantissa = _least(g, first, FINE_BITS, 5)
    out = np.zeros((len(first) - 1) << FINE_BITS, np.uint8)
    out[place] = (1 + ((zeros & np.uint64(7)) << np.uint64(5) | mantissa) % np.uint64(255)).astype(np.uint8)
    return out.reshape(-1, 1 << FINE_BITS)


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each band that is not empty."""
    keys, full = _all_keys(regs)
    row, band = np.nonzero(full)
    return row, keys[row, band]


def _all_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix64(packed + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]), packed != 0


def _prints(regs: np.ndarray) -> np.ndarray:
    """32 bits of each band's key, 0 for an empty band."""
    keys, full = _all_keys(regs)
    return np.where(full, np.maximum(keys & np.uint64(0xFFFFFFFF), 1), 0).astype(np.uint32)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers in use and registers that agree less those expected to agree by chance, of each pair of rows."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    if a.dtype == np.uint8:
        return used, (equal - FINE_CHANCE * used) / (1 - FINE_CHANCE)
    chance = 0.169919 * 2.0 ** (BUCKET_BITS - MANTISSA + 1) * 4 * n * m / np.maximum(n + m, 1.0) ** 2
    return used, equal - chance


def _possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, share: float, slack: float | None = SLACK) -> np.ndarray:
    """Whether sizes and registers leave the share possible; sizes alone with slack None. Registers in use are a sample
    without replacement of the union, so the slack shrinks as they come near its size."""
    sized = np.minimum(n, m) >= share * np.maximum(n, m) - 1e-6
    if slack is None:
        return sized
    used, equal = estimate(a, b, n, m)
    union = np.maximum((n + m) / (1 + share), used + 1.0)
    spread = np.sqrt(used * share * (1 - share) * (union - used) / np.maximum(union - 1, 1))
    return sized & (equal >= share * used - slack * spread - 1)


def sketch(docs: DataFrame, k: int, lower: bool = True) -> DataFrame:
    """doc_id, n (set size), s1, s2 (the set's sums), regs."""

    def sketched(batches):
        for batch in batches:
            for part in pieces_of(batch, 1):
                g, first = shingle_sets(part.column(1), k, lower)
                regs = registers(g, first)
                sums = []
                for salt in (0x1234567, 0x89ABCDE):
                    total = np.zeros(len(g) + 1, np.uint64)
                    np.cumsum(mix64(g + np.uint64(salt)), out=total[1:])
                    sums.append(pa.array(long_of(total[first[1:]] - total[first[:-1]])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), *sums, pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n", "s1", "s2", "regs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketched, "doc_id long, n long, s1 long, s2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    def banded(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)])
                row, key = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(long_of(key)), batch.column(0).take(pa.array(row))], names=["band", "doc"])

    return reps.select("doc_id", "regs").mapInArrow(banded, "band long, doc long")


def with_both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of a as <name>_a and of b as <name>_b. b may be the same in any share of the
    pairs: the row of such a b is repeated, and its pairs are spread over the copies."""
    side = lambda end: rows.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    hot = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b").select("b", F.ceil(F.col("n") / 256).cast("int").alias("_copies"))
    spread = F.coalesce(F.pmod(F.xxhash64("a"), F.col("_copies")), F.lit(0)).cast("int")
    left = pairs.join(F.broadcast(hot), "b", "left").withColumn("_salt", spread).drop("_copies")
    right = side("b").join(F.broadcast(hot), "b", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return left.join(side("a"), "a").join(right, ["b", "_salt"]).drop("_salt")


def _likely(pairs: DataFrame, reps: DataFrame, share: float, slack: float | None) -> DataFrame:
    """The pairs whose registers do not rule the share out."""

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                col = lambda name: batch.column(batch.schema.get_field_index(name))
                a, b = (np.stack([np.frombuffer(x.as_py(), np.uint16) for x in col(c)]) for c in ("regs_a", "regs_b"))
                keep = _possible(a, b, col("n_a").to_numpy().astype(float), col("n_b").to_numpy().astype(float), share, slack)
                yield pa.RecordBatch.from_arrays([col("a").filter(pa.array(keep)), col("b").filter(pa.array(keep))], names=["a", "b"])

    sized = with_both(pairs, reps, ["n", "regs"]).where(F.least("n_a", "n_b") >= F.lit(share) * F.greatest("n_a", "n_b") - 1e-6)
    return sized.mapInArrow(likely, "a long, b long")


def _fine(texts: DataFrame, k: int, lower: bool) -> DataFrame:
    def refined(batches):
        for batch in batches:
            for part in pieces_of(batch, 1):
                g, first = shingle_sets(part.column(1), k, lower)
                rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (_prints(registers(g, first)), fine_registers(g, first))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), *rows], names=["doc", "size", "prints", "fine"])

    return texts.select("doc_id", "text").mapInArrow(refined, "doc long, size long, prints binary, fine binary")


def _across(rows: DataFrame, fine: DataFrame, share: float, slack: float | None) -> DataFrame:
    """Of buckets (band, doc, center, n, part): the likely pairs a, b of different parts, without the center, each in
    the first band alone that both share. Buckets of over TILE rows are compared in tiles, so no task holds one."""
    rows = rows.join(fine, "doc")
    sides = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("doc"), sides).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), sides - 1)))
    rows = rows.select("band", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), F.col("_own").alias("own"), "doc", "center", "part", "size", "prints", "fine")
    dealt = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def pairs_of(own, doc, center, part, size, prints, regs, band, low, high):
        slot = int(np.argmax(prints[0] == max(band & 0xFFFFFFFF, 1)))
        free = np.flatnonzero(doc != center)
        left, right = free[own[free] == low], free[own[free] == high]
        for lo in range(0, len(left), 256):
            i, j = np.nonzero(part[left[lo : lo + 256], None] != part[None, right])
            i, j = left[lo : lo + 256][i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            for k in range(slot):  # a pair counts in its first common band
                new = (prints[i, k] != prints[j, k]) | (prints[i, k] == 0)
                i, j = i[new], j[new]
            for at in range(0, len(i), 8192):
                x, y = i[at : at + 8192], j[at : at + 8192]
                likely = _possible(regs[x], regs[y], size[x], size[y], share, slack)
                x, y = doc[x[likely]], doc[y[likely]]
                yield np.maximum(x, y), np.minimum(x, y)

    def compared(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool):
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "low", "high")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, int)
            ends = np.append(starts[1:], len(key))
            if not last:  # the last group may go on in the next batch
                held.append(table.slice(int(starts[-1])))
                starts, ends = starts[:-1], ends[:-1]
            own, doc, center, part, size = (table.column(c).to_numpy() for c in ("own", "doc", "center", "part", "size"))
            prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint32).reshape(-1, BANDS)
            regs = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, 1 << FINE_BITS)
            found = []
            for lo, hi in zip(starts, ends, strict=True):
                g = slice(lo, hi)
                found += pairs_of(own[g], doc[g], center[g], part[g], size[g].astype(float), prints[g], regs[g], int(key[lo, 0]), key[lo, 1], key[lo, 2])
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                whole = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                held = []
                yield from groups(whole, False)
        if held:
            yield from groups(held[0], True)

    return dealt.mapInArrow(compared, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """The pairs whose whole sets reach the share."""

    def verified(batches):
        for whole in batches:
            for batch in pieces_of(whole, whole.schema.get_field_index("text_a")):
                col = lambda name: batch.column(batch.schema.get_field_index(name))
                _, once, at = np.unique(col("b").to_numpy(), return_index=True, return_inverse=True)
                ga, fa = shingle_sets(col("text_a"), k, lower)
                gb, fb = shingle_sets(col("text_b").take(pa.array(once)), k, lower)
                keep = []
                for i, j in enumerate(at):
                    x, y = ga[fa[i] : fa[i + 1]], gb[fb[j] : fb[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep)], names=["a", "b"])

    return with_both(pairs, texts, ["text"]).mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, slack: float | None = SLACK) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id, kept, a row for each of its rows. With slack None every
    pair of a bucket whose sizes allow it is compared exactly: no estimate rules pairs out."""
    sketches = cut(sketch(docs, k, lower), "sketch")
    keyed = sketches.select("doc_id", F.struct("n", "s1", "s2").alias("key"))
    classes = cut(keyed.where("key.n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    alone = classes.select(F.col("rep").alias("doc_id"))
    reps = cut(sketches.where("n > 0").join(alone, "doc_id", "left_semi").select("doc_id", "n", "regs"), "reps")

    bands = _bands(reps)
    buckets = bands.groupBy("band").agg(F.min("doc").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(heavy_join(bands, buckets, "band", "n", "inner").select("band", "doc", "center", "n"), "buckets")
    pairs = members.where("doc <> center").select(F.col("doc").alias("a"), F.col("center").alias("b")).distinct()
    pairs = cut(_likely(pairs, reps, percent / 100, slack), "pairs")

    in_buckets = members.select(F.col("doc").alias("doc_id")).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long"), "text").join(in_buckets, "doc_id", "left_semi"), "texts")
    links = cut(_verified(pairs, texts, k, percent, lower), "stars")
    found = cut(components(links), "components")

    # buckets of three and more that hold several components: the pairs across them
    labelled = members.where("n > 2").join(found, F.col("doc") == F.col("node"), "left").select("band", "doc", "center", F.coalesce("component", "doc").alias("part"))
    mixed = labelled.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("band", "n")
    rest = heavy_join(labelled, mixed, "band", "n", "inner")
    fine = cut(_fine(texts, k, lower), "fine")
    across = cut(_across(rest, fine, percent / 100, slack).distinct(), "across")
    more = cut(_verified(across, texts, k, percent, lower), "more")
    if more.limit(1).count():
        found = cut(components(links.union(more)), "components")
    drop_cut(reps, members, pairs, texts, links, fine, across, more)

    parts = classes.join(found, F.col("rep") == F.col("node"), "left").select("key", "n", F.coalesce("component", "rep").alias("part"))
    out = heavy_join(keyed, parts, "key", "n", "left")
    component = F.coalesce("part", "doc_id")
    return out.select("doc_id", F.col("key.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
