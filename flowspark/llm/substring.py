"""Substring deduplication with compressed FM-indexes.

A window is `window` consecutive words of one document; a word goes where some window over it has a word sequence
that also starts anywhere else. Steps:

1. Anchors: the smallest hash of any GRAM consecutive words in a window is the window's anchor, which depends on the
   window's words alone, so equal windows have equal anchors. Only anchors that stand in runs of windows more
   than once can hold a repeat; all others are dropped after one count over the corpus.
2. Runs: neighbouring windows with the same anchor form a run (at most RUN windows). Every window of the corpus is in
   one run. Runs of frequent anchors (over a thousandth of all, and any over KEY_ROWS) are split into single windows
   keyed by their own hash, so no key gathers what it only shares a few words with. Equal runs are counted before
   they move, and again where they meet: a key never holds more than KEY_ROWS different runs but for collisions of
   hashes, whatever the size of the corpus.
3. Shards: the distinct runs of a shard, with their counts, are one text over the shard's word numbers. Its
   Burrows-Wheeler transform is kept as a wavelet matrix of packed bit vectors with rank counts. All runs are then
   streamed against it: backward search extends each match to the left while its interval holds more than one
   occurrence (by the runs' counts), which gives the matching statistics; intervals of `window` words and more are
   reported. Words are 32-bit hashes here, so 35 words are compared by 1120 bits.
4. The reported windows of each distinct run go back to its occurrences and to the documents' words.

A repeat's two occurrences have equal anchors, so they meet in one shard: nothing is lost by sharding, and no shard
sees more than its own runs.

Nulls: a null text has no words (kept_sha256 is that of the empty text); a null doc_id is an id like others. Equal
rows are counted as repeats of each other; rows are named by doc_id and a hash of the text, so rows of one id and
other texts are told apart. Other columns are passed on whatever they are called. An empty table gives an empty
result. Texts are never cut: a text is worked on in one piece, with some tens of bytes of memory for each of its
bytes, so texts of some hundred MB need larger executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT_SHARE, Words, cut, drop_cut, grams, heavy_join, hot_keys, long_of, mix64, pieces_of, powers, shuffle_partitions, table

WINDOW, GRAM, RUN = 35, 8, 28


# ---------------------------------------------------------------- FM-index


class BitRank:
    """A packed bit vector with the number of ones before each word of it."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n >> 6) * 8 + 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    """Rank of any symbol below 2**levels at any position, a level a bit."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i ends up at the bottom on the symbol's path. Differences of two positions on one path
        are the symbol's occurrences between them."""
        for k in range(self.levels):
            ones = self.bits[k].rank(i)
            i = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols and more (prefix doubling)."""
    _, rank = np.unique(text, return_inverse=True)
    rank, n, k = rank.astype(np.int64), len(text), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Of weighted pieces of text (lengths, symbols back to back): how often any pattern occurs in them, with
    each occurrence counted as often as its piece."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        self.names, codes = np.unique(symbols, return_inverse=True)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(codes)) + piece  # a separator, the smallest symbol, ends each piece
        text = np.zeros(len(codes) + len(lengths), np.int64)
        text[at] = codes + 1
        self.text, self.first = text, np.cumsum(lengths + 1) - (lengths + 1)
        order = suffix_array(text, int(lengths.max(initial=1)) + 1)
        # rows that are equal up to depth lie together; their symbols to the left may come in any order
        last = np.concatenate([text[-1:], text[:-1]])[order]
        weight = np.zeros(len(text), np.int64)
        weight[at] = weights[piece]
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        self.levels = max(1, int(text.max(initial=1)).bit_length())
        self.tree = WaveletMatrix(last, self.levels)
        count = np.bincount(text, minlength=(1 << self.levels) + 1)
        every = np.arange(1 << self.levels)
        #: Row of the first suffix with each symbol, less where the symbol's path starts at the bottom.
        self.base = (np.cumsum(count) - count)[: 1 << self.levels] - self.tree.descend(every, np.zeros(len(every), np.int64))
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        return self.base[symbol] + self.tree.descend(symbol, low), self.base[symbol] + self.tree.descend(symbol, high)

    def reach(self, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each end in the index's own text: the smallest start, not below least, from which the text up to end
        (left out) occurs at least twice. Backward search in step over all."""
        start = end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size)
        live = np.arange(len(end))
        while len(live):
            live = live[start[live] > least[live]]
            symbol = self.text[start[live] - 1]
            a, b = self.extend(symbol, low[live], high[live])
            twice = self.weight[b] - self.weight[a] >= 2
            live, a, b = live[twice], a[twice], b[twice]
            start[live] -= 1
            low[live], high[live] = a, b
        return start


def repeated_windows(index: FMIndex, lengths: np.ndarray, window: int) -> np.ndarray:
    """For each piece of the index, as bits, at which offsets a window starts that occurs at least twice.

    The matching statistics are taken from the right. Where the match that ends at `end` cannot go on to the left of
    s, windows that hold both s - 1 and end - 1 are none; if already the GRAM words from s - 1 on occur once, neither
    are any over those, and the end moves to just before their last word."""
    masks = np.zeros(len(lengths), np.int64)
    live = np.flatnonzero(lengths >= window)
    end = lengths[live].copy()
    while len(live):
        first = index.first[live]
        s = index.reach(first + end, first) - first
        hit = end - s >= window
        bits = np.where(hit, (1 << np.where(hit, end - window + 1, 0)) - (1 << np.where(hit, s, 0)), 0)
        masks[live] |= bits
        on = (s > 0) & (end > window)
        live, first, s, end = live[on], first[on], s[on], end[on]
        probe = np.minimum(s - 1 + GRAM, end - 1)
        back = index.reach(first + probe, first + s - 1) - first
        end = np.where(back > s - 1, np.minimum(probe - 1, end - 1), end - 1)
        on = end >= window
        live, end = live[on], end[on]
    return masks


# ---------------------------------------------------------------- anchors and runs


def runs_of(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs in w: number of the first word, number of windows, anchor."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(w.h) < window:
        return none
    h = w.grams(GRAM, 0x51ED27)
    span = window - GRAM + 1
    least, done = h, 1  # smallest of `done` hashes from each position; doubled up to span
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    at = np.flatnonzero(w.inside(window))
    if not len(at):
        return none
    anchor, doc = least[at], w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(place % RUN == 0)
    return at[head], np.diff(np.append(head, len(at))), anchor[head]


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the whole text, which tells rows of one id apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, mark, anchor, n: each document's anchors, and how often they stand in its runs."""

    def anchored(batches):
        for batch in batches:
            for part in pieces_of(batch, 2):
                w = Words(part.column(2))
                at, windows, anchor = runs_of(w, window)
                times = np.zeros(len(at), np.int64)
                h = w.grams(GRAM, 0x51ED27)
                for offset in range(RUN + window - GRAM):
                    place = np.minimum(at + offset, len(h) - 1)
                    times += (offset < windows + window - GRAM) & (h[place] == anchor)
                order = np.lexsort((anchor, w.doc[at]))
                doc, anchor, times = w.doc[at][order], anchor[order], times[order]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                head = np.flatnonzero(new)
                n = np.add.reduceat(times, head) if len(head) else times
                rows = pa.array(doc[head])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(long_of(anchor[head])), pa.array(n)], names=["doc_id", "mark", "anchor", "n"])

    return docs.mapInArrow(anchored, "doc_id long, mark long, anchor long, n long")


def _runs(batch: pa.RecordBatch, window: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batch (doc_id, mark, text, anchors, hot): for its slices the words and the runs of listed anchors: first word,
    windows, key. Runs of hot anchors come as single windows, keyed by the window."""
    for part in pieces_of(batch, 2):
        w = Words(part.column(2))
        at, n, anchor = runs_of(w, window)
        lists = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
        listed = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        hot = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(bool)
        row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((listed, row))
        listed, hot, row = listed[order], hot[order], row[order]
        doc = w.doc[at]
        found = _find(row, listed, doc, anchor)
        keep = found >= 0
        at, n, anchor, is_hot = at[keep], n[keep], anchor[keep], hot[found[keep]] if len(hot) else np.zeros(keep.sum(), bool)
        one = np.repeat(at[is_hot], n[is_hot]) + (np.arange(n[is_hot].sum()) - np.repeat(np.cumsum(n[is_hot]) - n[is_hot], n[is_hot]))
        whole = grams(w.h, window, 0x7F4A7C)[one] if len(one) else np.zeros(0, np.uint64)
        yield part, w, np.concatenate([at[~is_hot], one]), np.concatenate([n[~is_hot], np.ones(len(one), np.int64)]), np.concatenate([anchor[~is_hot], whole])


def _find(row: np.ndarray, key: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where (at, wanted) is in the sorted (row, key), -1 where it isn't."""
    if not len(row) or not len(at):
        return np.full(len(at), -1)
    all_row, all_key = np.concatenate([row, at]), np.concatenate([key, wanted])
    given = np.arange(len(all_row)) >= len(row)
    order = np.lexsort((given, all_key, all_row))
    held = np.where(given[order], -1, order)
    held = np.maximum.accumulate(np.where(held >= 0, np.arange(len(order)), -1))
    out = np.empty(len(order), np.int64)
    out[order] = np.where(held >= 0, order[np.maximum(held, 0)], -1)
    out = out[len(row) :]
    good = (out >= 0) & (row[np.maximum(out, 0)] == at) & (key[np.maximum(out, 0)] == wanted)
    return np.where(good, out, -1)


def _names(w: Words, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run's words."""
    pw, inverse = powers(len(w.h) + 1)
    out = []
    for salt in (0x2545F491, 0x4F6CDD1D):
        prefix = np.zeros(len(w.h) + 1, np.uint64)
        np.cumsum(mix64(w.h + np.uint64(salt)) * pw[: len(w.h)], out=prefix[1:])
        out.append(mix64((prefix[at + words] - prefix[at]) * inverse[at] + words.astype(np.uint64)))
    return out[0], out[1]


def _distinct_runs(rows: DataFrame, window: int) -> DataFrame:
    """key, r1, r2, words (32-bit hashes), n of the runs of rows (doc_id, mark, text, anchors, hot): equal runs counted."""

    def listed(batches):
        for batch in batches:
            for part, w, at, n, key in _runs(batch, window):
                words = n + window - 1
                r1, r2 = _names(w, at, words)
                _, once, count = np.unique(r1, return_index=True, return_counts=True)
                h = (w.h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                blobs = [h[i:j].tobytes() for i, j in zip(at[once].tolist(), (at[once] + words[once]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(long_of(key[once])), pa.array(long_of(r1[once])), pa.array(long_of(r2[once])), pa.array(blobs, pa.binary()), pa.array(count)], names=["key", "r1", "r2", "words", "n"])

    return rows.mapInArrow(listed, "key long, r1 long, r2 long, words binary, n long")


#: Keys that carry rows whose windows are known already through the join with the masks.
CARRIERS = 4096


def _occurrences(rows: DataFrame, window: int, known: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, mark, start (number of the first word in its text), r1, r2, own of each run of rows. Runs in known
    (r1, r2, mask; fewer than 1000) come together, with their repeated windows in own and a carrier for r1."""
    table = np.array(sorted(known), np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0].view(np.uint64) if len(table) else table[:, 0])]

    def listed(batches):
        for batch in batches:
            for part, w, at, n, _ in _runs(batch, window):
                r1, r2 = _names(w, at, n + window - 1)
                doc = w.doc[at]
                start = at - w.first[doc]
                own = np.zeros(len(at), np.int64)
                if len(table) and len(at):
                    keys = np.ascontiguousarray(table[:, 0]).view(np.uint64)
                    place = np.minimum(np.searchsorted(keys, r1), len(keys) - 1)
                    hit = (keys[place] == r1) & (table[place, 1] == long_of(r2))
                    own = np.where(hit, table[place, 2], 0)
                open_ = own == 0
                # the known runs' windows, by their place in the text
                d, p = [], []
                for offset in range(RUN):
                    on = np.flatnonzero(own >> offset & 1)
                    d.append(doc[on])
                    p.append(start[on] + offset)
                d, p = np.concatenate(d), np.concatenate(p)
                order = np.lexsort((p, d))
                d, p = d[order], p[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (p[1:] // RUN != p[:-1] // RUN)
                head = np.flatnonzero(new)
                masks = np.bitwise_or.reduceat(np.int64(1) << (p % RUN), head) if len(head) else np.zeros(0, np.int64)
                all_doc = np.concatenate([doc[open_], d[head]])
                mark = part.column(1).take(pa.array(all_doc))
                carrier = (d[head] * 7919 + p[head] // RUN + len(w.data)) % CARRIERS
                columns = [np.concatenate([start[open_], p[head] // RUN * RUN]).astype(np.int32), np.concatenate([long_of(r1[open_]), carrier]), np.concatenate([long_of(r2[open_]), np.zeros(len(head), np.int64)]), np.concatenate([own[open_], masks])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(all_doc)), mark, *map(pa.array, columns)], names=["doc_id", "mark", "start", "r1", "r2", "own"])

    return rows.mapInArrow(listed, "doc_id long, mark long, start int, r1 long, r2 long, own long")


#: Symbols of one index: a shard of more runs is indexed in several parts, cut between keys. Runs of a key beyond
#: which its windows are dealt by their own hash, so that the runs of one key stay within one index.
SHARD, KEY_ROWS = 1 << 21, 1 << 14


def _combined(table: pa.Table) -> pa.Table:
    """key, r1, r2, words, n in order, with equal runs, which several tasks counted, in one row."""
    key, r1, r2 = (table.column(c).to_numpy() for c in ("key", "r1", "r2"))
    order = np.lexsort((r2, r1, key))
    key, r1, r2 = key[order], r1[order], r2[order]
    new = np.ones(len(key), bool)
    new[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (key[1:] != key[:-1])
    total = np.bincount(np.cumsum(new) - 1, table.column("n").to_numpy()[order]).astype(np.int64)
    one = table.take(pa.array(order[new]))
    return one.set_column(one.schema.get_field_index("n"), "n", pa.array(total))


def _symbols(table: pa.Table) -> int:
    return table.column("words").nbytes // 4


def _search(runs: DataFrame, window: int) -> DataFrame:
    """r1, r2, n, mask of the distinct runs with repeated windows. runs: key, r1, r2, words, n, all rows of a key in
    one task and next to each other. What is held of a key is its different runs, however often they come."""

    def index(table: pa.Table):
        table = _combined(table)
        key, total = table.column("key").to_numpy(), table.column("n").to_numpy()
        blobs = table.column("words").to_pylist()
        # a window that is its key's only run and occurs once has nothing to be found
        alone = np.array([len(b) == 4 * window for b in blobs], bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[:-1] != key[1:]
        use = np.flatnonzero(~(alone & (total == 1)))
        if not len(use):
            return
        blobs = [blobs[k] for k in use]
        lengths = np.array([len(b) // 4 for b in blobs])
        symbols = np.frombuffer(b"".join(blobs), np.uint32)
        masks = repeated_windows(FMIndex(symbols, lengths, total[use]), lengths, window)
        hit = masks != 0
        found = table.take(pa.array(use[hit]))
        yield pa.RecordBatch.from_arrays([found.column(c).combine_chunks() for c in ("r1", "r2", "n")] + [pa.array(masks[hit])], names=["r1", "r2", "n", "mask"])

    def searched(batches):
        held: list[pa.Table] = []
        size, most = 0, SHARD
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += _symbols(held[-1])
            if size > most:
                whole = pa.concat_tables(held)
                key = whole.column("key").to_numpy()
                other = np.flatnonzero(key != key[-1])
                if len(other):
                    last = int(other[-1]) + 1
                    yield from index(whole.slice(0, last))
                    whole = whole.slice(last)
                whole = _combined(whole)
                held, size = [whole], _symbols(whole)
                most = max(SHARD, 2 * size)
        if held:
            yield from index(pa.concat_tables(held))

    return runs.mapInArrow(searched, "r1 long, r2 long, n long, mask long")


def removed_words(n: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a repeated window; masks hold the window offsets behind each start."""
    step = np.zeros(n + 1, np.int64)
    for offset in range(RUN):
        at = starts[(masks >> offset) & 1 == 1] + offset
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
    return np.cumsum(step[:n]) > 0


def find_repeats(docs: DataFrame, window: int = WINDOW, done: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, mark, spans (array of start, mask): the repeated windows of each document that has some. docs: doc_id,
    mark, text. done gets the tables that may be dropped once the result is written."""
    spark = docs.sparkSession
    anchors = cut(_anchors(docs, window), "anchors")
    counted = cut(anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1"), "anchor-counts")
    total = counted.agg(F.sum("n").alias("_all"))  # one row
    hot = F.col("n") > F.least(F.lit(float(KEY_ROWS)), F.greatest(F.lit(64.0), F.col("_all") * HOT_SHARE))
    counts = counted.crossJoin(F.broadcast(total)).select("anchor", "rows", hot.alias("hot"))
    marked = heavy_join(anchors.select("doc_id", "mark", "anchor"), counts, "anchor", "rows", "inner")
    lists = marked.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("anchor", "hot"))).alias("a")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("a.anchor").alias("anchors"), F.col("a.hot").alias("hot"))
    rows = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("doc_id", "mark", "text", "anchors", "hot")

    runs = _distinct_runs(rows, window)
    dealt = runs.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    masks = cut(_search(dealt, window), "masks")
    if done is not None:
        done += [anchors, counted, masks]
    # runs with over a thousandth of all repeats, so fewer than 1000, are known where the texts are read; no other run
    # has enough rows to be a hot key of the join
    named = masks.withColumn("run", F.struct("r1", "r2"))
    known = [(r["r1"], r["r2"], r["mask"]) for r in hot_keys(named, "run").limit(1000).collect()]
    carriers = spark.range(CARRIERS).select(F.col("id").alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(0).cast("long").alias("mask"))
    joined = _occurrences(rows, window, known).join(masks.select("r1", "r2", F.col("mask").alias("found")).unionByName(carriers.withColumnRenamed("mask", "found")), ["r1", "r2"])
    found = joined.withColumn("found", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("found"))).where("found <> 0")
    # equal rows give equal spans, which are held once
    return found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", F.col("found").alias("mask"))).alias("spans"))


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """_row (a row of docs, whole) and spans (null for none)."""
    done: list[DataFrame] = []
    spans = cut(find_repeats(_named(docs), window, done), "spans")
    drop_cut(*done)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    rows = docs.select(F.struct("*").alias("_row"))
    here = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_mark"))
    return rows.join(spans, here, "left").select("_row", "spans")


def _flat(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the rows themselves, and their spans."""
    for batch in batches:
        columns = batch.column(0).flatten()
        flat = pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=[str(k) for k in range(len(columns) + 1)])
        for part in pieces_of(flat, text):
            yield part, part.column(len(columns))


def _removals(texts: pa.Array, spans: pa.Array, window: int) -> tuple[Words, np.ndarray]:
    """The words of a slice and which of them go."""
    w = Words(texts)
    gone = np.zeros(len(w.h), bool)
    for i, found in enumerate(spans.to_pylist()):
        if found:
            at = np.array([(s["start"], s["mask"]) for s in found], np.int64)
            gone[w.first[i] : w.first[i + 1]] = removed_words(int(w.first[i + 1] - w.first[i]), at[:, 0], at[:, 1], window)
    return w, gone


def word_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def told(batches):
        for part, spans in _flat(batches, 1):
            w, gone = _removals(part.column(1), spans, window)
            data = w.data.tobytes()
            lost = np.bincount(w.doc[gone], minlength=part.num_rows)
            digests = []
            starts, ends, keep = w.start.tolist(), w.end.tolist(), (~gone).tolist()
            for i in range(part.num_rows):
                words = [data[starts[j] : ends[j]] for j in range(w.first[i], w.first[i + 1]) if keep[j]]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first).astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return rows.mapInArrow(told, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of text: runs of removed words go with the gap behind them. Texts
    without any stay as they are."""
    columns = docs.columns
    at = columns.index("text")

    def trimmed(batches):
        for part, spans in _flat(batches, at):
            w, gone = _removals(part.column(at), spans, window)
            texts = part.column(at).to_pylist()
            for i in np.unique(w.doc[gone]).tolist():
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                raw, base = texts[i].encode(), int(w.off[i])
                keep = np.ones(len(raw), bool)
                for j in np.flatnonzero(gone[lo:hi]) + lo:
                    keep[w.start[j] - base : (w.start[j + 1] - base) if j + 1 < hi else len(raw)] = False
                texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
            out = list(part.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return _with_spans(docs, window).mapInArrow(trimmed, docs.schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return word_report(table(spark, sf_dir, "documents"))
