"""SentencePiece encoding and decoding with a distinct-chunk table.

The text is marked as the library does it: spaces become U+2581 and one more stands in front. Where no piece of
the vocabulary has a marker after another character (checked when the model is loaded), no merge crosses from a
word to the marker of the next, so a text's ids are those of its marked words one after another. Each distinct
marked word is segmented once and kept in a table with its ids and the text that its pieces decode to; a text's ids
and its decoded text are joined back from the table by position. Models that break the condition are encoded text by
text. The table is one of each Python worker, filled as words come: one table for the whole corpus would need a
shuffle of every occurrence of every word, which is many times the corpus, to save some seconds of a worker.

A null text counts as empty: only the end id, decoded to an empty text. Texts are never cut. Repeated rows give
repeated rows; an empty table gives an empty result. Only doc_id and text are read, so other columns may be called
anything.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ._common import table

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Words a worker keeps at a time, and the longest that it keeps; beyond it the table starts anew (the ids stay the same).
KEPT_WORDS, KEPT_LENGTH = 600_000, 200


class ChunkTable:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kept, self.known = kept, {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.digits = [b"%d " % i for i in range(len(pieces))]
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.stops = np.array([not p.endswith(MARK) for p in pieces])
        probe = self.sp.encode_as_pieces(" a  b ")
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces) and "".join(probe) == f"{MARK * 2}a{MARK * 2}b{MARK}"
        self.last = b"%d" % self.sp.eos_id()
        #: What each piece decodes to by itself; None where the library must be asked (bytes, unknown, control).
        odd = lambda i: self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_unused(i)
        self.plain = [None if odd(i) else p.replace(MARK, " ") for i, p in enumerate(pieces)]
        self.end, self.lone, self.letter = self.sp.eos_id(), self.sp.piece_to_id(MARK), self.sp.piece_to_id("a")

    def _segment(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """The words' ids in decimal, a space after each, and the text that their pieces decode to.

        The words are encoded in one go: an id begins a word where its piece starts with a marker and the piece before
        it ends without one. Words of markers only stand alone, as they have no such end."""
        # the library gives no ids for the empty text that a lone marker stands for
        found = {c: self._row(self.sp.encode(c[1:]) or [self.lone]) for c in chunks if not c.strip(MARK)}
        chunks = [c for c in chunks if c.strip(MARK)]
        if chunks:
            ids = self.sp.encode("".join(chunks).replace(MARK, " ")[1:])
            pieces = np.array(ids)
            heads = np.flatnonzero(self.starts[pieces] & np.concatenate([[True], self.stops[pieces[:-1]]])).tolist()
            if len(heads) != len(chunks):  # not one by one after all
                return found | {c: self._row(self.sp.encode(c[1:])) for c in chunks}
            for c, i, j in zip(chunks, heads, [*heads[1:], len(ids)], strict=True):
                found[c] = self._row(ids[i:j])
        return found

    def _row(self, ids: list[int]) -> tuple[bytes, str]:
        texts = [self.plain[i] for i in ids]
        return self._decimal(ids), self.sp.decode([self.letter, *ids])[1:] if None in texts else "".join(texts)

    def _decimal(self, ids: list[int]) -> bytes:
        return b"".join([self.digits[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def look_up(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """What the table has for each chunk, after the new ones were added."""
        known = self.known
        new = list({c for c in chunks if c not in known})
        if len(known) + len(new) > self.kept:
            known.clear()
            new = list(set(chunks))
        found = self._segment(new)
        known.update((c, x) for c, x in found.items() if len(c) <= KEPT_LENGTH)
        return [known.get(c) or found[c] for c in chunks]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.both(text)[0].split()))

    def both(self, text: str) -> tuple[bytes, str]:
        """(decimal ids joined by one space, end id last; decoded text)"""
        if not self.splits:
            ids = self.sp.encode(text)
            return "".join(f"{i} " for i in [*ids, self.end]).encode()[:-1], self.sp.decode([*ids, self.end])
        chunks, known = self.chunks(text), self.known
        try:
            at = [known[c] for c in chunks]
        except KeyError:
            at = self.look_up(chunks)
        # the library leaves out the marker that it put in front
        return b"".join([x[0] for x in at]) + self.last, "".join([x[1] for x in at])[1:]


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text; keep_ids adds the ids and the
    decoded text themselves."""
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_ids else []

    def encoded(batches):
        words = chunk_table(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, decoded = words.both(text.as_py() or "")
                row = ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                rows.append((*row, list(map(int, ids.split())), decoded) if keep_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * (3 + len(more))
            kinds = [pa.int64(), pa.string(), pa.string(), *(k for _, k in more)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(n for n, _ in more)])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
