"""Exact token counts by prefix dynamic programming.

A byte-pair encoding without its last token is the encoding of the text without that token's characters. So the
encoding of every prefix follows from shorter ones: that of length i is that of length i - |t| followed by t, for
the one token t that ends at i and forms a stable pair with the last token there. The dynamic programme keeps, at
each prefix of a word, the number of tokens and the last token of a word that goes on (open), and the number of one
that ends there (closed, with the end-of-word mark). The closed counts of all prefixes are stored for each distinct
word; a text's count is the sum of its words' last entries, and the count of any prefix of a text the sum of the words
before plus one entry. So truncation at any character and budgets are answered from the table without encoding again.
Positions are those of the normalised text (NFC and lower case, as the tokenizer makes it).

A null text counts as empty: 0 tokens. Texts are never cut. Repeated rows give repeated rows; an empty table gives an
empty result. Only doc_id and text are read, so other columns may be called anything.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import pieces_of, table

LIMIT = 2048
#: Words a worker keeps counts of at a time; beyond it the table starts anew (the counts stay the same).
KEPT_WORDS = 400_000


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Token counts of a byte-level BPE with an end-of-word mark, read from a tokenizers .json file."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab = spec["model"]["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.mark = spec["model"]["end_of_word_suffix"]
        self.made: dict[str, tuple[str, str, int]] = {}
        for (a, b), i in self.ranks.items():
            self.made.setdefault(a + b, (a, b, i))
        #: Whether each token has one way to be merged, later than its parts: then stable() need not encode.
        self.single = len(self.made) == len(self.ranks) and all(i > self.made.get(x, ("", "", -1))[2] for a, b, i in self.made.values() for x in (a, b))
        #: Tokens of words that go on and that end there (without the mark); of each, which tokens before it are stable.
        self.opens: dict[str, dict[str, bool]] = {t: {} for t in self.vocab if not t.endswith(self.mark)}
        self.closes: dict[str, dict[str, bool]] = {t.removesuffix(self.mark): {} for t in self.vocab if t.endswith(self.mark) and t != self.mark}
        #: The longest token, open or closed, that ends with these two letters: none longer needs a look.
        self.longest: dict[str, int] = {}
        for t in {*self.opens, *self.closes}:
            if len(t) > self.longest.get(t[-2:], 1):
                self.longest[t[-2:]] = len(t)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split, regex.V1)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.gap, self.run = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1), regex.compile(r"[\S\x1c-\x1f]+", regex.V1)
        self.name = _byte_names()
        self.kept, self.counts, self.pairs, self.known = kept, {}, 0, {}
        self.held: tuple[str, list[int], list[str], list[int]] = ("", [0], [""], [])

    def bpe(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 40:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.mark) and len(token) > len(self.mark):
            token = token.removesuffix(self.mark)
            return [*token[:-1], token[-1] + self.mark]
        return list(token)

    def stable(self, known: dict[str, bool], a: str, b: str) -> bool:
        """Whether a then b is what their joint text encodes to (a may be empty: b alone); kept in known."""
        self.pairs += 1
        if self.pairs > 1_000_000:
            for kept in (*self.opens.values(), *self.closes.values()):
                kept.clear()
            self.pairs = 0
        known[a] = found = self._no_merge_across(a, b) if self.single and a else self.bpe(self._symbols(a) + self._symbols(b)) == ([a, b] if a else [b])
        return found

    def _no_merge_across(self, a: str, b: str) -> bool:
        """Goes back through the merges that made a and b, latest first. At each moment the parts that touch where
        they meet would merge if the rank of that comes before the merges that take either part up; of equal ranks
        the left one comes first."""
        none, never = ("", "", -1), 1 << 40
        takes_a = takes_b = never
        while True:
            rank = self.ranks.get((a, b), never)
            if rank < takes_a and rank <= takes_b and rank < never:
                return False
            made_a, made_b = self.made.get(a, none), self.made.get(b, none)
            if made_a[2] < 0 and made_b[2] < 0:
                return True
            if made_a[2] > made_b[2]:
                a, takes_a = made_a[1], made_a[2]
            else:
                b, takes_b = made_b[0], made_b[2]

    def table(self, word: str) -> tuple[list[int], list[int]]:
        """Token counts of each non-empty prefix of a word given in byte names: open, closed."""
        opens, closes, longest, stable, mark = self.opens.get, self.closes.get, self.longest.get, self.stable, self.mark
        # what was kept at the prefixes that the word before had too is the same here
        before, counts, last, closed = self.held
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        counts, last, closed = counts[: same + 1], last[: same + 1], closed[:same]
        for i in range(same + 1, len(word) + 1):
            goes = ends = 0
            far = longest(word[i - 2 : i], 1) if i > 1 else 1
            for j in range(i - far if i > far else 0, i):
                t, before = word[j:i], last[j]
                if not goes and (known := opens(t)) is not None:
                    good = known.get(before)
                    if good or (good is None and stable(known, before, t)):
                        goes, token = counts[j] + 1, t
                        if ends:
                            break
                if not ends and (known := closes(t)) is not None:
                    good = known.get(before)
                    if good or (good is None and stable(known, before, t + mark)):
                        ends = counts[j] + 1
                        if goes:
                            break
            if not goes or not ends:
                raise ValueError(f"no token ends {word[:i]!r}")
            counts.append(goes)
            last.append(token)
            closed.append(ends)
        self.held = word, counts, last, closed
        return counts[1:], closed

    def names(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(self.name[b] for b in word.encode())

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def look_up(self, runs: list[str]) -> list[int]:
        """Tokens of runs without white space; each distinct run is counted once and kept."""
        known = self.counts
        try:
            return [known[r] for r in runs]
        except KeyError:
            new = {r for r in runs if r not in known}
            if len(known) + len(new) > self.kept:
                known.clear()
                new = set(runs)
            split = {r: self.words.findall(r) for r in new}
            for w in sorted({w for words in split.values() for w in words if w not in self.known}):
                self.word(w)  # in order, so that words with one beginning follow each other
            for r, words in split.items():
                known[r] = sum([self.word(w)[-1] for w in words])
            return [known[r] for r in runs]

    def word(self, word: str) -> "bytes | list[int]":
        """The stored table: counts of word[:p] for p = 1..len(word), each as a word that ends there."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            counts = self.table(self.names(word))[1]
            if not word.isascii():  # an entry a character, not a byte
                counts = [counts[at - 1] for at in accumulate(len(c.encode()) for c in word)]
            found = self.known[word] = bytes(counts) if counts[-1] < 200 and max(counts) < 256 else counts
        return found

    def prefix_counts(self, word: str) -> list[int]:
        """Exact counts of encode(word[:p]) for p = 1..len(word), word being lower-case letters only."""
        return list(self.word(word))

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The normalised text in pieces, special strings (True) by themselves."""
        if "<|" not in text or not self.special.search(text):
            return [(self.normal(text), False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(self.normal(text[at : m.start()]), False), (m.group(), True)]
            at = m.end()
        return [*out, (self.normal(text[at:]), False)]

    def runs(self, text: str) -> list[int]:
        """Token counts of a text's white-space-free runs and special strings, in order."""
        return self.all_runs([text])[0]

    def all_runs(self, texts: list[str]) -> list[list[int]]:
        """The same of several texts, whose new words are counted together."""
        flat, ends, special = [], [], []
        for text in texts:
            for part, whole in self.parts(text):
                if whole:
                    special.append(len(flat))
                    flat.append("")  # one token, as no run is empty
                else:
                    flat += part.split() if _PLAIN.search(part) is None else [x for x in self.gap.split(part) if x]
            ends.append(len(flat))
        counts = self.look_up(flat)
        for k in special:
            counts[k] = 1
        return [counts[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def count(self, text: str) -> int:
        return sum(self.runs(text))

    def places(self, text: str):
        """(start, end, words or None for a special string) of each run, by the normalised text."""
        at = 0
        for part, special in self.parts(text):
            if special:
                yield at, at + len(part), None
            else:
                for m in self.run.finditer(part):
                    yield at + m.start(), at + m.end(), self.words.findall(m.group())
            at += len(part)

    def within(self, word: str, p: int) -> int:
        """Tokens of word[:p]. A contraction cut short is split anew: its quote mark is a word of its own."""
        return self.word(word)[p - 1] if word[0] != "'" or p == len(word) else sum(self.word(w)[-1] for w in self.words.findall(word[:p]))

    def prefix_count(self, text: str, p: int) -> int:
        """Tokens of the first p characters of the normalised text. A special string counts once it is whole; up to
        there it is text like other."""
        total, near = 0, []
        for start, end, words in self.places(text):
            if start >= p:
                break
            if end > p and words is None:  # what stands right before the broken string belongs to its first word
                whole = "".join(x for x, _ in self.parts(text))
                joined = [n for n in near if n[1] is not None]
                head = joined[-1] if joined and joined[-1][2] == start else None
                return (total - head[3] if head else total) + self.count(whole[head[0] if head else start : p])
            if words is None:
                here = 1
            else:
                here, at = 0, start
                for w in words:
                    if at + len(w) > p:
                        here += self.within(w, p - at) if p > at else 0
                        break
                    here += self.word(w)[-1]
                    at += len(w)
            total += here
            near = [(start, words, end, here)]
        return total

    def fitting(self, text: str, counts: list[int], budget: int) -> tuple[int, int]:
        """How many leading runs, and how many leading characters of the normalised text, fit into a budget of tokens,
        given the runs' counts. Special strings are not cut."""
        sums = list(accumulate(counts))
        whole = bisect_right(sums, budget)
        places = self.places(text)
        end = 0
        for _ in range(whole):
            end = next(places)[1]
        left = budget - (sums[whole - 1] if whole else 0)
        start, stop, words = next(places, (0, 0, None))
        if words is None:
            return whole, max(end, start)
        at = start
        for w in words:
            n = self.word(w)[-1]
            if n > left:
                fits = [p for p in range(1, len(w)) if self.within(w, p) <= left]
                return whole, at + (fits[-1] if fits else 0)
            left -= n
            at += len(w)
        return whole, at


#: Where str.split() does not see the gaps that the tokenizer sees.
_PLAIN = re.compile(r"[\x1c-\x1f]")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and from the stored tables how much stays within the limit: fit_runs
    leading white-space-free runs, and fit_chars leading characters of the normalised text (null: all)."""

    def counted(batches):
        c = counter(path)
        for batch in (part for whole in batches for part in pieces_of(whole, 1)):
            size, n, runs, chars = [], [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for text, counts in zip(texts, c.all_runs(texts), strict=True):
                size.append(len(text.encode()))
                n.append(sum(counts))
                fits = (len(counts), None) if n[-1] <= limit else c.fitting(text, counts, limit)
                runs.append(fits[0])
                chars.append(fits[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(runs, pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_runs", "fit_chars"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_runs long, fit_chars long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
