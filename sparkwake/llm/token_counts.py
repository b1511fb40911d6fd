"""Exact token counts by dynamic programming over prefixes, for BPE vocabularies with word ends."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, giving_back, pieces, small_batches, worker_cache

#: Distinct words, in each of two generations, whose counts a worker remembers.
WORDS = 300_000
PAIRS = 500_000
PUNCTUATION = b".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes of a text, without encoding any prefix anew.

    Two neighbouring tokens can stand together if BPE leaves their joint text as these two; a sequence of
    tokens is BPE's own if all neighbours can. So the last token of a prefix is the one that ends there and
    can follow the last token of the prefix before it, and its count is that prefix's count plus one. For a word that
    ends, the last step is the same with the end mark on its token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = _byte_letters()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_bytes = [t["content"].encode() for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"], regex.V0)
        #: By last token: which strings can follow it as a token, going on or ending there; filled as needed.
        self.going: dict[str, dict[str, bool]] = {"": {}}
        self.ending: dict[str, dict[str, bool]] = {"": {}}
        self.known = 0

    def symbols(self, text: str) -> list[str]:
        """The single letters of a token; an end mark belongs to the last."""
        if text.endswith(self.end) and text != self.end:
            body = text.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(text)

    def fits(self, left: str, right: str) -> bool:
        """Whether right is a token that BPE leaves standing after the token left (or at the start, after "")."""
        if right not in self.vocab:
            return False
        if not left:
            return True
        parts = [*self.symbols(left), *self.symbols(right)]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [left, right]

    def _learn(self, table: dict[str, bool], left: str, token: str, end: str) -> bool:
        fit = table[token] = self.fits(left, token + end)
        self.known += 1
        return fit

    def forget(self) -> None:
        """Drop what is known of pairs, once it is much; only between words."""
        if self.known > PAIRS:
            self.going, self.ending, self.known = {"": {}}, {"": {}}, 0

    def _walk(self, piece: str, upto: int) -> tuple[list[str], list[int]]:
        """The last token and the token count of each prefix up to a length; the token is unique, so shorter ones go first."""
        follow, longest = self.going, self.longest
        last, counts, tables = [""], [0], [follow[""]]
        for i in range(1, upto + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                token = piece[j:i]
                fit = tables[j].get(token)
                if fit is None:
                    fit = self._learn(tables[j], last[j], token, "")
                if fit:
                    break
            else:
                raise ValueError(f"no encoding of {piece[:i]!r}")
            last.append(token)
            counts.append(counts[j] + 1)
            tables.append(follow.setdefault(token, {}))
        return last, counts

    def _close(self, piece: str, i: int, last: list[str], counts: list[int]) -> int:
        """The count of the prefix of length i as a word of its own."""
        for j in range(i - 1, max(-1, i - self.longest - 1), -1):
            table, token = self.ending.setdefault(last[j], {}), piece[j:i]
            fit = table.get(token)
            if fit is None:
                fit = self._learn(table, last[j], token, self.end)
            if fit:
                return counts[j] + 1
        raise ValueError(f"no encoding of {piece[:i]!r}")

    def prefix_counts(self, piece: str) -> list[int]:
        """Counts of each prefix of one pre-token's letters, each as a word of its own."""
        last, counts = self._walk(piece, len(piece))
        return [0] + [self._close(piece, i, last, counts) for i in range(1, len(piece) + 1)]

    def whole(self, piece: str) -> int:
        """The last of the prefix counts."""
        if piece + self.end in self.vocab:
            return 1
        last, counts = self._walk(piece, len(piece) - 1)
        return self._close(piece, len(piece), last, counts)

    def normalise(self, text: str) -> str:
        # letter by letter, so a final sigma stays a plain one
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def letters_of(self, piece: str) -> str:
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def count(self, word: bytes) -> int:
        """Tokens of a run without ASCII white space; special tokens inside are one each."""
        text = word.decode()
        if b"<|" in word and any(s in word for s in self.special_bytes):
            return len(self.special.findall(text)) + sum(self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if text.isascii() and text.isalpha():
            return self.whole(text.lower())
        return sum(self.whole(self.letters_of(p)) for p in self.pieces.findall(self.normalise(text)))


class _Counts(Remembered):
    def __init__(self, counter: PrefixCounter):
        super().__init__(self.count, WORDS)
        self.counter = counter

    def count(self, word: bytes) -> int:
        if b"<" in word:
            return self.counter.count(word)
        if word[-1] in PUNCTUATION and word[:-1].isalpha():
            # one more pre-token: what stands before it is counted once for all that may follow
            return self[word[:-1]] + self[word[-1:]]
        return self[low] if (low := word.lower()) != word else self.counter.count(word)


def _counts(path: str) -> _Counts:
    """One per worker process, kept from task to task."""
    return worker_cache(("token counts", path), lambda: _Counts(PrefixCounter(path)))


def word_prefixes(text: bytes, counts: dict[bytes, int]) -> np.ndarray:
    """Tokens of the text up to the end of each of its words (runs without ASCII white space)."""
    each = [np.fromiter(map(counts.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, pieces(text))]
    return np.cumsum(np.concatenate(each)) if each else np.zeros(0, np.int64)


def total(prefixes: Column) -> Column:
    """Tokens of a whole text, from its stored prefix counts."""
    return F.coalesce(F.try_element_at(prefixes, F.lit(-1)), F.lit(0)).cast("long")


def words_within(prefixes: Column, budget: int) -> Column:
    """How many whole words of a text fit a budget of tokens, from its stored prefix counts: no text is encoded again."""
    return F.when(total(prefixes) <= budget, F.size(prefixes)).otherwise(F.size(F.filter(prefixes, lambda n: n <= budget)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token counts of every prefix of whole texts that ends with a word.

    Words are independent under this kind of vocabulary, so a worker counts each distinct word once, by the
    recurrence over its prefixes, and a text's counts are a running sum over its words. They are stored, so that totals, limits and
    places to truncate at are look-ups: total(), words_within(). Nothing is shuffled.

    Null texts are empty: no bytes, no words. Very long texts are read in parts. Rows that repeat are counted each; other columns
    are ignored.

    Returns doc_id, n_bytes and prefixes (array<int>, one entry per word).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for batch in batches:
            sizes, kept = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                kept.append(word_prefixes(text or b"", counts))
                sizes.append(len(text or b""))
                counts.forget()
                counts.counter.forget()
            ends = np.cumsum([0, *map(len, kept)])
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), prefixes], ["doc_id", "n_bytes", "prefixes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        giving_back(run), f"doc_id {kind}, n_bytes long, prefixes array<int>"
    )
