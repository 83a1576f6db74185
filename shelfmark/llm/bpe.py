"""BPE encoding and decoding with a contiguous rank array.

A word of n symbols is a row of n part ids and n-1 adjacent ranks, both
contiguous. Each step scans the ranks for the minimum (the leftmost of equal
ones), deletes that boundary and refreshes the two neighbouring ranks. Words of
equal length form a matrix, so a step serves thousands of words at once: every
row that still has a merge loses exactly one boundary, so the matrix stays
rectangular. Only words longer than `SHORT` symbols take a heap instead.

Letters and numbers are what the library takes for such, since Python's Unicode
database may be older. Vocabularies are files of the `tokenizers` library, given by path and read on
the executors; nothing is trained and nothing is copied.

Defined results: null and empty texts have no tokens; repeated rows give
repeated rows; columns other than those named are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm._text import documents, slices

SHORT = 40
CACHE = 300_000
#: Bytes of text at a time: small, so that the words of a slice stay in the processor's cache.
SLICE = 256 << 10
_NONE = np.int64(1 << 40)


@lru_cache(1)
def library_classes() -> tuple[tuple[range, ...], tuple[range, ...]]:
    """The code points of \\p{L} and \\p{N} as the tokenizers library knows them: its Unicode tables are newer than Python's."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    spans = (pre_tokenizers.Split(Regex(p), "removed", invert=True).pre_tokenize_str(text) for p in (r"\p{L}+", r"\p{N}+"))
    return tuple(tuple(range(points[a], points[b - 1] + 1) for _, (a, b) in s) for s in spans)


@lru_cache(2)
def classes(most: int) -> tuple[str, str, str]:
    """Regex classes of letters, numbers and white space up to a code point."""
    show = lambda rs: "".join(f"\\U{r[0]:08x}-\\U{min(r[-1], most):08x}" for r in rs if r[0] <= most)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return *map(show, library_classes()), space


@lru_cache(2)
def unknown(most: int) -> re.Pattern:
    """Characters up to a code point that Python's Unicode database doesn't hold; how they compose and what their small forms are, the library alone may know.

    Inside the basic plane they compile to a table; beyond it, each character of a text is held against all their ranges.
    """
    new = [c for c in range(most + 1) if unicodedata.category(chr(c)) == "Cn"]
    edges = np.flatnonzero(np.diff(new, prepend=-2, append=most + 3) > 1)
    return re.compile("[" + "".join(f"\\U{new[a]:08x}-\\U{new[b - 1]:08x}" for a, b in zip(edges, edges[1:])) + "]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _narrow(text: str) -> bool:
    """Whether all characters are of the basic plane."""
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


class RankBpe:
    """Encoder and decoder of one vocabulary file; words in, id arrays out."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in alphabet], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        #: Classes inside the basic plane compile to a table; the full ones are slower and serve texts with other characters.
        self.words, self.wide = self._pattern(0xFFFF), self._pattern(sys.maxunicode)
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _pattern(self, most: int) -> re.Pattern:
        letter, number, space = classes(most)
        lead = "" if self.suffix else " ?"
        digits = f"[{number}]" if self.suffix else f"{lead}[{number}]+"
        tail = "" if self.suffix else f"|[{space}]+(?![^{space}])|[{space}]+"
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{lead}[{letter}]+|{digits}|{lead}[^{space}{letter}{number}]+{tail}")

    def split(self, text: str) -> list[str]:
        """Pre-tokens; special tokens of the vocabulary stand alone."""
        if self.cuts and "<|" in text:
            out = []
            for part in self.cuts.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.suffix:
            text = self._small(text)
        return (self.words if _narrow(text) else self.wide).findall(text)

    def _small(self, text: str) -> str:
        """NFC in small letters; texts with characters newer than Python's database go to the library's own normaliser."""
        if not text.isascii() and unknown(0xFFFF if _narrow(text) else sys.maxunicode).search(text):
            from tokenizers import normalizers

            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (a pre-token or a special token)."""
        out: list[np.ndarray | None] = [None] * len(words)
        by: dict[int, list[int]] = {}
        raw = []
        for i, w in enumerate(words):
            b = w.encode("utf-8", "surrogatepass")
            raw.append(b)
            if w in self.special:
                out[i] = np.array([self.special[w]], np.uint32)
            elif len(b) > SHORT:
                out[i] = self._long(b)
            else:
                by.setdefault(len(b), []).append(i)
        for n, at in by.items():
            if not n:
                for i in at:
                    out[i] = np.zeros(0, np.uint32)
                continue
            symbols = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(-1, n)
            for i, ids in zip(at, self._matrix(symbols), strict=True):
                out[i] = ids
        return out

    def _matrix(self, symbols: np.ndarray) -> list[np.ndarray]:
        count, n = symbols.shape
        parts = self.inner[symbols]
        parts[:, -1] = self.last[symbols[:, -1]]
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        rows = np.arange(count)
        out: list[np.ndarray] = [None] * count
        while len(rows):
            if n > 1:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), at]
                more = least < _NONE
            else:
                more = np.zeros(len(rows), bool)
            for r, ids in zip(rows[~more], parts[~more].astype(np.uint32)):
                out[r] = ids
            if not more.any():
                break
            rows, parts, ranks, at, least = rows[more], parts[more], ranks[more], at[more], least[more]
            k = np.arange(len(rows))
            parts[k, at] = self.made[least]
            column = np.arange(n - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            column = np.arange(max(n - 2, 0))
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            n -= 1
            left = at > 0
            ranks[k[left], at[left] - 1] = self._rank(parts[k[left], at[left] - 1], parts[k[left], at[left]])
            right = at < n - 1
            ranks[k[right], at[right]] = self._rank(parts[k[right], at[right]], parts[k[right], at[right] + 1])
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        parts = self.inner[np.frombuffer(raw, np.uint8)]
        parts[-1] = self.last[raw[-1]]
        parts = parts.tolist()
        pair = dict(zip(self.keys.tolist(), self.ranks.tolist())) if not hasattr(self, "_pairs") else self._pairs
        self._pairs = pair
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pair.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := pair.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, alive) if ok], np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Of a vocabulary without decoder: the tokens' strings, joined by spaces; special tokens are kept."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


class Encoder:
    """Whole texts to little-endian 32-bit ids, with the words met so far kept."""

    def __init__(self, path: str, decoded: bool = False):
        self.bpe = RankBpe(path)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.decoded = decoded

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.text.clear()
        words = [self.bpe.split(t) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.ids))
        for w, ids in zip(new, self.bpe.encode_words(new), strict=True):
            self.ids[w] = ids.astype("<u4").tobytes()
            if self.decoded:
                self.text[w] = self.bpe.decode(ids)
        for ws in words:
            yield b"".join(map(self.ids.__getitem__, ws)), " ".join(map(self.text.__getitem__, ws)) if self.decoded else ""


@lru_cache(4)
def encoder(path: str, decoded: bool = False) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path, decoded)


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary, decoded string) of every whole text; ids are little-endian unsigned 32-bit."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, True)
        for part in slices(batches, text_column, SLICE):
            got = list(e.batch(part.column(text_column).to_pylist()))
            yield pa.record_batch([part.column(id_column), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], [id_column, "ids", "decoded"])

    return documents(df, id_column, text_column).mapInArrow(run, f"{id_column} {kind}, ids binary, decoded string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """The contract of op10: doc_id, n_tokens, ids_sha256, decoded_sha256. Digests are taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, True)
        for part in slices(batches, most=SLICE):
            n, a, b = [], [], []
            for ids, text in e.batch(part.column("text").to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
