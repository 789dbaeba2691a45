"""Byte-pair encoding with word ends, by numpy merge rounds over many words at once.

A text is normalised and cut into words in Python; each distinct word of a slice is merged
once. The symbols of all those words lie in one flat array. A round looks up every pair of
neighbours by binary search over the sorted pair keys and merges, in each word, the
leftmost-first occurrences of the word's lowest-ranked pair.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import col, in_arrow
from .textkit import slices, text_of

#: Encoded words that a task keeps; beyond it the memory is emptied, and words are merged again.
KEPT_WORDS = 100_000
NO_RANK = np.iinfo(np.int64).max
#: Fixed value: white space as the vocabulary's pattern engine has it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ids, merges and patterns of one tokenizer file (JSON)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        wide = 1 << 20
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([self.ids[a] * wide + self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        shown = byte_symbols()
        self.byte_ids = np.array([self.ids[shown[b]] for b in range(256)], np.int64)
        self.last_ids = np.array([self.ids[shown[b] + self.end] for b in range(256)], np.int64)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split.replace(r"\s", SPACE))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last_ids[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            inside = owner[:-1] == owner[1:]
            ranks = np.full(len(symbols), NO_RANK)
            ranks[:-1][inside] = self.rank(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            runs = np.diff(np.r_[starts, len(owner)])
            least = np.repeat(best, runs)
            open_ = least < NO_RANK
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, ranks, least = symbols[open_], owner[open_], ranks[open_], least[open_]
                if not len(symbols):
                    break
            chosen = alternate(ranks == least, symbols)
            symbols[chosen] = self.merged[ranks[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        cuts = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]
        return np.split(symbols[order], cuts)


def alternate(hit: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Positions to merge: of overlapping hits in a row (a a a), the first, third and so on."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    fresh = np.r_[True, np.diff(at) > 1]
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    return at[(at - first) % 2 == 0]


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(json.loads(spec))


def lowered(text: str) -> str:
    """Lower case of each character by itself: a final sigma has no form of its own."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Coder:
    """Encodes texts, keeping the words it has merged."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}

    def words(self, text: str) -> list:
        """The words of a text; the ids of added tokens stand among them as ints."""
        v = self.vocab
        cut = lambda part: v.word.findall(lowered(part if part.isascii() else unicodedata.normalize("NFC", part)))
        if v.special is None or not v.special.search(text):
            return cut(text)
        out, at = [], 0
        for m in v.special.finditer(text):
            out += cut(text[at : m.start()])
            out.append(v.added[m[0]])
            at = m.end()
        return out + cut(text[at:])

    def learn(self, lists: list[list]) -> None:
        fresh = {w for ws in lists for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
            fresh = {w for ws in lists for w in ws}
        whole = [w for w in fresh if isinstance(w, int)]
        fresh = sorted(w for w in fresh if not isinstance(w, int))
        ids = (self.vocab.merge([w.encode() for w in fresh]) if fresh else []) + [np.array([w]) for w in whole]
        for w, i in zip([*fresh, *whole], ids, strict=True):
            self.known[w] = (i.astype("<u4").tobytes(), decode(self.vocab, i))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        lists = [self.words(t) for t in texts]
        self.learn(lists)
        known, out = self.known, []
        for ws in lists:
            got = [known[w] for w in ws]
            out.append((b"".join([a for a, _ in got]), " ".join([b for _, b in got])))
        return out


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: this vocabulary names no decoder, so tokens are joined by spaces. A word's part of it is kept with its ids."""
    return " ".join(vocab.tokens[i] for i in ids.tolist())


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (array of int) and decoded.

    `path` is the tokenizer's JSON file on the driver; its text travels with the tasks by
    broadcast (a few MB, fixed). Null text is empty and has no ids; extra columns are
    ignored; repeated rows are encoded alike; no rows, no result.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def run(batches):
        vocab = vocabulary(spec.value)
        coder = Coder(vocab)
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                rows = []
                for key, (packed, text) in zip(ids.to_pylist(), coder.encode(text_of(texts)), strict=True):
                    numbers = np.frombuffer(packed, "<u4")
                    row = (key, len(numbers), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append((*row, numbers.astype(np.int32), text) if keep_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return in_arrow(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")), run, schema)
