"""Token counts of a BPE with word ends, by rank-synchronous merging of ragged arrays.

White space separates pre-tokens and is dropped, so the count of a text is the sum over its chunks
between white space. Every task keeps a table of distinct chunks. The pre-tokens of the chunks not
yet in the table are held as one ragged array of symbols; in every round each pre-token applies its
lowest-ranked pair, all pre-tokens at once, until none has a mergeable pair. The surviving symbols
are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, frugal, slices

#: White space as Unicode has it. str.split() has four controls more.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
NONE = np.iinfo(np.int64).max


class MergeTable:
    """Vocabulary and ranked merges of a tokenizers file."""

    def __init__(self, path: str):
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only a plain BPE with word ends is supported")
        whole = tokenizers.Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.end, self.vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        size = max(self.vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([self.vocab[x] for x in col], np.int64) for col in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        born = np.zeros(size, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1] + 1
        if not (np.arange(len(made)) + 1 > np.maximum(born[left], born[right])).all():
            raise ValueError("a merge comes before the symbols that it joins; ranks can't be applied in step")
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.size, self.key, self.rank, self.made = size, key[order], order.astype(np.int64), made[order]

    def pretokens(self, chunk: str) -> tuple[list[str], int]:
        """The pre-tokens of a chunk in the byte alphabet, and how many special tokens it holds."""
        parts, found = [chunk], 0
        if self.special and self.special.search(chunk):
            parts, found = self.special.split(chunk), len(self.special.findall(chunk))
        return [w for p in parts if p for w, _ in self.split(self.normalize(p))], found

    def many(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokens of all chunks, the chunk of each, and the special tokens of each chunk.

        Chunks that keep their length when they are normalised go through the library in one text, as white space parts
        them; their pre-tokens are told apart by offsets. The others go one by one.
        """
        words, owner, special = [], [], np.zeros(len(chunks), np.int64)
        rest = [i for i, c in enumerate(chunks) if not self.special or not self.special.search(c)]
        normal = self.normalize(" ".join([chunks[i] for i in rest])).split(" ")
        plain = [i for i, n in zip(rest, normal, strict=True) if len(n) == len(chunks[i])] if len(normal) == len(rest) else []
        if plain:
            kept = set(plain)
            found = self.split(" ".join([n for i, n in zip(rest, normal, strict=True) if i in kept]))
            words = [w for w, _ in found]
            ends = np.cumsum(np.fromiter((len(chunks[i]) + 1 for i in plain), np.int64, len(plain)))
            owner = np.array(plain, np.int64)[np.searchsorted(ends, np.fromiter((o[0] for _, o in found), np.int64, len(found)), "right")].tolist()
        for i in sorted(set(range(len(chunks))).difference(plain)):
            own, special[i] = self.pretokens(chunks[i])
            words += own
            owner += [i] * len(own)
        return words, np.array(owner, np.int64), special

    def symbols(self, word: str) -> list[int]:
        vocab = self.vocab
        return [vocab[c] for c in word[:-1]] + [vocab[word[-1] + self.end]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where it can't merge, and its place in the sorted table."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), at

    def count(self, words: list[list[int]]) -> np.ndarray:
        """Symbols that survive in each word."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        own = np.flatnonzero(out > 1)
        length = out[own]
        sym = np.fromiter((s for i in own for s in words[i]), np.int64, int(length.sum()))
        while len(own):
            start = np.cumsum(length) - length
            last = start + length - 1
            rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
            inner = np.ones(len(sym), bool)
            inner[last] = False
            inner = np.flatnonzero(inner)
            rank[inner], at[inner] = self.ranks(sym[inner], sym[inner + 1])
            best = np.minimum.reduceat(rank, start)
            apply = (rank == np.repeat(best, length)) & (rank != NONE)
            pos = np.flatnonzero(apply)
            if len(pos):  # of pairs that overlap, as in a run of one symbol, every second merges
                fresh = np.concatenate([[True], np.diff(pos) != 1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            sym[pos] = self.made[at[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            length = np.add.reduceat(keep.astype(np.int64), start)
            out[own] = length
            live = (best != NONE) & (length > 1)
            sym = sym[keep & np.repeat(live, np.diff(np.append(start, len(keep))))]
            own, length = own[live], length[live]
        return out


class CountTable:
    """Token counts of distinct chunks. It starts anew beyond most_chars."""

    def __init__(self, path: str, most_chars: int = 48 << 20):
        self.merges, self.most_chars = MergeTable(path), most_chars
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0

    def add(self, chunks) -> None:
        new = [c for c in chunks if c not in self.known]
        words, owner, total = self.merges.many(new)
        place: dict[str, int] = {}
        code = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        counts = self.merges.count([self.merges.symbols(w) for w in place])
        if len(words):
            total += np.bincount(owner, counts[code], len(new)).astype(np.int64)
        self.known.update(zip(new, total.tolist(), strict=True))
        self.chars += sum(map(len, new)) + 100 * len(new)

    def count(self, texts: list[str]) -> list[int]:
        split = [SPACE.split(t) if any(c in t for c in CONTROLS) else t.split() for t in texts]
        missing = set().union(*split) - self.known.keys()
        if missing:
            self.add(sorted(missing))
        return [sum(map(self.known.__getitem__, words)) for words in split]


@lru_cache(1)
def count_table(path: str) -> CountTable:
    """One table for each Python worker; tasks that a worker runs one after another share it."""
    return CountTable(path)


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = count_table(path)
    for whole in batches:
        for batch in slices(whole, ["text"]):
            if table.chars > table.most_chars:
                table.clear()
            n = pa.array(table.count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text.

    Reads doc_id and text; other columns have no effect. A null text counts as empty: 0 bytes and 0
    tokens. Repeated rows each give a row; a null doc_id stays null; an empty table gives no rows.
    tokenizer_path must be readable at every executor. There is no shuffle.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        lambda batches: frugal(count_batches(batches, tokenizer_path)), "doc_id long, n_bytes long, n_tokens long"
    )
