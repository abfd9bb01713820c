"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a model has a whitespace marker after another character, so no merge crosses the
start of a run of markers. A text is therefore the concatenation of independent chunks, each a run
of markers with the word behind it. Every task keeps a table of the distinct chunks met so far;
the library segments each of them once and the ids are joined back by position.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, frugal, slices

MARK = "▁"
#: What normalisers of such models change: ligatures, wide letters, marks, runs of blanks, blanks at the ends.
PROBE = " ﬁ Ａ e\u0301 ①  x\u3000y\t "
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Distinct marked chunks, their ids and what they decode to. It starts anew beyond most_chars."""

    def __init__(self, model_path: str, most_chars: int = 16 << 20):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if sp.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("this model normalises its input, so chunks of a text aren't those of the model")
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(len(pieces))]
        self.piece = {i: p.replace(MARK, " ") for i, p in enumerate(pieces) if plain[i]}
        self.anchor = sp.encode("a")
        self.shown = len(sp.decode(self.anchor))
        self.most_chars = most_chars
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.surface: list[str] = []
        self.flat = array("i")
        self.start = array("q", [0])
        self.chars = 0

    def decode(self, ids: list[int]) -> str:
        """What the ids of a chunk show behind others; bytes are left to the library."""
        try:
            return "".join(map(self.piece.__getitem__, ids))
        except KeyError:
            return self.sp.decode(self.anchor + ids)[self.shown :]

    def add(self, chunks: list[str]) -> None:
        """Segments chunks behind an anchor, whose ids come first whatever follows it."""
        skip = len(self.anchor)
        for chunk, ids in zip(chunks, self.sp.encode(["a" + c.replace(MARK, " ") for c in chunks], num_threads=1), strict=True):
            ids = ids[skip:]
            self.code[chunk] = len(self.surface)
            self.flat.extend(ids)
            self.start.append(len(self.flat))
            self.surface.append(self.decode(ids))
            self.chars += len(chunk) + 80

    def codes(self, texts: list[str]) -> list[list[int]]:
        """The codes of each text's chunks, in order."""
        chunks = [split(t) for t in texts]
        if new := set().union(*chunks) - self.code.keys():
            self.add(sorted(new))
        return [list(map(self.code.__getitem__, c)) for c in chunks]

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in order, and how many each has."""
        start, flat = np.array(self.start), np.array(self.flat)
        n = start[codes + 1] - start[codes]
        return flat[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


@lru_cache(1)
def chunk_table(model_path: str) -> ChunkTable:
    """One table for each Python worker; tasks that a worker runs one after another share it."""
    return ChunkTable(model_path)


def split(text: str) -> list[str]:
    """The chunks of a text, each with its markers."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if MARK + MARK in marked:
        return CHUNK.findall(marked)
    return marked.replace(MARK, " " + MARK).split(" ")[1:]


def encode_batches(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    table = chunk_table(model_path)
    for whole in batches:
        for batch in slices(whole, ["text"], 2 << 20):
            if table.chars > table.most_chars:
                table.clear()
            codes = table.codes(batch.column(1).to_pylist())
            words = np.fromiter(map(len, codes), np.int64, len(codes))
            flat, n = table.gather(np.fromiter(chain.from_iterable(codes), np.int64, int(words.sum())))
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(words)])]
            shown = ["".join(map(table.surface.__getitem__, cs)) for cs in codes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([s[1:] if s.startswith(" ") else s for s in shown], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every whole text, as the library gives them.

    Reads doc_id and text; other columns have no effect. A null text counts as empty: no ids, empty
    decoded text. Repeated rows each give a row; a null doc_id stays null; an empty table gives no rows.
    model_path must be readable at every executor. There is no shuffle.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        lambda batches: frugal(encode_batches(batches, model_path)), "doc_id long, ids array<int>, decoded string"
    )
