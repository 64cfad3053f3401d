"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Blocks of pieces are packed best-fit (longest first, each into the
fullest bin that holds it); bins that are nearly full are emitted, and so are those with less room than the shortest item left anywhere.
The others become items of the next round, dealt anew to as many blocks as their number asks for, so a block never holds much more than
``block`` items however badly they fit. Rounds end after one with a single block, or when one saves under a hundredth of
its bins. A piece's place is its offset in its bin plus the offsets of the bins that hold that bin.

Defined results: a null text counts as empty; an empty text has the end token alone; repeated rows are documents of their own;
a null ``doc_id`` is carried through; a very long text is many pieces; items of equal length go in the order of their ids; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of

CAPACITY = 4096
BLOCK = 4096
NEARLY_FULL = 0.995


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A comma or full stop that ends a word after a letter is a token run of its own.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)")


#: Marks that may end a word: they are a run of their own after letters. Not ' (contractions) and not < (special tokens).
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<")
#: Lower-case Latin-1 letters. The tokenizer takes such a run as it is, so it can go to the model directly, which costs a third.
_LATIN = re.compile(r"[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = str.maketrans(_byte_letters())


class WordTokens(dict):
    """Ids by word, for a tokenizer that lower-cases, drops white space and never joins tokens across it or from a letter
    to a mark; so words can be encoded one by one, without their case and their final stop, and kept.

    Two generations of at most ``most`` words are kept: what was used since the last turn survives it.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core and len(core) < len(word) and (core.isalpha() or _LATIN.fullmatch(core.decode())):
            return self[core] + self[word[len(core) :]]
        if not core or (core.isalpha() and core.islower()):
            ids = [t.id for t in self.model.tokenize(word.decode())]
        elif _LATIN.fullmatch(text := word.decode()):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_LETTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        raw = text.encode()
        # Special tokens are written with "<"; they count in their own case only.
        words = raw.split() if b"<" in raw else _STOP.sub(rb" \1", raw.lower()).split()
        return b"".join(map(self.__getitem__, words))


@cache
def kept_tokens(path: str) -> WordTokens:
    """One for each worker process: the next tasks of a reused worker go on with its words."""
    return WordTokens(path)


PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    path = path or default_tokenizer()
    width, end = 4 * capacity, np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_tokens(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text) + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names=names if with_ids else names[:-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(pieces, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: longest first, into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - free
        if free > need:
            insort(room, (free - need, b))
    return bins, offsets


def _again(level: int, capacity: int):
    """Packs one block of underfull bins; bins of later rounds are numbered apart from earlier ones."""

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable").reset_index(drop=True)
        bins, pdf["shift"] = best_fit(pdf["length"].to_numpy(), capacity)
        pdf["parent"] = (level << 56) + (int(pdf["block"].iloc[0]) << 24) + bins
        return pdf

    return pack_block


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    scratch = Scratch(pieces.sparkSession, "packing")
    with small_batches(pieces.sparkSession):
        pieces = scratch.save(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block))
    kinds = dict(pieces.dtypes)
    columns = list(pieces.columns)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, pdf["offset"] = best_fit(pdf["length"].to_numpy(), capacity)
        pdf["bin"] = (int(pdf["block"].iloc[0]) << 24) + bins
        return pdf

    deal = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", block int, offset bigint, bin bigint"
    placed = scratch.save(pieces.withColumn("block", deal(blocks, "doc_id", "piece", "ids_crc32")).groupBy("block").applyInPandas(first, schema), "placed")
    items = placed.groupBy("bin").agg(F.sum("length").alias("length"))
    levels = []
    while blocks > 1:
        under = scratch.save(items.where(F.col("length") < nearly_full * capacity), "under")
        least = under.agg(F.min("length")).first()[0]
        under = under.where(F.col("length") + F.lit(least or 0) <= capacity)
        before = under.count()
        if not before:
            break
        level = len(levels) + 1
        blocks = -(-before // block)
        again = under.withColumn("block", deal(blocks, "bin", F.lit(level)))
        moved = scratch.save(again.groupBy("block").applyInPandas(_again(level, capacity), "bin bigint, length bigint, block int, shift bigint, parent bigint"), f"level{level}")
        levels.append(moved.select("bin", "shift", "parent"))
        items = moved.groupBy("parent").agg(F.sum("length").alias("length")).withColumnRenamed("parent", "bin")
        if items.count() > 0.99 * before:
            break
    for moved in levels:
        placed = placed.join(moved, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("parent", "bin")).drop("shift", "parent")
    return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
