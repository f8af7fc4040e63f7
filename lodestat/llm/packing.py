"""Packing of token sequences by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import id_and_text, with_null_ids
from lodestat.llm.tokens import encoder


class BestFit:
    """At most `open_bins` sequences are open; a bitset over their free space gives the tightest that still fits.

    A full sequence closes at once. When one too many is open, the fullest closes first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins = 0, [[] for _ in range(capacity + 1)]  # bit f is set if bins[f] holds an open sequence
        self.count = self.made = 0

    def _take(self, free: int) -> int:
        bin_id = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece of `length`, and the offset in it."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(bin_id)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        return bin_id, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32`: each text's ids and `end_id`, cut into pieces of at most `capacity`.

    Only longer ones are cut: all pieces but the first hold `capacity` ids. A null text counts as empty: its end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for begin in range(0, len(batch), 256):  # the ids of a few texts are held at a time
                some = batch.iloc[begin : begin + 256]
                for doc_id, ids in zip(some["doc_id"].array, encode(some["text"].tolist())):
                    ids += end
                    at, piece, step = 0, 0, (len(ids) // 4 - 1) % capacity + 1
                    while 4 * at < len(ids):
                        rows.append((doc_id, piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])))
                        at, piece, step = at + step, piece + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_null_ids(id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1024) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: rows of a `length` of at most `capacity`, packed into few sequences.

    Pieces, without their tokens, are dealt over tasks by a hash and arrive in the order of another hash, so each task
    packs a mixture of lengths, the same one if it has to run again. Adaptive execution makes tasks of a set size, so that
    the sequences left unfilled at a task's end do not grow in share. Offsets within a sequence are gapless from 0.
    """
    columns = pieces.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bins = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            batch = batch[columns]
            batch["sequence_id"] = [task + b for b, _ in placed]
            batch["offset"] = [at for _, at in placed]
            yield batch

    dealt = pieces.repartition(F.xxhash64(*columns)).sortWithinPartitions(F.hash(*columns), *columns)
    return dealt.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = 1024) -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    Whole texts are encoded where they are read; only the pieces' numbers move. Repeated rows are packed each, null ids are
    kept, other columns are ignored, an empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity, open_bins)
