"""Token ids in files of directly addressable codes: any token is read without decoding its neighbours.

One file holds the ids of consecutive documents. Ids are split into chunks from their low bits up; level k holds the k-th
chunk of every id that has one, at a fixed width, and a bitmap that says which of them go on to level k + 1. The place of
an id's next chunk is the number of set bits before it, which a directory of running counts (one for each 512 bits) and
one partial count give. The widths are the ones that make this file smallest, by dynamic programming over the counts of
all its ids' bit lengths.

Layout, little-endian: `LSDC`, version, levels (unsigned 32-bit), documents, tokens (unsigned 64-bit), for each level its
width and number of chunks (unsigned 64-bit), document ids (signed 64-bit), document ends (unsigned 64-bit), then for each
level its chunks in 64-bit words that no chunk straddles and, but for the last level, bitmap words and the directory
(unsigned 64-bit).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.rows import NO_ID, id_and_text, with_null_ids
from lodestat.llm.tokens import encoder
from lodestat.operators.ordering import running_total
from lodestat.session import saved, scratch_path

MAGIC, VERSION = b"LSDC", 1
RANK_WORDS = 8  # bitmap words for each directory entry
READERS = 20_000  # tasks that read files back, at most
FILE_TOKENS = 2_000_000  # a file is closed at the first document end beyond this


def code_widths(lengths: np.ndarray, widest: int = 12) -> list[int]:
    """Chunk widths, low bits first, of least total size; `lengths[b]` is the number of ids of b bits. At most `widest` bits each."""
    top = max(1, int(np.flatnonzero(lengths)[-1]) if lengths.any() else 1)
    left = np.append(lengths[::-1].cumsum()[::-1], 0)  # ids of b bits or more
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for done in range(top - 1, -1, -1):
        count = int(left[done + 1]) if done else int(lengths.sum())
        options = []
        for width in range(1, min(widest, top - done) + 1):
            size = count * 64 / (64 // width)
            if done + width < top:
                size += count * (1 + 1 / RANK_WORDS) + best[done + width][0]
            options.append((size, [width, *best[done + width][1]]))
        best[done] = min(options)
    return best[0][1]


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """`values` in 64-bit words, as many to a word as fit whole."""
    per = 64 // width
    padded = np.zeros(-(-len(values) // per) * per, np.uint64)
    padded[: len(values)] = values
    out = np.zeros(len(padded) // per, np.uint64)
    for k in range(per):
        out |= padded[k::per] << np.uint64(k * width)
    return out


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of the documents' ids, in the order given."""
    rest = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint64)
    widths = code_widths(np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=33))
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64) if ids else np.zeros(0, np.uint64)
    body, levels, tokens = [], [], len(rest)
    for k, width in enumerate(widths):
        levels.append((width, len(rest)))
        body.append(packed(rest & np.uint64((1 << width) - 1), width))
        rest = rest >> np.uint64(width)
        if k + 1 < len(widths):
            more = rest > 0
            bitmap = np.zeros(-(-len(more) // 512) * 64, np.uint8)
            some = np.packbits(more, bitorder="little")
            bitmap[: len(some)] = some
            words = bitmap.view(np.uint64)
            counts = np.bitwise_count(words).reshape(-1, RANK_WORDS).sum(axis=1, dtype=np.uint64)
            body += [words, np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])]
            rest = rest[more]
    head = MAGIC + struct.pack("<IIQQ", VERSION, len(widths), len(doc_ids), tokens) + b"".join(struct.pack("<QQ", *level) for level in levels)
    names = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    return head + b"\0" * (-len(head) % 8) + names.tobytes() + ends.tobytes() + b"".join(x.tobytes() for x in body)


class TokenFile:
    """Random access to the ids of one file, from its bytes or a memory map of them."""

    def __init__(self, data):
        data = np.frombuffer(data, np.uint8)
        if data[:4].tobytes() != MAGIC:
            raise ValueError("not a token file")
        version, levels, docs, self.tokens = struct.unpack_from("<IIQQ", data, 4)
        if version != VERSION:
            raise ValueError(f"token file version {version}")
        shape = [struct.unpack_from("<QQ", data, 28 + 16 * k) for k in range(levels)]
        self._at = -(-(28 + 16 * levels) // 8) * 8
        self._data = data
        self.doc_ids = self._next(docs, np.int64)
        self.ends = self._next(docs, np.uint64).astype(np.int64)
        self.levels = []
        for k, (width, n) in enumerate(shape):
            chunks = self._next(-(-n // (64 // width)), np.uint64)
            last = k + 1 == levels
            words = None if last else self._next(-(-n // 512) * RANK_WORDS, np.uint64)
            self.levels.append((width, chunks, words, None if last else self._next(-(-n // 512) + 1, np.uint64)))

    def _next(self, n: int, kind: type) -> np.ndarray:
        begin, self._at = self._at, self._at + 8 * n
        return self._data[begin : self._at].view(kind)

    def token(self, i: int) -> int:
        """The i-th id of the file, from one chunk and one rank for each level it has."""
        value = shift = 0
        for width, chunks, words, ranks in self.levels:
            per = 64 // width
            value |= (int(chunks[i // per]) >> (i % per * width) & ((1 << width) - 1)) << shift
            shift += width
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                break
            block = i >> 9
            before = sum(int(w).bit_count() for w in words[block * RANK_WORDS : i >> 6])
            i = int(ranks[block]) + before + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def range(self, begin: int, end: int) -> np.ndarray:
        """The ids from `begin` to before `end`. The chunks of a range are a range on every level, so one rank places each."""
        value, here, shift = np.zeros(end - begin, np.uint32), None, 0
        for width, chunks, words, ranks in self.levels:
            per = np.uint64(64 // width)
            at = np.arange(begin, end, dtype=np.uint64)
            part = (chunks[(at // per).astype(np.int64)] >> (at % per * np.uint64(width))) & np.uint64((1 << width) - 1)
            part = (part << np.uint64(shift)).astype(np.uint32)
            if here is None:
                value = part
            else:
                value[here] |= part
            if words is None or begin == end:
                break
            shift += width
            some = words[begin >> 6 : (end + 63) >> 6]
            more = np.flatnonzero(np.unpackbits(some.view(np.uint8), bitorder="little")[begin & 63 : (begin & 63) + end - begin])
            here = more if here is None else here[more]
            begin = self._rank(begin, words, ranks)
            end = begin + len(more)
        return value

    def _rank(self, i: int, words: np.ndarray, ranks: np.ndarray) -> int:
        """Set bits before bit i."""
        block = i >> 9
        if i & 511 == 0:
            return int(ranks[block])
        before = int(np.bitwise_count(words[block * RANK_WORDS : i >> 6]).sum())
        return int(ranks[block]) + before + (int(words[i >> 6]) & ((1 << (i & 63)) - 1)).bit_count()

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _store(folder: str):
    """The file system of a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write `docs` to token files below `folder` in ascending id order; return the table of files `part, number, path, n_docs, n_tokens, base`.

    Rows are dealt by ranges of the id, with the text's hash as second key for ids that repeat, and sorted within a task;
    a task writes files of about `file_tokens` ids, so it holds no more than that and one document. Each file is written
    beside its name and then moved, and a task that runs again writes the same files. `base` is the number of ids in all
    files before. Null ids come first, a null text counts as empty (its end id alone), repeated rows are written each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        part, number = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def write() -> pd.DataFrame:
            path = f"{root}/part-{part:06d}-{number:04d}.dac"
            beside = f"{root}/_{part:06d}-{number:04d}-{uuid.uuid4().hex}"
            with store.open_output_stream(beside) as out:
                out.write(encode_file(names, ids))
            store.move(beside, path)
            return pd.DataFrame([(part, number, path, len(names), held)], columns=["part", "number", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                for doc_id, raw in zip(some["doc_id"].array, encode(some["text"].tolist())):
                    names.append(int(doc_id))
                    ids.append(np.frombuffer(raw + end, "<u4"))
                    held += len(ids[-1])
                    if held >= file_tokens:
                        yield write()
                        names, ids, held, number = [], [], 0, number + 1
        if names:
            yield write()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = id_and_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = saved(dealt.mapInPandas(run, "part int, number int, path string, n_docs long, n_tokens long"), "token_files")
    return running_total(files, {"base": "n_tokens"}, ["part", "number"]).withColumn("base", F.col("base") - F.col("n_tokens"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files.

    Files are dealt by their place in the order to a stated number of tasks, which adaptive execution leaves as it is: one for
    each file up to READERS, beyond that as many files a task as that takes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                with store.open_input_file(path) as source:
                    file = TokenFile(source.read())
                starts = np.concatenate([np.zeros(1, np.int64), file.ends[:-1]])
                # documents are checked in order; a stretch of the file is decoded at a time
                crcs, k = [], 0
                while k < len(file.ends):
                    last = max(k + 1, int(np.searchsorted(file.ends, starts[k] + 500_000, "right")))
                    values = file.range(int(starts[k]), int(file.ends[last - 1])).astype("<u4")
                    cuts = (np.append(starts[k:last], file.ends[last - 1]) - starts[k]).tolist()
                    crcs += [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])]
                    k = last
                yield pd.DataFrame({"doc_id": file.doc_ids, "start": base + starts, "n_tokens": file.ends - starts, "ids_crc32": np.array(crcs, np.int64)})

    tasks = max(1, min(files.count(), READERS))
    dealt = files.repartitionByRange(tasks, "part", "number")
    return with_null_ids(dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write `docs` to token files (below the shared folder unless `folder` is named) and return what the files hold, a row per document.

    An empty table gives no files and no rows. Other columns of `docs` are ignored.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    files = saved(write_token_files(docs, folder, tokenizer, end_id, id_col, text_col), "token_bases")
    return read_token_files(files, folder)
