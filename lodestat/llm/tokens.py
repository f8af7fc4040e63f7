"""Token ids of whole texts by the tokenizers library, with the ids of recurring stretches remembered."""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BREAK = re.compile(r"(?<=\S)(?=[ \n\t\r])")
SPACED = re.compile(r"\s[ \n]|\0")
PLAIN = (" ", "\n")
PAIRS = ("  ", " \n", "\n ", "\n\n", "\0")
RARE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in PLAIN)  # the other white space
JOINED = 4_000  # stretches encoded in one call
CLOSING = string.punctuation.replace("'", "")


def spaced(text: str) -> bool:
    """Whether SPACED is in the text; where spaces and line breaks are its only white space, seeking five strings says so."""
    return bool(SPACED.search(text)) if any(c in text for c in RARE) else any(pair in text for pair in PAIRS)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without adding special tokens.

    A text is cut where a space or line break follows something other than white space. The tokenizers used here cut there
    too before they merge anything, so the ids of a stretch (white space and what follows) do not depend on its neighbours
    and the ids of a text are those of its stretches in a row; so are those of closing marks after a letter (one below
    U+0130, which stays one letter in lower case), and only the stretch without its marks is kept. New stretches are encoded by the library, many in one call; two
    generations of at most `kept` stretches stay in memory, which changes the time and never the ids.

    Special-token strings in a text are ordinary text, or with `recognised` the special ids, as in the library's plain call;
    a text that has such a string is then encoded by the library as a whole.
    """

    def __init__(self, path: str, kept: int = 500_000, recognised: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special] if recognised else []
        self.kept, self.young, self.old = kept, {"": b""}, {}
        self.marks: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self.marks[marks] = self._one(marks)
        return ids

    def _recognised(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return self._one(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _learn(self, stretches: list[str]) -> None:
        old, young, closed, wanted = self.old, self.young, [], set()
        for s in stretches:
            if s in old:
                young[s] = old[s]
                continue
            bare = s.rstrip(CLOSING)
            if bare != s and bare[-1:].isalpha() and bare[-1] < "\u0130":
                closed.append((s, bare))
                s = bare
            wanted.add(s)
        joinable = []
        for s in wanted.difference(young):
            if s in old:
                young[s] = old[s]
            elif s[0] in " \n\t\r" and not s[-1].isspace():
                joinable.append(s)
            else:
                young[s] = self._one(s)
        for at in range(0, len(joinable), JOINED):
            part = joinable[at : at + JOINED]
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids) // 4)
            cuts = 4 * np.searchsorted(starts, np.cumsum(np.fromiter(map(len, part), np.int64, len(part))), "left")
            begin = 0
            for s, end in zip(part, cuts.tolist()):
                young[s] = ids[begin:end]
                begin = end
        for s, bare in closed:
            young[s] = young[bare] + self._marks(s[len(bare) :])

    def _ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches in a row, and where each one's begin, with the end of all; different stretches are looked up once."""
        coded, known = stretches.dictionary_encode(), self.young
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([s for s in different if s not in known])
        found = list(map(known.__getitem__, different))
        at, size = coded.indices.to_numpy(), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, sizes = (np.cumsum(size) - size)[at], size[at]
        ends = np.append(0, np.cumsum(sizes))
        return np.frombuffer(b"".join(found), "<u4")[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        out = []
        for at in range(0, len(texts), 256):
            if len(self.young) > self.kept:
                self.young, self.old = {"": b""}, self.young
            some = texts[at : at + 256]
            ids, plain, other = [b""] * len(some), [], []
            for k, text in enumerate(some):
                if text and any(s in text for s in self.special):
                    ids[k] = self._recognised(text)
                elif text:
                    (other if spaced(text) else plain).append(k)
            cut = pa.array([some[k] for k in plain], pa.large_string())
            for gap in PLAIN:
                cut = pc.replace_substring(cut, gap, "\0" + gap)
            cut = pc.split_pattern(cut, "\0")
            rest = [BREAK.split(some[k]) for k in other]
            flat, ends = self._ids(pa.concat_arrays([cut.flatten(), pa.array([s for stretches in rest for s in stretches], pa.large_string())]))
            counts = [*pc.list_value_length(cut).to_pylist(), *map(len, rest)]
            bounds = ends[np.cumsum([0, *counts])].tolist()
            for k, a, b in zip([*plain, *other], bounds, bounds[1:]):
                ids[k] = flat[a:b].tobytes()
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker, with the ids of the library's plain call."""
    return Encoder(path, recognised=True)
