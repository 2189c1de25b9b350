"""Pre-tokens of a lower-casing BPE with word ends, and the vocabulary strings that are whole tokens."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from llm.shared import held, slices

#: Chunks and pre-tokens that a worker keeps, about.
CACHE = 400_000
#: Bytes of text that are cut at once.
SLICE = 2 << 20
#: Longer chunks are not kept.
LONGEST = 64


@cache
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def pattern(path: str) -> regex.Pattern:
    """The pre-token pattern that the tokenizer file names."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
    return regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))


@cache
def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that, alone, are one pre-token and encode as one token; with its id.

    This is the proof behind the shortcut: each string is put through the library once.
    """
    tokenizer, single = library(path), pattern(path)
    end = json.loads(tokenizer.model.__getstate__())["end_of_word_suffix"]
    texts = [s.removesuffix(end) for s in tokenizer.get_vocab(with_added_tokens=False) if s.endswith(end)]
    texts = [s for s in texts if s.isascii() and single.fullmatch(s) and s == s.lower()]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(texts, found, strict=True) if len(e.ids) == 1}


@cache
def plain_pattern(path: str) -> re.Pattern:
    """The same pattern for lower-case plain text."""
    kinds = {k: "".join(c for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile(pattern(path).pattern.replace(r"\p{L}", "a-z" + kinds["L"]).replace(r"\p{N}", "0-9" + kinds["N"]))


#: Characters beyond ASCII that lower-case and normalise one by one, alike in every Unicode version; no white space.
_LATIN = [chr(c) for c in range(0xA1, 0x17F) if c not in (0xAD, 0x130)]
_PLAIN = re.compile(r"[\x21-\x7E¡-¬®-įı-ž]+")
_PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-įı-ž]*")
#: White space to str.split, but not to the tokenizer.
_APART = regex.compile(r"[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """Stretches that encode independently of each other: a pre-token never spans white space."""
    return [text] if _APART.search(text) else text.split()


class Words(dict):
    """Ids of a chunk or pre-token, as little-endian 32-bit bytes.

    Plain texts are cut into pre-tokens at once, others into chunks, of which the plain ones are cut further.
    Pre-tokens that are whole tokens have their id from the proven table; the library merges only the
    rest, many at a time: every pre-token ends in exactly one token with a word end, which parts them again.
    Chunks with unusual characters or special strings go to the library as they are. A table of over
    ``CACHE`` entries, about 70 MB, starts anew from the proven ones.
    """

    def __init__(self, path: str):
        self.library, self.single, self.plain = library(path), pattern(path), plain_pattern(path)
        self.whole = {s: i.to_bytes(4, "little") for s, i in whole_tokens(path).items()}
        names = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for s, i in names.items() if s.endswith("</w>")]] = True
        self.update(self.whole)

    def cut(self, text: str) -> tuple[bool, list[str]]:
        """The parts of a text, and whether they are pre-tokens."""
        if "<|" in text or not _PLAIN_TEXT.fullmatch(text):
            return False, chunks(text)
        return True, self.plain.findall(text.lower())

    def meet(self, texts: list[list[str]]) -> None:
        """Learn the chunks of a batch that are not known yet."""
        parts = {}
        for chunk in set().union(*texts).difference(self):
            if len(chunk) > LONGEST or "<|" in chunk:
                continue
            if chunk.isascii() and chunk.isprintable() or _PLAIN.fullmatch(chunk):
                parts[chunk] = self.plain.findall(chunk.lower())
        self._merge({p for found in parts.values() for p in found})
        for chunk, found in parts.items():
            self[chunk] = b"".join(map(self.__getitem__, found))

    def _merge(self, pretokens: set[str], step: int = 4096) -> None:
        """Learn pre-tokens of plain characters."""
        new = [p for p in pretokens.difference(self) if len(p) <= LONGEST]
        for i in range(0, len(new), step):
            some = new[i:i + step]
            ids = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            packed = ids.tobytes()
            if len(at) != len(some):
                raise ValueError("a pre-token does not end in one word-end token")
            for p, a, b in zip(some, [0, *at], at):
                self[p] = packed[a:b]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def ids(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        """Slices of a batch with the ids of each text's parts."""
        for part in slices(batch, size=SLICE):
            if len(self) > CACHE:
                self.clear()
                self.update(self.whole)
            cut = [self.cut(t or "") for t in part.column("text").to_pylist()]
            self._merge(set().union(*(c for plain, c in cut if plain)))
            self.meet([c for plain, c in cut if not plain])
            yield part, [list(map(self.__getitem__, c)) for _, c in cut]


def words(path: str) -> Words:
    """The table of this worker process."""
    return held(("words", path), lambda: Words(path))
