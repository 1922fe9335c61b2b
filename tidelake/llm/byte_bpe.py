"""Byte-level BPE ids of whole texts by a local rank file, and the bytes of ids."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of more characters are encoded in parts of about so many.
PART = 1 << 18
#: Runs of white space from so many characters on are encoded on their own: the pattern's look-ahead takes stack for each.
LONG_RUN = 1 << 14
#: White space as the pattern's `\s` means it (the Unicode property, not Python's str.isspace).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WS}]{{{LONG_RUN},}}")
_BOUNDARY = re.compile(rf"(?<=[^{_WS}])(?=[{_WS}])|(?<=[{_WS}])(?=[{_WS}][^{_WS}])|(?<=[A-Za-z])(?=[!-@\[-`{{-~])|(?<=[0-9])(?=[!-/:-~])")


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in parts whose matches of the pattern are, one after another, those of the whole text; True marks a
    part that is a single match.

    No match goes on from a character that is not white space to one that is, from an ASCII letter to ASCII digits
    or marks, nor from an ASCII digit to another ASCII character that is none; and the last of several white-space characters
    before a word starts a match, whatever comes before. Only such places are cut, the first one after `size` characters.
    """
    if len(text) <= min(size, LONG_RUN):
        yield text, False
        return
    at = 0

    def cut(to: int) -> Iterator[tuple[str, bool]]:
        nonlocal at
        while at < to:
            found = _BOUNDARY.search(text, at + max(size, 1), to) if to - at > size else None
            end = found.start() if found else to
            yield text[at:end], False
            at = end

    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from cut(run.start())
        yield text[at:end], True
        at = end
    yield from cut(len(text))


@lru_cache(maxsize=4)
def _encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Takes a whole string as a single match.
ALL = r"(?s:.+)"


def encode_text(text: str, rank_path: str, pattern: str, size: int = PART) -> np.ndarray:
    """The ids of one whole text; marks of special tokens in it are ordinary text."""
    done = [np.array(_encoding(rank_path, ALL if single else pattern).encode_ordinary(part), np.int32) for part, single in parts(text, size)]
    return done[0] if len(done) == 1 else np.concatenate(done)


def encoder(rank_path: str, pattern: str, size: int = PART) -> Callable[[Column | str], Column]:
    """A function from a column of texts to one of ids, array<int>; a null or empty text has none.

    `rank_path` must be readable where tasks run. Rows do not move and do not depend on each other, so repeated rows
    have the same ids; a task holds an Arrow batch and one text's ids, however long the text.
    """

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            ids = [encode_text(t.as_py() or "", rank_path, pattern, size) for t in texts]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))

    return lambda text: encode(F.col(text) if isinstance(text, str) else text)


def decoder(rank_path: str, pattern: str) -> Callable[[Column | str], Column]:
    """A function from a column of ids to the raw bytes that they stand for, which need not be whole characters.

    Null gives null, no ids give no bytes, and an id that is null or not in the rank file raises an error.
    """

    @F.arrow_udf("binary")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in columns:
            yield pa.array([_encoding(rank_path, pattern).decode_bytes(x.as_py()) if x.is_valid else None for x in ids], pa.binary())

    return lambda ids: decode(F.col(ids) if isinstance(ids, str) else ids)
