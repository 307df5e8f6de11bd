"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

The library spends most of its time on words it has met before. Here the texts of a
batch are cut at their white space, where the vocabulary's own pre-tokenizer cuts too,
and each different run between two cuts is looked up once. A new run is cut further,
into that pre-tokenizer's pieces; new pieces go to the library together, and their ids
are kept. Cutting is left to the library itself for every text with a character outside
a range where both cut alike, or with an added token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillscope.llm.workers import kept

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_DIGITS = "0-9²³¹¼-¾"
#: outside of these a text goes to the library whole
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")
# The pre-tokenizers' patterns as the two vocabulary files state them.
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_PIECES = {
    "bytes": re.compile(
        f"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\\s{_LETTERS}{_DIGITS}]+|\\s+(?!\\S)|\\s+"
    ),
    "words": re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+"),
}
#: white space that the pre-tokenizer cuts by what follows: three and more, or two at the end
_LONG_SPACE = re.compile(r"\s\s(?:\s|\Z)")
_SPACE = re.compile(r"\s+")
#: after a letter or digit, a run of these at the end of a word is a piece of its own
_MARKS = ",.;:!?"
#: the character by which a byte-level vocabulary writes each byte
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ODD = [x for x in range(256) if x not in _PLAIN]
_WRITTEN = {x: chr(256 + i) for i, x in enumerate(_ODD) if x != ord("\n")}
#: pieces a worker remembers, about 130 MB: half of them new or met lately
REMEMBERED = 600_000
#: new pieces go to the library joined, so many at a time; longer texts take it more time
_JOINED = 64
#: texts of so many bytes are encoded together; a longer one alone
ENCODED_BYTES = 1 << 22


class Tokens:
    """Ids as little-endian unsigned 16-bit numbers; both vocabularies have fewer."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary for pieces that are cut and written in its characters already
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer, self.pieces.pre_tokenizer = None, Split("\n", "removed")
        # marks such as <|endoftext|> inside a text get their own id, as the library has it
        self.marks = [mark.content for mark in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.kind = kind
        self.known: dict[str, bytes] = {}  # ids of the pieces met lately
        self.older: dict[str, bytes] = {}  # of those met before; they go first
        entries = self.tokenizer.get_vocab()
        self.size = np.zeros(max(entries.values()) + 1, np.int64)  # bytes a token stands for
        self.ends = np.zeros(len(self.size), bool)
        for token, at in entries.items():
            self.ends[at] = token.endswith("</w>")
            self.size[at] = len(token)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; none for a null or empty one."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a run that several of them share is looked up once."""
        cut = [self._cut(text) if text else "" for text in texts]
        runs = pc.split_pattern(pa.array([x or "" for x in cut], pa.string()), "\0")
        coded = runs.values.dictionary_encode()
        ids = self._run_ids(coded.dictionary).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32)[runs.offsets.to_numpy()].tolist() if texts else []
        data = memoryview(data or b"")
        return [
            self._library([text])[0] if x is None else data[begin:end].tobytes()
            for text, x, begin, end in zip(texts, cut, ends[:-1], ends[1:], strict=True)
        ]

    def _cut(self, text: str) -> str | None:
        """A text with zero characters, of which it has none, at white space that pieces never
        cross; None if the library is to cut it."""
        if _UNSAFE.search(text) or any(mark in text for mark in self.marks):
            return None
        if self.kind == "words":
            return _SPACE.sub("\0", text.lower())
        if _LONG_SPACE.search(text):
            return "\0".join(_PIECES[self.kind].findall(text))
        return text.replace(" ", "\0 ").replace("\n", "\0\n")  # belongs to what follows

    def _library(self, texts: list[str], tokenizer: Any = None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u2").tobytes() for x in found]

    def _run_ids(self, runs: pa.Array) -> pa.Array:
        """Ids of different runs; words with and without marks after them are looked up once."""
        stems = pc.utf8_rtrim(runs, characters=_MARKS)
        marked = pc.match_substring_regex(stems, f"[{_LETTERS}{_DIGITS}]$")
        stems = pc.if_else(marked, stems, runs)
        marks = pc.replace_substring_regex(runs, f"(?s)^.*[{_LETTERS}{_DIGITS}]", "")
        marks = pc.if_else(marked, marks, "")
        coded = pa.concat_arrays([stems, marks]).dictionary_encode()
        ids = pa.array(self._look_up(_strings(coded.dictionary)), pa.binary()).take(coded.indices)
        return pc.binary_join_element_wise(ids[: len(runs)], ids[len(runs) :], b"")

    def _look_up(self, runs: list[str]) -> list[bytes]:
        """Ids of different runs; only those of single pieces are kept."""
        known, older, cut = self.known, self.older, _PIECES[self.kind].findall
        found = list(map(known.get, runs))
        missing: list[tuple[int, tuple[str, ...]]] = []
        new: set[str] = set()
        for i, (run, ids) in enumerate(zip(runs, found, strict=True)):
            if ids is not None:
                continue
            if run in older:
                known[run] = found[i] = older[run]
            elif run[1:].isalpha() and (run[0] == " " or run[0].isalpha()):  # one piece
                new.add(run)
                missing.append((i, (run,)))
            else:
                pieces = tuple(cut(run))
                missing.append((i, pieces))
                for piece in pieces:
                    if piece in older:
                        known[piece] = older[piece]
                    elif piece not in known:
                        new.add(piece)
        self._ask(list(new))
        for i, pieces in missing:
            found[i] = b"".join([known[piece] for piece in pieces])
        if 2 * len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return found

    def _ask(self, new: list[str]) -> None:
        """Ids of pieces from the library."""
        # white space and marks, which a vocabulary may lack, go as they are
        letters = re.compile(r"\S|\s\S" if self.kind == "bytes" else f"[{_LETTERS}]+$")
        plain, other = [], []
        for piece in new:
            (plain if letters.match(piece) else other).append(piece)
        self.known.update(zip(other, self._library(other), strict=True))
        joined = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        texts = ["\n".join(part).encode().decode("latin-1").translate(_WRITTEN) for part in joined]
        for part, found in zip(joined, self._library(texts, self.pieces), strict=True):
            ids = np.frombuffer(found, "<u2")
            if self.kind == "bytes":
                sizes = np.cumsum([len(p.encode()) for p in part])
                stops = np.searchsorted(np.cumsum(self.size[ids]), sizes) + 1
            else:
                stops = np.flatnonzero(self.ends[ids]) + 1
            begin = 0
            for piece, stop in zip(part, (2 * stops).tolist(), strict=True):
                self.known[piece] = found[begin:stop]
                begin = stop


def _strings(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


def tokens(path: str, kind: str) -> Tokens:
    """One tokenizer per worker process, kept between its tasks with what it learned."""
    return kept(f"tokens {kind} {path}", lambda: Tokens(path, kind))


def text_parts(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a column of about ``most`` bytes with their texts; one long text is its own range.

    Only one range is held as Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes), column.slice(begin).to_pylist()
