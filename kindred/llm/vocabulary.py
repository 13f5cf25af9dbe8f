"""How the two public byte-level vocabularies cut texts into words, and a bounded table of words seen."""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
import regex
from tokenizers import Tokenizer

# White space by the Unicode property, which the library's \s means. Python's own split also cuts at 0x1C-0x1F.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_BEYOND_LATIN = regex.compile("[^\\x00-\u024f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordVocabulary:
    """A vocabulary file whose words never hold white space: the normaliser and the split of its library.

    Chunks between white space are cut into words separately, so equal chunks have equal tokens.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special = regex.compile("|".join(f"({regex.escape(s)})" for s in self.specials)) if self.specials else None

    def normal(self, text: str) -> str:
        # Up to U+024F nothing composes, and lower case does not depend on the neighbours.
        return text.lower() if text.isascii() or not _BEYOND_LATIN.search(text) else self.tokenizer.normalizer.normalize_str(text)

    def segments(self, text: str) -> list[tuple[list[str], int | None]]:
        """Chunks up to each special string, with its id; the last segment has none."""
        out, start = [], 0
        if self.special and any(s in text for s in self.specials):
            for m in self.special.finditer(text):
                out.append((self._split(text[start:m.start()]), self.specials[m[0]]))
                start = m.end()
        out.append((self._split(text[start:] if start else text), None))
        return out

    def chunks(self, text: str) -> tuple[list[str], list[int]]:
        """All chunks of a text, and the ids of the special strings in it."""
        if "<" not in text:
            return self._split(text), []
        parts = self.segments(text)
        return [c for chunks, _ in parts for c in chunks], [s for _, s in parts if s is not None]

    def _split(self, text: str) -> list[str]:
        text = self.normal(text)
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, as the characters that stand for their bytes."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    """Loaded once per Python worker."""
    return WordVocabulary(path)


_tables: list[WordTable] = []
# Of the C library, where it has it: without it freed memory stays with the worker.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def forget(but: WordTable | None = None) -> None:
    """Empty the tables of this Python worker, all but one, and give memory that is free back to the system: it serves task after task."""
    for table in _tables:
        if table is not but:
            table.older = {}
            table.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable) -> Callable:
    """A function over the batches of a task that gives free memory back before and after, as the worker waits on beside stages that need no Python."""
    @wraps(run)
    def task(batches):
        forget()
        yield from run(batches)
        forget()
    return task


class WordTable(dict):
    """What `value` makes of a chunk, kept for chunks seen: two generations of at most `most` entries.

    When the newer one is full it becomes the older one, from which chunks come back when they are
    met again; what was not met for a whole generation is forgotten.
    """

    def __init__(self, value: Callable[[str], object], most: int = 200_000):
        super().__init__()
        self.value, self.most, self.older = value, most, {}
        _tables.append(self)

    def __missing__(self, chunk: str):
        found = self.older.get(chunk)
        if found is None:
            found = self.value(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


class ChunkTable(WordTable):
    """A table of chunks between white space whose values add up over the words of a chunk.

    A word before a punctuation mark is looked up as the word and the mark, so that it is worked out once.
    """

    def __missing__(self, chunk: str):
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha() and not _BEYOND_LATIN.search(chunk):
            found = self[chunk[:-1]] + self[chunk[-1]]
            if len(self) < self.most:
                self[chunk] = found
            return found
        return super().__missing__(chunk)
