"""Token ids of whole texts by the tokenizers library, with a cache of encoded chunks.

A chunk is a stretch of text that no token crosses: where the vocabulary drops white
space, what stands between white space; for byte-level vocabularies, a word with the space
before it. Encoding chunks one by one gives the ids of the whole text. Chunks of plain Latin words
and punctuation go straight to the library's model, all others through all of its steps.
Texts with special tokens, or with the separators U+001C to U+001F, which Python and the
library class differently, go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct

from tokenizers import Tokenizer

#: Chunks kept by one worker; when full, the cache starts anew.
CACHE_CHUNKS = 700_000
#: Longer chunks are encoded, not kept.
CACHED_CHARS = 64

_BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Letters of one case folding and normal form, then punctuation that forms one piece.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def _spelled() -> list[str]:
    """For each byte the character that byte-level vocabularies write: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


_SPELLED = _spelled()


class ChunkEncoder(dict):
    """chunk -> its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int) -> None:
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        odd = [re.escape(t["content"]) for t in settings["added_tokens"]] + ["[\x1c-\x1f]"]
        self.odd = re.compile("|".join(odd)).search
        #: Characters to those that stand for their bytes in the vocabulary.
        letters = [chr(c) for c in range(0xC0, 0x100)] + [" "]
        self.bytes = {ord(c): "".join(_SPELLED[b] for b in c.encode()) for c in letters}
        self.drops_space = _drops_space(settings)
        if not self.drops_space and not _splits_like_words(settings):
            raise ValueError(f"{path}: neither drops white space nor splits text at words by bytes")

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, word: str) -> bytes:
        ids = [token.id for token in self.tokenizer.model.tokenize(word.translate(self.bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            ids = self._ids(chunk)
        elif plain[2] and plain[1].strip():
            ids = self[plain[1]] + self[plain[2]]
        elif self.drops_space and chunk != (low := chunk.lower()):
            ids = self[low]
        else:
            ids = self._plain(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; null is empty."""
        if not text:
            return b""
        if self.odd(text):
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.split() if self.drops_space else _BYTE_CHUNK.findall(text)))


def _drops_space(settings: dict) -> bool:
    parts = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = parts[0] if parts else {}
    return first.get("behavior") == "Removed" and first.get("invert", False)


def _splits_like_words(settings: dict) -> bool:
    p = settings["pre_tokenizer"] or {}
    plain = p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space")
    return plain and not settings["normalizer"]


def encoder(path: str, limit: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The encoder of this worker process for the vocabulary at ``path``."""
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, limit)
    return _ENCODERS[key]
