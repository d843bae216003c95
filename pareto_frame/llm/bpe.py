"""BPE as a streaming transducer with bounded lookahead, and its decoder.

From the merge list follows how far ahead of a place text can still change which
merges happen there (:func:`lookahead`). Within a word the transducer holds a window of
symbols: it merges the window, emits the tokens that end more than the lookahead before the
window's end, and goes on after them. So memory is bounded by the window, for words
of any length; words end where the vocabulary's splitting ends them, which closes the
window. Short words are looked up in a bounded table of words done before.

The decoder is a state machine from bytes to text that takes ids one at a time and
holds at most the bytes of one unfinished character.

Defined cases: a null or empty text has no ids and decodes to the empty string; texts of
any length are taken whole; repeated rows and repeated or null ``doc_id`` are coded row
by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered by one worker, and the longest that are.
CACHE_WORDS, CACHED_CHARS = 500_000, 48
#: Symbols that a window holds beyond the lookahead.
WINDOW = 256
SHIFT = 20
#: Rank of a pair that does not merge.
NONE = (1 << 60, -1)


def spelled_bytes() -> list[str]:
    """For each byte the character that byte-level vocabularies write: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """Symbols after a place that can decide about the merges that end at it.

    ``merges`` are (left, right, result) by falling priority. Whether ``left right`` merges can
    only be changed from the right by an earlier merge that takes ``right`` away, so by a
    merge (right, next) of higher priority, and by what decides about ``right`` and ``next``.
    The merges are visited by priority, so what a merge depends on is known when it comes.
    A token stays as it is unless a merge takes it as its left part.
    """
    ahead: dict[int, int] = {}  # after the end of a token, to know that it is formed
    taken: dict[int, int] = {}  # after the end of a token, to know if a merge so far takes it
    for left, right, result in merges:
        need = max(ahead.get(right, 0), taken.get(right, 0), ahead.get(left, 0) - lengths[right])
        ahead[result] = max(ahead.get(result, 0), need)
        taken[left] = max(taken.get(left, 0), lengths[right] + need)
    return max([0, *ahead.values(), *taken.values()])


class Bpe:
    """Encoder and decoder for a vocabulary file of words in lower case with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model = settings["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.end = end
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.spelled = spelled_bytes()
        self.inside = {b: vocab.get(c) for b, c in enumerate(self.spelled)}
        self.ending = {b: vocab.get(c + end) for b, c in enumerate(self.spelled)}
        triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b, c) in enumerate(triples):
            self.merges.setdefault(a << SHIFT | b, (rank, c))
        lengths = {i: max(1, len(t.removesuffix(end)) if end else len(t)) for t, i in vocab.items()}
        self.ahead = lookahead(triples, lengths)
        split = settings["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        specials = settings["added_tokens"]
        self.special = {t["content"]: t["id"] for t in specials}
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if specials else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.known: dict[str, tuple[bytes, int, bytes]] = {}

    # encoding

    def _merge(self, symbols: list[int]) -> list[int]:
        """All merges of one window, by priority, then from the left."""
        get = self.merges.get
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while True:
            best = min(ranks, default=NONE)
            if best is NONE:
                return symbols
            i = ranks.index(best)
            symbols[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] << SHIFT | best[1], NONE)
            if i < len(ranks):
                ranks[i] = get(best[1] << SHIFT | symbols[i + 1], NONE)

    def size_of(self, token: int) -> int:
        name = self.names[token]
        return len(name.removesuffix(self.end)) or 1

    def transduce(self, word: bytes) -> Iterator[int]:
        """The tokens of one word, each as soon as no later byte can change it."""
        window: list[int] = []
        last = len(word) - 1
        for i, byte in enumerate(word):
            window.append(self.ending[byte] if i == last else self.inside[byte])
            if len(window) < WINDOW + 2 * self.ahead and i < last:
                continue
            tokens = self._merge(list(window))
            if i == last:
                yield from tokens
                return
            stable, at = 0, 0
            for token in tokens:
                at += self.size_of(token)
                if at > len(window) - self.ahead:
                    break
                yield token
                stable = at
            window = window[stable:]

    def _word(self, word: str) -> tuple[bytes, int, bytes]:
        """Decimal ids, their number, and the decoded bytes of a word."""
        known = self.known.get(word)
        if known:
            return known
        ids = list(self.transduce(word.encode()))
        made = (" ".join(map(str, ids)).encode(), len(ids), b" ".join(self.pieces(ids)))
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = made
        return made

    def split(self, text: str) -> Iterator[tuple[str, bool]]:
        """The words of a text in normal form, and the special tokens in it (True)."""
        parts = self.around.split(text) if self.around and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield part, True
            else:
                for word in self.words.findall(normal(part)):
                    yield word, False

    def encode(self, text: str | None) -> Iterator[int]:
        for word, special in self.split(text or ""):
            if special:
                yield self.special[word]
            else:
                yield from self.transduce(word.encode())

    # decoding

    def pieces(self, ids: Iterable[int]) -> Iterator[bytes]:
        return (self.names[i].encode() for i in ids)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of the vocabulary's token strings, joined by a space, as the file (without a decoder) has it."""
        state, first = codecs.getincrementaldecoder("utf-8")("replace"), True
        for piece in self.pieces(ids):
            yield state.decode(piece if first else b" " + piece)
            first = False
        yield state.decode(b"", True)

    def plain(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text: bytes of the tokens, a space at the end of each word; a character comes out once it is whole."""
        state, byte_of = codecs.getincrementaldecoder("utf-8")("replace"), {c: b for b, c in enumerate(self.spelled)}
        for i in ids:
            name = self.names[i]
            if name in self.special:
                yield state.decode(name.encode())
                continue
            body = name.removesuffix(self.end)
            yield state.decode(bytes(byte_of[c] for c in body) + (b" " if body != name else b""))
        yield state.decode(b"", True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text, piece by piece."""
        ids_hash, text_hash, total = hashlib.sha256(), hashlib.sha256(), 0
        state = codecs.getincrementaldecoder("utf-8")("replace")
        held_ids: list[bytes] = []
        held_text: list[bytes] = []

        def flush(gap: bytes) -> None:
            ids_hash.update(b" ".join(held_ids) + gap)
            text_hash.update(state.decode(b" ".join(held_text) + gap).encode())
            held_ids.clear()
            held_text.clear()

        for word, special in self.split(text or ""):
            if held_ids and len(held_ids) >= 4096:
                flush(b" ")
            if special:
                made = (str(self.special[word]).encode(), 1, word.encode())
            else:
                made = self.known.get(word) or self._word(word)
            held_ids.append(made[0])
            held_text.append(made[2])
            total += made[1]
        flush(b"")
        text_hash.update(state.decode(b"", True).encode())
        return total, ids_hash.hexdigest(), text_hash.hexdigest()


def normal(text: str) -> str:
    """Normal form C, white space as one space, each character in lower case by itself."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_CODERS: dict[str, Bpe] = {}


def coder(path: str) -> Bpe:
    """The coder of this worker process for the vocabulary at ``path``."""
    if path not in _CODERS:
        _CODERS[path] = Bpe(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary).encode
        for batch in batches:
            ids = pa.array((list(encode(t.as_py())) for t in batch.column(1)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = coder(vocabulary).digest
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
