"""Token ids of whole texts through the tokenizers library, with a cache of chunks.

A byte-level BPE never merges across the places where its splitting pattern cuts, and that pattern
always cuts before a space which a non-space follows, around a line end between two non-spaces, and between letters and the signs behind
them. So a text is cut at those places, each distinct chunk is encoded once per Python worker while it is remembered, and a text's
ids are the concatenation. A text that
holds an added token of the vocabulary (such as ``<|endoftext|>``) is encoded whole: the library gives
that token its own id and splits the rest around it.
"""

from __future__ import annotations

import os
import re
import struct

from . import shared

#: Chunks that a worker remembers, about 200 bytes each: half of them in use, half from before, of which those that come up again are kept.
CACHE_CHUNKS = 1_200_000
_SPACES = re.compile(r" (?=\s|\Z)")
_RUNS = re.compile(r"\s\s|\s\Z")
_CUT = re.compile(r" (?=\S)")
#: Signs at a chunk's end, which the splitting pattern always parts from letters before them; an apostrophe may begin a part of its own.
_SIGNS_BEHIND = re.compile(r"[!-&(-/:-@\[-`{-~]+\Z")
_encoders: dict[str, "Encoder"] = {}


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _pack(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


def _byte_signs() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes that aren't printable; other bytes are written as themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + k for k, b in enumerate(others)}


_SIGNS = _byte_signs()
#: Letters below this code point are letters in every version of the tables that tell letters apart.
_LATIN_END = "\u0250"


class _Chunks(dict):
    """Ids of chunks; one that isn't there is taken from those of before, or encoded, when it is asked for."""

    def __init__(self, encode, before: dict | None = None):
        super().__init__({"": b""})
        self._encode, self._before = encode, before or {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self._before.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        self[chunk] = ids
        return ids

    def renewed(self) -> _Chunks:
        self._before = {}
        return _Chunks(self._encode, self)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for one token wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.led = _Chunks(self._chunk)
        #: Of a text's beginning, and of signs behind letters: what is no chunk behind a space.
        self.heads, self.tails = _Chunks(lambda x: self._raw([x])[0]), _Chunks(lambda x: self._raw([x])[0])
        space = self._raw([" "])[0]
        #: The sign that a space becomes inside the model; None if the file isn't byte-level.
        self.sign = next((x for x in ("\u0120",) if _pack([t.id for t in self.model.tokenize(x)]) == space), None)
        self.line_end = self._raw(["\n"])[0]

    def _raw(self, chunks: list[str]) -> list[bytes]:
        return [_pack(x.ids) for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _chunk(self, chunk: str) -> bytes:
        """A chunk behind a space, or behind a line end that it begins with. Latin letters are one part of the splitting pattern and go to the model at once."""
        if self.sign and chunk.isascii() and chunk.isalpha():  # the usual case
            return _pack([t.id for t in self.model.tokenize(self.sign + chunk)])
        behind = chunk[0] == "\n"
        body = chunk[1:] if behind else chunk
        signs = _SIGNS_BEHIND.search(body)
        stem = body[: signs.start()] if signs else body
        if not (self.sign and stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END)):
            return self.line_end + self._raw([body])[0] if behind else self._raw([" " + body])[0]
        if signs:
            tail = signs.group()
            return self.led[chunk[: len(chunk) - len(tail)]] + (self.tails[tail] if len(tail) < 9 else self._raw([tail])[0])
        written = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SIGNS)
        ids = _pack([t.id for t in self.model.tokenize(written if behind else self.sign + written)])
        return self.line_end + ids if behind else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if 2 * len(self.led) > CACHE_CHUNKS:
            self.led = self.led.renewed()
        for name in ("heads", "tails"):
            if len(getattr(self, name)) > 50_000:
                setattr(self, name, getattr(self, name).renewed())
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if whole:
            found = dict(zip(whole, self._raw([texts[k] for k in whole]), strict=True))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in found]))
            return [found[k] if k in found else next(rest) for k in range(len(texts))]
        get, out = self.led.__getitem__, []
        for t in texts:
            if not _RUNS.search(t):
                chunks = t.replace("\n", " \n").split(" ")
            else:
                chunks = _CUT.split(t) if _SPACES.search(t) else t.split(" ")
            head, chunks[0] = self.heads[chunks[0]], ""
            out.append(head + b"".join(map(get, chunks)))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; it and its cache outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches, path: str, end_id: int, at_once: int = 256):
    """(row values, ids as bytes with the end id) of Arrow batches whose last column is the text."""
    shared.own_worker("tokens", _encoders.clear)
    enc, end = encoder(path), int(end_id).to_bytes(4, "little")
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            part = batch.slice(i, at_once)
            texts = part.column(part.num_columns - 1).to_pylist()
            rows = zip(*(part.column(k).to_pylist() for k in range(part.num_columns - 1)), strict=True)
            for row, ids in zip(rows, enc.encode(texts), strict=True):
                yield row, ids + end
