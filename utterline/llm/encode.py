"""Whole-text encoding with a word-level tokenizer of the ``tokenizers`` library.

The tokenizer drops white space and never lets a token cross it, so a text's ids are the ids of its
blank-separated chunks, one after the other. Chunks repeat far more than texts do; each worker keeps a bounded
map from chunk to ids and asks the library only for those it lacks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

from .common import Generations

_BEYOND = re.compile("[^\x00-į]")
_TAIL = ".,!?;:%$#&*|"
_ENCODERS: dict[str, ChunkEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder(Generations):
    """``encode_many(texts)`` gives each text's ids as little-endian uint32 bytes.

    Valid for tokenizers that lower-case, drop white space and split letters from signs, as ``word_bpe_49k`` does.
    ``size`` bounds the bytes kept in each of two generations.
    """

    def __init__(self, path: str, size: int = 80 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(self._ids, ("utterline.llm.packing", "utterline.llm.token_store"), size)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in byte_letters().items()})

    def _ids(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.islower() and not _BEYOND.search(chunk):
                # a lower-case word without marks to compose is one pre-token: the library's model alone encodes it
                if not chunk.isascii():
                    chunk = chunk.encode().decode("latin-1").translate(self.letters)
                return array("I", [t.id for t in self.model.tokenize(chunk)]).tobytes()
        elif (base := chunk.rstrip(_TAIL)) != chunk and base.isalpha() and base.lower().isalpha():  # letters and signs are split before merging; a lower case that isn't all letters would join the signs
            return self[base] + self[chunk[len(base):]]
        return array("I", self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids).tobytes() if chunk else b""

    def chunks(self, text: str) -> list[str]:
        if "<|" not in text and not _BEYOND.search(text):  # lower-casing before equals lower-casing within
            text = text.lower()
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return text.split(" ")

    def encode_many(self, texts: Iterable[str]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, self.chunks(t))) for t in texts]


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
