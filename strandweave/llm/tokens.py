"""Byte-BPE token ids of whole texts."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from strandweave.llm import textscan

LONG_SPACE = 100_000  #: bytes of white space in a row that go through ``tokenizers``

#: White space other than ASCII's, and the bytes that its UTF-8 forms begin with.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WIDE_FIRST = np.zeros(256, dtype=bool)
_WIDE_FIRST[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE files write for each byte: itself if printable, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class TextEncoder:
    """Ids as the tokenizer gives them for whole texts.

    Texts go through the faster of two libraries over the same vocabulary.
    Those that hold a special token's text, other white space than ASCII's or
    more white space in a row than the faster one's pattern can take go
    through ``tokenizers``. Nothing is remembered between texts: where words
    are ever new, looking them up costs more than encoding them again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, self.added = file["model"]["vocab"], [t["content"] for t in file["added_tokens"]]
        self.path, self._whole = path, None
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in self.added}
        self.plain = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        """The ``tokenizers`` object, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _odd(self, column: pa.Array, texts: list[str | None]) -> set[int]:
        """The texts that ``tokenizers`` encodes."""
        raw, off = textscan.text_bytes(column)
        rare = np.unique(np.searchsorted(off, np.flatnonzero(_WIDE_FIRST[raw]), side="right") - 1)
        odd = {i for i in rare.tolist() if _WIDE_SPACE.search(texts[i])}
        for i in np.flatnonzero(np.diff(off) >= LONG_SPACE).tolist():
            solid = np.flatnonzero(~textscan.IS_SPACE[raw[off[i] : off[i + 1]]])
            if np.diff(solid, prepend=-1, append=off[i + 1] - off[i]).max() > LONG_SPACE:
                odd.add(i)
        return odd | {i for i, x in enumerate(texts) if x and any(t in x for t in self.added)}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each text's first id with the total at the end); null texts are empty."""
        texts = column.to_pylist()
        odd, plain = self._odd(column, texts), self.plain.encode_ordinary
        parts = [np.zeros(0, np.uint32)]
        for i, x in enumerate(texts):
            found = [] if not x else self.tokenizer.encode(x, add_special_tokens=False).ids if i in odd else plain(x)
            parts.append(np.fromiter(found, np.uint32, len(found)))
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])
