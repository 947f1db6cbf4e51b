"""Single pre-tokens through a byte-level BPE model: much cheaper than the whole encoding pipeline for one short string."""

from __future__ import annotations

import os
import unicodedata


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Model:
    """A tokenizers file; ``ids`` of one pre-token, ``whole`` of any text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._letters, self._model = byte_letters(), self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._usual: set[str] = set()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, pre_token: str) -> list[int]:
        letters = pre_token
        if not (pre_token.isascii() and pre_token.isalnum()):  # those stand for themselves
            letters = pre_token.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(letters)]

    def usual(self, text: str) -> bool:
        """No special string, and only characters whose classes the regular-expression engines surely see alike."""
        for s in self.special:
            if s in text:
                return False
        if text.isascii():
            return True
        new = set(text) - self._usual
        if any(c == "Σ" or unicodedata.category(c) == "Cn" for c in new):
            return False
        self._usual |= new
        return True
