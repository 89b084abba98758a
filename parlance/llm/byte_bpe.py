"""Byte-level BPE ids of whole texts, as ``tokenizers`` gives them for one definition file.

``tiktoken`` finds the same ids several times faster from the same vocabulary (a pre-token's merges are ranked by
id; both know the same classes of characters).  What it can't do goes to ``tokenizers`` itself: a text
with a special token's string, where that isn't plain text, and a text with a run of white space so long that
tiktoken's stack can't hold it.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pre-tokenizer pattern of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = 50_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def read_definition(path: str | None = None) -> str:
    """The definition file's text; the driver reads it and sends it to the tasks (its size is the vocabulary's)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable bytes stand for themselves,
    the others follow one another from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, definition: str, special_is_text: bool = False):
        import tiktoken
        spec = json.loads(definition)
        self.special = [] if special_is_text else [t["content"] for t in spec.get("added_tokens", [])]
        added = {t["content"] for t in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.definition, self.special_is_text, self.whole = definition, special_is_text, None
        self.space = re.compile(r"\s{%d}" % LONG_SPACE)
        #: bytes of each id's token (a special token's string)
        self.tokens = [b""] * (max([*ranks.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        for t in spec.get("added_tokens", []):
            self.tokens[t["id"]] = t["content"].encode()

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or (len(text) >= LONG_SPACE and self.space.search(text)):
            return np.array(self._reference().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def _reference(self):
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_str(self.definition)
            self.whole.encode_special_tokens = self.special_is_text
        return self.whole
