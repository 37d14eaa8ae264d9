"""Byte-level BPE ids of a tokenizer file, fast and exactly as the tokenizers library gives them.

The file's vocabulary is also handed to tiktoken, whose merge loop is several
times faster. It takes over only texts made of characters on whose classes the
two pattern engines agree and without an added token's string; all other texts
go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Pattern of the ByteLevel pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏͰ-ͷΑ-ΡΣ-ҁ‐-‧₠-€ぁ-ゖ一-龥가-힣]")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked_by_id(model: dict) -> bool:
    """Whether ids rise with the order of merges, each forming a token of its own: what tiktoken takes for granted."""
    formed = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    whole = {i for t, i in model["vocab"].items() if len(t) > 1}
    return None not in formed and all(a < b for a, b in zip(formed, formed[1:])) and set(formed) == whole


class ByteBpe:
    """encode(text): numpy uint32 ids, without special tokens added."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocab, byte = spec["model"]["vocab"], _byte_of_char()
        self.top = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.fast = None
        known = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        if known and all(set(t) <= byte.keys() for t in vocab) and _ranked_by_id(spec["model"]):
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            probe = "It's 12 o'clock;\n\n  Müßte élan? 한국어 ¡señor!\tx  "
            if fast.encode_ordinary(probe) == self.slow.encode(probe, add_special_tokens=False).ids:
                self.fast = fast

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not _OTHER.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
