"""Byte-level BPE from a tokenizer file, through the tiktoken library.

Where the file's vocabulary ids rise along its merge list, as is checked, they are also the merge ranks,
so one rank table built from the JSON gives the ids that the ``tokenizers`` library gives (held to it in
tests/llm). Files that need more than that are refused. Tokenizers are never trained.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken

#: The pre-token pattern of byte-level BPE with ``use_regex``.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """Printable characters stand for themselves, the other bytes for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Ids of whole texts and lengths of single pre-tokens; special strings become their ids."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        vocabulary = spec["model"]["vocab"]
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the vocabulary's ids don't follow the merge list")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=self.special)
        self._piece = self._encoding._core_bpe.encode_single_piece
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)").split
        self.ranks = ranks

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)

    def piece_length(self, pre_token: str) -> int:
        raw = pre_token.encode()
        return 1 if raw in self.ranks else len(self._piece(raw))
