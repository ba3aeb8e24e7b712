"""Byte-level BPE ids of whole texts, one encoder for each Python worker.

The rank file and the JSON file of a vocabulary hold the same merges; ``tests/llm`` holds the ids of both equal. The rank
file's encoder is about four times as fast, so corpus passes use it.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCAB_JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def added_tokens(path: str = VOCAB_JSON) -> dict[str, int]:
    """Texts that the JSON file names as tokens of their own, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@lru_cache(maxsize=4)
def encoding(path: str = RANKS, json_path: str | None = None) -> tiktoken.Encoding:
    """The encoder of a rank file, with the added tokens of ``json_path`` where it is given."""
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens=added_tokens(json_path) if json_path else {})


@lru_cache(maxsize=4)
def bytes_of_id(path: str = RANKS) -> tuple[np.ndarray, list[bytes]]:
    """The length in bytes of each id, and its bytes."""
    enc = encoding(path)
    table = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
    return np.fromiter(map(len, table), np.int64, len(table)), table


def ids(text: str, path: str = RANKS) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; special tokens' strings are ordinary text."""
    return encoding(path).encode_to_numpy(text).astype("<u4", copy=False) if text else np.empty(0, "<u4")


def library_ids(text: str, path: str = RANKS, json_path: str = VOCAB_JSON) -> np.ndarray:
    """Ids as the library that reads the JSON file gives them without adding special tokens: the text of an added token is
    that token wherever it stands."""
    return encoding(path, json_path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False) if text else np.empty(0, "<u4")
