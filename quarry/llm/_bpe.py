"""Byte-level BPE ids with the public tokenizer files.

``tokenizers`` defines the ids. The same vocabulary is also published as ranks for ``tiktoken``, which encodes three
times as fast; it is used for texts of Latin characters without special strings, where both give the same ids, and
all other texts go to ``tokenizers``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re

import numpy as np
import public_tokenizers

#: Beyond Latin letters the two libraries' character tables may differ.
_NOT_LATIN = re.compile("[^\x00-ɏ‐-‧]")


@functools.lru_cache(maxsize=4)
def _library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=2)
def _fast(name: str):
    """The same vocabulary as ranks, with a pattern of the special strings; None where there is none."""
    if name != "byte_bpe_50k.json":
        return None
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(name), "rb") as f:  # not by the library, which most workers then needn't load
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def version(name: str) -> str:
    """Digest of the tokenizer's file: counts of another file are never taken for this one's."""
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode(text: str | None, name: str) -> list[int]:
    """Ids of a whole text (null: empty), without added special tokens, truncation or padding."""
    text, fast = text or "", _fast(name)
    if fast and not _NOT_LATIN.search(text) and not any(s in text for s in fast[1]):
        return fast[0].encode_ordinary(text)
    if name.endswith(".model"):
        return _library(name).encode(text)
    return _library(name).encode(text, add_special_tokens=False).ids


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
