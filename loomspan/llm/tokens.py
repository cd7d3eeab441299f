"""Token ids by the installed tokenizer libraries; a vocabulary file is given by its path and read once in every process.

Byte-level BPE runs on tiktoken with the entries of the tokenizers file as ranks, several times faster than the tokenizers library
and with the same ids; what tiktoken can not do (strings of special tokens, endless white space) goes to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"

# Fixed value: the pattern that cuts a text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENDLESS = re.compile(r"\s{5000}")  # tiktoken's pattern engine runs out of stack in white space much longer than this


class ByteBpe:
    """Byte-level BPE; special says whether strings of special tokens inside a text are those tokens."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(added) if special else ()
        self.table = self._token_bytes()
        ranks = {b: i for i, b in enumerate(self.table) if b.decode("utf-8", "replace") not in added}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _token_bytes(self) -> list[bytes]:
        """What each id stands for: characters of an entry are numbers of bytes, printable ones as themselves."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(byte_of[c] for c in e) for e in entries]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        if any(s in text for s in self.special) or _ENDLESS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


class PieceBpe:
    """SentencePiece BPE; the library puts a blank before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


@cache
def byte_bpe(path: str, special: bool) -> ByteBpe:
    """The tokenizer of this process."""
    return ByteBpe(path, special)


@cache
def piece_bpe(path: str) -> PieceBpe:
    """The tokenizer of this process."""
    return PieceBpe(path)
