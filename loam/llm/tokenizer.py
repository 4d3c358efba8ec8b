"""A byte-pair tokenizer from a public vocabulary file, the same on the driver and in every task.

The driver reads the file and broadcasts its bytes (a vocabulary, so of fixed size); tasks need no such file.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the pattern has it, in runs on which its look-ahead would need too much stack.
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

_built: dict[int, Tokenizer] = {}


@dataclass
class Tokenizer:
    encoding: tiktoken.Encoding
    lengths: np.ndarray  # bytes of each token id
    end: int  # the first free id: end of text, and padding

    def encode(self, text: str) -> np.ndarray:
        """Token ids. Of a long run of white space all but what the next word takes is one piece of the pattern, and is merged as such."""
        found, at = [], 0
        for m in LONG_BLANKS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            found += [self.encoding.encode_ordinary(text[at : m.start()]), self.encoding._encode_single_piece(text[m.start() : stop])]
            at = stop
        found.append(self.encoding.encode_ordinary(text[at:] if at else text))
        return np.concatenate([np.array(x, dtype=np.int64) for x in found])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; a token that holds part of a character counts the whole one."""
        ids = self.encode(text)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[ids])
        return character[end - self.lengths[ids]], character[end - 1] + 1


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def build(content: bytes, pattern: str = PATTERN) -> Tokenizer:
    key = hash((content, pattern))
    if key not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _built[key] = Tokenizer(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths, len(lengths))
    return _built[key]
