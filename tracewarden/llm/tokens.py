"""Byte-pair token ids of whole texts."""

from __future__ import annotations

import base64

import numpy as np


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Token ids as a tokenizer file gives them, without special tokens.

    The same vocabulary exists as a list of ranked byte strings, which another library encodes several times faster. Both
    give the same ids as long as they agree on which characters are letters, digits and white space; that is certain (and
    tested character by character) for Latin-1, so other texts go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(ranks, "rb") as lines:
            vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
