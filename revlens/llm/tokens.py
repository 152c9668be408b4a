"""Token ids of texts with a public byte-level BPE vocabulary.

``Encoder`` takes a vocabulary file of either public format: ``*.json`` is
read by the tokenizers library, ``*.tiktoken`` (the same vocabulary as ranks)
by tiktoken.  Both give the same ids; tiktoken needs about a quarter of the
CPU time, so it is the default (figures in the README, equality in the tests).
It runs out of stack in white space of a million characters, so texts with a
run of ``LONG_SPACE`` go to the JSON file beside it.  A special token's string
inside a text is that token's id, as the JSON file's added tokens say.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import public_tokenizers

#: The id that ends every document.
END_ID = 1
#: White space characters in a row that tiktoken is not given.
LONG_SPACE = 100_000


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Texts to ids; built once a task from the vocabulary file at ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._space = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self._ids = lambda text: own.encode(text, add_special_tokens=False).ids
            self.size = own.get_vocab_size()
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self._other = path.removesuffix(".tiktoken") + ".json"
            with open(self._other, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self._ids = lambda text: own.encode(text, allowed_special="all")
            self.size = own.n_vocab
            self._space = re.compile(r"\s{%d}" % LONG_SPACE)

    def document(self, text: str | None) -> np.ndarray:
        """The text's ids, then the end id, as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self._space and len(text) >= LONG_SPACE and self._space.search(text):
            return Encoder(self._other).document(text)
        ids = self._ids(text)
        ids.append(END_ID)
        return np.array(ids, "<u4")
