"""Token ids of whole texts inside a Spark task.

`Tokenizer.encode(text, add_special_tokens=False)` of the `tokenizers` library defines the ids.  Where the same
vocabulary also lies beside it as a rank file, texts of Latin letters without an added special token are encoded from
the ranks, which takes a quarter of the time; tests/llm/test_operators.py holds the two equal.  Texts with characters from
U+0250 on, whose Unicode classes may differ between the libraries' versions, and texts that hold the string of a special
token always go to `tokenizers`.
"""

from __future__ import annotations

import os
import re

import numpy as np

_BEYOND_LATIN = re.compile("[^\u0000-ɏ]")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a name with a directory part is taken as it is."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids() of whole texts, null as empty.  Build one per Python task: it holds the vocabulary, some 100 MB."""

    def __init__(self, name: str = "byte_bpe_50k.json", use_ranks: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        twin = os.path.splitext(path)[0] + ".tiktoken"
        self.ranks = _rank_encoding(twin) if use_ranks and os.path.exists(twin) else None
        self._widths: np.ndarray | None = None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.ranks is None or any(s in text for s in self.specials) or not text.isascii() and _BEYOND_LATIN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.ranks._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id of a byte-level vocabulary starts, and the length at the end."""
        if self._widths is None:
            self._widths = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in self.library.get_vocab().items():
                self._widths[i] = len(token.encode()) if token in self.specials else len(token)
        return np.concatenate([[0], np.cumsum(self._widths[ids])])


def _rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
