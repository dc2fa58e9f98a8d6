"""Token ids of a public byte-level BPE vocabulary, inside Python workers."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable

import numpy as np

# Texts of printable ASCII and Latin letters without very long white space.  For
# these the ranks file gives the same ids several times faster; every other text
# goes through the `tokenizers` file itself, whose character classes count.
_OTHER = re.compile(r"[^\t\n\r -~\xa1-ɏ]|\s{1000}")


@functools.lru_cache(maxsize=4)
def _file(path: str):
    """The `tokenizers` file, loaded when the first text needs it."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@functools.lru_cache(maxsize=4)
def encoder(path: str, ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Function from a whole text to its ids (``add_special_tokens=False``).

    ``path`` is a `tokenizers` file.  ``ranks_path``, if given, names the same
    vocabulary as ranks.  The strings of special tokens are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def by_file(text: str) -> np.ndarray:
        return np.array(_file(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    if ranks_path is None:
        return by_file

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _OTHER.search(text):
            return by_file(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode
