"""Token ids of whole texts by a byte-level BPE vocabulary, with a bounded table of words met before in the worker."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Words kept in a worker's table before it starts anew.
KEPT_WORDS = 400_000
LONG_WORD = 64
#: Up to this letter both tokenizer libraries have been compared code point by code point (see the tests).
LAST_COMPARED = "ſ"


class ByteBpe:
    """Ids as the tokenizers library gives them (add_special_tokens=False, no truncation, no padding).

    A byte-level BPE cuts a text before every space that is followed by something other than white space, so each such word has its own ids.
    Words are encoded once and kept; texts with runs of spaces or special strings go to the library as a whole.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.quick = _ranked(ranks_path) if ranks_path else None
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        if self.quick is not None and (text.isascii() or max(text) <= LAST_COMPARED):
            return array("I", self.quick(text)).tobytes()
        return self.whole(text)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return b""
        if self.special is not None and self.special.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        if not words:
            return self.word(first)
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KEPT_WORDS:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    if not w or w[0].isspace():  # a run of white space: words are not apart here
                        return self.whole(text)
                    ids = known.get(w)
                    if ids is None:
                        ids = self.word(" " + w)
                        if len(w) <= LONG_WORD:
                            known[w] = ids
                    found[i] = ids
        return (self.word(first) if first else b"") + b"".join(found)


def _ranked(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def byte_bpe(path: str, ranks_path: str | None = None) -> ByteBpe:
    return ByteBpe(path, ranks_path)
