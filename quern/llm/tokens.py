"""Byte-level BPE ids of whole texts.

The contract names the ids that ``tokenizers`` gives for
``byte_bpe_50k.json`` with ``add_special_tokens=False``; the vocabulary's file
of ranks holds the same vocabulary, and ``tiktoken`` gives the same ids from it
in a third of the time (tests compare both on ordinary, random, special and
very long texts).  As there, the string of the special token in a text is its
one id, and the texts before and after it are split on their own.

The pattern that splits texts looks ahead behind white space and would use up
its stack in a run of a million of such characters, so runs of ``RUN`` or more
are cut out first: a run is one piece but for its last character, which belongs
to what follows, and at the end of a text it is one piece as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The special token of the vocabulary. Fixed value.
SPECIAL = {"<|endoftext|>": 50256}
RUN = 20_000
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
_ENDS = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of a text as an array of 32-bit numbers; null counts as empty."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.special = SPECIAL if path.endswith(f"/{VOCABULARY}") else {}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text with special tokens or long runs of white space, in order."""
        for part in _ENDS.split(text) if self.special else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            for run in _RUNS.finditer(part):
                end = run.end() - (run.end() < len(part))
                yield self.model.encode_ordinary(part[at : run.start()])
                yield self.model._encode_single_piece(part[run.start() : end])
                at = end
            yield self.model.encode_ordinary(part[at:])

    def plain(self, text: str) -> bool:
        """Whether neither a special token nor a long run can be in the text."""
        return len(text) < RUN and "<|" not in text

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return len(self.model.encode_ordinary(text)) if self.plain(text) else sum(map(len, self.parts(text)))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.plain(text):
            return np.array(self.model.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(ids, "<u4") for ids in self.parts(text)])


_LOADED: dict[str, Ids] = {}


def ids_of(name: str = VOCABULARY) -> Ids:
    """The tokenizer of this worker; ``name`` is a file of the public vocabularies or a path."""
    if name not in _LOADED:
        _LOADED[name] = Ids(name if "/" in name else vocabulary(name))
    return _LOADED[name]
