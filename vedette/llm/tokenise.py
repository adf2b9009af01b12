"""Token ids of a fixed public byte-level BPE vocabulary, loaded once in each worker."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Vocabulary file and, beside it, the same vocabulary as ranks.
DEFAULT = "byte_bpe_50k.json"


def vocabulary(name: str | None = None) -> str:
    """Path of a vocabulary file: a path as it is, else a name that the public_tokenizers package knows."""
    if name and os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name or DEFAULT)


@lru_cache(maxsize=2)
def _plain(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The same BPE over ranks, about four times as fast; None where there is no ranks file beside the vocabulary."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


#: Texts wholly of these characters go through the ranks: the two libraries' Unicode tables agree there.
_COMMON = re.compile("[\\x00-\\u024f]*\\Z")


class Encoder:
    """Ids as tokenizers' encode(text, add_special_tokens=False) gives them."""

    def __init__(self, name: str | None = None) -> None:
        self.path = vocabulary(name)
        self.n_ids = _plain(self.path).get_vocab_size()
        self.special = [t.content for t in _plain(self.path).get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ranked, out = _ranked(self.path), []
        for text in texts:
            if ranked is not None and _COMMON.match(text) and not any(s in text for s in self.special):
                out.append(ranked.encode_ordinary(text))
            else:
                out.append(_plain(self.path).encode(text, add_special_tokens=False).ids)
        return out
