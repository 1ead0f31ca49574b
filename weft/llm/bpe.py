"""Token ids of whole batches by the ``tokenizers`` library, each distinct word encoded once a worker.

The vocabulary drops white space, never merges across it, and never merges a letter with one of
``.,!?;:``, so the ids of a text are the ids of its runs one after another. Runs of letters alone go
straight to the library's BPE model; other runs of printable ASCII and Latin letters do so piece by piece, each
piece once a worker, and every other run goes through the library's whole encoder.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weft.llm.textarrays import letter_spans, strings, text_bytes

#: Distinct runs kept by a worker, of those that a batch has more than once; beyond it the cache starts anew.
CACHE_WORDS = 120_000

#: Distinct pieces of other runs kept by a worker.
CACHE_PIECES = 20_000

_loaded: dict[str, Words] = {}


class Words:
    """Ids of words, for one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # letters up to U+024F are single characters in either case, but for U+0130, and composed already
        self.letters = {c: self.bytes.pre_tokenize_str(chr(c).lower())[0][0] for c in range(0x250) if chr(c).isalpha() and c != 0x130}
        latin = "".join(map(chr, self.letters))
        self.printable = re.compile(f"[!-~{latin}]+")
        #: Where the vocabulary's own pattern cuts such a run in lower case.
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[0-9]|[^0-9{latin}]+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _encode(self, run: str) -> tuple[int, ...]:
        if run.isalpha():
            if run.isascii():
                return tuple([x.id for x in self.model.tokenize(run.lower())])
            if max(run) < "\u0250" and "\u0130" not in run:
                return tuple([x.id for x in self.model.tokenize(run.translate(self.letters))])
        elif self.printable.fullmatch(run) and "<|" not in run:
            return tuple(chain.from_iterable(map(self._piece, self.piece.findall(run.lower()))))
        return tuple(self.whole.encode(run, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            ids = self.pieces[piece] = tuple([x.id for x in self.model.tokenize(piece.translate(self.letters))])
        return ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch with ``end`` after each text, and where each text's ids start (and the last's end)."""
        raw, off = text_bytes(texts)
        special = b"<|" in raw.tobytes()  # special tokens are lower case in the text itself
        flat, before = strings(raw, *letter_spans(raw, off), lower=not special)
        coded = flat.dictionary_encode()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy()
        held = list(map(self.cache.get, distinct))
        often = (np.bincount(code, minlength=len(distinct)) > 1).tolist()
        encode, tokenize = self._encode, self.model.tokenize
        plain = pc.ascii_is_alpha(coded.dictionary).to_pylist()  # and in lower case
        for i in [i for i, ids in enumerate(held) if ids is None]:
            run = distinct[i]
            held[i] = ids = [x.id for x in tokenize(run)] if plain[i] and not special else encode(run)
            if often[i]:
                self.cache[run] = tuple(ids)
        size = np.fromiter(map(len, held), np.int32, len(held))
        pool = np.fromiter(chain.from_iterable(held), np.uint32, int(size.sum()))
        n = size[code]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        at = ends[before] + np.arange(len(before))
        out = np.empty(int(ends[-1]) + len(texts), np.uint32)
        last = np.zeros(len(out), bool)
        last[at[1:] - 1] = True
        out[last] = end
        first = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        out[~last] = pool[np.repeat((first[code] - ends[:-1]), n) + np.arange(ends[-1])]
        return out, at


def loaded(path: str) -> Words:
    """The tokenizer of a file, kept by the worker."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
