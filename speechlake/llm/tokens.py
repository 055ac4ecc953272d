"""Encoding whole texts with a public tokenizer inside tasks."""

from __future__ import annotations

import array
import functools
import os

import numpy as np
import pyarrow as pa

#: White space beside the ASCII kinds; a text that holds any is encoded in one piece.
ODD = "\x1c\x1d\x1e\x1f\x85\xa0                　"
#: ASCII letters and digits by byte.
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Pieces that are kept in each of two generations, and the longest of them.
MOST_KEPT, LONGEST_KEPT = 400_000, 40


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, from the tokenizers library.

    Neither kind of pre-tokenizer joins a character with white space after it, nor a letter or digit with a
    comma or full stop that ends a word; so a text's ids are those of the pieces between such places in turn.
    Arrow finds the distinct pieces of a batch; only those that were not seen lately are encoded. A text that
    holds one of the tokenizer's added tokens as written is encoded whole, as the library does it.
    `drops_space` tells that the tokenizer drops white space altogether.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.whole = (*ODD, *sorted(t.content for t in self.tok.get_added_tokens_decoder().values()))
        self.drops_space = len(self.tok.encode(" \n", add_special_tokens=False).ids) == 0
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _codes(self, pieces: list[str]) -> list[bytes]:
        if len(self.kept) > MOST_KEPT:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        missing = [p for p in pieces if p not in kept]
        new = [p for p in missing if p not in older]
        kept.update((p, older[p]) for p in missing if p in older)
        kept.update(zip(new, self._whole(new)))
        out = [kept[p] for p in pieces]
        for p in [p for p in new if len(p) > LONGEST_KEPT]:
            del kept[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in self.whole) for t in texts]
        encoded = [b"" if o else t.encode() for o, t in zip(odd, texts)]
        ends = np.cumsum([len(e) for e in encoded])
        starts = ends - [len(e) for e in encoded]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        last = np.append(space[1:], True)
        last[ends[ends > starts] - 1] = True
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (((data[1:] == 44) | (data[1:] == 46)) & last[1:] & ALNUM[data[:-1]])
        cut[starts[ends > starts]] = True
        at = np.flatnonzero(cut)
        if self.drops_space:
            data = np.where(space, np.uint8(32), data)
        offsets = np.append(at, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes = self._codes(found.dictionary.to_pylist())
        lengths = np.array([len(c) // 4 for c in codes], np.int64)
        flat = np.frombuffer(b"".join(codes), "<u4")
        piece = found.indices.to_numpy(zero_copy_only=False)
        n = lengths[piece] if len(piece) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[piece] - upto[:-1], n) + np.arange(upto[-1])] if len(piece) else flat
        first, after = upto[np.searchsorted(at, starts)], upto[np.searchsorted(at, ends)]
        return [self._whole([t])[0] if o else ids[i:j].tobytes() for o, t, i, j in zip(odd, texts, first.tolist(), after.tolist())]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def batches(texts: list, chars: int = 1_000_000):
    """(first, texts) in runs of about so many characters; null texts are empty."""
    run: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        run.append(t if isinstance(t, str) else "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run
