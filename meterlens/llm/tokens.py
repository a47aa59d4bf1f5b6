"""Token ids by a public byte-level BPE of the tokenizers library, each distinct word encoded once.

The pre-tokenizer of such a vocabulary always starts a new piece at a space that
stands between two other characters, so a text may be cut there and its pieces
encoded one by one. It does so as well at a line break between two such characters and
at a comma or full stop that follows a letter or digit and stands before white space.
Most words of a corpus come again and again; a worker keeps the ids of those it has met,
and when there are too many, of those it has met twice. Texts with other white space next
to a space are encoded whole.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Words and characters that a worker remembers before it forgets the rare ones.
WORDS_KEPT, CHARS_KEPT = 600_000, 16_000_000
CHUNK_CHARS = 2_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Places(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


#: A comma or a full stop cut off the word before it.
_MARKS = frozenset(("\0,", "\0."))


def _marked(text: str, fine: bool) -> str:
    """A text that falls into words at spaces; one without a space before it begins with \\0. fine: line breaks, commas and full stops begin such words, whatever stands before these two."""
    if "\0" in text:
        return ""
    if fine:
        if "\n" in text and "\n\n" not in text and "\r" not in text:
            text = text.replace("\n", " \0\n")
        text = text.replace(", ", " \0, ").replace(". ", " \0. ")
    return "\0" + text


class Encoder:
    """ids of texts: ``add_special_tokens=False``, and special tokens' strings in a text are ordinary text."""

    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else vocabulary(name))
        self.tokenizer.encode_special_tokens = True
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.odd, self.mark, self.open_end = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)
        self.chars = 0

    def _forget_rare(self) -> None:
        """Keeps the words met twice since the last time, if they leave half of the room."""
        kept = np.flatnonzero(self.met > 1)
        names = list(self.place)
        names = [names[i] for i in kept.tolist()]
        chars = sum(map(len, names))
        if 2 * len(kept) > WORDS_KEPT or 2 * chars > CHARS_KEPT:
            self._forget()
            return
        self.place = _Places(zip(names, range(len(names))))
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[kept] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.starts, self.sizes, self.chars = ends - sizes, sizes, chars
        self.odd, self.mark, self.open_end, self.met = self.odd[kept], self.mark[kept], self.open_end[kept], np.zeros(len(kept), np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self) -> None:
        """Encodes the words met since the last call: many in one text, told apart by the ids that begin with a space."""
        new = list(islice(self.place, len(self.sizes), None))
        if not new:
            return
        n, base = len(new), len(self.ids)
        odd, starts, sizes, flat = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), [self.ids]
        plain = [i for i, w in enumerate(new) if w and not (w[0].isspace() or w[-1].isspace() or w[0] == "\0")]
        for k in range(0, len(plain), 5000):
            own = plain[k : k + 5000]
            ids = self._whole([" " + " ".join([new[i] for i in own])])[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(own):
                raise AssertionError("a word's ids must begin at a space")
            starts[own], sizes[own] = base + at, np.diff(at, append=len(ids))
            flat.append(ids)
            base += len(ids)
        rest = sorted(set(range(n)).difference(plain))
        first = [i for i in rest if new[i][:1] == "\0" and new[i][1:] and not new[i][-1].isspace()]
        odd[sorted(set(rest).difference(first))] = True
        for i, ids in zip(first, self._whole([new[i][1:] for i in first])):
            starts[i], sizes[i] = base, len(ids)
            flat.append(ids)
            base += len(ids)
        mark = np.fromiter((w in _MARKS for w in new), bool, n)
        open_end = np.fromiter((w[-1:].isalnum() and w[-1] < "\u0500" for w in new), bool, n)  # letters and digits since the first Unicode
        self.starts, self.sizes, self.ids = np.append(self.starts, starts), np.append(self.sizes, sizes), np.concatenate(flat)
        self.odd, self.mark, self.open_end, self.met = np.append(self.odd, odd), np.append(self.mark, mark), np.append(self.open_end, open_end), np.append(self.met, np.zeros(n, np.int64))
        self.chars += sum(map(len, new))

    def _chunk(self, texts: list[str], fine: bool = True) -> list[np.ndarray]:
        if len(self.place) > WORDS_KEPT or self.chars > CHARS_KEPT:
            self._forget_rare()
        lists = pc.split_pattern(pa.array([_marked(text, fine) for text in texts], pa.large_string()), " ")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        words = lists.flatten().dictionary_encode()
        index = np.fromiter(map(self.place.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy()]
        self._learn()
        self.met += np.bincount(index, minlength=len(self.met))
        per_word = self.sizes[index]
        into = np.cumsum(per_word)
        flat = self.ids[np.repeat(self.starts[index] - into + per_word, per_word) + np.arange(into[-1])]
        bounds = np.concatenate([[0], into[ends - 1]])
        out = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        odd = np.add.reduceat(self.odd[index], ends - sizes, dtype=np.int64) > 0
        if fine:
            wrong = self.mark[index]
            wrong[1:] &= ~self.open_end[index[:-1]]
            wrong[ends - sizes] = False  # a text may begin with a mark
            again = np.flatnonzero((np.add.reduceat(wrong, ends - sizes, dtype=np.int64) > 0) & ~odd)
            if len(again):
                for i, ids in zip(again, self._chunk([texts[i] for i in again], False)):
                    out[i] = ids
        for i, ids in zip(np.flatnonzero(odd), self._whole([texts[i] for i in np.flatnonzero(odd)])):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]):
        """Yields the ids of each text, in order; a null is the empty text."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text or "")
            chars += len(chunk[-1])
            if chars >= CHUNK_CHARS:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        if chunk:
            yield from self._chunk(chunk)


def encoder(name: str) -> Encoder:
    """This process's encoder, kept from task to task."""
    return kept(("encoder", name), lambda: Encoder(name))
