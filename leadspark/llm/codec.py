"""The encoder of a public tokenizer, with a bounded memory of words, as tasks use it.

Applies to tokenizers that drop white space and never merge across it (their pre-tokenizer keeps only letters, digits and
runs of other signs): there, the ids of a text are the ids of its words one after the other. ``for_file`` checks this
property on a few texts, and the tests compare whole tables with the tokenizers library.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A letter run and a sign run, without the apostrophe (contractions) and without signs beyond ASCII: such words
# skip the normalizer, as their normal form is just their lower case.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
# What marks the end of a word in the vocabulary.
_END = "</w>"
# Words that a task remembers; the memory starts anew when it is full.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class WordCodec(dict):
    """Maps a word (UTF-8 bytes without ASCII white space) to its packed ids.

    New words are learnt together: the plain ones in one call of a byte-pair encoder whose ranks are the vocabulary's ids. The mark of a
    word's end is a byte there that plain words cannot hold, so a token with the mark tells where a word ends.
    """

    _MARK = "\x01"

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        byte_of = {letter: b for b, letter in byte_letters().items()}
        ranks, self.ends = {}, np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            letters = token.removesuffix(_END)
            if all(c in byte_of for c in letters):
                self.ends[i] = letters != token
                ranks[bytes(map(byte_of.__getitem__, letters)) + self._MARK.encode() * (letters != token)] = i
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        for text in ("In eaenat, the  ouat.\nÉté!! don't x1y22", "<|endoftext|> a<|startoftext|>b  ß", "Über-strasse#### internationalisation éèàç$$$ ..."):
            if self.encode(text.encode()) != self._full(text):
                raise ValueError(f"{path}: a text's ids are not those of its words")

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of these words, besides those known if there is room."""
        new = {w for w in words if w not in self}
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = set(words)
        plain = []
        for word in new:
            text = word.decode("utf-8", "replace")
            parts = _PLAIN.fullmatch(text)
            if parts:
                plain.append((word, parts[1].lower(), parts[2]))
            else:
                self[word] = self._full(text)
        if not plain:
            return
        pieces = list({p for _, *both in plain for p in both if p})
        ids = np.array(self.merges.encode_ordinary(f"{self._MARK} ".join(pieces) + self._MARK), np.int64)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        data, at, packed = ids.astype(self.kind).tobytes(), 0, {"": b""}
        for piece, stop in zip(pieces, stops, strict=True):
            packed[piece] = data[at:stop]
            at = stop
        for word, letters, signs in plain:
            self[word] = packed[letters] + packed[signs]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of whole texts (UTF-8). Arrow finds the distinct words; each is looked up once and its ids are taken by place."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        self.learn(words)
        packed = list(map(self.__getitem__, words))
        ids = np.frombuffer(b"".join(packed), self.kind)
        sizes = np.array([len(p) for p in packed], np.int64) // self.kind.itemsize
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stops = (ends[parts.offsets.to_numpy()] * self.kind.itemsize).tolist()
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a whole text or of a piece cut at white space."""
        words = text.split()
        self.learn(words)
        return b"".join(map(self.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, self.kind).tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def for_file(path: str) -> WordCodec:
    return WordCodec(path)
