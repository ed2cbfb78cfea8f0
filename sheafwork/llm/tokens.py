"""Texts to token ids with a public tokenizer, word by word.

White space separates what the tokenizer looks at, so a text's ids are those of its words one after the other; every
distinct word is encoded once per worker and remembered, up to a bound.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from sheafwork.llm.words import Ragged, WordIndex, Words, words_of

#: Fixed value: the pre-tokenizer pattern of tokenizers for which ``PLAIN`` words may pass the normalizer by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Plain words are a run of Latin-1 letters and perhaps one of ASCII marks other than the apostrophe: composed already, lower-cased
#: letter by letter, two pre-tokens. A letter beyond ASCII is 0xC3 and one more byte; not those of the signs of multiplication and division.
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
WORDS_AT_ONCE = 1000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by the tokenizer file ``path`` (the tokenizers library's JSON format).

    The file's pre-tokenizer must drop or split at white space, as word-level vocabularies do. Special tokens' strings
    inside a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Ragged()
        self.numbers = WordIndex(self._learn, self.known.keep, most=400_000, places=True)
        self._prepare(json.loads(self.tokenizer.to_str()))

    def _prepare(self, made: dict) -> None:
        """Where the normalizer leaves plain words alone but for case, the model reads them without it, many at a time."""
        from tokenizers import Tokenizer, pre_tokenizers

        steps = [step["type"] for step in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                      and cuts[0]["pattern"] == {"Regex": PATTERN} and made["model"]["end_of_word_suffix"] == "</w>")
        self.letters = _byte_letters() | {32: " "}
        self.marks: dict[bytes, list[int]] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: Words, at: np.ndarray) -> None:
        """The ids of the words at these places, plain ones many at a time and without a string of their own."""
        starts, sizes = words.starts[at], words.lengths[at]
        ends = np.cumsum(sizes)
        first = ends - sizes
        data = words.data[np.repeat(starts - first, sizes) + np.arange(int(ends[-1]))]
        second = np.zeros(len(data), dtype=bool)
        second[1:] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
        second[first] = False
        lead = np.append(second[1:], False)
        letter, mark = _LETTER[data] | second | lead, _MARK[data]
        back = np.zeros(len(data), dtype=bool)  # a letter behind a mark
        back[1:] = mark[:-1] & letter[1:]
        back[first] = False
        n_letters, n_marks, wrong = (np.add.reduceat(x.astype(np.int64), first) for x in (letter, mark, back))
        plain = (n_letters > 0) & (n_letters + n_marks == sizes) & (wrong == 0) & self.plain

        lengths = np.zeros(len(at), dtype=np.int64)
        lists: dict[int, list[int]] = {i: self._whole(words.word(at[i]).decode()) for i in np.flatnonzero(~plain).tolist()}
        ids, of_word = self._plain_ids(data[letter & np.repeat(plain, sizes)], second[letter & np.repeat(plain, sizes)], n_letters[plain])
        lengths[plain] = of_word
        marked = np.flatnonzero(plain & (n_marks > 0)).tolist()
        suffix = {i: data[first[i] + n_letters[i]:ends[i]].tobytes() for i in marked}
        for mark_of in set(suffix.values()) - self.marks.keys():
            self.marks[mark_of] = self._whole(mark_of.decode())
        own = lengths.copy()
        for i in marked:
            lengths[i] += len(self.marks[suffix[i]])
        for i, found in lists.items():
            lengths[i] = len(found)
        begin = np.cumsum(lengths) - lengths
        values = np.empty(int(lengths.sum()), dtype=np.int32)
        values[np.repeat(begin[plain] - (np.cumsum(of_word) - of_word), of_word) + np.arange(len(ids))] = ids
        for i in marked:
            values[begin[i] + own[i]:begin[i] + lengths[i]] = self.marks[suffix[i]]
        for i, found in lists.items():
            values[begin[i]:begin[i] + lengths[i]] = found
        self.known.add_flat(values, lengths)
        if len(self.marks) > 10_000:
            self.marks = {}

    def _plain_ids(self, data: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, given as their bytes one after the other, and how many each has."""
        if not len(sizes):
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        upper = (data >= 65) & (data <= 90) | second & (data <= 0x9E)
        spaced = np.full(len(data) + len(sizes), 32, dtype=np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data + np.where(upper, np.uint8(32), np.uint8(0))
        text = spaced.tobytes().decode("latin-1").translate(self.letters)
        cuts = np.concatenate(([0], np.cumsum(sizes + 1)))[::WORDS_AT_ONCE].tolist() + [len(text)]
        parts = [self.bare.encode_batch_fast([text[a:b]], add_special_tokens=False)[0].ids
                 for a, b in zip(cuts, cuts[1:]) if b > a]
        ids = np.concatenate([np.array(p, dtype=np.int32) for p in parts])
        return ids, np.diff(np.concatenate(([0], np.flatnonzero(self.ends_word[ids]) + 1)))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, and how many each has. A null text has only the end."""
        found = words_of(texts)
        ids, lengths = self.known.take(self.numbers(found))
        last = np.cumsum(found.counts)
        total = np.concatenate(([0], np.cumsum(lengths)))
        counts = total[last] - total[last - found.counts] + 1
        out = np.full(len(ids) + len(last), end, dtype=np.int32)
        is_id = np.ones(len(out), dtype=bool)
        is_id[np.cumsum(counts) - 1] = False
        out[is_id] = ids
        return out, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file: Spark reuses Python workers, and so what they have learned."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
