"""Token ids of whole texts by a tokenizers file, through a bounded store of words.

A text is cut at ASCII white space only. The pre-tokenizer of the vocabulary drops white space and never joins across
it, so the ids of a text are the ids of its words, one after another. A word of Latin letters followed by marks is two
pre-tokens, the letters in lower case and the marks: that is what the library's own normalizer and split make of it.
Each distinct one goes to the library once while it stays in the store; all else is done on whole batches by array
operations. Any other word goes to the library as it stands, and is kept by its bytes.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np

from .words import HashTable, hash_ranges, table_of, word_bounds

assert array("I").itemsize == 4 and sys.byteorder == "little"

MARKS = table_of(b".,!?*#$%&:;|")
LETTERS = table_of(bytes([*range(65, 91), *range(97, 123)]))
JOINED = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with Latin letters in lower case, and which bytes are of such a letter: ASCII ones, and those of the Latin-1 range.

    All of them have plain lower cases and no decompositions under the library's normalizer.
    """
    low, letter = LOWER[data], LETTERS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    second = data[lead + 1]
    fine = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[fine], second[fine]
    letter[lead] = letter[lead + 1] = True
    upper = second < 0x9F
    low[lead[upper] + 1] += 32
    return low, letter


class WordEncoder:
    """Ids of words in flat arrays. The store is emptied once it has over `entries` words or `opaque_bytes` of words kept by their bytes."""

    def __init__(self, path: str, entries: int = 500_000, opaque_bytes: int = 4 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.entries, self.opaque_bytes = entries, opaque_bytes
        #: Splitting off marks is right only where the vocabulary lower-cases and pre-tokenizes letters and marks apart.
        spec = json.loads(self.tokenizer.to_str())
        self.split_marks = "Lowercase" in json.dumps(spec["normalizer"]) and "\\p{L}" in json.dumps(spec["pre_tokenizer"])
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)  # tokens that end a pre-token, where the vocabulary marks them
        if suffix:
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.opaque, self.kept = HashTable(), {}, 0
        self.ids, self.starts = array("I"), array("q", [0])  # of the k-th word: from starts[k] to starts[k + 1]

    def _learn(self, words: list[bytes], whole: bool) -> np.ndarray:
        """Numbers of new words. whole: each is one pre-token, so many may go to the library as one text, cut again at their last tokens."""
        first, group = len(self.starts) - 1, JOINED if whole and self.last.any() else 1
        texts = [b" ".join(words[k : k + group]).decode() for k in range(0, len(words), group)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = words[k * group : (k + 1) * group]
            if group > 1:
                ids = array("I", e.ids)
                stops = np.flatnonzero(self.last[np.frombuffer(ids, dtype=np.uint32)]) + 1
                if len(stops) == len(own):
                    self.starts.extend((stops + len(self.ids)).tolist())
                    self.ids.extend(ids)
                    continue
            for found in [e] if len(own) == 1 else self.tokenizer.encode_batch_fast([w.decode() for w in own], add_special_tokens=False):
                self.ids.extend(found.ids)
                self.starts.append(len(self.ids))
        return np.arange(first, first + len(words))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, opaque: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each range."""
        out = np.zeros(len(starts), dtype=np.int64)
        plain = np.flatnonzero(~opaque)
        if len(plain):
            s, e = starts[plain], ends[plain]
            keys = hash_ranges(low, s, e)
            at = self.known.find(keys)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                new, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
                rows = missing[first]
                numbers = self._learn([low[a:b].tobytes() for a, b in zip(s[rows].tolist(), e[rows].tolist(), strict=True)], True)
                self.known.add(new, numbers)
                at[missing] = numbers[inverse]
            out[plain] = at
        rest = np.flatnonzero(opaque)
        if len(rest):
            words = [data[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.opaque]
            self.kept += sum(map(len, new))
            self.opaque.update(zip(new, self._learn(new, False).tolist(), strict=True))
            out[rest] = [self.opaque[w] for w in words]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of tokens of each row of a text column, and all ids, row after row."""
        if self.known.used > self.entries or self.kept > self.opaque_bytes:
            self.clear()
        starts, ends, per_row = word_bounds(data, offsets)
        if self.split_marks:
            low, letter = lower_letters(data)
            letters, marks = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (letter, MARKS[data]))
            n = letters[ends] - letters[starts]
            core = starts + n
            opaque = (n == 0) | (marks[ends] - marks[starts] != ends - core) | (letters[core] - letters[starts] != n)
            tail = ~opaque & (core < ends)
            times = 1 + tail
            place = np.cumsum(times) - times
            s, e, o = (np.empty(int(times.sum()), dtype=t) for t in (np.int64, np.int64, bool))
            s[place], e[place], o[place] = starts, np.where(opaque, ends, core), opaque
            s[place[tail] + 1], e[place[tail] + 1], o[place[tail] + 1] = core[tail], ends[tail], False
            number = self._numbers(data, s, e, o, low)
            border = np.concatenate([place, [len(s)]])[np.concatenate([[0], np.cumsum(per_row)])]
        else:
            number = self._numbers(data, starts, ends, np.ones(len(starts), dtype=bool), data)
            border = np.concatenate([[0], np.cumsum(per_row)])
        first = np.frombuffer(self.starts, dtype=np.int64).copy()
        length = first[number + 1] - first[number]
        total = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(total[border])
        if not with_ids:
            return counts, None
        at = np.repeat(first[number] - total[:-1], length) + np.arange(total[-1])
        return counts, np.array(self.ids, dtype="<u4")[at] if len(at) else np.zeros(0, dtype="<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file; its store is bounded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
