"""A bounded memo from words and pieces of words to token ids, for tokenizers that never join across ASCII spaces."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import count, islice

import numpy as np

from .shared import SLICE_BYTES, read_only_path

#: Words held at most between two slices of text, some 250 bytes each; this bounds a task's memory, not what is encoded.
MEMO_WORDS = 300_000
#: Words of more characters are encoded each time and not held.
MEMO_WORD_CHARS = 64
#: Plain words that are handed to the tokenizer as one text.
JOINED_WORDS = 1_000
#: Characters of texts that are split here: Latin ones, and dashes, quotes and the like. None joins or changes its neighbours when it is normalised.
_KNOWN = [*range(0x2B0), *range(0x2010, 0x2028), 0x20AC]
#: The only splitter and normalisers for which that is done, as the tokenizer's file spells them.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_STOPS = (".", "!", "?", "。", "！", "？")


@lru_cache(maxsize=2)
def _tokenizer(tokenizer_file: str):
    """The tokenizer, the openings of its special tokens, by id whether a token closes a word, and how it splits Latin text (see ``_latin``).

    Raises an error where spaces and line feeds are no walls for it: where a piece
    of several characters holds one, or words encoded alone differ from a text's.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(read_only_path(tokenizer_file))
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # Ġ and Ċ stand for the space and the line feed where bytes are spelled as letters
    spaced = [p for p in vocabulary if len(p.removesuffix("</w>")) > 1 and set(p) & set(" \nĠĊ")]
    probe = ["Ab", "x1.", "it's", "é,", "北京"]

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    alone = [i for p in probe for i in ids(p)]
    if spaced or ids(" ".join(probe)) != alone or ids("\n".join(probe)) != alone:
        raise ValueError(f"tokens of {tokenizer_file} reach over white space; words cannot be encoded alone")
    closes = np.zeros(max(vocabulary.values()) + 1, bool)
    closes[[k for p, k in vocabulary.items() if p.endswith("</w>")]] = True
    return tokenizer, special, closes, _latin(tokenizer)


@dataclass
class _Latin:
    """Text that can be split as the tokenizer splits it.

    ``whole`` tells whether a whole text is such, ``word`` whether it is letters
    alone; ``pieces`` of a small text; ``apart`` puts spaces around a small text's
    runs of signs and around apostrophes with the letters behind them; ``letters`` are
    spelled so for the model.
    """

    whole: Callable[[str], object]
    word: Callable[[str], object]
    pieces: Callable[[str], list[str]]
    apart: Callable[[str], str]
    letters: dict[int, str]


def _latin(tokenizer) -> _Latin | None:
    """Kinds of the known characters, as the tokenizer itself tells them; None if its splitter or normalisers are others."""

    def steps(part, name: str) -> list[dict]:
        return json.loads(part.__getstate__()).get(name, []) if part else []

    if steps(tokenizer.pre_tokenizer, "pretokenizers") != _SPLITTER or steps(tokenizer.normalizer, "normalizers") != _NORMALISER:
        return None

    def pieces(text: str) -> list[str]:
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]

    letters, digits, spaces, signs = {}, [], [], []
    told = {k: (pieces(f"b{k}b"), pieces(f"?{k}?")) for k in map(chr, _KNOWN)}
    for k, (within, between) in told.items():
        if told.get(k.lower()) != told[k]:
            continue
        if len(within) == 1:
            letters[ord(k)] = within[0][1:-1]
        elif len(within) == 2:
            spaces.append(k)
        else:
            (digits if len(between) == 3 else signs).append(k)
    letter, digit, space, sign = ("".join(map(re.escape, x)) for x in (map(chr, letters), digits, spaces, signs))
    return _Latin(
        re.compile(f"[{letter}{digit}{space}{sign}]*").fullmatch,
        re.compile(f"[{letter}]+").fullmatch,
        re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[{sign}]+").findall,
        partial(re.compile(f"'[{letter}]+|[{sign}]+").sub, r" \g<0> "),
        letters,
    )


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of ranges (begin, count) in a row."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)


class WordTable:
    """Token ids of texts by words split at spaces and line feeds or, for Latin text, by the tokenizer's own split.

    The tokenizer drops white space before its merges and none of its pieces
    holds any (checked when the tokenizer is loaded), so a text's ids are its
    words' ids in order. Where its splitter is known (see ``_latin``), Latin text is
    made small and its signs are put apart, so that far fewer words are distinct. A text that holds a special token's opening is encoded whole by the
    library instead.
    """

    def __init__(self, tokenizer_file: str) -> None:
        self.tokenizer, self.special, self.closes, self.latin = _tokenizer(tokenizer_file)
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        #: Numbers given out; those of words that were let go stay in the arrays until they are trimmed.
        self.known = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.ends = np.zeros(1 << 14, bool)
        self.hits = np.zeros(1 << 14, np.int64)

    def _trim(self) -> None:
        """Lets go of all words but the most used quarter of what may be held."""
        words = list(self.index)
        numbers = np.fromiter(self.index.values(), np.int64, len(words))
        often = np.sort(np.argsort(-self.hits[numbers], kind="stable")[: MEMO_WORDS // 4])
        keep = numbers[often]
        self.index = defaultdict(count(len(keep)).__next__, ((words[k], n) for n, k in enumerate(often.tolist())))
        self.known = len(keep)
        ids = self.flat[_spread(self.begin[keep], self.count[keep])]
        n, counts = len(keep), self.count[keep]
        self.flat[: len(ids)], self.used = ids, len(ids)
        self.begin[:n], self.ends[:n], self.hits[:n] = np.cumsum(counts) - counts, self.ends[keep], self.hits[keep] // 2
        self.count[:n] = counts
        self.hits[n:] = 0

    def _put(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[numbers] = counts
        self.begin[numbers] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put_whole(self, words: list[str], numbers: list[int]) -> None:
        for a in range(0, len(words), 20_000):
            ids = self._encode(words[a : a + 20_000])
            self._put(np.array(numbers[a : a + 20_000]), np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

    def _put_latin(self, words: list[str], numbers: list[int]) -> None:
        """Small words of Latin letters are one piece each, which is spelled here and given to the model straight away."""
        tokenize, letters = self.tokenizer.model.tokenize, self.latin.letters
        counts: list[int] = []
        ids: list[int] = []
        for word in words:
            tokens = tokenize(word if word.isascii() else word.translate(letters))
            counts.append(len(tokens))
            ids += [t.id for t in tokens]
        self._put(np.array(numbers, np.int64), np.array(counts, np.int64), np.array(ids, np.uint32))

    def _put_plain(self, words: list[str], numbers: list[int]) -> None:
        """Words of letters alone are as a rule one piece for the tokenizer, so that one token of each, its last, closes a word.

        Every word has one such token at least, so if there are as many as words, each has one.
        """
        for a in range(0, len(words), JOINED_WORDS):
            part = words[a : a + JOINED_WORDS]
            ids = self._encode([" ".join(part)])[0]
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(part):
                self._put(np.array(numbers[a : a + JOINED_WORDS]), np.diff(last, prepend=-1), ids)
            else:
                self._put_whole(part, numbers[a : a + JOINED_WORDS])

    def _fresh(self, since: int) -> list[str]:
        """The words that joined the index since it held so many, in order."""
        return list(islice(reversed(self.index), len(self.index) - since))[::-1]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new words; those of Latin text share their pieces' ids."""
        index, first, latin = self.index, self.known, self.latin
        made: list[int] = []
        parts: list[int] = []
        sizes: list[int] = []
        spelled: list[int] = []
        plain: list[int] = []
        other: list[int] = []
        held = len(index)
        for number, word in enumerate(fresh, first):
            if latin and word.isascii() and word.isalpha() and word.islower():
                spelled.append(number)
            elif not latin or not latin.whole(word):
                (plain if word.isalpha() else other).append(number)
            else:
                low = word.lower()
                own = [low] if latin.word(low) else latin.pieces(low)
                if own != [word]:
                    made.append(number)
                    sizes.append(len(own))
                    parts += map(index.__getitem__, own)
                else:
                    (spelled if latin.word(word) else other).append(number)
        begun = first + len(fresh)
        fresh += self._fresh(held)
        for number, word in enumerate(fresh[begun - first :], begun):
            (spelled if latin.word(word) else other).append(number)
        self.known = end = first + len(fresh)
        while end > len(self.begin):
            self.begin, self.count, self.ends, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.ends, self.hits))
        if spelled:
            self._put_latin([fresh[n - first] for n in spelled], spelled)
        self._put_plain([fresh[n - first] for n in plain], plain)
        self._put_whole([fresh[n - first] for n in other], other)
        if made:
            counts = self.count[parts]
            until = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(counts)])
            self._put(np.array(made), total[until] - total[until - sizes], self.flat[_spread(self.begin[parts], counts)])
        self.ends[first:end] = False
        self.ends[[n for n in (*plain, *other, *made) if fresh[n - first].endswith(_STOPS)]] = True
        for word in fresh:
            if len(word) > MEMO_WORD_CHARS:
                # its number stays in the arrays until they are trimmed, but the string is let go
                del index[word]

    def _numbers(self, words: list[str]) -> np.ndarray:
        held = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > held:
            self._learn(self._fresh(held))
        self.hits[: self.known] += np.bincount(numbers, minlength=self.known)
        return numbers

    def _parts(self, text: str) -> list[str]:
        """The text cut before spaces or line feeds into parts of about a slice; a longer word stays whole."""
        cuts, at = [0], SLICE_BYTES
        while at < len(text):
            cut = max(text.rfind(" ", cuts[-1] + 1, at), text.rfind("\n", cuts[-1] + 1, at))
            if cut < 0:
                later = [p for p in (text.find(" ", at), text.find("\n", at)) if p >= 0]
                if not later:
                    break
                cut = min(later)
            cuts.append(cut)
            at = cut + SLICE_BYTES
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids and the positions (in ids, exclusive) at which sentences end.

        Texts are meant to be a slice together; a longer one is worked on in parts, so
        that no more than a slice is held as words.
        """
        if len(texts) != 1 or len(texts[0]) <= SLICE_BYTES or any(s in texts[0] for s in self.special):
            return self._encode_slice(texts)
        told = [self._encode_slice([part])[0] for part in self._parts(texts[0])]
        starts = np.cumsum([0, *(len(ids) for ids, _ in told[:-1])])
        return [(np.concatenate([ids for ids, _ in told]), np.concatenate([ends + s for (_, ends), s in zip(told, starts)]))]

    def _encode_slice(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.known > MEMO_WORDS:
            self._trim()
        words: list[str] = []
        sizes, kinds, whole = [], [], {}
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                whole[k] = self._encode([text])[0]
                sizes.append(0)
                kinds.append(False)
                continue
            latin = self.latin and self.latin.whole(text)
            own = (self.latin.apart(text.lower()) + " " if latin else text).replace("\n", " ").split(" ")
            sizes.append(len(own))
            kinds.append(bool(latin))
            words += own
        numbers = self._numbers(words)
        counts = self.count[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        ids = self.flat[_spread(self.begin[numbers], counts)]
        # behind signs that are put apart there is an empty word if there was a space
        stops = self.ends[numbers] & (np.append(numbers[1:] == self.index.get("", -1), False) | ~np.repeat(np.array(kinds, bool), sizes))
        out, word_at, id_at = [], 0, 0
        for k, size in enumerate(sizes):
            if k in whole:
                out.append((whole[k], np.zeros(0, np.int64)))
                continue
            own = ends[word_at : word_at + size]
            last = int(own[-1]) if size else id_at
            out.append((ids[id_at:last], own[stops[word_at : word_at + size]] - id_at))
            word_at, id_at = word_at + size, last
        return out
