"""Token ids of texts, with the tokenizers library."""

from __future__ import annotations

import functools
import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

END_ID = 2
_CACHED = 400_000  # words in each of two stores, about 250 bytes each
_LONGEST = 200  # longer words are not kept
_BLOCK_CHARS = 1 << 18  # of texts whose missing words are learned together
_STRING_WORDS = 200  # in one string for the model
_INNER_SPACE = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|$)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUTS = {"\n": re.compile(r"\n(?<!\s\n)")}  # after a visible character
_CUTS |= {mark: re.compile(rf"\{mark}(?<=[{_LETTERS}]\{mark})") for mark in string.punctuation}  # after a letter
_PLAIN = re.compile(rf"(?:\t\n)?[{_LETTERS}]+")
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as they are
_SHOWN = dict(zip([b for b in range(256) if b not in _KEPT], range(256, 512)))
_ASCII_SHOWN = {chr(b): chr(_SHOWN.get(b, b)) for b in range(128)}
_SHOWN_CODES = np.array([_SHOWN.get(b, b) for b in range(256)], "<u2")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Ids by word. One that is missing is taken from the older store, or asked for, where it is looked up: a text is
    one pass over its words."""

    def __init__(self, learn: Callable[[str], bytearray], older: dict[str, bytes]):
        self.learn, self.older = learn, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.learn(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    A byte-level BPE with the usual expression never joins a space that stands before a visible character
    to what precedes it, nor a line end to the visible character before it, nor punctuation to the letter before it, so a
    text's ids are those of its words, cut there. A word that no space stands in front of is kept behind a tab. Words
    recur: each is kept unless it is long. When a store is full it becomes the older one, in place of the last, and a new one is begun; what
    is used again moves there, so that rare words go and common ones stay. The missing words of a block of texts are
    learned together, once all of them were looked up: until then an empty array stands for each. Letters are one piece,
    which the model encodes without another look at the expression. Texts that hold the string of an added
    token, such as <|endoftext|>, are encoded whole: it is one id, and cuts the text before and behind it.
    Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        before, model = plan["pre_tokenizer"] or {}, plan["model"]
        added = [re.escape(x["content"]) for x in plan["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None  # one in a text ends the piece before it
        self.by_parts = (
            plan["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
        )
        self.model = self.tokenizer.model
        self.bare = None if model.get("ignore_merges") else Tokenizer(self.model)  # takes a string as one piece
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_ASCII_SHOWN[" "])]] = True
        self.asked: dict[str, bytearray] = {}  # words to learn, and where their ids go
        self.words = _Words(self._ask, {})

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        """Ids of what the expression takes as one piece, straight from the model."""
        if piece.isascii() and piece[1:].isalpha():  # what is no letter stands in front
            shown = _ASCII_SHOWN[piece[0]] + piece[1:]
        else:
            shown = piece.encode("utf-8").decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of letters behind a space, many in one string.

        Where as many ids begin with a space as there are stems, no merge crossed from one to the next, so each has the
        ids that it has alone. Otherwise they are encoded one by one.
        """
        found = []
        for k in range(0, len(stems), _STRING_WORDS):
            part = stems[k : k + _STRING_WORDS]
            ids = cuts = np.empty(0, "<u4")
            if self.bare:
                raw = np.frombuffer(f" {' '.join(part)}".encode(), np.uint8)
                shown = _SHOWN_CODES[raw].tobytes().decode("utf-16-le")
                ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(part):
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                found += [raw[a:b] for a, b in zip(ends, ends[1:])]
            else:
                found += [self._piece(f" {stem}") for stem in part]
        return found

    def _ask(self, word: str) -> bytearray:
        """Where the ids of a word that neither store has will stand."""
        self.asked[word] = ids = bytearray()
        return ids

    def _learn(self) -> None:
        """Ids of the words asked for, put where they are awaited and into the store."""
        stems, others = [], []
        for word in self.asked:
            if (word.isalpha() and word.isascii()) or (word[0] != "\t" and _PLAIN.fullmatch(word)):
                stems.append(word)
            elif _PLAIN.fullmatch(word):
                self.asked[word].extend(self._piece("\n") + self._piece(word[2:]))
            else:
                others.append(word)
        for word, ids in zip(stems, self._stems(stems)):
            self.asked[word].extend(ids)
        for word, ids in zip(others, self._whole([w[1:] if w[0] == "\t" else f" {w}" for w in others])):
            self.asked[word].extend(ids)
        self.words.update(zip(self.asked, map(bytes, self.asked.values())))
        for word in [w for w in self.asked if len(w) > _LONGEST]:
            del self.words[word]
        self.asked = {}

    def _block(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > _CACHED:
            self.words.older = {}
            self.words = _Words(self._ask, self.words)
        found = []
        for text in texts:
            if not self.by_parts or (self.added and self.added.search(text)):
                found.append(self._whole([text]))
                continue
            if _ODD_SPACE.search(text):
                words = _INNER_SPACE.split(text)
            else:
                for mark, cut in _CUTS.items():
                    if mark in text:
                        text = cut.sub(f" \t{mark}", text)
                words = text.split(" ")
            words[0] = f"\t{words[0]}"
            found.append(list(map(self.words.__getitem__, words)))
        self._learn()
        return [b"".join(ids) for ids in found]

    def encode(self, text: str) -> bytes:
        return self._block([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in turn. Texts are read ahead by a block."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= _BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
