"""Encoding of whole texts with a tokenizer file, inside Arrow tasks."""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed value: how byte-level tokenizers of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space next to a space makes pieces that a split at spaces would cut; these are the kinds beside the space.
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_WORDS_KEPT, _LONGEST_KEPT = 700_000, 48


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in
    order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: b for b in printable}, **{b: 256 + i for i, b in enumerate(others)}}


class Words(dict):
    """Ids of a space and a word, made when first asked for. A full table is begun anew once as many words were missed as
    it holds."""

    def __init__(self, made):
        super().__init__()
        self.made, self.missed = made, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.made(word)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= _WORDS_KEPT:
                self.missed += 1
                if self.missed <= _WORDS_KEPT:
                    return ids
                self.clear()
                self.missed = 0
            self[word] = ids
        return ids


class Encoder:
    """Ids of a text as a numpy array, equal to the tokenizer's own encoding with add_special_tokens=False.

    With `added`, strings of added tokens in a text are those tokens, as the library has it when nothing is set; a text that
    holds one goes through the tokenizer whole. Without, strings of special tokens are ordinary text. With a byte-level BPE file, a text is split at its
    spaces and the ids of each word are remembered: a space before a word always begins a piece there, so the ids
    of the words are those of the text. Texts with runs of white space go through the tokenizer as they are. Memory is
    bounded.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.by_word = _byte_level(path)
        self.words = Words(self._word)
        self.pieces: dict[str, bytes] = {}  # ids of what words with signs and breaks are made of
        self.cut, self.letters = regex.compile(PIECES).findall, byte_letters()
        self.bytes_of = [np.array(i, self.kind).tobytes() for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        if not self.by_word or _joined_spaces(text) or any(content in text for content in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        head, *words = text.split(" ")
        return np.frombuffer(b"".join([*map(self._piece, self.cut(head)), *map(self.words.__getitem__, words)]), self.kind)

    def _word(self, word: str) -> bytes:
        """The ids of a space and a word. Signs of ASCII at the end of letters are one piece."""
        core = word.rstrip(_SIGNS)
        if not core.isalpha():
            return b"".join(map(self._piece, self.cut(" " + word)))
        if len(core) == len(word):
            return self._encode(" " + core)
        return self.words[core] + self._piece(word[len(core):])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._encode(piece)
            if len(self.pieces) < _WORDS_KEPT // 4 and len(piece) <= _LONGEST_KEPT:
                self.pieces[piece] = ids
        return ids

    def _encode(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes_of[token.id] for token in self.tokenizer.model.tokenize(letters)])


def _joined_spaces(text: str) -> bool:
    return "  " in text or any(space in text and (space + " " in text or " " + space in text) for space in _OTHER_SPACES)


def _byte_level(path: str) -> bool:
    """Whether the file says: no normalizer, byte-level pieces without a prefix space, BPE, nothing added."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    pieces = said.get("pre_tokenizer") or {}
    return (said.get("normalizer") is None and pieces.get("type") == "ByteLevel" and not pieces.get("add_prefix_space")
            and pieces.get("use_regex", True) and said["model"].get("type", "BPE") == "BPE"
            and not said["model"].get("dropout") and all(x.get("special") for x in said.get("added_tokens") or []))


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder for each file, choice of `added` and process: its table of words serves all tasks of a worker.

    Functions travel to the workers by value, and their globals with them, for one task only. So what outlives a
    task hangs on a module of the process.
    """
    kept = sys.modules.setdefault("_tidelog_kept", types.ModuleType("_tidelog_kept")).__dict__.setdefault("encoders", {})
    if (path, added) not in kept:
        kept[path, added] = Encoder(path, added)
    return kept[path, added]


def let_go() -> None:
    """Frees the encoders of a worker, at the beginning of work that needs its memory for other tables."""
    sys.modules.pop("_tidelog_kept", None)


def utf8(text: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
