"""Encoding with the tokenizers library, each distinct word once.

A tokenizer that drops white space encodes a text as its words one after another, so
a batch's distinct words are encoded and the ids gathered. Words of plain Latin
characters are split into pre-tokens here and only those reach the library's model;
any other word (rarer scripts, special tokens, control characters) passes through the
whole library. A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .units import Codes, coded, gathered

CACHED = 220_000
PLAIN = regex.compile("[!-~¡-įı-ɏ]+")  # without the one letter here that two lower-case characters replace
#: The settings under which words can be encoded one by one.
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.by_word = (spec["normalizer"] or {}).get("normalizers") == WORD_NORMAL and steps[0].get("pattern") == {"Regex": WORD_SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel" and not spec["post_processor"]
        self.model, self.split, self.stand_ins = self.library.model, regex.compile(WORD_SPLIT), byte_characters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.vocabulary = self.library.get_vocab_size()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            text = part.encode().decode("latin-1").translate(self.stand_ins)
            found = np.array([t.id for t in self.model.tokenize(text)], np.uint32).tobytes()
            if len(self.parts) < CACHED:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if not PLAIN.fullmatch(word) or "<|" in word:
            return np.array(self.library.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        if word.isalpha():
            return self._part(word.lower())
        return b"".join(map(self._part, self.split.findall(word.lower())))

    def encode(self, texts: pa.Array) -> Codes:
        texts = texts.fill_null("")
        if not self.by_word:
            each = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return Codes(np.concatenate(each or [np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64))
        lists = pc.ascii_split_whitespace(texts)
        distinct, which = coded(lists.flatten())
        ids = []
        for w in distinct:
            found = self.words.get(w)
            if found is None:
                found = self._word(w)
                if len(self.words) < CACHED:
                    self.words[w] = found
            ids.append(found)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return gathered(ids, which, offsets - offsets[0])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
