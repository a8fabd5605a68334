"""Token ids of whole texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# White space as the tokenizer files define it.
SPACE = "\t-\r \x85\xa0  -     　"
# Letters that no normal form changes, and characters that surely end a run of letters.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
ENDS = " \\n,.;:!?|#*&$%()"
# Words whose ids a worker keeps.  Words come in a long tail: the frequent ones are met early.
KEPT_WORDS = 350_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is printable, else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers in bytes.

    Both known layouts of tokenizer files cut a text into words before they look for tokens, so the ids of a text are those of its
    words one after the other.  Plain words go to the tokenizer's model and are kept; everything else goes through the
    whole tokenizer.  Texts that hold a special token, and files of any other layout, are encoded without cutting.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        model, before, normal = layout["model"], layout["pre_tokenizer"] or {}, layout["normalizer"]
        self.special = [t["content"] for t in layout["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model, self.known = self.tokenizer.model, {}
        self.letters = {ord(chr(b)): c for b, c in _byte_letters().items()}
        plain_model = model["type"] == "BPE" and not model.get("dropout")
        whole_words = plain_model and normal is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        lower_words = plain_model and model.get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(normal)
        self.lower, self.cut = bool(lower_words), None
        if whole_words and before.get("use_regex"):
            self.cut = re.compile(f" ?[{LETTER}]+(?![^{ENDS}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
            self.plain = re.compile(f" ?[{LETTER}]+").fullmatch
        elif lower_words:
            self.cut = re.compile(f"[{LETTER}]+(?![^{ENDS}])|[^{SPACE}]+")
            self.plain = re.compile(f"[{LETTER}]+").fullmatch

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not self.plain(word):
            return self._whole(word)
        word = word.lower() if self.lower else word
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def encode(self, texts: list[str]) -> list[bytes]:
        known, extra, found = self.known, {}, []
        for text in texts:
            if self.cut is None or any(s in text for s in self.special):
                found.append(self._whole(text))
                continue
            words = self.cut.findall(text)
            try:
                found.append(b"".join([known[w] for w in words]))
            except KeyError:
                for w in words:
                    if w not in known and w not in extra:
                        (known if len(known) < KEPT_WORDS else extra)[w] = self._word(w)
                found.append(b"".join([known[w] if w in known else extra[w] for w in words]))
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)
