"""Splitting texts into pre-tokens exactly as a tokenizer file says, and encoding single pre-tokens."""

from __future__ import annotations

import json
import re

#: The ranges of letters, digits and white space below U+0100.
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Splitter:
    """``words(text)``: the pre-tokens of a text, special strings among them as themselves.

    Texts whose characters lie below U+0100 take one regular expression that equals the file's rules there;
    all others go through the library's own normaliser and pre-tokeniser.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        d = json.loads(spec)
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.marks = sorted({x[0] for x in self.special if x})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        norm, pre = d["normalizer"], d["pre_tokenizer"]
        kinds = [x["type"] for x in (norm or {}).get("normalizers", [norm] if norm else [])]
        other = f"[^{SPACE}{LETTER}{DIGIT}]+"
        self.lower, self.fast = False, None
        if kinds == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence":
            self.lower = True
            self.fast = re.compile(f"{ENDINGS}|[{LETTER}]+|[{DIGIT}]|{other}").findall
        elif norm is None and pre["type"] == "ByteLevel" and pre["use_regex"]:
            self.fast = re.compile(f"{ENDINGS}| ?[{LETTER}]+| ?[{DIGIT}]+| ?{other}|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.table = {b: c for b, c in enumerate(self.letters)}

    def _part(self, text: str) -> list[str]:
        if self.fast:
            try:
                text.encode("latin-1")
                return self.fast(text.lower() if self.lower else text)
            except UnicodeEncodeError:
                pass
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [bytes(map(self.bytes.__getitem__, x)).decode() for x, _ in t.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(m in text for m in self.marks) or len(parts := self.cut.split(text)) == 1:
            return self._part(text)
        out: list[str] = []
        for x in parts:
            if x in self.special:
                out.append(x)
            elif x:
                out += self._part(x)
        return out

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.table))]

    def pieces(self) -> dict[int, str]:
        return {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
