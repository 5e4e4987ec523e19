"""Token ids of whole texts for a tokenizer file of the tokenizers library.

The byte-pair merges run in tiktoken's core, fed with the file's own
vocabulary in merge order, at a fraction of the library's time. A file, or a
text, that this core can't treat like the library goes to the library itself;
the tests hold both against an untouched `Tokenizer`.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

END_ID = 1

#: ends every piece where the vocabulary marks word ends; texts that hold it go to the library
MARK = "\x01"
#: characters beyond these may be normalised in ways that only the library knows
UNUSUAL = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]|İ")
#: characters of one kind in a row from which on a text goes to the library, whose pattern engine has no such limit
LONG_RUN = re.compile(r"\S{20000}|\s{20000}")

#: Fixed value: the pattern of the byte-level pre-tokenizer, which the files name but don't hold.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the pattern of the pre-tokenizer that `marked` follows on texts without UNUSUAL characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# kinds of bytes in such texts: white space 0, letters (all beyond ASCII are) 1, digits 2, others 3
_KIND = np.array([0 if b in b"\t\n\v\f\r " else 2 if 48 <= b <= 57 else 1 if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 3
                  for b in range(256)], np.uint8)

_ENCODERS: dict = {}


def marked(text: str) -> str:
    """The pieces of WORD_PATTERN in a text without UNUSUAL characters, each with MARK after it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = _KIND[raw]
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quote = np.flatnonzero((raw[:-1] == 39) & first[:-1])  # a contraction begins where a piece does
    if len(quote):
        after = np.append(raw, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 108) & (two == 108)) | (((one == 114) | (one == 118)) & (two == 101))
        first[quote[short | long] + 1] = False
        for ends in (quote[short] + 2, quote[long] + 3):
            ends = ends[ends < len(raw)]
            first[ends] = kind[ends] > 0
    at = np.flatnonzero(kind)
    starts = np.cumsum(first[at])
    if not len(at):
        return ""
    out = np.full(len(at) + int(starts[-1]), ord(MARK), np.uint8)
    out[np.arange(len(at)) + starts - 1] = raw[at]
    return out.tobytes().decode()


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of one tokenizer file as little-endian bytes of a fixed width.

    The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`:
    a special token's string in a text is that token. With `plain_specials`
    such strings are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = plain_specials
        self.vocab_size = self.lib.get_vocab_size()
        self.dtype = "<u2" if self.vocab_size <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.specials = [] if plain_specials else [t["content"] for t in added]
        self.pieces = None  # finds a normalised text's pieces where the vocabulary marks word ends
        self.core = self._core(spec)

    def _core(self, spec: dict):
        """tiktoken's core for the file, or None where only the library can read it."""
        model, before, clean = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model["vocab"]
        order = [vocab.get(a + b, -1) for a, b in merges]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        odd = self.specials and any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"])
        if model["type"] != "BPE" or not plain or odd or order != sorted(set(order)) or -1 in order:
            return None
        suffix = model.get("end_of_word_suffix") or ""
        if not suffix and not clean and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            pattern = BYTE_LEVEL_PATTERN
        elif suffix and (cut := self._word_pattern(clean, before)):
            import regex
            self.pieces, pattern = regex.compile(cut), f"[^{MARK}]+{MARK}"
            self.plain_words = cut == WORD_PATTERN
        else:
            return None
        letters = byte_letters()
        ranks = {}
        for token, i in vocab.items():
            body = token.removesuffix(suffix) if suffix else token
            if any(c not in letters for c in body):
                return None
            ranks[bytes(letters[c] for c in body) + (MARK.encode() if body != token else b"")] = i
        singles = [ranks.get(bytes([b]), len(vocab)) for b in range(256)] + [ranks.get(bytes([b]) + MARK.encode(), len(vocab)) for b in range(256) if suffix]
        if len(ranks) != len(vocab) or max(singles) >= (order[0] if order else len(vocab)):
            return None  # every byte, with and without the word's end, comes before the first merge
        import tiktoken
        return tiktoken.Encoding("core", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _word_pattern(clean: dict | None, before: dict) -> str | None:
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (clean or {}).get("normalizers", [])]
        cuts = before.get("pretokenizers", [])
        if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or len(cuts) != 2:
            return None
        split, level = cuts
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or level.get("type") != "ByteLevel" \
                or level.get("use_regex") or level.get("add_prefix_space"):
            return None
        return split["pattern"].get("Regex")

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text (null: empty)."""
        if not text:
            return np.zeros(0, self.dtype)
        if self.core is None or any(s in text for s in self.specials) or (self.pieces and MARK in text) \
                or (len(text) >= 20000 and LONG_RUN.search(text)):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)
        if self.pieces:
            if self.plain_words and not UNUSUAL.search(text):
                text = marked(unicodedata.normalize("NFC", text).lower())
            else:
                text = "".join([p + MARK for p in self.pieces.findall(self.lib.normalizer.normalize_str(text))])
            if not text:
                return np.zeros(0, self.dtype)
        return np.array(self.core.encode_ordinary(text), self.dtype)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as bytes, without an end id."""
        return [self.ids(t).tobytes() for t in texts]


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, plain_specials) not in _ENCODERS:
        _ENCODERS[path, plain_specials] = Encoder(path, plain_specials)
    return _ENCODERS[path, plain_specials]


def in_chunks(texts, chars: int = 1 << 21):
    """Index ranges of about `chars` characters, so that a worker holds the ids of a few texts at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
