"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie; every node has a failure link to the node that holds
what is left after its longest pieces are popped, and the number of pieces that
go. A word is read once, character by character, and its pieces are counted
without being built.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import without

END = "</w>"  # marks a vocabulary entry that ends a word
KEEP = 500_000  # words whose lengths a worker keeps, in each of two generations
LONG = 64
MAX_VOCAB = 1 << 20  # entries; the automaton is broadcast

# The words of the vocabulary file's own pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Byte-level files write byte b as character b where that prints, else as the next character from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PRINTS]
BYTE_CHARS = [chr(b) if b in _PRINTS else chr(256 + _REST.index(b)) for b in range(256)]


def symbols(word: str) -> list[str]:
    """The word's bytes as characters; the last one carries the mark of the word's end."""
    chars = list(word) if word.isascii() and word.isprintable() else [BYTE_CHARS[b] for b in word.encode()]
    chars[-1] += END
    return chars


def entry_symbols(entry: str) -> list[str]:
    if entry.endswith(END) and len(entry) > len(END):
        chars = list(entry[:-len(END)])
        chars[-1] += END
        return chars
    return list(entry)


def read_vocabulary(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return sorted(json.load(f)["model"]["vocab"])


class Automaton:
    def __init__(self, vocabulary: list[str]):
        if len(vocabulary) > MAX_VOCAB:
            raise ValueError(f"the vocabulary has more than {MAX_VOCAB} entries")
        child: list[dict[str, int]] = [{}]
        whole = [False]
        for entry in vocabulary:
            at = 0
            for s in entry_symbols(entry):
                if s not in child[at]:
                    child[at][s] = len(child)
                    child.append({})
                    whole.append(False)
                at = child[at][s]
            whole[at] = at > 0
        fail, popped = [-1] * len(child), [0] * len(child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in child[u].items():
                queue.append(v)
                if whole[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                n, z = popped[u], fail[u]
                while z >= 0 and s not in child[z]:
                    n, z = n + popped[z], fail[z]
                if z >= 0:
                    fail[v], popped[v] = child[z][s], n
        self.child, self.fail, self.popped = child, fail, popped

    def length(self, word: list[str]) -> int:
        """Number of pieces that greedy longest match cuts the symbols into; 1 (unknown) where it gets stuck."""
        child, fail, popped = self.child, self.fail, self.popped
        u = n = 0
        for s in word:
            while s not in child[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = child[u][s]
        while u:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


class Counter:
    """Words and pieces of texts; what a worker has counted for a run of characters it keeps."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.young: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}

    def run(self, chars: str) -> tuple[int, int]:
        words = WORDS.findall(unicodedata.normalize("NFC", chars).lower())
        return len(words), sum(self.automaton.length(symbols(w)) for w in words)

    def text(self, text: str | None) -> tuple[int, int]:
        words = pieces = 0
        get = self.young.get
        for chars in (text or "").split():
            got = get(chars)
            if got is None:
                got = self.old.get(chars) or self.run(chars)
                if len(chars) <= LONG:
                    self.young[chars] = got
            words += got[0]
            pieces += got[1]
        if len(self.young) > KEEP:
            self.young, self.old = {}, self.young
        return words, pieces


_AUTOMATA: dict[str, Automaton] = {}


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_words and n_tokens (long): the words of the whole text and their greedy pieces, without special tokens.

    `vocabulary` is the path of a tokenizer file with word ends, there on every
    executor like the library that reads it. Text is NFC-normalised and
    lower-cased, and cut into words as the file's own pre-tokenizer does. Null,
    empty and blank texts have none. Input columns n_words and n_tokens are
    replaced, others kept; repeated rows stay; nothing is shuffled.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _AUTOMATA:
            _AUTOMATA[vocabulary] = Automaton(read_vocabulary(vocabulary))
        counter = Counter(_AUTOMATA[vocabulary])
        for texts in batches:
            yield pd.DataFrame([counter.text(t) for t in texts], columns=["n_words", "n_tokens"])

    kept = without(docs, "n_words", "n_tokens")
    return kept.withColumn("__n", counted(F.col(text_col))).select(*kept.columns, "__n.n_words", "__n.n_tokens")
