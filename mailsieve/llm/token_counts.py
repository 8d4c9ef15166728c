"""Operator 3, token counts that follow edits.

A text is split into pre-tokens, by the pattern of the vocabulary, and runs of
them of about ``LEAF`` characters are the leaves of a segment tree that sums
characters and tokens. An edit finds its leaves by descending through the
character sums, lexes these again from a leaf that ends before anything the edit
can reach, until a pre-token ends where an untouched leaf begins, and updates the
sums on the paths above the leaves it changed. Everything else keeps its count.

No pre-token looks more than two characters past its end, so a leaf that begins
at least two characters before an edit begins with a pre-token after it too.

Trees are columns (characters and tokens of the leaves) and can be stored; edits
are an array of (start, end, insert) per row, applied in order, each in the
coordinates of the text that the edits before it left. Offsets beyond the text
are moved to its end. Nothing is shuffled.

Defined results: null and empty texts have no token; null edits are none, and a
null in an edit is 0 or empty; repeated rows are counted each; an empty table
gives an empty result; other columns are passed by.
"""

import base64
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches

LEAF = 512
REACH = 2
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PRE_TOKEN = regex.compile(PATTERN)
#: A blank between two letters always begins a pre-token, whatever stands around it.
BETWEEN_WORDS = regex.compile(r"(?<=\p{L}) (?=\p{L})")
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITED = "struct<n_tokens:bigint,n_chars:bigint,recounted_chars:bigint,text:string>"
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary, read once per worker."""
    if path not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def leaf_ends(text: str) -> Iterator[int]:
    """Where a leaf may end: behind pre-tokens that don't end in white space.

    How white space is split depends on what follows it; with this rule a leaf
    alone is split as it is inside its text.
    """
    return (p.end() for p in PRE_TOKEN.finditer(text) if not text[p.end() - 1].isspace())


def leaves_of(text: str) -> list[str]:
    """Runs of whole pre-tokens of about LEAF characters.

    They end between two words; where no such place is near, the text is lexed.
    """
    ends = [0]
    while len(text) - ends[-1] > LEAF:
        place = ends[-1] + LEAF
        plain = BETWEEN_WORDS.search(text, place, place + 4 * LEAF)
        ends.append(plain.start() if plain else _next_end(text, ends[-1], place))
    if ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def _next_end(text: str, begin: int, place: int) -> int:
    """The first end of a leaf from ``place`` on, with a pre-token beginning at ``begin``."""
    for piece in PRE_TOKEN.finditer(text, begin):
        if piece.end() >= place and not text[piece.end() - 1].isspace():
            return piece.end()
    return len(text)


class Tree:
    """Sums over leaves, as heaps whose node k has the children 2k and 2k + 1."""

    def __init__(self, leaves: list[str], tokens: list[int], encode) -> None:
        self.leaves, self.encode, self.recounted = leaves or [""], encode, 0
        self.first = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * 2 * self.first, [0] * 2 * self.first
        for k, leaf in enumerate(self.leaves):
            self.chars[self.first + k], self.tokens[self.first + k] = len(leaf), tokens[k] if tokens else 0
        for node in range(self.first - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins."""
        node, before = 1, 0
        while node < self.first:
            node *= 2
            if offset >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.first, len(self.leaves) - 1)
        return leaf, before if leaf == node - self.first else before - self.chars[self.first + leaf]

    def edit(self, start: int, end: int, insert: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        low, begin = self.find(max(0, start - REACH))
        high = self.find(max(start, end - 1))[0]
        head, tail = start - begin, end - begin
        old = "".join(self.leaves[low : high + 1])
        while len(old) < tail:
            high += 1
            old += self.leaves[high]
        while True:
            after, context = high + 1, ""
            while after < len(self.leaves) and len(context) <= REACH:
                context += self.leaves[after]
                after += 1
            region = old[:head] + insert + old[tail:]
            ends = list(leaf_ends(region + context))
            if high + 1 >= len(self.leaves) or not region or len(region) in ends:
                break
            high += 1
            old += self.leaves[high]
        self._replace(low, high, region, ends)

    def _replace(self, low: int, high: int, region: str, ends: list[int]) -> None:
        """Deal the new pre-tokens out to the same leaves, about evenly."""
        share, at, end = len(region) / (high - low + 1), 0, 0
        ends = iter([e for e in ends if e < len(region)] + [len(region)])
        for leaf in range(low, high + 1):
            while leaf < high and end < (leaf - low + 1) * share:
                end = next(ends, len(region))
            end = len(region) if leaf == high else end
            self._set(leaf, region[at:end])
            at = end

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.recounted += len(text)
        node = self.first + leaf
        self.chars[node], self.tokens[node] = len(text), len(self.encode(text))
        while node > 1:
            node //= 2
            self._add_up(node)


def with_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column ``tree`` (replaced if it is there)."""

    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in batches:
            rows = []
            for text in texts:
                leaves = leaves_of(text or "")
                rows.append(([len(x) for x in leaves], [len(encode(x)) for x in leaves]))
            yield pd.DataFrame(rows, columns=["chars", "tokens"])

    return small_batches(docs).withColumn("tree", F.pandas_udf(build, TREE)(F.col(text_col).cast("string")))


def n_tokens(tree: Column) -> Column:
    """The root's sum."""
    return F.aggregate(tree["tokens"], F.lit(0).cast("bigint"), lambda a, x: a + x)


def apply_edits(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (with trees and edits) with a column ``edited``: n_tokens, n_chars,
    recounted_chars and the new text."""

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for texts, trees, edits in batches:
            rows = []
            for text, chars, tokens, changes in zip(texts, trees["chars"], trees["tokens"], edits):
                leaves, at = [], 0
                for n in [] if chars is None else chars:
                    leaves.append(text[at : at + n])
                    at += n
                tree = Tree(leaves, [] if tokens is None else [int(t) for t in tokens], encode)
                for change in [] if changes is None else changes:
                    tree.edit(int(change["start"] or 0), int(change["end"] or 0), change["insert"] or "")
                rows.append((tree.tokens[1], tree.chars[1], tree.recounted, "".join(tree.leaves)))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_chars", "recounted_chars", "text"])

    changed = F.pandas_udf(run, EDITED)
    return small_batches(docs).withColumn("edited", changed(F.col(text_col).cast("string"), F.col("tree"), F.col(edits_col)))
