"""Edit-aware token counts: a kept segment tree of pre-token runs for each document.

A text is cut into leaves of about ``leaf_chars`` code points, only at places where a pre-token must start whatever
surrounds it: a single space between a letter or digit and a letter. Token counts of leaves therefore add up to that of
the text, and inner nodes hold the sums of code points and tokens below them. :func:`build_trees` encodes each text once and gives
its tree as a row, to be stored; :func:`recount` takes stored trees and edits and gives the trees of the next version. An edit
descends the code-point sums to the leaves it touches, takes one more leaf on each side as context, encodes that region
again and updates the sums on the way up; no other text is encoded. The tree keeps its shape: a region is dealt out anew over
the leaves it had.

Edits apply in order, each to the text as the ones before left it; offsets are code points and are clipped to the text. Null texts
count as empty. Null lists of edits, null edits and edits with a null start or end change nothing; an end before the start is taken
as the start; a null replacement is empty. Repeated rows give repeated results, and an edit of an id that several rows have applies to each
of them; edits of unknown or null ids apply to none. Very long texts are trees with more leaves. An empty table gives an empty
result. Other columns, whatever their names, are ignored. A lost task reads its rows again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import encoder, vocabulary

_BORDER = re.compile(r"(?<=[^\W_]) (?=[^\W\d_])")


def split_leaves(text: str, leaf_chars: int) -> list[str]:
    """Runs of whole pre-tokens, at least leaf_chars long but for the last; longer where no border is near."""
    out, at = [], 0
    while len(text) - at > leaf_chars:
        m = _BORDER.search(text, at + leaf_chars)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class CountTree:
    """Token count of a text that is being edited. encode gives a text's tokens; with the leaves' tokens given, none is encoded."""

    def __init__(self, leaves: list[str], encode, leaf_chars: int = 512, tokens: list[int] | None = None):
        self.encode, self.leaf_chars, self.leaves = encode, leaf_chars, leaves
        self.base = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.encoded_chars = self.encoded_leaves = 0
        for i, leaf in enumerate(leaves):
            if tokens is None:
                self._set(i, leaf)
            else:
                self.chars[self.base + i], self.tokens[self.base + i] = len(leaf), tokens[i]
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _set(self, i: int, leaf: str) -> None:
        self.leaves[i] = leaf
        self.chars[self.base + i], self.tokens[self.base + i] = len(leaf), len(self.encode(leaf))
        self.encoded_chars += len(leaf)
        self.encoded_leaves += 1

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the code points before it."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.base, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the code points from start up to end."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, _ = self._find(max(0, start - 1))
        last, _ = self._find(end)
        first, last = max(0, first - 1), min(len(self.leaves) - 1, last + 1)
        before = self._before(first)
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - before] + replacement + region[end - before :]
        slots = last - first + 1
        parts = split_leaves(region, max(self.leaf_chars, len(region) // slots))
        parts = parts[: slots - 1] + ["".join(parts[slots - 1 :])]
        for i in range(slots):
            self._set(first + i, parts[i] if i < len(parts) else "")
        low, high = (self.base + first) // 2, (self.base + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2

    def _before(self, leaf: int) -> int:
        node, total = self.base + leaf, 0
        while node > 1:
            if node % 2:
                total += self.chars[node - 1]
            node //= 2
        return total


def sample_edits(text: Column) -> Column:
    """Three edits for each text, made from its length alone: an insertion, a deletion and a replacement."""
    return edits_for(F.length(F.coalesce(text, F.lit(""))))


def edits_for(n: Column) -> Column:
    """The edits of :func:`sample_edits` for a text of n code points."""
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("text"))
    a, b, c = (n / 4).cast("int"), (n / 2).cast("int"), (n * 3 / 4).cast("int")
    return F.array(edit(a, a, " with 42 more words"), edit(b, b + 25, ""), edit(c, c + 10, "Grüße, 2024"))


TREE = "doc_id {kind}, version int, n_chars long, n_tokens long, leaves array<string>, tokens array<int>"


def build_trees(docs: DataFrame, leaf_chars: int = 512, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees of version 0, one for each row: doc_id, version, n_chars, n_tokens, leaves (their texts) and tokens (of each leaf)."""
    ranks = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            leaves = [split_leaves(t or "", leaf_chars) for t in batch.column(1).to_pylist()]
            tokens = [[len(encode(x)) for x in row] for row in leaves]
            yield _rows(batch.column(0), [0] * len(leaves), leaves, tokens)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, TREE.format(kind=plain.dtypes[0][1]))


def _rows(ids: pa.Array, versions: list[int], leaves: list[list[str]], tokens: list[list[int]], **more: list[int]) -> pa.RecordBatch:
    long = pa.int64()
    columns = {
        "doc_id": ids, "version": pa.array(versions, pa.int32()), "n_chars": pa.array([sum(map(len, x)) for x in leaves], long), "n_tokens": pa.array(list(map(sum, tokens)), long),
        "leaves": pa.array(leaves, pa.list_(pa.string())), "tokens": pa.array(tokens, pa.list_(pa.int32())), **{k: pa.array(v, long) for k, v in more.items()},
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def recount(trees: DataFrame, edits: Column, leaf_chars: int = 512, tokenizer: str | None = None) -> DataFrame:
    """The trees after their edits (arrays of start, end, text), with n_tokens_before, n_leaves_encoded and n_chars_encoded: what was encoded again."""
    ranks = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            done = []
            for leaves, tokens, changes in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                tree = CountTree(leaves, encode, leaf_chars, tokens)
                before = tree.n_tokens
                for change in changes or ():
                    if change is not None and change["start"] is not None and change["end"] is not None:
                        tree.edit(change["start"], change["end"], change["text"] or "")
                done.append((tree.leaves, tree.tokens[tree.base : tree.base + len(tree.leaves)], before, tree.encoded_leaves, tree.encoded_chars))
            leaves, tokens, before, n_leaves, n_chars = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [], [], [])
            yield _rows(batch.column(0), [v + 1 for v in batch.column(1).to_pylist()], leaves, tokens, n_tokens_before=before, n_leaves_encoded=n_leaves, n_chars_encoded=n_chars)

    schema = TREE.format(kind=dict(trees.dtypes)["doc_id"]) + ", n_tokens_before long, n_leaves_encoded long, n_chars_encoded long"
    return trees.select("doc_id", "version", "leaves", "tokens", edits.alias("edits")).mapInArrow(run, schema)


def recount_table(trees: DataFrame, edits: DataFrame, **settings) -> DataFrame:
    """:func:`recount` with a table of edits: doc_id, nth (their order), start, end, text. Trees without edits are given unchanged but for the version.

    Edits are few beside texts: they are gathered by document, and trees without any are never encoded.
    """
    one = F.struct("nth", "start", "end", "text")
    listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(F.sort_array(F.collect_list(one)).alias("_edits"))
    bare = F.transform("_edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text")))
    return recount(trees.join(listed, trees["doc_id"] == F.col("_of"), "left"), bare, **settings)
