"""Token counts that follow edits without counting whole documents again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import in_frames, text_of, trimmed
from termspire.llm.tokenizer import default_path, encoder


#: Characters beyond which a leaf of several pre-token runs is split again after an edit.
LEAF_CHARS = 256
#: Rows, and bytes of text but for a single row, whose trees a worker holds at once.
ROWS, BYTES = 512, 1 << 22


def _sums(values: list[int], base: int) -> list[int]:
    """A heap of subtree sums: node i has the children 2i and 2i + 1, leaves start at ``base``."""
    level = np.zeros(base, np.int64)
    level[: len(values)] = values
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1)
        levels.append(level)
    return [0, *np.concatenate(levels[::-1]).tolist()]


class PretokenTree:
    """A segment tree over the pre-token runs of one text.

    A leaf is a run of pre-tokens between two places where pre-tokens always
    end. Inner nodes hold the sums of characters and of tokens below them. An
    edit re-encodes the leaves that it touches and their boundary context, deals what comes out to these leaves
    again, and corrects the sums above; if they can't hold it in pieces of LEAF_CHARS, leaves are added and the sums made anew, by
    additions only. ``encoded`` counts the characters encoded again.
    """

    def __init__(self, leaves: list[str], counts: list[int], enc):
        self.enc, self.encoded = enc, 0
        self._lay(leaves, counts)

    @classmethod
    def of_text(cls, text: str, enc) -> PretokenTree:
        return cls(*cut(text, enc), enc)

    def _lay(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = _sums(list(map(len, leaves)), self.base), _sums(counts, self.base)

    def counts(self) -> list[int]:
        """Tokens of each leaf."""
        return self.tokens[self.base : self.base + len(self.leaves)]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at``, and the place in it."""
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _fixed(self, i: int) -> bool:
        """Whether the start of leaf ``i`` ends pre-tokens whatever stands before it."""
        leaf = self.leaves[i]
        return len(leaf) > 1 and leaf[0] == " " and not leaf[1].isspace()

    def _put(self, i: int, leaf: str, count: int) -> None:
        self.leaves[i] = leaf
        i += self.base
        chars, tokens = len(leaf) - self.chars[i], count - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` by ``new``; both are cut to the text."""
        start = min(max(0, start), self.n_chars)
        end = min(start + max(0, length), self.n_chars)
        last = len(self.leaves) - 1
        i, a = self._find(start) if start < self.n_chars else (last, len(self.leaves[last]))
        j, b = self._find(end) if end < self.n_chars else (last, len(self.leaves[last]))
        # The left border must not depend on what changes.
        while i and not (self._fixed(i) and a >= 2):
            i -= 1
            a += len(self.leaves[i])
        while j < last and not self._fixed(j + 1):
            j += 1
        region = "".join(self.leaves[i : j + 1])
        changed = region[:a] + new + region[a + end - start :]
        self.encoded += len(changed)
        # A region that starts inside the text starts with the space of its first run.
        parts, counts = cut(changed, self.enc)
        slots = j - i + 1
        each = -(-len(parts) // slots)
        groups = [("".join(parts[k : k + each]), sum(counts[k : k + each])) for k in range(0, each * slots, each)]
        if each > 1 and max(len(leaf) for leaf, _ in groups) > LEAF_CHARS:
            old = self.counts()
            self._lay(self.leaves[:i] + parts + self.leaves[j + 1 :], old[:i] + counts + old[j + 1 :])
            return
        for k, (leaf, count) in enumerate(groups, i):
            if leaf or self.leaves[k]:
                self._put(k, leaf, count)


def cut(text: str, enc) -> tuple[list[str], list[int]]:
    """The leaves of a text, which make it up, and the tokens of each."""
    parts, counts = enc.counts(text)
    leaves = [parts[0], *(" " + p for p in parts[1:])]
    return (leaves[1:], counts[1:]) if len(leaves) > 1 and not leaves[0] else (leaves, counts)


def build(docs: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """The trees of all texts, to be written and edited later: (id, n_tokens, n_chars, text, lengths, counts).

    ``lengths`` and ``counts`` are the characters and tokens of the leaves in order; sums above them are additions
    when a tree is loaded. Null text is empty; rows that repeat are trees of their own; a very long text is one tree, held whole by
    the task that builds or edits it, while of others it holds some at a time; an empty table gives none. Columns of other names are ignored.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), text_of().alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in _slices(batches):
            sums, lengths, counts = [], [], []
            for text in batch["text"].to_pylist():
                leaves, own = cut(text, enc)
                lengths.append(np.fromiter(map(len, leaves), np.int32, len(leaves)))
                counts.append(np.array(own, np.int32))
                sums.append((sum(own), len(text)))
            yield _batch(batch["id"], ["n_tokens", "n_chars"], sums, batch["text"], lengths, counts)

    return rows.mapInArrow(trimmed(make), _shape(rows, "n_tokens long, n_chars long, " + _TREE)).withColumnRenamed("id", id_col)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ROWS rows and, but for single rows, BYTES of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = before = 0
        while start < batch.num_rows:
            stop = min(start + ROWS, max(start + 1, int(np.searchsorted(ends, before + BYTES, "right"))))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def _batch(ids: pa.Array, names: list[str], numbers: list[tuple[int, ...]], text: pa.Array | None = None, *lists: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of an id, long columns and, with ``text``, a tree: the text, lengths and counts."""
    columns = [ids, *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True))]
    if text is None:
        return pa.RecordBatch.from_arrays(columns, ["id", *names])
    for rows in lists:
        starts = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(rows))))
    columns.insert(-2, text)
    return pa.RecordBatch.from_arrays(columns, ["id", *names, "text", "lengths", "counts"])


_TREE = "text string, lengths array<int>, counts array<int>"
_COUNTS = "n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, n_chars_encoded long"


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's values."""
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    return (values[a:z] for a, z in zip(at, at[1:], strict=False))


def _shape(rows: DataFrame, rest: str) -> str:
    return f"id {dict(rows.dtypes)['id']}, {rest}"


def _applied(tree: PretokenTree, edits) -> int:
    edits = [] if edits is None else [e for e in edits if e is not None]
    for e in edits:
        tree.edit(int(e["start"] or 0), int(e["length"] or 0), e["new"] or "")
    return len(edits)


def edit(trees: DataFrame, id_col: str = "doc_id", edits_col: str = "edits", path: str | None = None, keep: bool = True) -> DataFrame:
    """Apply edits to stored trees: the columns of :func:`count_tokens` and, with ``keep``, the new trees' text, lengths and counts.

    ``trees`` are those of :func:`build`, or of an earlier ``edit`` (whose ``n_tokens_edited`` and ``n_chars_edited`` are then
    n_tokens and n_chars), with a column of edits as :func:`count_tokens` takes. Only leaves that edits touch are encoded.
    Rows without edits cost no Python and, without ``keep``, aren't read beyond their sums.
    """
    path = path or default_path()
    has = F.coalesce(F.size(edits_col) > 0, F.lit(False))
    some = trees.where(has).select(F.col(id_col).alias("id"), "n_tokens", "text", "lengths", "counts", F.col(edits_col).alias("edits"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(path), [c.split()[0] for c in _COUNTS.split(", ")]
        for batch in _slices(batches):
            out, texts, lengths, counts = [], [], [], []
            own = zip(*(batch[c].to_pylist() for c in ("n_tokens", "text", "edits")), *(_rows(batch[c]) for c in ("lengths", "counts")), strict=True)
            for before, text, edits, sizes, tokens in own:
                ends = np.cumsum(sizes).tolist()
                tree = PretokenTree([text[a:z] for a, z in zip([0, *ends], ends, strict=False)], tokens.tolist(), enc)
                n = _applied(tree, edits)
                out.append((before, tree.n_tokens, tree.n_chars, n, tree.encoded))
                if keep:
                    left = [(len(leaf), c) for leaf, c in zip(tree.leaves, tree.counts(), strict=True) if leaf] or [(0, 0)]
                    texts.append(tree.text())
                    for column, values in zip((lengths, counts), zip(*left, strict=True), strict=True):
                        column.append(np.array(values, np.int32))
            tree_columns = (pa.array(texts, batch["text"].type), lengths, counts) if keep else ()
            yield _batch(batch["id"], names, out, *tree_columns)

    done = some.mapInArrow(trimmed(work), _shape(some, _COUNTS + f", {_TREE}" * keep)).withColumnRenamed("id", id_col)
    zero = F.lit(0).cast("long")
    same = trees.where(~has).select(
        id_col, "n_tokens", F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"),
        zero.alias("n_edits"), zero.alias("n_chars_encoded"), *["text", "lengths", "counts"] * keep,
    )
    return done.unionByName(same)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """Token counts before and after edits, in one pass over texts whose trees aren't kept.

    ``docs`` has the id, ``text`` and ``edits_col``, an array of structs
    (start int, length int, new string) that apply one after another to the
    text as it then is, in characters. Null text is empty, null edits are none,
    a null part of an edit counts as 0 or the empty string, and places beyond the
    text are cut to it. Rows that repeat count each, an empty table gives no rows. Returns (id, n_tokens, n_tokens_edited, n_chars_edited,
    n_edits, n_chars_encoded), a row for each row; other columns are ignored.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), text_of().alias("text"), F.col(edits_col).alias("edits"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            out = []
            for key, text, edits in zip(batch["id"].array, batch["text"], batch["edits"], strict=True):
                tree = PretokenTree.of_text(text, enc)
                before, n = tree.n_tokens, _applied(tree, edits)
                out.append((key, before, tree.n_tokens, tree.n_chars, n, tree.encoded))
            yield pd.DataFrame(out, columns=["id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", "n_chars_encoded"])

    kind = dict(rows.dtypes)["id"]
    return in_frames(
        rows, count,
        f"id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, n_chars_encoded long",
    ).withColumnRenamed("id", id_col)
