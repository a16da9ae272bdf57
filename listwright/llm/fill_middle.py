"""Fill-in-the-middle: texts rearranged around sentinels, as cuts and joins of a rope.

A text is a rope: a balanced tree whose leaves are runs of whole units (lines with their line feed),
and whose nodes cache how many units and code points are below them. It is cut at two unit ranks, and
the three sub-ropes are joined again, with sentinels, in the order of the form; a leaf is only copied
where a cut falls inside of it. Going back, the output is a rope again, cut at the code points where
its sentinels stand, and its parts are joined in their first order.

Where to cut follows from the document's id alone: h1 to h4 are the first four 8-digit groups of the
sha256 of ``seed:doc_id``. h1 and h2 give the two ranks, h3 whether the text is rearranged at all, h4
the form: ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle.

Defined results: a null or empty text, or one that holds a sentinel, stays as it is (``plain``), with no
prefix or middle; any other text can be read back, as no sentinel arises where parts and sentinels meet.
A null doc_id hashes as ``seed:`` alone. A text without a line feed is one unit, however long. Repeated
rows give equal rows, rows that share a doc_id equal hashes. An empty table gives an empty table. Only
``doc_id`` and ``text`` are read. A very long text is one row, as it is in the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM = 7, 100, 50
#: Code points of a leaf from which the next unit starts another.
LEAF = 2048


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Rope:
    """A node: a leaf with text, or the join of two ropes; ``units`` and ``chars`` hold for all below."""

    __slots__ = ("left", "right", "text", "units", "chars", "height")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.units, self.chars, self.height = units, len(text), 0
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.height = 1 + max(left.height, right.height)

    def __str__(self) -> str:
        """The leaves in order; a stack of its own, as the order of nodes is all that is needed."""
        out, rest = [], [self]
        while rest:
            node = rest.pop()
            if node.left is None:
                out.append(node.text)
            else:
                rest += (node.right, node.left)
        return "".join(out)


def join(a: Rope, b: Rope) -> Rope:
    """One rope of two. The shorter tree goes down the taller one's side, so heights stay logarithmic."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return Rope(left=a, right=b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes, one of which may have grown a level too tall: it gives its inner side away."""
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
        return Rope(left=Rope(left=a, right=b.left), right=b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
        return Rope(left=a.left, right=Rope(left=a.right, right=b))
    return Rope(left=a, right=b)


def units_of(text: str) -> int:
    """Lines of a text; the last one may lack its line feed."""
    return text.count("\n") + (1 if text and text[-1] != "\n" else 0)


def rope(text: str) -> Rope:
    """A balanced rope whose leaves end at line feeds."""
    leaves, at = [], 0
    while at < len(text):
        cut = text.find("\n", at + LEAF - 1) + 1 or len(text)
        leaves.append(Rope(part := text[at:cut], units_of(part)))
        at = cut
    while len(leaves) > 1:
        paired = [Rope(left=a, right=b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = paired + leaves[2 * len(paired) :]
    return leaves[0] if leaves else Rope()


def _leaf_cut(leaf: Rope, at: int) -> tuple[Rope, Rope]:
    head, tail = leaf.text[:at], leaf.text[at:]
    return Rope(head, units_of(head)), Rope(tail, units_of(tail))


def cut_units(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0:
        return Rope(), node
    if rank >= node.units:
        return node, Rope()
    if node.left is None:
        at = 0
        for _ in range(rank):
            at = node.text.index("\n", at) + 1
        return _leaf_cut(node, at)
    if rank <= node.left.units:
        a, b = cut_units(node.left, rank)
        return a, join(b, node.right)
    a, b = cut_units(node.right, rank - node.left.units)
    return join(node.left, a), b


def cut_chars(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest."""
    if rank <= 0:
        return Rope(), node
    if rank >= node.chars:
        return node, Rope()
    if node.left is None:
        return _leaf_cut(node, rank)
    if rank <= node.left.chars:
        a, b = cut_chars(node.left, rank)
        return a, join(b, node.right)
    a, b = cut_chars(node.right, rank - node.left.chars)
    return join(node.left, a), b


def numbers(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


class Moved(NamedTuple):
    """A text's units, its form, code points of prefix and middle (None if plain) and the output."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def rearranged(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: Sentinels = Sentinels()) -> Moved:
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return Moved(units_of(text), "plain", None, None, text)
    whole = rope(text)
    n = whole.units
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = cut_units(whole, second)
    prefix, middle = cut_units(head, first)
    p, s, m = (Rope(x) for x in marks)
    form = "spm" if h4 % 100 < spm else "psm"
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = order[0]
    for part in order[1:]:
        out = join(out, part)
    return Moved(n, form, prefix.chars, middle.chars, str(out))


def restored(output: str, form: str, marks: Sentinels = Sentinels()) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    order = (marks.suffix, marks.prefix, marks.middle) if form == "spm" else marks[:3]
    rest, parts = rope(output), {}
    at = [output.index(x) for x in order]
    for mark, start, end in reversed(list(zip(order, at, [*at[1:], len(output)], strict=True))):
        rest, part = cut_chars(rest, start)
        parts[mark] = cut_chars(part, len(mark))[1]
    return str(join(join(parts[marks.prefix], parts[marks.middle]), parts[marks.suffix]))


MOVED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: Sentinels = Sentinels()) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and the output itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = [rearranged(d, t.as_py() or "", seed, rate, spm, marks) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MOVED)


def restore(moved: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """``transform``'s rows with ``restored``: the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, outputs = batch.column(batch.schema.get_field_index("form")), batch.column(batch.schema.get_field_index("output"))
            texts = [restored(o.as_py(), f.as_py(), marks) for o, f in zip(outputs, forms, strict=True)]
            yield batch.append_column("restored", pa.array(texts, pa.string()))

    return moved.mapInArrow(run, f"{MOVED}, restored string")


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: Sentinels = Sentinels()) -> DataFrame:
    """The transformation's result per document, with digests of the output and of the text read back from it."""
    both = restore(transform(docs, seed, rate, spm, marks), marks)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
