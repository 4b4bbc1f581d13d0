"""Exact dedup by owners in Patricia tries (operator 13).

Texts are equal when their bytes are, after lower-casing A-Z. Every task of the
first pass inserts the full byte strings of its rows into a compressed radix
trie, whose terminal nodes store the owner of their text (the row that stays)
and the number of rows, so however many copies a task holds, one leaves it.
These classes are dealt by length and content hash; the tries of the second
pass merge them byte by byte, so a hash alone never makes two texts equal.

A trie holds at most ``TRIE_BYTES`` of labels. Beyond that the first pass
spills its heaviest subtree: its classes go to the second pass as they are,
where they meet their like. The second pass reads whole (length, hash) groups
one after the other and empties the trie between two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from voxpop.llm.common import settled, written

#: Label bytes that the trie of a task holds before it spills a subtree.
TRIE_BYTES = 64 << 20
#: Bytes of texts in one outgoing batch.
BATCH_BYTES = 8 << 20


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


class Patricia:
    """A compressed radix trie over byte strings; every edge has a label, every terminal node a value."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.held = 0  # label bytes
        self._weight: dict[int, int] = {}  # by first byte

    def terminal(self, key: bytes) -> _Node:
        """The node at which ``key`` ends, made if need be; its value is None if it is new."""
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self._add(key[0], size - at)
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key[at : at + len(label)])
            upper = _Node(label[:n])
            child.label = label[n:]
            upper.children[label[n]] = child
            node.children[key[at]] = upper
            node, at = upper, at + n
        return node

    def _add(self, first: int, size: int) -> None:
        self.held += size
        self._weight[first] = self._weight.get(first, 0) + size

    def heaviest(self) -> int:
        return max(self._weight, key=self._weight.__getitem__)

    def pop(self, first: int) -> Iterator[tuple[bytes, object]]:
        """Takes the subtree of a first byte out and yields its texts and values."""
        self.held -= self._weight.pop(first)
        return _walk(self.root.children.pop(first))

    def clear(self) -> Iterator[tuple[bytes, object]]:
        """Takes everything out, the empty text included."""
        root = self.root
        self.__init__()
        return _walk(root)


def _walk(top: _Node) -> Iterator[tuple[bytes, object]]:
    stack = [(top, b"")]
    while stack:
        node, before = stack.pop()
        text = before + node.label
        if node.value is not None:
            yield text, node.value
        stack.extend((c, text) for c in node.children.values())


def _better(a: tuple, b: tuple, largest: bool) -> bool:
    """Whether owner ``a`` (id, row) takes the place of ``b``: ids decide, then the first row; a null id owns only among null ids."""
    if a[0] is None or b[0] is None:
        return b[0] is None and (a[0] is not None or a[1] < b[1])
    return (a[0] > b[0] if largest else a[0] < b[0]) or (a[0] == b[0] and a[1] < b[1])


def _frames(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[text_at] or b"")
        if size >= BATCH_BYTES:
            yield _frame(held, schema)
            held, size = [], 0
    if held:
        yield _frame(held, schema)


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in ddl])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest") -> DataFrame:
    """Groups of equal texts -> one row per input row: the id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the row with the ``"largest"`` or the ``"smallest"`` id of a
    group stays. A null text counts as empty; empty texts are equal to each other.
    Of rows that repeat the owner's id and text one stays. A null id owns its
    group only if all ids there are null; keep_id is null then. An empty table
    gives an empty result. Other columns are not read, whatever their names.

    The result is a table written to the shared checkpoint folder; the
    intermediate ones are deleted.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    largest = keep == "largest"
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    first = StructType().add("row", "long").add("ref", "long").add("id", id_type).add("size", "long").add("hash", "binary")
    first = first.add("text", "binary").add("owner", id_type).add("owner_row", "long").add("n", "long")
    out1 = _arrow(first)

    def classes_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, row = Patricia(), TaskContext.get().partitionId() << 33

        def leaving(found):  # value: [ref, owner, owner's row, rows]
            for text, (ref, owner, owner_row, n) in found:
                yield (None, ref, None, len(text), hashlib.sha256(text).digest(), text, owner, owner_row, n)

        for batch in batches:
            members = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (text or b"").lower()  # of bytes: A-Z alone
                node = trie.terminal(key)
                v = node.value
                if v is None:
                    v = node.value = [row, ident, row, 0]
                elif _better((ident, row), (v[1], v[2]), largest):
                    v[1], v[2] = ident, row
                v[3] += 1
                members.append((row, v[0], ident, None, None, None, None, None, None))
                row += 1
                while trie.held > TRIE_BYTES:
                    yield from _frames(leaving(trie.pop(trie.heaviest())), out1, 5)
            yield from _frames(iter(members), out1, 5)
        yield from _frames(leaving(trie.clear()), out1, 5)

    held, path = written(rows.mapInArrow(classes_of_task, first), "exact-classes")
    second = StructType().add("ref", "long").add("keep_id", id_type).add("owner_row", "long").add("group_size", "long")
    second = second.add("text_sha256", "string")
    out2 = _arrow(second)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, group = Patricia(), None

        def done():  # value: [owner, owner's row, rows, refs, hash]
            for _, (owner, owner_row, n, refs, digest) in trie.clear():
                yield from ((ref, owner, owner_row, n, digest.hex()) for ref in refs)

        for batch in batches:
            for ref, size, digest, text, owner, owner_row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (size, digest) != group:
                    if trie.held > TRIE_BYTES:
                        yield from _frames(done(), out2, 4)
                    group = (size, digest)
                node = trie.terminal(text)
                if node.value is None:
                    node.value = [owner, owner_row, 0, [], digest]
                v = node.value
                if _better((owner, owner_row), (v[0], v[1]), largest):
                    v[0], v[1] = owner, owner_row
                v[2] += n
                v[3].append(ref)
        yield from _frames(done(), out2, 4)

    texts = held.where("row is null").select("ref", "size", "hash", "text", "owner", "owner_row", "n")
    texts = texts.repartition("size", "hash").sortWithinPartitions("size", "hash")
    owners, owners_path = written(texts.mapInArrow(merged, second), "exact-owners")
    every = held.where("row is not null").select("row", "ref", "id").join(owners, "ref")
    kept = (F.col("row") == F.col("owner_row")).alias("kept")
    return settled(every.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, "text_sha256"), "exact", path, owners_path)
