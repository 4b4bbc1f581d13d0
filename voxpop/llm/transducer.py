"""SentencePiece encoding and decoding as a weighted transducer (operator 5).

Compiled from a model file: the normaliser (a dummy prefix and the space mark),
a trie of the pieces, byte fallback for characters that no piece has, and the
weights. Encoding composes the machine with an input and takes the shortest
path in the tropical semiring; decoding runs it backwards.

In a BPE model the library applies merges by rank, and no sum of piece scores
gives the same result. The weights are therefore on pairs of neighbouring
pieces: 0 where the two may stand side by side, infinite where merging would
have joined a symbol across their border first. Every prefix of an input has
exactly one segmentation of weight 0, its BPE encoding, so a state is a
position, each state keeps one arc, and the shortest path is found in one pass.
Whether a pair may stand follows from the edges of the two pieces: the symbols
at the border while each piece is merged, and the rank at which each goes.

Pieces never run across a space mark or a line break, so texts are cut there
and the paths of recent chunks are remembered (at most ``MEMORY``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxpop.session import ship_package

MODEL = "piece_bpe_32k.model"
#: Chunks whose paths a worker remembers.
MEMORY = 400_000
SPACE = "▁"
_NEVER = float("inf")


class Transducer:
    """The compiled machine of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are compiled")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.ids = normal
        self.rank = {p: -model.pieces[i].score for p, i in normal.items()}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.silent = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece runs across a space mark or a line break")
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.trie: dict = {}
        for piece, i in normal.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.paths: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, dict[int, bool]] = {}  # left piece -> right piece -> whether they may stand

    def merged(self, text: str, at_border=None) -> list[str]:
        """Symbols after merging by rank, leftmost first; ``at_border(symbols, rank)`` sees each step."""
        symbols = list(text)
        while True:
            best, where = _NEVER, -1
            for k in range(len(symbols) - 1):
                r = self.rank.get(symbols[k] + symbols[k + 1], _NEVER)
                if r < best:
                    best, where = r, k
            if at_border:
                at_border(symbols, best)
            if where < 0:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def edge(self, i: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """(symbol, rank at which it goes) at the left and at the right edge while piece i is merged; None if merging doesn't give it."""
        if i not in self.edges:
            left, right = [], []

            def seen(symbols, rank):
                for side, symbol in ((left, symbols[0]), (right, symbols[-1])):
                    if side and side[-1][0] == symbol:
                        side[-1] = (symbol, rank)
                    else:
                        side.append((symbol, rank))

            whole = self.merged(self.pieces[i], seen)
            self.edges[i] = (left, right) if whole == [self.pieces[i]] else None
        return self.edges[i]

    def may_stand(self, i: int, j: int) -> bool:
        """Whether merging keeps the border between pieces i and j."""
        left, right = self.edge(i), self.edge(j)
        if left is None or right is None:
            return False
        rank = self.rank
        for a, a_goes in left[1]:
            for b, b_goes in right[0]:
                r = rank.get(a + b)
                if r is not None and r < a_goes and r <= b_goes:
                    return False
        return True

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def shortest_path(self, chunk: str) -> tuple[int, ...]:
        """The ids along the path of weight 0 through the composition with one chunk."""
        if chunk.startswith(SPACE * 2):  # pieces of space marks alone tie in rank, which pairs don't tell apart
            symbols = self.merged(chunk[:64]) if len(chunk) <= 64 else self._long_spaces(chunk)
            out: list[int] = []
            for s in symbols:
                out += [self.ids[s]] if s in self.ids else [x for c in s for x in self._bytes(c)]
            return tuple(out)
        n, trie, pairs, ids = len(chunk), self.trie, self.pairs, self.ids
        start, piece = [-1] * (n + 1), [-1] * (n + 1)  # of the arc that ends here; piece -1: bytes
        for at in range(n):
            if at and start[at] < 0:
                continue
            before, node, to = piece[at], trie, at
            may = pairs.get(before)
            if may is None:
                may = pairs[before] = {}
            while to < n:
                node = node.get(chunk[to])
                if node is None:
                    break
                to += 1
                if start[to] < 0 and "" in node:
                    i = node[""]
                    ok = may.get(i)
                    if ok is None:
                        ok = may[i] = before < 0 or self.may_stand(before, i)
                    if ok:
                        start[to], piece[to] = at, i
            if start[at + 1] < 0 and chunk[at] not in ids:
                start[at + 1] = at
        out, at = [], n
        while at:
            out.append((piece[at],) if piece[at] >= 0 else self._bytes(chunk[start[at]]))
            at = start[at]
        return tuple(x for ids in reversed(out) for x in ids)

    def _long_spaces(self, chunk: str) -> list[str]:
        import heapq

        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                both = symbols[k] + symbols[after[k]]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both], k, both))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if symbols[k] is None or after[k] < 0 or symbols[k] + symbols[after[k]] != both:
                continue
            gone = after[k]
            symbols[k], symbols[gone] = both, None
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [s for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.paths, []
        for chunk in self.chunks.findall(self.prefix + text.replace(" ", SPACE)):
            path = known.get(chunk)
            if path is None:
                if len(known) >= MEMORY:
                    known.clear()
                    self.pairs.clear()
                path = self.shortest_path(chunk)
                if len(chunk) <= 64:
                    known[chunk] = path
            out += path
        return out

    def decode(self, ids) -> str:
        parts, raw = [], bytearray()
        byte_of, silent, pieces = self.byte_of, self.silent, self.pieces
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in silent:
                parts.append(pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: str = MODEL) -> Transducer:
    import public_tokenizers

    return Transducer(public_tokenizers.path(model))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL) -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers; null and empty texts have none, repeated rows stay.

    The space mark itself in a text encodes like a space, as in the library.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            ids = [np.array(machine.encode(t.as_py()), "<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", *, model: str = MODEL) -> DataFrame:
    """``encoded`` (id, ids) with the text that the ids spell; null ids spell the empty text."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = [machine.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, text string")
