"""SentencePiece encoding and decoding as relations.

Encoding finds for every text the segmentation into pieces with the largest sum of scores, as the library's unigram
segmenter does on the same pieces; ties go to the longer last piece. Characters without a piece cost the smallest score
less ten and become byte pieces.

1. Each task cuts its texts into words, where no piece reaches from one into the next, and numbers the words it does not
   know yet, up to a bound (`words`). What it knows goes with the task: Spark keeps idle workers, and what those held
   would be missing to all later work of their executor.
2. The new words of a batch become units. A cut between two characters is safe where no piece holds them side by side, so
   each unit can be segmented for itself.
3. From all characters of all units at once, a walk down the tree of pieces gives the edges of the lattices: one step for
   each character of the longest piece, over the places where some piece may still go on.
4. The edges are folded by end and size, all units side by side: for each end the best edge stays. A walk back from the
   last ends, again side by side, marks the best paths. Few units have more than LONG characters (a text that pieces cover
   without a safe cut, as many equal characters); they would make as many steps and are folded one at a time, by a
   function that looks their substrings up as it goes and holds a few numbers per character.

Words do not leave their task: on the corpora measured a word in 17 is new, and sending words and their ids between tasks
took more than the texts themselves. So nothing is shuffled, and no key can be hot.

Decoding puts the bytes of the pieces one after the other. `encode` can do so in its own pass, since two passes in one
stage take two workers for each task.

Defined cases: null and empty texts have no ids and decode to the empty text; a text's own U+2581 decodes to a space, as
with the library; rows are never matched by doc_id, so nulls and repeats pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .words import WordIds, gathered

SPACE = "▁"
UNKNOWN_COST = 10.0
# Rows that a task codes at once, words that it knows, characters of units that are folded side by side, and
# characters of a unit that goes alone.
ROWS, KNOWN, SIDE, LONG = 256, 400_000, 1 << 17, 64
# Bits of a code point.
_CHAR = 21


@dataclass
class Pieces:
    """A piece table: strings and scores by id, and the ids of the 256 byte pieces."""

    strings: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Pieces of a model file, read on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [not s for s in special], byte_ids)

    @cached_property
    def longest(self) -> int:
        return max(len(s) for s, n in zip(self.strings, self.normal) if n)

    @cached_property
    def inside(self) -> set[str]:
        """Pairs of neighbouring characters of the pieces: cuts between other pairs are safe."""
        return {s[i : i + 2] for s, n in zip(self.strings, self.normal) if n for i in range(len(s) - 1)}

    @property
    def unknown_score(self) -> float:
        return min(x for x, n in zip(self.scores, self.normal) if n) - UNKNOWN_COST

    def bytes_by_id(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        out = [s.encode() if n else b"" for s, n in zip(self.strings, self.normal)]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


class Lattice:
    """Best paths through the pieces of many words at once."""

    def __init__(self, pieces: Pieces):
        normal = [(s, float(x), i) for i, (s, x, n) in enumerate(zip(pieces.strings, pieces.scores, pieces.normal)) if n]
        self.scores = {s: (x, i) for s, x, i in normal}
        self.longest, self.unknown = pieces.longest, pieces.unknown_score
        # The tree of pieces: (node, character) to node, and the piece that ends at a node. The root is 0.
        nodes, ends = {}, [-1]
        for s, _, i in normal:
            node = 0
            for c in s:
                node = nodes.setdefault(node << _CHAR | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.step = np.array(sorted(nodes), np.int64)
        self.node = np.array([nodes[k] for k in self.step.tolist()], np.int64)
        self.piece = np.array(ends, np.int32)
        self.score = np.array(pieces.scores, np.float64)
        self.inside = np.array(sorted({ord(p[0]) << _CHAR | ord(p[1]) for p in pieces.inside}), np.int64)
        self.bytes = np.array(pieces.byte_ids, np.int32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, which follow a space each, and how many each has."""
        chars = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        cut = np.ones(len(chars), bool)
        cut[1:] = ~_held(self.inside, chars[:-1] << _CHAR | chars[1:])[0]
        cut[begin] = True
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(chars)))
        found = [(np.empty(0, np.int64), np.empty(0, np.int32))]
        for i in np.flatnonzero(length > LONG).tolist():
            unit = chars[first[i] : first[i] + length[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(long_path(unit, self.scores, self.longest, self.unknown), np.int32)
            found.append((np.full(len(ids), i), ids))
        short = np.flatnonzero(length <= LONG)
        group = np.cumsum(length[short]) // SIDE
        for some in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
            at, ids = self.paths(gathered(chars, first[some], length[some]), length[some])
            found.append((some[at], ids))
        unit, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(unit, kind="stable")
        unit, ids = self._in_bytes(unit[order], ids[order])
        return ids, np.bincount(np.searchsorted(begin, first[unit], "right") - 1, minlength=len(words))

    def paths(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that stand one after the other, and the unit of each; a character without a piece gets a
        negative id that holds its code point."""
        first = np.cumsum(length) - length
        unit = np.repeat(np.arange(len(length)), length)
        stop = np.repeat(first + length, length)
        begins, pieces = [], []
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for size in range(1, self.longest + 1):
            known, place = _held(self.step, node << _CHAR | chars[at + size - 1])
            node = np.where(known, self.node[place], 0)
            piece = self.piece[node]
            if size == 1:
                begins.append(at), pieces.append(np.where(piece < 0, -1 - chars, piece))
            else:
                begins.append(at[piece >= 0]), pieces.append(piece[piece >= 0])
            on = known & (at + size < stop[at])
            at, node = at[on], node[on]
        size = np.repeat(np.arange(1, len(begins) + 1, dtype=np.int16), [len(b) for b in begins])
        begin, piece = np.concatenate(begins), np.concatenate(pieces)
        step = (begin - first[unit[begin]] + size).astype(np.uint16)
        # Edges come by size already; a step is one end within every unit.
        order = np.argsort(step, kind="stable")
        begin, piece, size, step = begin[order], piece[order], size[order], step[order]
        score = np.where(piece < 0, self.unknown, self.score[np.maximum(piece, 0)])
        # A unit of n characters has n + 1 places.
        begin = begin + unit[begin]
        end = begin + size
        total, back = np.full(len(chars) + len(length), -np.inf), np.zeros(len(chars) + len(length), np.int64)
        starts = first + np.arange(len(length))
        total[starts] = 0.0
        edges = np.flatnonzero((np.diff(step) != 0) | (np.diff(size) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(step)]):
            to, here = end[lo:hi], total[begin[lo:hi]] + score[lo:hi]
            # Sizes grow within a step: the longer one of equals stays.
            better = np.flatnonzero(here >= total[to])
            total[to[better]], back[to[better]] = here[better], lo + better
        used, inner = np.zeros(len(total), bool), np.ones(len(total), bool)
        inner[starts] = False
        now = starts + length
        while len(now):
            used[now] = True
            now = begin[back[now]]
            now = now[inner[now]]
        place = np.flatnonzero(used)
        return np.searchsorted(starts, place, "right") - 1, piece[back[place]].astype(np.int32)

    def _in_bytes(self, unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters without a piece."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return unit, ids
        fills = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[odd].tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(f) for f in fills]
        wide, out = np.repeat(ids, width), np.repeat(unit, width)
        wide[wide < 0] = self.bytes[np.frombuffer(b"".join(fills), np.uint8)]
        return out, wide


def _held(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where sorted ``keys`` hold each of ``wanted``."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def words_of(text: str, whole: bool) -> list[str]:
    """A text as words that follow a space each; ``whole`` if no piece reaches over the end of a word."""
    if not text:
        return []
    if not whole:
        return [text.replace(" ", SPACE)]
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        # Several spaces stay together, as pieces hold them.
        return [w[1:] for w in _COARSE.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


_COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def long_path(unit: str, scores: dict[str, tuple[float, int]], longest: int, unknown: float) -> list[int]:
    """`Lattice.paths` of one unit, without its edges: the same sums and the same choice among equals."""
    n = len(unit)
    total, size, ids = np.zeros(n + 1), np.zeros(n + 1, np.int16), np.zeros(n + 1, np.int32)
    for end in range(1, n + 1):
        best = None
        for k in range(1, min(end, longest) + 1):
            found = scores.get(unit[end - k : end])
            if found is None and k == 1:
                found = (unknown, -1 - ord(unit[end - 1]))
            if found is not None:
                here = (total[end - k] + found[0], k, found[1])
                best = here if best is None or here > best else best
        total[end], size[end], ids[end] = best
    out, end = [], n
    while end:
        out.append(int(ids[end]))
        end -= int(size[end])
    return out[::-1]


def _coded(pieces: Pieces, keep: int, decoded: str | None = None):
    """Ids of texts, and the texts that these decode to in a column ``decoded``; the first ``keep`` columns pass through."""
    whole = not any(p[1] == SPACE and p[0] != SPACE for p in pieces.inside)
    added = ["ids"] if decoded is None else ["ids", decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(Lattice(pieces).words, KNOWN)
        table = None if decoded is None else pa.array(pieces.bytes_by_id(), pa.large_binary())
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                flat, size = known.ids([words_of(t, whole) for t in part.column(keep).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))
                out = [ids] if decoded is None else [ids, _decoded(ids, table)]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *out], names=[*batch.schema.names[:keep], *added])

    return lean(run)


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", keep: Sequence[str] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """The ``keep`` columns of every document and its ids; ``decoded`` names a column for the text that the ids decode to."""
    held = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + ", ids array<int>"
    if decoded is not None:
        schema += f", `{decoded}` string"
    rows = docs.select(*keep, F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(_coded(pieces, len(keep), decoded), schema)


def _decoded(ids: pa.Array, table: pa.Array) -> pa.Array:
    """Texts of lists of ids: taken in the order of the ids, the pieces' bytes stand one after the other."""
    lists = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
    taken = table.take(ids.flatten())
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    at = pa.py_buffer(ends[np.concatenate([[0], np.cumsum(lists)])])
    data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, at, data])
    try:
        shown = joined.cast(pa.large_string())
    except pa.ArrowInvalid:
        shown = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())
    return pc.utf8_slice_codeunits(pc.replace_substring(shown, SPACE, " "), 1).cast(pa.string())


def _texts(pieces: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces, pa.large_binary())
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = _decoded(part.column(part.num_columns - 1), table)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return lean(run)


def decode(tokens: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """Add the decoded text to a table that holds ids."""
    others = [c for c in tokens.columns if c != ids]
    schema = tokens.select(*others, ids).schema.add("decoded", "string")
    return tokens.select(*others, ids).mapInArrow(_texts(pieces.bytes_by_id()), schema)
