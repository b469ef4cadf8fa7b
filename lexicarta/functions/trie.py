"""A lexicon as a compact trie, and where its entries stand in the texts of an Arrow batch, for all places at once."""

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexicarta.functions.runs import Hashes
from lexicarta.functions.text import CONSONANTS

#: Code points fit in so many bits, below those of a node.
CHAR_BITS = 21
#: Native characters, those at which a syllable starts, and digits, which end one (as in functions/text).
NATIVE_FIRST, NATIVE_LAST = 0x1000, 0x109F
SYLLABLE_STARTS, NATIVE_DIGITS = np.array([ord(c) for c in CONSONANTS], np.uint32), np.arange(ord("၀"), ord("၉") + 1, dtype=np.uint32)
#: Of each native character, and of any other behind them: 0 outside of syllables, 1 in one, 2 at its start.
KINDS = np.ones(NATIVE_LAST - NATIVE_FIRST + 2, np.uint8)
KINDS[NATIVE_DIGITS - NATIVE_FIRST], KINDS[SYLLABLE_STARTS - NATIVE_FIRST], KINDS[-1] = 0, 2, 0
#: Places from which a trie is walked at once, and syllables or characters of a piece of a batch.
AT_ONCE = 1 << 18


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int = AT_ONCE):
    """A batch in slices of rows whose sizes add up to most or less; a larger row comes alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


class Trie:
    """Entries as sorted edges: an edge's key is its node and its character, its target is its place among the edges, plus one.

    Nodes are numbered level by level, so the edges of all levels stand in one sorted array. ends[node] is the
    number of the entry that ends at a node, -1 without one; meanings are those of the entries.
    """

    def __init__(self, chunks: list[str], meanings: list[str]):
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        self.meanings = [meanings[i] for i in order]
        texts = [chunks[i] for i in order]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        keys, ends, node = [], [np.full(1, -1, np.int64)], np.zeros(len(texts), np.int64)
        alive, made, level = np.flatnonzero(sizes > 0), 1, 0
        while len(alive):
            edges = (node[alive] << CHAR_BITS) | chars[starts[alive] + level]
            fresh, to = np.unique(edges, return_inverse=True)
            node[alive] = made + to
            level += 1
            last = alive[sizes[alive] == level]
            own = np.full(len(fresh), -1, np.int64)
            own[node[last] - made] = last
            keys.append(fresh)
            ends.append(own)
            made += len(fresh)
            alive = alive[sizes[alive] > level]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.ends = np.concatenate(ends)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(nodes), -1, np.int64)
        wanted = (nodes << CHAR_BITS) | chars
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at + 1, -1)


def contained(texts: pa.StringArray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry), each pair once and by row: the entries that stand anywhere in the texts. Null texts hold none."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row, stops = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
    pairs = []
    for first in range(0, len(chars), AT_ONCE):
        start = np.arange(first, min(first + AT_ONCE, len(chars)))
        place, node = start, np.zeros(len(start), np.int64)
        while len(start):
            node = trie.step(node, chars[place].astype(np.int64))
            keep = node >= 0
            start, place, node = start[keep], place[keep], node[keep]
            entry = trie.ends[node]
            hit = entry >= 0
            pairs.append(row[start[hit]] * len(trie.meanings) + entry[hit])
            place = place + 1
            keep = place < stops[start]
            start, place, node = start[keep], place[keep], node[keep]
    found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return found // max(1, len(trie.meanings)), found % max(1, len(trie.meanings))


class Syllables:
    """The syllables of a batch of texts, one after the other, in one buffer of bytes."""

    def __init__(self, column: pa.ListArray):
        flat = column.flatten()
        if column.null_count or flat.null_count or pc.any(pc.equal(pc.utf8_length(flat), 0)).as_py():  # neither null nor empty ones count
            column = pa.array([[s for s in row or () if s] for row in column.to_pylist()], column.type)
            flat = column.flatten()
        self.rows = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.n = len(flat)
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + self.n + 1] if self.n else np.zeros(1, np.int32)
        self.bytes = flat.buffers()[2] if self.n else pa.py_buffer(b"")
        self.byte_at = offsets
        text = self.bytes.to_pybytes()[offsets[0] : offsets[-1]].decode("utf-8", "surrogatepass")
        self.chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False) if self.n else np.empty(0, np.int64)
        self.char_at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.row_end = np.repeat(self.rows[1:], np.diff(self.rows))  # of each syllable, where its text ends

    @classmethod
    def of_texts(cls, column: pa.StringArray) -> "Syllables":
        """The syllables that text.split_syllables() finds in native texts, for all texts of a batch at once; null ones have none."""
        out = cls.__new__(cls)
        sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer("".join(t or "" for t in column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = KINDS[np.minimum(chars - np.uint32(NATIVE_FIRST), np.uint32(len(KINDS) - 1))]
        leads, part = kinds == 2, kinds > 0
        row = np.repeat(np.arange(len(sizes)), sizes)
        breaks = np.ones(len(chars), bool)  # a part of a syllable behind something else, or in another text
        breaks[1:] = ~part[:-1] | (row[1:] != row[:-1])
        starts = part & (leads | breaks)
        out.rows = np.concatenate([[0], np.cumsum(np.bincount(row[starts], minlength=len(sizes)))]).astype(np.int64)
        out.n, out.chars = int(out.rows[-1]), chars[part].astype(np.int64)
        out.char_at = np.append(np.flatnonzero(starts[part]), len(out.chars)).astype(np.int64)
        low = (chars[part] - np.uint32(NATIVE_FIRST)).astype(np.uint8)
        utf8 = np.stack([np.full_like(low, 0xE0 | NATIVE_FIRST >> 12), low >> 6 | 0x80, low & 0x3F | 0x80], 1)  # all native characters take three bytes
        out.bytes, out.byte_at = pa.py_buffer(utf8.tobytes()), (3 * out.char_at).astype(np.int32)
        out.row_end = np.repeat(out.rows[1:], np.diff(out.rows))
        return out

    @cached_property
    def hashes(self) -> Hashes:
        return Hashes(self.chars)

    def matches(self, trie: Trie, longest: int) -> list[np.ndarray]:
        """For each number of syllables, 1 to longest, the entry that so many from each place on make, -1 without one."""
        out = [np.full(self.n, -1, np.int64) for _ in range(longest)]
        at, node = np.arange(self.n), np.zeros(self.n, np.int64)
        place = self.char_at[:-1].copy()
        stop = np.minimum(at + longest, self.row_end)
        size = np.zeros(self.n, np.int64)  # whole syllables that the path has behind it
        while len(at):
            node = trie.step(node, self.chars[place])
            keep = node >= 0
            at, node, place, stop, size = at[keep], node[keep], place[keep] + 1, stop[keep], size[keep]
            whole = place == self.char_at[at + size + 1]
            size = size + whole
            entry = trie.ends[node]
            hit = np.flatnonzero(whole & (entry >= 0))
            for k in range(1, longest + 1):
                own = hit[size[hit] == k]
                out[k - 1][at[own]] = entry[own]
            keep = at + size < stop
            at, node, place, stop, size = at[keep], node[keep], place[keep], stop[keep], size[keep]
        return out

    def chunks(self, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """The texts from syllable to syllable; where they follow each other without a gap, nothing is copied."""
        if len(starts) and (starts[1:] == ends[:-1]).all():
            offsets = np.append(self.byte_at[starts], self.byte_at[ends[-1]]).astype(np.int32)
            return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), self.bytes)
        first, sizes = self.byte_at[starts].astype(np.int64), (self.byte_at[ends] - self.byte_at[starts]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(self.bytes, np.uint8)[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
