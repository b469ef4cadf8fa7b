"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of text is a row of symbols; the leaves of its tree hold the rank
of the pair at each place (with the place, so that ties go left), and the root
is the leftmost pair of the lowest rank. A merge changes three leaves, and
their paths to the root, until the root holds no pair. Many short pieces of one
tree size go through these steps at once, as NumPy rows; a long piece has a
tree of its own in a plain array. Tasks keep what a chunk (text between white
space) became in a table of bounded bytes.
"""

import json
import re
import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame

from lexicarta.llm.shared import map_rows, worker_object

#: Bytes after which a task's table of chunks starts anew; each counts with its letters, its ids and 150 more.
MOST_BYTES = 48 << 20
#: Bytes from which a piece has a tree of its own.
LONG = 512
#: Cells of a block of trees.
BLOCK = 1 << 20
NONE = np.iinfo(np.int64).max
#: Code points below this are split by a plain pattern; texts with others by the tokenizer's own splitter.
PLAIN = 0x250
#: Texts with these are split with care: special tokens, and separators that are white space to Python alone.
ODD = re.compile(r"<\||[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def plain_pattern() -> re.Pattern:
    """The splitter of word_bpe_49k.json (contractions, letters, single digits, other marks) below PLAIN."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+")


class WordBpe:
    """One tokenizer file (BPE with word ends), ready to encode in a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special = {t.encode(): np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        own = byte_symbols()
        self.first = np.array([vocab[c] for c in own], np.int64)
        self.last = np.array([vocab[c + end] for c in own], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        keys = np.array([a << 16 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, np.array([c for *_, c in pairs], np.int64)
        self.pattern, self.exotic = plain_pattern(), re.compile(rf"[^\x00-{chr(PLAIN - 1)}]|[\x1c-\x1f]")
        self.splitter = Tokenizer.from_file(path)
        self.rank_of = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made[self.ranks], strict=True)}
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """rank * size + place of the pairs (a, b) that merge, NONE of the others; negative symbols are no symbols."""
        key = a << 16 | b
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[found] == key), self.ranks[found] * size + at, NONE)

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """The rows of symbols (padded with -1, as wide as a power of two) after all merges, gaps being -1."""
        n, size = symbols.shape
        places = np.arange(size)
        after = np.tile(places + 1, (n, 1))
        before = np.tile(places - 1, (n, 1))
        right = np.concatenate([symbols[:, 1:], np.full((n, 1), -1)], axis=1)
        tree = np.full((n, 2 * size), NONE)
        tree[:, size:] = self.leaves(symbols, right, places, size)
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            place, rank = root % size, root // size
            gone = after[live, place]
            then = after[live, gone]
            symbols[live, place] = self.made[rank]
            symbols[live, gone] = -1
            after[live, place] = then
            inside = then < size
            before[live[inside], then[inside]] = place[inside]
            prior = before[live, place]
            here = symbols[live, place]
            tree[live, size + gone] = NONE
            tree[live, size + place] = self.leaves(here, np.where(inside, symbols[live, np.minimum(then, size - 1)], -1), place, size)
            has = prior >= 0
            tree[live[has], size + prior[has]] = self.leaves(symbols[live[has], prior[has]], here[has], prior[has], size)
            for node in (gone + size, place + size, np.where(has, prior, place) + size):
                up = node >> 1
                while up[0]:
                    tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
                    up = up >> 1
            live = live[tree[live, 1] < NONE]
        return symbols

    def long_piece(self, raw: bytes) -> list[int]:
        """The ids of one long piece: the same tree in a plain array, rank * size + place in each leaf."""
        n, rank_of = len(raw), self.rank_of
        size = 1 << (n - 1).bit_length()
        symbols = self.first[np.frombuffer(raw, np.uint8)].tolist()
        symbols[-1] = int(self.last[raw[-1]])
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        first = self.leaves(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64), np.arange(n - 1), size)
        levels = np.full(2 * size, NONE)
        levels[size : size + n - 1] = first
        low = size
        while low > 1:
            levels[low // 2 : low] = np.minimum(levels[low : 2 * low : 2], levels[low + 1 : 2 * low : 2])
            low //= 2
        tree, none = array("q", levels.tobytes()), int(NONE)
        while tree[1] < none:
            rank, place = divmod(tree[1], size)
            gone = after[place]
            then = after[gone]
            symbols[place] = made = rank_of[symbols[place] << 16 | symbols[gone]][1]
            symbols[gone] = -1
            after[place] = then
            leaf = none
            if then < n:
                before[then] = place
                found = rank_of.get(made << 16 | symbols[then])
                if found:
                    leaf = found[0] * size + place
            changes = [(gone + size, none), (place + size, leaf)]
            prior = before[place]
            if prior >= 0:
                found = rank_of.get(symbols[prior] << 16 | made)
                changes.append((prior + size, found[0] * size + prior if found else none))
            for node, value in changes:
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    if other < value:
                        value = other
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [s for s in symbols if s >= 0]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (none empty), one after the other, and how many each has."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        counts, parts = np.zeros(len(raw), np.int64), []
        for i in np.flatnonzero(lengths >= LONG):
            found = np.array(self.long_piece(raw[i]), np.int64)
            counts[i] = len(found)
            parts.append((np.array([i]), found))
        for width in np.unique(widths[lengths < LONG]):
            some = np.flatnonzero((widths == width) & (lengths < LONG))
            step = max(1, BLOCK // int(width))
            for part in (some[i : i + step] for i in range(0, len(some), step)):
                size, places = lengths[part], np.arange(width)
                source = flat[np.minimum(starts[part][:, None] + places, len(flat) - 1)]
                symbols = np.where(places < size[:, None], self.first[source], -1)
                rows = np.arange(len(part))
                symbols[rows, size - 1] = self.last[source[rows, size - 1]]
                symbols = self.merged(symbols)
                there = symbols >= 0
                counts[part] = there.sum(1)
                parts.append((part, symbols[there]))
        begins, ids = np.cumsum(counts) - counts, np.empty(counts.sum(), "<u4")
        for part, found in parts:
            n = counts[part]
            ids[np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return ids, counts

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk: NFC, lower case, then the tokenizer's pattern."""
        low = chunk.lower()
        if not self.exotic.search(low):
            return self.pattern.findall(low)
        text = self.splitter.normalizer.normalize_str(chunk)
        back = {c: b for b, c in enumerate(byte_symbols())}
        return [bytes(back[c] for c in p).decode() for p, _ in self.splitter.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, chunks: set[str]) -> None:
        if self.held > MOST_BYTES:
            self.chunks.clear()
            self.held = 0
        new = [c for c in chunks if c not in self.chunks]
        split = [self.split(c) for c in new]
        ids, counts = self.encode_pieces([p for ps in split for p in ps])
        ends = np.concatenate([[0], 4 * np.cumsum(counts)])[np.cumsum([len(ps) for ps in split])].tolist()
        raw = ids.tobytes()
        self.chunks.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        self.held += len(raw) + sum(map(len, new)) + 150 * len(new)

    def runs(self, text: str) -> list[list[str] | bytes]:
        """Chunks of the text between special tokens, and those tokens."""
        if not ODD.search(text):
            return [text.split()]
        out: list[list[str] | bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part.encode() in self.special:
                out.append(part.encode())
            else:
                out.append([c for c in re.split(r"[^\S\x1c-\x1f]+", part) if c])
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Of each text, the ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
        runs = [self.runs(t or "") for t in texts]
        chunks = {c for rs in runs for r in rs if isinstance(r, list) for c in r}
        if not chunks <= self.chunks.keys():
            self.learn(chunks)
        ids, decoded = [], []
        for rs in runs:
            ids.append(b"".join([x for r in rs for x in (map(self.chunks.__getitem__, r) if isinstance(r, list) else [self.special[r]])]))
            decoded.append(" ".join(map(self.names.__getitem__, np.frombuffer(ids[-1], "<u4").tolist())))
        return ids, decoded


def loaded(path: str) -> WordBpe:
    """The tokenizer of a worker process; it is read once there."""
    return worker_object(("bpe", path), lambda: WordBpe(path))


def bpe_encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids binary, decoded string) of each row of docs.

    row is the input row as a struct. ids are little-endian unsigned 32-bit integers of the whole text, special
    tokens' strings in it included, as the tokenizers library encodes without adding any; decoded is its
    decode() of them, special tokens kept. A null text counts as empty: no ids, an empty decoded text.
    Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """

    return map_rows(docs, lambda texts: loaded(path).encode(texts), "ids binary, decoded string", text)
