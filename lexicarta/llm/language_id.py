"""Language ID: unigrams of pieces, all segmentations summed.

Pieces are the words and letters of a fixed public vocabulary. Each language has a probability for each piece,
fitted by expectation-maximisation over all segmentations of a bounded sample's words. A word's probability is the
forward algorithm's sum over its segmentations; a text's is the product over its words. Words are runs of letters,
lower-cased, with a mark at the front as in the vocabulary. Many words go through the algorithm at once.
"""

import re
import sys
import unicodedata
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import forget, map_rows, small_batches, worker_object, written
from lexicarta.llm.toxicity import sampled

#: Documents of each language that the probabilities are fitted on, by hash: all of fewer, else about so many.
SAMPLE = 1500
#: Steps of expectation-maximisation, and a piece's count before any is seen.
STEPS, PRIOR = 3, 0.05
#: Bytes of a worker's table of words; cells of a block of words (words, letters and sizes of pieces, or words, sizes and
#: languages); letters of a word that are looked up at once.
MOST_BYTES, CELLS, PART = 24 << 20, 1 << 21, 1 << 14
#: Documents whose words are counted at once in a task.
STEP = 256
#: Probability of a letter outside the vocabulary.
STRANGE = 1e-7
FRONT = "▁"


@cache
def word_pattern() -> re.Pattern:
    """A word: a letter (categories L), and the letters and marks (M) that follow."""
    kinds = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in kinds:
            spans = kinds[kind]
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    letters, marks = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in kinds[k]) for k in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


#: Letters as Python's own classes see them, and what they see otherwise (numbers that are no digits, marks) or may: texts without
#: any of the latter have the same words by the quicker pattern.
PLAIN, ODD = re.compile(r"[^\W\d_]+"), re.compile("[¹²³¼½¾\u0300-\u036f\u0483-\u0489\u0559-\u1fff\u2070-\U0010ffff]")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (word_pattern() if not text.isascii() and ODD.search(text) else PLAIN).findall(text)


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with or without the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == FRONT or word_pattern().fullmatch("a" + p.removeprefix(FRONT)))


class Pieces:
    """Finds pieces in rows of code points by rolling hashes and tables that are read by their top bits."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        keys = np.array([self.key(p) for p in pieces], np.uint64)
        if len(np.unique(keys)) != self.n:
            raise ValueError("two pieces have one hash")
        self.tables, left = [], np.arange(self.n)
        for shift in range(44, 0, -7):
            table = np.full(1 << 20, -1, np.int32)
            slot = (keys[left] >> np.uint64(shift)).astype(np.int64) & 0xFFFFF
            table[slot] = left
            self.tables.append((np.uint64(shift), table))
            left = left[table[slot] != left]
            if not len(left):
                break
        self.keys = keys
        if len(left):
            raise ValueError("pieces without a slot")

    def key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return self.mixed(np.array([h], np.uint64))[0]

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or n."""
        h, out = self.mixed(h), np.full(h.shape, self.n, np.int32)
        for shift, table in self.tables:
            at = table[(h >> shift).astype(np.int64) & 0xFFFFF]
            hit = (at >= 0) & (self.keys[at] == h)
            out[hit] = at[hit]
        return out

    def matches(self, words: list[str]):
        """(first, found) by parts of the words: found[word, start - first, length - 1] is the piece there, n where none is, n + 1 of a lone letter outside the vocabulary."""
        lengths = np.array([len(w) for w in words], np.int64) + 1
        width = int(lengths.max())
        for first in range(0, width, PART):
            stop = min(width, first + PART)
            cut = [(FRONT + w)[first : stop + self.longest] for w in words]
            raw = "".join(c.ljust(stop - first + self.longest, "\0") for c in cut).encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(raw, "<u4").reshape(len(words), -1).astype(np.uint64)
            found = np.full((len(words), stop - first, self.longest), self.n, np.int32)
            h, left = np.zeros((len(words), stop - first), np.uint64), lengths[:, None] - np.arange(first, stop)[None, :]
            for size in range(1, min(self.longest, width - first) + 1):
                there = min(stop - first, width - first - size + 1)  # places where the longest word has so many letters left
                h, left = h[:, :there] * self.BASE + points[:, size - 1 : size - 1 + there] + np.uint64(1), left[:, :there]
                at = self.find(h)
                at[left < size] = self.n
                if size == 1:
                    at[(at == self.n) & (left >= 1)] = self.n + 1
                found[:, :there, size - 1] = at
            yield first, found

    def blocks(self, words: list[str], columns: int) -> list[list[int]]:
        """Places of the words in blocks of nearly one length, each within CELLS."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out, start = [], 0
        while start < len(order):
            n = 4096
            while n > 1 and n * max(min(PART, len(words[order[min(start + n, len(order)) - 1]]) + 1), columns) * self.longest > 2 * CELLS:
                n //= 2
            out.append(order[start : start + n])
            start += n
        return out


def forward(table: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """log of each word's probability in each language (column of p), summed over all segmentations.

    Sums up to the next places, as many as a piece is long, go round in a ring; every 16 letters they are
    scaled to their highest.
    """
    lengths = np.array([len(w) for w in words], np.int64) + 1
    ring = np.zeros((table.longest + 1, len(words), p.shape[1]))
    ring[0] = 1
    logs, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
    round_ = len(ring)
    for first, found in table.matches(words):
        there = (found != table.n).any(0)
        for start in range(first, first + found.shape[1]):
            here, sizes = ring[start % round_], np.flatnonzero(there[start - first]) + 1
            if len(words) == 1:
                ring[(start + sizes) % round_, 0] += here[0] * p[found[0, start - first, sizes - 1]]
                sizes = sizes[:0]
            for size in sizes:
                at = found[:, start - first, size - 1]
                some = np.flatnonzero(at != table.n)
                ring[(start + size) % round_, some] += here[some] * p[at[some]]
            ring[start % round_] = 0
            ends = np.flatnonzero(lengths == start + 1)
            if len(ends):
                out[ends] = np.log(ring[(start + 1) % round_, ends]) + logs[ends]
                ring[:, ends] = 1
            if start % 16 == 15:
                top = ring.max(0)
                top[top == 0] = 1
                ring /= top
                logs += np.log(top)
    return out


def expected(table: Pieces, words: list[str], langs: np.ndarray, weight: np.ndarray, p: np.ndarray) -> dict[int, float]:
    """How often each piece is expected in the words (key: language * pieces + piece), which come weight times each, each in its language."""
    n, lengths = len(words), np.array([len(w) for w in words], np.int64) + 1
    width = int(lengths.max())
    found = np.concatenate([f for _, f in table.matches(words)], axis=1)
    alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    up, down = np.zeros((n, width + 1)), np.zeros((n, width + 2))  # logs of the scales of alpha and beta at each place
    alpha[:, 0] = 1
    steps = [[(size, some) for size in range(1, min(table.longest, width - start) + 1) if len(some := np.flatnonzero(found[:, start, size - 1] != table.n))] for start in range(width)]
    chance = lambda start, size, some: p[found[some, start, size - 1], langs[some]]
    for start in range(width):
        ahead = slice(start + 1, start + 1 + table.longest)  # all these places have the scale of start
        up[:, ahead] = up[:, start : start + 1]
        for size, some in steps[start]:
            alpha[some, start + size] += alpha[some, start] * chance(start, size, some)
        top = np.where(alpha[:, start + 1] > 0, alpha[:, start + 1], 1)
        alpha[:, ahead] /= top[:, None]
        up[:, ahead] += np.log(top)[:, None]
    beta[np.arange(n), lengths] = 1
    for start in range(width - 1, -1, -1):
        scale = down[:, start + 1]
        for size, some in steps[start]:
            beta[some, start] += beta[some, start + size] * chance(start, size, some) * np.exp(down[some, start + size] - scale[some])
        top = np.where(beta[:, start] > 0, beta[:, start], 1)
        beta[:, start] /= top
        down[:, start] = scale + np.log(top)
    total = up[np.arange(n), lengths]
    keys, counts = [], []
    for start in range(width):
        for size, some in steps[start]:
            share = alpha[some, start] * chance(start, size, some) * beta[some, start + size]
            keys.append(langs[some] * len(p) + found[some, start, size - 1])
            counts.append(weight[some] * share * np.exp(up[some, start] + down[some, start + size] - total[some]))
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    return dict(zip(names.tolist(), np.bincount(at, np.concatenate(counts)).tolist(), strict=True))


@dataclass
class Model:
    """Languages, log of their share of documents, pieces and p[piece, language], with a row for none and one for strange letters."""

    languages: list[str]
    share: np.ndarray
    pieces: list[str]
    p: np.ndarray


def learn(docs: DataFrame, path: str, learnt=lambda doc_id: F.lit(True)) -> Model:
    """The model from rows with a language that learnt allows; its size is that of the vocabulary for each language."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learnt(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = {r.lang: r.n for r in counts.collect()}
    languages, pieces = sorted(n), vocabulary(path)
    size = len(pieces)
    if not languages:
        return Model([], np.zeros(0), pieces, np.zeros((size + 2, 0)))
    share = np.log(np.array([n[x] for x in languages], float) / sum(n.values()))
    ids = known.select("lang", "doc_id").join(F.broadcast(counts), "lang")
    ids = written(sampled(ids, SAMPLE).select("lang", "doc_id").distinct(), "language-sample")  # about SAMPLE rows a language at most
    texts = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    small_batches(spark)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        for part in (batch.slice(at, STEP) for batch in batches for at in range(0, batch.num_rows, STEP)):
            seen: Counter = Counter()
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in seen], pa.string()), "word": pa.array([w for _, w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    words = written(texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("lang", "word"), "language-words")
    fixed, place = spark.sparkContext.broadcast(pieces), {x: g for g, x in enumerate(languages)}
    p = np.full((size + 2, len(languages)), 1.0 / size)
    for _ in range(STEPS):
        p[size], p[size + 1] = 0, STRANGE
        sent = spark.sparkContext.broadcast(p)

        def expect(batches, sent=sent):
            from collections import Counter

            import pyarrow as pa

            table, total = worker_object(("pieces", path), lambda: Pieces(fixed.value)), Counter()
            for batch in batches:
                langs, ws, ns = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64), batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for block in table.blocks(ws, 1):
                    total.update(expected(table, [ws[i] for i in block], langs[block], ns[block].astype(float), sent.value))
            keys = np.fromiter(total.keys(), np.int64, len(total))
            yield pa.RecordBatch.from_pydict({"key": keys, "n": np.fromiter(total.values(), float, len(total))})

        sums = words.mapInArrow(expect, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # a row a piece and language, as the model
        sums = sums.sort_values("key")
        lang, piece = np.divmod(sums["key"].to_numpy(np.int64), size + 2)
        p = np.full((size + 2, len(languages)), PRIOR)
        p[piece, lang] += sums["n"].to_numpy(float)
        p[:size] /= p[:size].sum(0)
        sent.unpersist()
    p[size], p[size + 1] = 0, STRANGE
    forget(ids, words)
    return Model(languages, share, pieces, p)


class Scorer:
    """log p of words in every language, kept in a table of MOST_BYTES."""

    def __init__(self, model: Model):
        self.model, self.pieces, self.at = model, Pieces(model.pieces), {}
        self.table, self.held = np.zeros((1024, len(model.languages))), 0

    def rows(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        size = lambda ws: sum(map(len, ws)) + len(ws) * (120 + 8 * self.table.shape[1])
        if self.held + size(new) > MOST_BYTES:
            self.at, self.held, new = {}, 0, list(words)
        self.held += size(new)
        first = len(self.at)
        if first + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros((2 * len(new) + first, self.table.shape[1]))])
        for block in self.pieces.blocks(new, self.table.shape[1]):
            self.table[first + np.array(block)] = forward(self.pieces, [new[i] for i in block], self.model.p)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        every = {w for ws in words for w in ws}
        if not every <= self.at.keys() and self.model.languages:
            self.rows(every)
        names, scores = [], []
        for ws in words:
            if not ws or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.table[[self.at[w] for w in ws]].sum(0) + self.model.share
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score) of each row of docs, from its whole text alone.

    lang_pred is the language of the highest probability given the text, ties to the first by name, and score that
    probability; a null text or one without letters is `und` with score 0. Letters outside the vocabulary weigh
    the same in every language. Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    scorer = lambda: worker_object(("language", key), lambda: Scorer(sent.value))
    return map_rows(docs, lambda texts: scorer().predict(texts), "lang_pred string, score double", text)
