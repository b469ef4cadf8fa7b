"""Periodic runs of words: seed-and-extend along the diagonals of a text compared with itself.

A run of period q holds at least max(shortest, repeats * q) words, so on the diagonal of lag q at least q fewer words
match without a break. Periods fall into bands; the k-grams of a band are as long as the shortest overlap that any of its
periods guarantees, and no shorter than its longest period. Occurrences of one k-gram in one document that follow
each other are the seeds: a k-gram of at least q words recurs inside a run of smallest period q after q words and
no sooner (were it sooner, both periods would make a smaller one). So neighbours in the index are enough, and seeds grow
with the text, not with the pairs of occurrences.
Seeds are extended both ways along their diagonal; a table of the furthest place covered on each lag leaves out seeds that
lie in what is extended already. The texts of an Arrow batch are worked on together, as one array of words.
"""

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import small_batches

RUNS = "array<struct<start:long,length:long,period:long>>"


def bands(longest: int, shortest: int, repeats: int):
    """(least, most, k): the periods of each band and the length of its k-grams, for texts of up to longest words."""
    overlap = lambda q: max(shortest, repeats * q) - q
    low = 1
    while max(shortest, repeats * low) <= longest:
        if repeats * low >= shortest:
            high = k = overlap(low)
        else:
            high, k = low, overlap(low)
            while min(k, overlap(high + 1)) > high:
                high, k = high + 1, min(k, overlap(high + 1))
        yield low, high, k
        low = high + 1


def repeated(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """An array of n names: those of the places whose key occurs more than once, -1 elsewhere."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    out, more = np.full(n, -1, np.int64), counts[inverse] > 1
    out[places[more]] = inverse[more]
    return out


class Grams:
    """Names of the k-grams of an array of words that occur more than once, of a longer k each time. Equal names are equal words."""

    def __init__(self, words: np.ndarray):
        self.length, self.names = 1, repeated(words, np.arange(len(words)), len(words))

    def of(self, k: int) -> np.ndarray:
        while self.length < k:
            step = min(self.length, k - self.length)
            ahead = np.full(len(self.names), -1, np.int64)
            ahead[: len(self.names) - step] = self.names[step:]
            places = np.flatnonzero((self.names >= 0) & (ahead >= 0))
            self.names = repeated(self.names[places] * (len(self.names) + 1) + ahead[places], places, len(self.names))
            self.length += step
        return self.names


def seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of k-grams that recur next after low to high words, by lag and place."""
    places = np.flatnonzero(names >= 0)
    places = places[np.argsort(names[places], kind="stable")]
    lag = np.diff(places)
    near = np.flatnonzero((names[places[:-1]] == names[places[1:]]) & (lag >= low) & (lag <= high)) if len(places) else np.empty(0, np.int64)
    at, lag = places[near], lag[near]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def runs_of(words: np.ndarray, longest: int, shortest: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of words, in which words of different documents differ.

    longest: words of the longest document. repeats is 3 at least.
    """
    found, grams, n = [], Grams(words), len(words)
    for low, high, k in bands(longest, shortest, repeats):
        names = grams.of(k)
        at, lag = seeds(names, low, high)
        if not len(at):
            if not (names >= 0).any():
                break
            continue
        # a seed next to another of its lag lies in what that one's extension covers
        heads = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)]))
        lasts = np.append(heads[1:], len(at)) - 1
        covered: dict[int, int] = {}  # of each lag, the furthest place that an extension reached
        for first, last in zip(heads.tolist(), lasts.tolist(), strict=True):
            i, q = int(at[first]), int(lag[first])
            if covered.get(q, -1) > i:
                continue
            start, end = i, int(at[last]) + k
            while start > 0 and words[start - 1] == words[start - 1 + q]:
                start -= 1
            while end + q < n and words[end] == words[end + q]:
                end += 1
            covered[q] = end
            if end - start + q >= max(shortest, repeats * q):
                found.append((start, end - start + q, q))
    return sorted((s, m, q) for s, m, q in found)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:  # runs come by start, then period
            best = run
    return best


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def looped(doc_id: int | None, words: list) -> list:
    """Words with the tail that the tenth of documents with crc32(doc_id) % 10 = 0 repeats: from word a on, the first p words of it again and again."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def analysed(lists: list[list[bytes]], shortest: int, repeats: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, found together."""
    numbers, flat = count(), []
    for words in lists:
        flat.append(np.fromiter(map(defaultdict(numbers.__next__).__getitem__, words), np.int64, len(words)))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    out: list = [[] for _ in lists]
    longest = max(map(len, flat), default=0)
    if longest >= shortest:
        found = runs_of(np.concatenate(flat), longest, shortest, repeats)
        of = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for k, (start, length, period) in zip(of.tolist(), found, strict=True):
            out[k].append((start - int(starts[k]), length, period))
    return out


def periodic_runs(docs: DataFrame, shortest: int = 6, repeats: int = 4, rewrite: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): (row, runs, best, collapsed).

    Words are cut at ASCII white space. runs holds (start, length, period), word numbers from 0, by start and period, of every
    stretch whose smallest period is period, with at least shortest and at least repeats * period words (repeats is 3
    or more), that no neighbouring word extends. best is the one of the greatest length / period (ties: smallest start, then
    period), null without runs. collapsed is the text of the words that no run holds after its first period, joined by
    one space. rewrite(doc_id, words), if given, gives the words to look at. row is the input row as a struct, so its
    columns clash with nothing. A null or empty text has no words and no runs; rows with null or repeated ids are each worked
    on by themselves; an empty table gives an empty one. A text is held whole by one task, some 100 bytes a word.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    if repeats < 3:
        raise ValueError("runs of fewer than three repeats have no bands of periods")
    small_batches(docs.sparkSession)
    extra = _parse_datatype_string(f"runs {RUNS}, best struct<start:long,length:long,period:long>, collapsed string")
    kinds = [f.type for f in to_arrow_schema(extra)]
    packed = docs.select(F.struct("*").alias("row"))
    as_struct = lambda r: r and {"start": r[0], "length": r[1], "period": r[2]}

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row = part.column(0)
                lists = [words_of(t) for t in pc.struct_field(row, "text").to_pylist()]
                if rewrite:
                    lists = [rewrite(i, w) for i, w in zip(pc.struct_field(row, "doc_id").to_pylist(), lists, strict=True)]
                runs = analysed(lists, shortest, repeats)
                kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(lists, runs, strict=True)]
                made = [[as_struct(r) for r in own] for own in runs], [as_struct(strongest(own)) for own in runs], kept
                yield pa.RecordBatch.from_arrays([row, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], ["row", *extra.names])

    return packed.mapInArrow(work, StructType([*packed.schema.fields, *extra.fields]))
