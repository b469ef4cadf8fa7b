"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Words, and their first letters as stems, get log-odds between toxic and other labelled documents under a Dirichlet prior;
those that more toxic documents hold than chance allows make the lexicon, and every other word lowers a segment by the
same small step. One pass over a text, in linear time, finds all its maximal segments. Under the background's word rates, segments of such a score turn up at a known rate (the extreme-value law
of maximal segments), which turns each into evidence; a logistic curve over a document's evidence is its score.
"""

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import Table, forget, map_rows, small_batches, worker_object, written

#: Labelled rows of each class that the model is fitted on, by hash: all of fewer, else about so many.
SAMPLE = 20_000
#: Documents an entry of the lexicon is in at least; lengths of stems. The sample bounds the lexicon.
LEAST_DOCS, STEMS = 4, (5, 6, 7)
#: What an entry's likelihood ratio (G squared of documents) exceeds, beside twice the logarithm of the entries tried.
MARGIN = 4.0
#: Documents whose words are counted at once in a task.
STEP = 256
#: Weight of the Dirichlet prior, in words a class.
PRIOR = 1000.0
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Scores of the lexicon's entries, the step down of other words, the law's two parameters, the curve's two, and a name."""

    scores: dict
    step: float
    scale: float
    rate: float
    bias: float
    slope: float
    key: str = ""


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word, the most specific first."""
    return [word, *(word[:n] + "-" for n in reversed(STEMS) if len(word) > n)]


def scores_of(model: "Model") -> Table:
    """The score of each word, 0 where the lexicon holds nothing of it; a worker process keeps it for a model."""
    lexicon = model.scores
    return worker_object(("toxicity", model.key), lambda: Table(lambda word: next((lexicon[e] for e in entries(word) if e in lexicon), 0.0)))


def maximal_segments(scores: list[float], gaps: list[float]) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal scoring segments; scores are positive, gaps[i] is what lies before score i.

    Each candidate is kept with the sums to its left and right end and the nearest candidate before it whose left sum is
    lower. A new score follows those links, and joins with all from a candidate on whose right sum is lower than its
    own: each candidate is passed by once, so the search is linear.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # left, right, first, last, link
    total = 0.0
    for i, (score, gap) in enumerate(zip(scores, gaps, strict=True)):
        total -= gap
        left, first = total, i
        total += score
        right = total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i, j))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(right - left, first, last) for left, right, first, last, _ in kept]


def segments(words: list[str], model: Model) -> list[tuple[float, int, int]]:
    """(score, first word, last word) of the maximal segments of a text."""
    found = [(i, x) for i, x in enumerate(map(scores_of(model).__getitem__, words)) if x]
    if not found:
        return []
    at = [i for i, _ in found]
    gaps = [0.0, *(model.step * (b - a - 1) for a, b in zip(at, at[1:], strict=False))]
    return [(s, at[a], at[b]) for s, a, b in maximal_segments([x for _, x in found], gaps)]


def passages(words: list[str], model: Model) -> list[tuple[float, int, int]]:
    """(evidence, first word, last word) of every significant segment: how far it is above what chance brings, in nats."""
    found = segments(words, model)
    chance = math.log(max(model.rate * len(words), 1e-9)) if found else 0.0
    out = [(model.scale * s - chance, a, b) for s, a, b in found]
    return [x for x in out if x[0] > 0]


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Of rows (doc_id, n), n being the rows of a class, those whose id's hash falls into a share of most / n: all of n up to most, else about most."""
    share = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    return rows.where(share * F.col("n") <= most)


def training_rows(docs: DataFrame, labels: DataFrame, learnt) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic, weight) of a bounded sample of labelled rows, and that joined with their texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnt(F.col("doc_id"))).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    classes = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    picked = sampled(known.join(F.broadcast(classes), "toxic"), SAMPLE)
    picked = written(picked.select("doc_id", "toxic", (F.col("n") / F.least("n", F.lit(SAMPLE))).alias("weight")), "toxic-sample")
    # about 2 * SAMPLE rows of three numbers at most
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return picked, texts


def learn(docs: DataFrame, labels: DataFrame, learnt=lambda doc_id: F.lit(True)) -> Model:
    """The model from labelled rows that learnt allows; without rows of both classes it finds nothing toxic."""
    picked, texts = training_rows(docs, labels, learnt)
    texts = written(texts, "toxic-texts")
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        for part in (batch.slice(at, STEP) for batch in batches for at in range(0, batch.num_rows, STEP)):
            tokens, held = [Counter(), Counter()], [Counter(), Counter()]
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                found: Counter = Counter()
                for word, n in Counter(words_of(text)).items():
                    for entry in entries(word):
                        found[entry] += n
                tokens[toxic].update(found)
                held[toxic].update(found.keys())
            words = list(tokens[0].keys() | tokens[1].keys())
            columns = {f"{name}{k}": pa.array([c[k][w] for w in words], pa.int64()) for name, c in (("t", tokens), ("d", held)) for k in (0, 1)}
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string())} | columns)

    counted = texts.mapInArrow(count, "word string, t0 long, t1 long, d0 long, d1 long")
    counts = written(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "d0", "d1"))), "toxic-counts")
    sizes = {r.toxic: r.n for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    tried = counts.where(F.col("d0") + F.col("d1") >= LEAST_DOCS)
    n0, n1, n_tried = (x or 0 for x in counts.agg(F.sum(F.expr("if(word like '%-', 0, t0)")), F.sum(F.expr("if(word like '%-', 0, t1)")), F.count_if(F.col("d0") + F.col("d1") >= LEAST_DOCS)).first())
    blank = Model({}, 1.0, 1.0, 1.0, -4.0, 0.0, uuid.uuid4().hex)
    if not n0 or not n1 or not n_tried:
        return blank
    prior = F.lit(PRIOR) * (F.col("t0") + F.col("t1")) / F.lit(float(n0 + n1))
    a1, a0 = F.col("t1") + prior, F.col("t0") + prior
    odds = F.log(a1 / F.greatest(n1 + PRIOR - a1, F.lit(0.5))) - F.log(a0 / F.greatest(n0 + PRIOR - a0, F.lit(0.5)))
    part = lambda seen, expect: F.when(seen > 0, seen * F.log(seen / expect)).otherwise(0.0)
    docs_with, m0, m1 = F.col("d0") + F.col("d1"), sizes.get(0, 0), sizes.get(1, 0)
    share = docs_with / F.lit(float(m0 + m1))
    ratio = 2 * (part(F.col("d1"), share * m1) + part(F.col("d0"), share * m0) + part(m1 - F.col("d1"), (1 - share) * m1) + part(m0 - F.col("d0"), (1 - share) * m0))
    stood = tried.select("word", odds.alias("odds"), ratio.alias("ratio"), "t0", "t1").where((F.col("odds") > 0) & (F.col("ratio") >= 2 * math.log(n_tried) + MARGIN))
    lexicon = sorted(stood.collect(), key=lambda r: r.word)  # words that many of the sampled documents hold
    if not lexicon:
        return blank
    hit1, hit0 = min(0.9, sum(r.t1 for r in lexicon) / n1), min(0.9, sum(r.t0 for r in lexicon) / n0)
    step = max(1e-4, math.log((1 - hit0) / (1 - hit1)))
    scores = {r.word: float(r.odds) for r in lexicon}
    scale = decay([(float(r.odds), (r.t0 + 0.5) / (n0 + 1)) for r in lexicon], step)
    model = Model(scores, step, scale, 1.0, 0.0, 0.0, uuid.uuid4().hex)
    found = written(map_rows(texts, lambda ts: segment_scores(ts, model), "n long, scores array<double>").select("n", "scores", "row.toxic", "row.weight"), "toxic-segments")
    # the law's other parameter, by maximum likelihood over the other class: rate = documents / sum of words * exp(-scale * best)
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    law = found.where("toxic = 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-scale * best))).first()
    model.rate = law[0] / law[1] if law[1] else 1.0
    chance = F.log(F.greatest(model.rate * (F.col("n") - 1), F.lit(1e-9)))
    evidence = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(scale * s - chance, F.lit(0.0)))
    model.bias, model.slope = logistic(evidence_bins(found.select(evidence.alias("evidence"), "toxic", "weight")))
    forget(picked, texts, counts, found)
    return model


def evidence_bins(seen: DataFrame) -> list[tuple[float, int, float]]:
    """(evidence, toxic, weight) of all rows: sqrt(evidence) in steps of 0.01, bins with their mean, all beyond 100 in the last one."""
    root = F.sqrt(F.greatest("evidence", F.lit(0.0)))
    bins = seen.groupBy(F.least(F.round(root * 100), F.lit(10_000.0)).alias("bin"), "toxic").agg((F.sum(root * F.col("weight")) / F.sum("weight")).alias("x"), F.sum("weight").alias("w"))
    return sorted((r.x**2, r.toxic, r.w) for r in bins.collect())  # at most 10,001 bins for each class


def decay(scores: list[tuple[float, float]], step: float) -> float:
    """The scale at which background words' scores have an expected exponential of 1."""
    rest = 1 - sum(p for _, p in scores)
    value = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in scores) + rest * math.exp(-x * step) - 1
    high = 1e-3
    while value(high) < 0 and high < 100:
        high *= 2
    low = 0.0 if high <= 1e-3 else high / 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(rows: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Bias and slope of a weighted logistic curve over sqrt(evidence), by Newton steps with a small ridge."""
    x, y, w = (np.array(c, float) for c in zip(*rows, strict=True))
    design = np.stack([np.ones_like(x), np.sqrt(np.maximum(x, 0))], axis=1)
    beta = np.array([math.log((w[y == 1].sum() + 0.5) / (w[y == 0].sum() + 0.5)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 0.01 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def segment_scores(texts: list[str | None], model: Model) -> tuple[list[int], list[list[float]]]:
    """The number of words plus one, and the scores of the maximal segments, of each text."""
    words = [words_of(t) for t in texts]
    return [len(w) + 1 for w in words], [[s for s, *_ in segments(w, model)] for w in words]


def toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(row, score, predicted, passages) of each row of docs, from its whole text alone.

    score is the curve's value at the text's evidence, 0 to 1; predicted is 1 from the threshold on; passages are the
    significant segments as (first_word, last_word, evidence), words being runs of letters. Null and empty texts have no
    words, so no evidence, and the score of that. Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """

    def score(texts):
        scores, spans = [], []
        for t in texts:
            found = passages(words_of(t), model)
            z = model.bias + model.slope * math.sqrt(sum(e for e, *_ in found))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            spans.append([{"first_word": a, "last_word": b, "evidence": e} for e, a, b in found])
        return scores, spans

    out = map_rows(docs, score, "score double, passages array<struct<first_word:long,last_word:long,evidence:double>>", text)
    return out.select("row", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out and teaches nothing by its label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
