"""Toxic passages by maximum-scoring segments of token log-odds.

Learning. Documents with labels give, per token, the number of toxic and of clean documents that hold it. A
token's log-odds compare both classes under a Dirichlet prior proportional to the token's share of all
documents; its z-score is the log-odds over their standard deviation. Tokens are lower-case words, and stems
(the first letters of longer words, marked ``~``); the longest known stem stands in for a word that was not seen. All tokens with a
z-score of at least ``MIN_Z`` are kept. The model is bounded by its sample: of more than ``LABELLED`` labelled
documents, a share by the hash of their ids is learned from, about as many as that.

Scoring. Each token counts its log-odds less ``DRIFT``, so a random text drifts down. A linear-time scan finds all
maximal segments of positive score. Repetition is no evidence: S is the highest score of a part of the segment
in which each positive word counts once. The score distribution in clean training documents gives the
extreme-value parameters lambda and K; a segment's significance in a text of n tokens is lambda * S - ln(K n),
its negative log expectation, so long texts need higher scores. Segments of which a clean text of that length has fewer than
``EXPECTED`` are significant and all reported. A document's evidence is the negative log of the product of the expectations of all segments of
which fewer than one is expected (of those with the same positive words the most significant one counts), so that several weak ones add up; without any it is 0. A logistic curve over the logarithm
of the evidence, fitted on the training documents, turns it into a score; for the fit, which is on counts per quarter of evidence, evidence of 1000 and more counts as
1000, where the curve is flat. Texts are scored with the evidence that they have.

Null and empty texts have no evidence and get the base score. Documents with several label rows count as
toxic if one says so. Without labels of both classes every score is next to 0 (below 1e-9). Repeated rows are scored each;
further columns are ignored by ``score_documents`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_name, materialise

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of stems, the longest first; a word has those that are shorter than it.
STEMS = (8, 7, 6, 5, 4)
#: Words of which a task remembers the log-odds.
MEMO = 100_000
PRIOR, MIN_Z, MIN_DOCS, DRIFT = 10.0, 3.0, 3, 0.35
#: A segment is significant if fewer such are expected in a clean text of its length.
EXPECTED = 0.01
#: Labelled documents to learn from, at most; the documented bound of the sample.
LABELLED = 1_000_000
#: Token counts that a task holds before it hands them on.
COUNTED = 200_000
SCORED = "doc_id long, evidence double, score double, predicted int, passages array<struct<start: int, end: int, significance: double>>"


def training_rows(id_col: Column) -> Column:
    """Rows to learn from: the CRC-32 of the id as text is no multiple of five."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def stems(word: str) -> list[str]:
    return ["~" + word[:n] for n in STEMS if len(word) > n]


class _Memo(dict):
    """Log-odds of words under the model, remembered: of the word, else of its longest known stem, else 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        gain = self.weights.get(word)
        if gain is None:
            gain = next((self.weights[s] for s in stems(word) if s in self.weights), 0.0)
        if len(self) < MEMO:
            self[word] = gain
        return gain


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    lam: float = 1.0
    k: float = 0.1
    intercept: float = -30.0
    slope: float = 0.0
    significant: float = -math.log(EXPECTED)

    def memo(self) -> _Memo:
        return _Memo(self.weights)

    def gains(self, words: list[str], memo: _Memo) -> list[float]:
        """Log-odds of each word."""
        return list(map(memo.__getitem__, words))

    def judge(self, words: list[str], gains: list[float]) -> tuple[float, list[tuple[int, int, float]]]:
        """A text's evidence and its significant segments: first token, token after the last, significance."""
        limit = math.log(max(self.k * len(gains), 1e-9))
        out = []
        if gains and max(gains) > DRIFT:
            for a, b, s in segments([g - DRIFT for g in gains]):
                # Counting each word once only lowers the score, so most segments are ruled out as they are.
                if self.lam * s > limit and (z := self.lam * once(words[a:b], gains[a:b], s) - limit) > 0:
                    out.append((a, b, z))
        return self.evidence(words, gains, out), [x for x in out if x[2] > self.significant]

    @staticmethod
    def evidence(words: list[str], gains: list[float], passages: list[tuple[int, int, float]]) -> float:
        """Sum of the significances; of segments with the same telling words the most significant one counts."""
        if len(passages) < 2:
            return sum(z for _, _, z in passages)
        most: dict[frozenset[str], float] = {}
        for a, b, z in passages:
            telling = frozenset(w for w, g in zip(words[a:b], gains[a:b]) if g > 0)
            most[telling] = max(z, most.get(telling, 0.0))
        return sum(most.values())

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * math.log1p(evidence)))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Candidates are kept with the cumulative sums before and at their ends; a new one is merged with the nearest
    earlier candidate that begins lower as long as it also ends lower.
    """
    stack: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each candidate: index of the nearest earlier one that begins at a lower sum, or -1
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, i + 1, left, total))
                lower.append(j)
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


def once(words: list[str], gains: list[float], score: float) -> float:
    """The highest score of a part of a segment in which each positive word counts once; ``score`` is the segment's own.

    Ends are taken in turn. A tree over the starts holds the score of the part from each start to the end; a word adds
    to the parts that begin after its last place, so a segment of n words takes n log n steps.
    """
    telling = [(i, w, g) for i, (w, g) in enumerate(zip(words, gains)) if g > 0]
    if len({w for _, w, _ in telling}) == len(telling):
        return score
    size = 1 << (len(telling) - 1).bit_length()
    added, top = [0.0] * (2 * size), [-math.inf] * (2 * size)  # top: highest below a node, with what was added to it
    last: dict[str, int] = {}
    best, cost, at = 0.0, 0.0, 0
    for n, (i, w, g) in enumerate(telling):
        # Costs (drift, and log-odds of words that speak against) are the same for all starts but for those before them.
        cost += sum(DRIFT - min(x, 0.0) for x in gains[at:i])
        at = i
        leaf = n + size
        top[leaf] = cost
        low, high = last.get(w, -1) + 1 + size, leaf + 1
        first, final = low, leaf
        while low < high:
            if low & 1:
                top[low], added[low], low = top[low] + g, added[low] + g, low + 1
            if high & 1:
                high -= 1
                top[high], added[high] = top[high] + g, added[high] + g
            low, high = low >> 1, high >> 1
        for node in (first >> 1, final >> 1):
            while node:
                top[node] = max(top[2 * node], top[2 * node + 1]) + added[node]
                node >>= 1
        last[w] = n
        best = max(best, top[1] - cost - DRIFT)
    return best


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per token and class among some rows; the row without a token counts documents."""
    found = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        names = list(found[0] | found[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[c][n] for n in names], pa.int64()) for c in (0, 1))], ["token", "clean", "toxic"])

    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
            words = set(tokens(text.as_py() or ""))
            words |= {s for w in words for s in stems(w)}
            found[toxic].update(words)
            found[toxic][""] += 1
            if len(found[0]) + len(found[1]) > COUNTED:
                yield rows()
                found[0].clear()
                found[1].clear()
    yield rows()


def _log_odds(counts: DataFrame) -> dict[str, float]:
    totals = counts.filter("token = ''").first()
    if not totals or not totals["clean"] or not totals["toxic"]:
        return {}
    n0, n1 = totals["clean"], totals["toxic"]
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR - F.col(y) - prior))
    delta = odds("toxic", n1) - odds("clean", n0)
    error = lambda y, n: 1 / (F.col(y) + prior) + 1 / (n + PRIOR - F.col(y) - prior)
    spread = F.sqrt(error("toxic", n1) + error("clean", n0))
    rows = counts.filter("token <> ''").filter(F.col("toxic") + F.col("clean") >= MIN_DOCS).filter((F.col("clean") + prior < n0 + PRIOR) & (F.col("toxic") + prior < n1 + PRIOR))
    rows = rows.select("token", delta.alias("delta"), (delta / spread).alias("z")).filter(F.abs("z") >= MIN_Z)
    return {r["token"]: r["delta"] for r in rows.orderBy("token").collect()}  # tokens of a bounded sample of documents


def _karlin(histogram: dict[float, int]) -> float:
    """lambda > 0 with expectation of exp(lambda * score) = 1, for a distribution with negative mean."""
    n = sum(histogram.values())
    if not any(s > 0 for s in histogram) or sum(s * c for s, c in histogram.items()) >= 0:
        return 1.0
    value = lambda lam: sum(c * math.exp(min(700.0, lam * s)) for s, c in histogram.items()) / n - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton's method on (evidence, label, count), lightly regularised."""
    a, b = 0.0, 0.0
    for _ in range(60):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for x, y, n in rows:
            x = math.log1p(x)
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x))))
            w = n * p * (1 - p)
            ga, gb = ga + n * (y - p), gb + n * (y - p) * x
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 0.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model on labelled rows outside the held-out fifth (``LABELLED`` of them, about, if there are more); three passes over their texts."""
    label = labels.filter("toxic is not null").groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(training_rows(F.col("label_id")))
    label = materialise(label, "labels")
    n = label.count()
    if n > LABELLED:
        label = materialise(label.filter(F.pmod(F.xxhash64("label_id"), F.lit(n)) < LABELLED), "sample")
    rows = docs.join(broadcast_if_small(label), docs[id_col] == label["label_id"]).select(F.col(text_col).cast("string").alias("text"), "toxic")
    counts = materialise(rows.mapInArrow(_count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    weights = _log_odds(counts)
    if not weights:
        return Model({})
    model = Model(weights)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token scores, rounded to eighths, and segments by score, in clean documents."""
        scores, tops, memo = Counter(), Counter(), model.memo()
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                if not toxic:
                    words = tokens(text.as_py() or "")
                    gains = model.gains(words, memo)
                    scores.update(round((g - DRIFT) * 8) for g in gains)
                    if gains and max(gains) > DRIFT:
                        tops.update(int(once(words[x:y], gains[x:y], s)) for x, y, s in segments([g - DRIFT for g in gains]))
        rows = [("token", k, n) for k, n in scores.items()] + [("segment", k, n) for k, n in tops.items()]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["kind", "value", "n"])

    found = rows.mapInArrow(background, "kind string, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()  # some hundred rows
    per_token = {r["value"] / 8: r["n"] for r in found if r["kind"] == "token"}
    lam = _karlin(per_token)
    long_ones = [(r["value"], r["n"]) for r in found if r["kind"] == "segment" and r["value"] >= 1]
    all_tokens = max(1, sum(per_token.values()))
    # Segments above a score are expected K n exp(-lambda S) times: K from the counts at the score that half of them reach.
    k, seen = 0.1, sum(n for _, n in long_ones)
    if seen >= 20:
        level, above = 0, seen
        for value, n in sorted(long_ones):
            if above <= seen / 2:
                break
            level, above = value + 1, above - n
        k = min(1.0, max(1e-6, above / (all_tokens * math.exp(-lam * level)))) if above else k
    model = Model(weights, lam, k)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, memo = Counter(), model.memo()
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = tokens(text.as_py() or "")
                gains = model.gains(words, memo)
                seen[round(4 * model.judge(words, gains)[0]), toxic] += 1
        cols = list(zip(*((k[0], k[1], n) for k, n in seen.items()))) if seen else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["value", "toxic", "n"])

    fit = rows.mapInArrow(evidence, "value long, toxic long, n long").groupBy(F.least("value", F.lit(4000)).alias("value"), "toxic").agg(F.sum("n").alias("n")).collect()  # at most 8002 rows
    intercept, slope = _logistic([(r["value"] / 4, r["toxic"], r["n"]) for r in fit])
    return Model(weights, lam, k, intercept, slope)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for b in batches:
            sums, found = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                words = tokens(text)
                gains = model.gains(words, memo)
                evidence, passages = model.judge(words, gains)
                spans = []
                if passages:
                    # Lower-casing may change lengths, so offsets are those of the lower-cased text where it does.
                    at = [m.span() for m in TOKEN.finditer(text.lower())]
                    spans = [{"start": at[x][0], "end": at[y - 1][1], "significance": z} for x, y, z in passages]
                sums.append(evidence)
                found.append(spans)
            scores = [model.score(e) for e in sums]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("significance", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, kind)],
                ["doc_id", "evidence", "score", "predicted", "passages"],
            )

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, evidence, score, predicted, passages (character spans with significance)."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scorer(model), SCORED)


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those scored toxic; all columns stay. Rows that share a doc_id go together."""
    gone_id = fresh_name(docs, "gone_id")
    gone = score_documents(docs, model, id_col, text_col).filter("predicted = 1").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = materialise(gone, "toxic")
    return docs.join(broadcast_if_small(gone), docs[id_col].eqNullSafe(gone[gone_id]), "left_anti")
