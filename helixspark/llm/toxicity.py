"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (runs of bytes other than white space, A-Z in lower case, ASCII punctuation at both ends removed) and
their prefixes of some lengths.  For each token the log-odds of toxic against clean documents are taken with an
informative Dirichlet prior, that is the token's share of all training documents times ``prior`` pseudo-counts; those
whose z-score reaches ``z_min`` count, all others weigh nothing.  A word's score is that of its heaviest counting token
less a drift that makes clean text fall on average.  A linear-time scan finds all maximal scoring segments of a text.
For segments of random text extreme-value theory gives ``P(S > x) ~ 1 - exp(-K n exp(-lambda x))`` for n words;
``lambda`` is solved from the word scores of all clean training documents and ``K`` from their best segments, so
``lambda S - ln(K n)`` is comparable for texts of any length, and a segment is significant where it is positive.  A logistic
layer over segments alone (the best one, the sum of all significant ones, their number and how many words they hold) gives
the score.

The model is fitted on a bounded number of labelled documents (``train_docs``), of which whole texts are read.  Half of
them give the token weights with which the calibration sees the other half, and the other way round, so the calibration is
not fooled by tokens that only the training documents have.

Defined cases: null and blank texts have no segments and get a score as well; without usable labels every score is 0.5,
with labels of one kind only their smoothed share; ids may be null or repeated; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep
from .labelled import logistic, sigmoid, training_sample
from .shingling import U, _powers, _tables, mix, text_chunks
from .tables import slim

PREFIXES = (4, 6, 8)  # bytes
KINDS = len(PREFIXES) + 1


def _word_bytes() -> np.ndarray:
    """Bytes that may start or end a token: letters, digits and all of UTF-8 beyond ASCII."""
    core = np.zeros(256, dtype=bool)
    core[128:] = True
    core[48:58] = core[65:91] = core[97:123] = True
    return core


CORE = _word_bytes()


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each word's tokens, one row a kind; first byte and end of each word; first word of each text and end).

    Row 0 is the whole word; a prefix as long as the word or longer is 0.  Words of punctuation only are left out.
    """
    value, gap = _tables()
    empty = np.empty(0, dtype=np.int64)
    if not len(data):
        return np.empty((KINDS, 0), dtype=np.uint64), empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    # the nearest core byte at or after, and at or before, each word's ends
    core_at = np.flatnonzero(CORE[data])
    if not len(core_at):
        return np.empty((KINDS, 0), dtype=np.uint64), empty, empty, np.zeros(len(offsets), dtype=np.int64)
    low = np.searchsorted(core_at, a)
    high = np.searchsorted(core_at, b)
    good = low < high
    a, b = core_at[low[good]], core_at[high[good] - 1] + 1
    up, down = _powers(len(data))
    total = np.concatenate([[U(0)], np.cumsum(value[data] * up[: len(data)])])
    out = np.empty((KINDS, len(a)), dtype=np.uint64)
    out[0] = mix((total[b] - total[a]) * down[a])
    for i, p in enumerate(PREFIXES, 1):
        cut = a + p < b
        out[i] = np.where(cut, mix((total[np.minimum(a + p, b)] - total[a]) * down[a] + U(i)), U(0))
    return out, a, b, np.searchsorted(a, offsets)


@dataclass
class Weights:
    """Counting tokens with their log-odds, sorted by hash, and the scan's drift, lambda and ln K."""

    hashes: np.ndarray
    odds: np.ndarray
    drift: float = 0.1
    lam: float = 1.0
    ln_k: float = 0.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.hashes >> U(48)).astype(np.int64)] = True

    def gains(self, tokens: np.ndarray) -> np.ndarray:
        """Log-odds of each word: those of its token that weighs most either way, 0 without a counting one."""
        best = np.zeros(tokens.shape[1])
        if len(self.hashes):
            for row in tokens:
                at = np.flatnonzero(self.seen[(row >> U(48)).astype(np.int64)])
                where = np.minimum(np.searchsorted(self.hashes, row[at]), len(self.hashes) - 1)
                hit = self.hashes[where] == row[at]
                at, odds = at[hit], self.odds[where[hit]]
                better = np.abs(odds) > np.abs(best[at])
                best[at[better]] = odds[better]
        return best


def log_odds(counts: np.ndarray, totals: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z-scores) of tokens from their (clean, toxic) counts under the informative Dirichlet prior."""
    alpha = prior * np.maximum(counts.sum(1), 0.5) / max(1.0, totals.sum())
    c, t = counts[:, 0] + alpha, counts[:, 1] + alpha
    delta = np.log(t / np.maximum(totals[1] + prior - t, 1e-9)) - np.log(c / np.maximum(totals[0] + prior - c, 1e-9))
    return delta, delta / np.sqrt(1 / t + 1 / c)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, sum)`` of a sequence, in order, in linear time.

    A segment is kept on a list with the sums before and after it.  A new positive item looks back for the last segment
    that started lower; if what lies between never rose as high as the new sum, all of it joins to one segment.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    first: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []  # index of the last earlier segment with a smaller left sum, -1 if none
    for i in np.flatnonzero(score > 0).tolist():
        f, lo, hi = i, total[i], total[i + 1]
        j = len(first) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            f, lo, nxt = first[j], left[j], back[j]
            for held in (first, end, left, right, back):
                del held[j:]
            j = nxt
        first.append(f)
        end.append(i + 1)
        left.append(lo)
        right.append(hi)
        back.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(first, end, left, right, strict=True)]


N_EVIDENCE = 4


def best_segment(gain: np.ndarray, drift: float, lam: float) -> float:
    """``lambda S - ln n`` of the best segment of a text, 0 for S without any."""
    return lam * max((s for _, _, s in segments(gain - drift)), default=0.0) - float(np.log(max(2, len(gain))))


def evidence(gain: np.ndarray, weights: Weights) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(evidence of a text, its significant segments with their normalised scores).

    The evidence is the best normalised segment, and of the significant ones the sum, the number and the words they hold.
    """
    floor = float(np.log(max(2, len(gain)))) + weights.ln_k
    found = [(a, b, weights.lam * s - floor) for a, b, s in segments(gain - weights.drift)]
    good = [x for x in found if x[2] > 0]
    best = max((x[2] for x in found), default=-floor)
    return [best, float(np.log1p(sum(x[2] for x in good))), float(np.log1p(len(good))), float(np.log1p(sum(b - a for a, b, _ in good)))], good


def solve_lambda(score: np.ndarray, count: np.ndarray) -> float:
    """The positive root of mean(exp(lambda * score)) = 1 for scores that occur ``count`` times, or 1 where there is none."""
    if not len(score) or score.max() <= 0 or (score * count).sum() >= 0:
        return 1.0
    total = count.sum()
    above = lambda x: (np.exp(np.minimum(x * score, 50)) * count).sum() >= total
    low, high = 0.0, 1.0
    while not above(high) and high < 64:
        low, high = high, high * 2
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return max(low, 0.05)


@dataclass
class ToxicityModel:
    weights: Weights
    layer: np.ndarray
    constant: float | None = None

    def judge(self, gain: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        if self.constant is not None:
            return self.constant, []
        found, good = evidence(gain, self.weights)
        return float(sigmoid(np.array([*found, 1.0]) @ self.layer)), good


GAIN_BINS = 128  # to a unit of log-odds
TOKENS = "part int, y int, kind int, token long, n long"


def _least_z(clean: Column, sums: dict[int, list[int]], prior: float) -> Column:
    """Size of the z-score of a token that ``clean`` clean documents and no toxic one have; see :func:`log_odds`."""
    out = F.lit(0.0)
    for kind, (n00, n01, n10, n11) in sums.items():
        no, yes = float(n00 + n10), float(n01 + n11)
        t = clean * (prior / max(1.0, no + yes))
        c = clean + t
        delta = F.log(c / F.greatest(no + prior - c, F.lit(1e-9))) - F.log(t / F.greatest(yes + prior - t, F.lit(1e-9)))
        out = F.when(F.col("kind") == kind, delta / F.sqrt(1 / t + 1 / c)).otherwise(out)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = 20000, prior: float = 8000.0, z_min: float = 3.5, least: int = 4) -> ToxicityModel:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fifth.

    Counts, sums and the rows of at most ``train_docs`` documents' evidence reach the driver; texts do not.
    """
    chosen = training_sample(docs, labels, label, train_docs)
    sample = keep(chosen.select("id", "text", (F.col("y") >= 0.5).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("part")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, y = batch.column("part").to_numpy(), batch.column("y").to_numpy()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                tokens, _, _, first = token_hashes(data, offsets)
                group = np.repeat(part[a:b] * 2 + y[a:b], np.diff(first)).astype(np.uint64)
                text = np.repeat(np.arange(b - a), np.diff(first)).astype(np.uint64)
                for kind in range(KINDS):
                    own = tokens[kind] != 0
                    # a document counts a token once
                    order = np.lexsort((text[own], tokens[kind][own]))
                    h, t, g = tokens[kind][own][order], text[own][order], group[own][order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.empty(0, dtype=bool)
                    h, g = h[new], g[new].astype(np.int64)
                    cols = [pa.array((g // 2).astype(np.int32)), pa.array((g % 2).astype(np.int32)), pa.array(np.full(len(h), kind, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(np.ones(len(h), dtype=np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "y", "kind", "token", "n"])

    seen = sample.mapInArrow(count, TOKENS)
    cell = lambda p, y: F.sum(F.when((F.col("part") == p) & (F.col("y") == y), F.col("n")).otherwise(0))
    per_token = seen.groupBy("kind", "token").agg(*[cell(p, y).alias(f"n{p}{y}") for p in (0, 1) for y in (0, 1)])
    per_token = per_token.persist()
    try:
        cells = [f"n{p}{y}" for p in (0, 1) for y in (0, 1)]
        sums = {r["kind"]: [r[c] for c in cells] for r in per_token.groupBy("kind").agg(*[F.sum(c).alias(c) for c in cells]).collect()}
        # tokens that may reach z_min in the sample or in a half of it; bounded by the sample
        clean, toxic = F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11")
        often = per_token.where((clean + toxic >= 2 * least) & ((toxic > 0) | (_least_z(clean, sums, prior) >= z_min / 2))).toArrow()
    finally:
        per_token.unpersist()
    kinds, tokens = often["kind"].to_numpy(), often["token"].to_numpy().view(np.uint64)
    cell_counts = np.column_stack([often[c].to_numpy() for c in cells]).astype(np.float64).reshape(len(kinds), 4)

    def weigh(parts: tuple[int, ...]) -> Weights:
        keep_h, keep_o = [np.empty(0, dtype=np.uint64)], [np.empty(0)]
        for kind, total in sums.items():
            own = kinds == kind
            counts = sum(cell_counts[own][:, [2 * p, 2 * p + 1]] for p in parts)
            delta, z = log_odds(counts, sum(np.array(total, dtype=float)[[2 * p, 2 * p + 1]] for p in parts), prior)
            good = ((z >= z_min) & (counts[:, 1] >= least)) | (z <= -z_min)
            keep_h.append(tokens[own][good])
            keep_o.append(np.clip(delta[good], -2, 4))
        h, o = np.concatenate(keep_h), np.concatenate(keep_o)
        order = np.argsort(h)
        return Weights(h[order], o[order])

    whole, crossed = weigh((0, 1)), (weigh((1,)), weigh((0,)))

    def each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Word scores of each text, by weights that its half of the sample had no part in."""
        part = batch.column("part").to_numpy()
        for a, b, data, offsets in text_chunks(batch.column("text")):
            tokens, _, _, first = token_hashes(data, offsets)
            both = [w.gains(tokens) for w in crossed]
            yield from (both[part[a + i]][first[i] : first[i + 1]] for i in range(b - a))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.empty(0), *each(batch)])
            bins, n = np.unique(np.rint(found * GAIN_BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], ["bin", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_segment(g, whole.drift, whole.lam) for g in each(batch) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(found))]), pa.array([len(found)], pa.int64())], ["total", "n"])

    # the clean documents' word scores give drift and lambda (a row per bin reaches the driver), their best segments K
    clean_rows = sample.where("y = 0").select("text", "part")
    held = sorted(clean_rows.mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect())
    gain, n = np.array([r["bin"] for r in held]) / GAIN_BINS, np.array([r["n"] for r in held], dtype=np.float64)
    whole.drift = float(max(0.02, 2 * (np.maximum(gain, 0) * n).sum() / n.sum())) if len(n) else 0.1
    whole.lam = solve_lambda(gain - whole.drift, n)
    seen_best = clean_rows.mapInArrow(best, "total double, n long").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    whole.ln_k = seen_best["total"] / seen_best["n"] - float(np.euler_gamma) if seen_best["n"] else 0.0

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [evidence(g, whole)[0] for g in each(batch)]
            cols = [batch.column("id"), batch.column("y"), *[pa.array([r[j] for r in rows], pa.float64()) for j in range(N_EVIDENCE)]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", *columns])

    columns = [f"x{j}" for j in range(N_EVIDENCE)]
    table = sample.mapInArrow(weighed, "id long, y int, " + ", ".join(f"{c} double" for c in columns)).toArrow()
    y = table["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(whole, np.zeros(N_EVIDENCE + 1), 0.5 if not len(y) else float((y.sum() + 0.5) / (len(y) + 1)))
    x = np.column_stack([table[c].to_numpy() for c in columns])
    return ToxicityModel(whole, logistic(x, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, passages array<struct<start, end, weight>>``: the significant toxic passages in words of the text
    that hold a letter or digit, with their normalised scores."""
    schema = f"id {dict(docs.dtypes)[id_col]}, score double, passages array<struct<start:int,end:int,weight:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column("text")):
                tokens, _, _, first = token_hashes(data, offsets)
                gain = model.weights.gains(tokens)
                judged = [model.judge(gain[first[i] : first[i + 1]]) for i in range(b - a)]
                passages = [[{"start": s, "end": e, "weight": float(w)} for s, e, w in found] for _, found in judged]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([s for s, _ in judged], pa.float64()), pa.array(passages, kind)], ["id", "score", "passages"])

    return slim(docs, id=id_col, text=text_col).mapInArrow(run, schema)
