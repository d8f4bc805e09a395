"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.llm.common import SPACE, in_frames, share_bound, text_of, trimmed

#: Labelled documents that the model is fitted to, at most about; a documented bound, every document is scored.
SAMPLE = 3000
#: Of each class a quarter as many are taken if there are, however rare it is. Longer texts (in bytes) are scored, but not fitted to,
#: and lines of the fitted ones are LINES at most on average: beyond, the sample gets smaller.
RARE, LONGEST, LINES = SAMPLE // 4, 1 << 20, 500_000
THRESHOLD = 0.7
#: Text bytes whose lines are described at once (some 70 bytes of memory each), and rows of a batch whose texts are taken out at once.
GROUP, ROWS = 1 << 19, 512
#: Lines that are described at once (some 3 KB of memory each); a text of more lines, or of more than GROUP bytes, is gone through in slices.
SLICE = 20_000
BINS = 6

_KINDS = ("lower", "upper", "digit", "space", "point", "mark", "bar", "symbol", "high")
_LUT = np.zeros(256, np.uint8)
for _kind, _chars in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"()-", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256))), 1
):
    _LUT[list(_chars)] = _kind
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15 | 1, np.uint64))
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
N_BASE = len(_KINDS) + 8


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, lines of each text), over all bytes of all texts.

    Shares of character kinds, log words, log bytes, mean word length, distinct words,
    words that repeat the one before them, words that end in a symbol or mark, how the line
    starts and ends.
    """
    buf = b"\n".join(texts) + b"\n"
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    a = np.frombuffer(buf, np.uint8)
    kind = _LUT[a]
    stop = np.flatnonzero(a == 10)
    start = np.append(0, stop[:-1] + 1)
    n = stop - start
    counts = np.stack([np.add.reduceat(kind == k, start, dtype=np.int32) for k in range(1, len(_KINDS) + 1)], axis=1)
    size = np.maximum(n, 1)[:, None]
    gap = (kind == 4) | (a == 10)
    begins = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    words = np.zeros(len(n))
    distinct, again, marked = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if len(begins):
        length = np.append(np.flatnonzero(gap & np.append(False, ~gap[:-1])), [])[: len(begins)].astype(np.int64) - begins
        line = np.searchsorted(stop, begins)
        words = np.bincount(line, minlength=len(n)).astype(float)
        inside = np.arange(len(a)) - np.repeat(np.append(0, begins), np.diff(np.append(np.append(0, begins), len(a))))
        value = np.where(gap, 0, _VALUES[a] * _POWERS[inside & 255])
        h = np.add.reduceat(value, begins)
        same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=len(n))
        key = np.lexsort((h, line))
        new = np.append(True, (h[key][1:] != h[key][:-1]) | (line[key][1:] != line[key][:-1]))
        distinct = np.bincount(line[key][new], minlength=len(n))
        tail = kind[begins + length - 1]
        marked = np.bincount(line[(tail == 6) | (tail == 8)], minlength=len(n))
    w = np.maximum(words, 1)
    last = np.where(n > 0, kind[np.maximum(stop - 1, 0)], 0)
    f = np.column_stack(
        [counts / size, np.log1p(words), np.log1p(n), (n - counts[:, 3]) / w, distinct / w, again / w, marked / w, kind[start] == 2, last == 5]
    )
    return f, n, lines


def slices(text: bytes) -> Iterator[bytes]:
    """``text`` in runs of whole lines, SLICE of them or GROUP bytes at most; a line is never cut."""
    stops = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
    at = start = 0
    while at < len(stops):
        end = max(at + 1, min(at + SLICE, int(np.searchsorted(stops, start + GROUP, side="right"))))
        yield text[start : stops[end - 1]]
        start, at = int(stops[end - 1]) + 1, end


def forward(score: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log sums over all labellings of the lines up to each one, by its label, for one long chain.

    The chain is cut into as many blocks as a block has lines. All blocks go through their lines side by side, each with the 2 x 2 products of its
    own lines' moves; then blocks are joined one after the other, so a chain of n lines takes two times the root of n steps.
    """
    n = len(score) - 1
    out = np.empty_like(score)
    out[0] = score[0]
    if not n:
        return out
    m = int(np.ceil(np.sqrt(n)))
    k = -(-n // m)
    own = np.zeros((k * m, 2))
    own[:n] = score[1:]
    own = own.reshape(k, m, 2)
    upto = np.empty((m, k, 2, 2))
    upto[0] = t + own[:, 0, None, :]
    for i in range(1, m):
        before = upto[i - 1]
        upto[i] = np.logaddexp(before[:, :, :1] + t[0], before[:, :, 1:] + t[1]) + own[:, i, None, :]
    entry = np.empty((k, 2))
    entry[0] = score[0]
    for b in range(1, k):
        entry[b] = np.logaddexp(entry[b - 1, 0] + upto[-1, b - 1, 0], entry[b - 1, 1] + upto[-1, b - 1, 1])
    reached = np.logaddexp(entry[:, :1] + upto[:, :, 0], entry[:, 1:] + upto[:, :, 1])
    out[1:] = reached.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out


class Model:
    """Weights of the field, with 0 for a bad and 1 for a good line."""

    def __init__(self, cuts: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.cuts, self.mean, self.scale = cuts, mean, scale
        self.weights = np.zeros(3 * N_BASE + N_BASE * BINS + 3)
        self.transitions = np.zeros((2, 2))
        self.calibration = np.array([0.0, 1.0])

    def features(self, base: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of each line: its own values and bins, the neighbouring lines' values, and the text's ends."""
        z = (base - self.mean) / self.scale
        first = np.zeros(len(z), bool)
        first[np.cumsum(lines) - lines] = True
        last = np.append(first[1:], True)
        before, after = np.roll(z, 1, axis=0), np.roll(z, -1, axis=0)
        before[first], after[last] = 0, 0
        at = (base[:, :, None] > self.cuts[None]).sum(axis=2)
        bins = (at[:, :, None] == np.arange(BINS)).reshape(len(z), -1)
        return np.column_stack([z, before, after, bins, first, last, np.ones(len(z))]).astype(np.float32)

    def chains(self, u: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of good for each line, expected transitions, and the log of all partition functions, by forward-backward."""
        order = np.argsort(-lines, kind="stable")
        first = (np.cumsum(lines) - lines)[order]
        n = lines[order]
        active = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left")
        t = self.transitions
        A = np.zeros((len(u), 2))
        score = np.zeros((len(u), 2))
        score[:, 1] = u
        for i, k in enumerate(active.tolist()):
            at = first[:k] + i
            A[at] = score[at]
            if i:
                p = A[at - 1]
                A[at] += np.logaddexp(p[:, :1] + t[0], p[:, 1:] + t[1])
        B = np.zeros((len(u), 2))
        for i in range(len(active) - 2, -1, -1):
            at = first[: active[i + 1]] + i
            nxt = B[at + 1] + score[at + 1]
            B[at] = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
        z = np.logaddexp(*A[first + n - 1].T)
        total = np.zeros(len(lines))
        total[order] = z
        per = np.repeat(total, lines)
        good = np.exp(A[:, 1] + B[:, 1] - per)
        inner = np.ones(len(u), bool)
        inner[(np.cumsum(lines) - lines)] = False
        at = np.flatnonzero(inner)
        moves = A[at - 1][:, :, None] + t + (score[at] + B[at])[:, None, :] - per[at][:, None, None]
        return good, np.exp(moves).sum(axis=0), float(z.sum())

    def fit(self, x: np.ndarray, lines: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-3) -> None:
        """Likelihood of the line labels ``y``, by Adam; observed less expected counts are the gradient."""
        inner = np.ones(len(y), bool)
        inner[np.cumsum(lines) - lines] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
        m = np.zeros(x.shape[1] + 4)
        v = np.zeros_like(m)
        for i in range(1, rounds + 1):
            good, moves, _ = self.chains(x @ self.weights, lines)
            g = np.append((y - good) @ x / len(y) - penalty * self.weights, ((seen - moves) / len(y) - penalty * self.transitions).ravel())
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            step = 0.1 * m / (1 - 0.9**i) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            self.weights += step[:-4]
            self.transitions += step[-4:].reshape(2, 2)

    def share(self, base: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of each text, the mean marginal of good, weighted by the lines' lengths."""
        good, _, _ = self.chains(self.features(base, lines) @ self.weights, lines)
        first = np.cumsum(lines) - lines
        w = size + 1e-3
        return np.add.reduceat(good * w, first) / np.add.reduceat(w, first)

    def long_share(self, text: bytes) -> float:
        """:meth:`share` of one text in slices: only one number and the size of each line are kept for the whole of it."""
        us, sizes = [], []
        base = before = None

        def describe_with(after: np.ndarray | None) -> None:
            """``base`` between the lines that stand around it; these are dropped again."""
            around = [x for x in (before, base, after) if x is not None]
            x = self.features(np.concatenate(around), np.array([sum(map(len, around))]))
            us.append((x @ self.weights)[before is not None : len(x) - (after is not None)])

        for part in slices(text):
            rows, size, _ = describe([part])
            if base is not None:
                describe_with(rows[:1])
                before = base[-1:]
            base = rows
            sizes.append(size)
        describe_with(None)
        score = np.zeros((sum(map(len, us)), 2))
        score[:, 1] = np.concatenate(us)
        a = forward(score, self.transitions)
        # The way back is the way there of the turned chain.
        b = forward(score[::-1], self.transitions.T)[::-1] - score
        good = np.exp(a[:, 1] + b[:, 1] - np.logaddexp(a[-1, 0], a[-1, 1]))
        w = np.concatenate(sizes) + 1e-3
        return float(good @ w / w.sum())

    def score(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.calibration[0] + self.calibration[1] * np.log(p / (1 - p)))))


class Prior:
    """What is known without documents of both classes: the labels' smoothed share of good ones, (good + 1) / (all + 2)."""

    def __init__(self, good: int, n: int):
        self.n, self.value = n, (good + 1) / (n + 2)


def train(base: np.ndarray, size: np.ndarray, lines: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None, rounds: int = 3) -> Model:
    """A model from document labels: all lines of a good document are good; in a bad one the lines
    that the model thinks bad are, its worst line among them, and it's fitted again. The documents' weights
    make up for classes that are sampled more than others when scores are calibrated."""
    weight = np.ones(len(labels)) if weight is None else weight
    cuts = np.quantile(base, np.arange(1, BINS) / BINS, axis=0).T
    model = Model(cuts, base.mean(axis=0), base.std(axis=0) + 1e-6)
    x = model.features(base, lines)
    first = np.cumsum(lines) - lines
    bad = np.repeat(labels == 0, lines)
    y = (~bad).astype(np.int64)
    for _ in range(rounds):
        model.fit(x, lines, y)
        good, _, _ = model.chains(x @ model.weights, lines)
        worst = good <= np.repeat(np.minimum.reduceat(good, first), lines)
        y = np.where(bad & ((good < 0.5) | worst), 0, 1)
    p = np.clip(model.share(base, size, lines), 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    c = model.calibration
    for _ in range(200):  # logistic regression on one value, by damped Newton steps
        q = 1 / (1 + np.exp(-(c[0] + c[1] * z)))
        w = weight * q * (1 - q) + 1e-6
        r = weight * (labels - q)
        g = np.array([r.sum() - 0.1 * c[0], (r * z).sum() - 0.1 * (c[1] - 1)])
        h = np.array([[w.sum() + 0.1, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 0.1]])
        c = c + 0.5 * np.linalg.solve(h, g)
    model.calibration = np.array([c[0], max(c[1], 1e-3)])
    return model


def held_out(id_col: str):
    """Whether the CRC-32 of the id as text leaves 2 by 4; such rows' labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model | Prior:
    """The model from at most about ``sample`` labelled documents, by a hash of the id, and at least RARE of each class.

    Lines are described on the executors; what comes to the driver are the numbers of the sampled documents'
    lines, never their texts. Labels that are null or belong to held-out ids aren't used; of several labels of an id the
    least is, and rows that repeat an id count each. Documents of one class only, or none (an empty table
    of documents or labels), give a :class:`Prior`.
    """
    h = F.pmod(F.xxhash64("lid", F.lit(11)), F.lit(SPACE))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("lid")).agg(F.min(label_col).cast("int").alias("y")).withColumn("h", h)
    text = F.encode(text_of(), "UTF-8")
    rows = docs.select(F.col(id_col).alias("did"), text.alias("t")).where(F.octet_length("t") <= LONGEST)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        return Prior(sum(c for y, c in counts.items() if y), n)
    share = {y: min(1.0, max(sample / n, RARE / c)) for y, c in counts.items()}
    bound = F.lit(0)
    for y, s in share.items():
        bound = F.when(F.col("y") == y, F.lit(share_bound(s))).otherwise(bound)
    # At most about 1.25 * sample ids, by the bounds above: texts stay where they are.
    picked = F.broadcast(known.where(F.col("h") < bound))
    chosen = rows.join(picked, F.col("did") == F.col("lid"))
    lines = chosen.agg(F.sum(F.regexp_count(F.decode("t", "UTF-8"), F.lit("\n")) + 1)).first()[0] or 0
    if lines > LINES:  # fewer of each class, by the same hash
        chosen = chosen.where(F.col("h") < (bound * F.lit(LINES / lines)).cast("long"))

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                base, size, count = describe([bytes(batch["t"].iloc[i])])
                yield pd.DataFrame({"h": [batch["h"].iloc[i]], "y": [batch["y"].iloc[i]], "n": count, "base": [base.astype("<f4").tobytes()], "size": [size.astype("<i4").tobytes()]})

    got = chosen.select("h", "y", "t").mapInPandas(trimmed(lines_of), "h long, y int, n long, base binary, size binary").toPandas()
    if got["y"].nunique() < 2:
        return Prior(sum(c for y, c in counts.items() if y), n)
    # Equal hashes are rows of one id: their contents decide, so that refits agree.
    got = got.assign(b=got["base"].map(bytes), s=got["size"].map(bytes)).sort_values(["h", "b", "s"])
    base = np.frombuffer(b"".join(got["b"]), "<f4").reshape(-1, N_BASE).astype(float)
    size = np.frombuffer(b"".join(got["s"]), "<i4").astype(np.int64)
    y = got["y"].to_numpy()
    weight = np.array([1 / share[k] for k in y.tolist()])
    return train(base, size, got["n"].to_numpy(), (y > 0).astype(int), weight / weight.mean())


def _scores(raw: list[bytes], model: Model | Prior) -> np.ndarray:
    """A score for each text, GROUP bytes or SLICE lines at a time."""
    scores = np.full(len(raw), model.value if isinstance(model, Prior) else 0.0)
    if isinstance(model, Prior):
        return scores
    some: list[int] = []
    size = lines = 0

    def close() -> None:
        nonlocal size, lines
        if some:
            scores[some] = model.score(model.share(*describe([raw[i] for i in some])))
        some.clear()
        size = lines = 0

    for i, t in enumerate(raw):
        own = t.count(b"\n") + 1
        if len(t) > GROUP or own > SLICE:
            scores[i] = model.score(np.array([model.long_share(t)]))[0]
            continue
        if size + len(t) > GROUP or lines + own > SLICE:
            close()
        some.append(i)
        size, lines = size + len(t), lines + own
    close()
    return scores


def keep_good(docs: DataFrame, model: Model | Prior, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, each judged by its own text, with all of their columns as they are.

    Rows go through once, in Arrow batches, without a shuffle. Null text is empty; a :class:`Prior` keeps all rows or none.
    """
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0, bool)]
            for i in range(0, batch.num_rows, ROWS):
                raw = [(t or "").encode() for t in batch.column(at).slice(i, ROWS).to_pylist()]
                good.append(_scores(raw, model) >= threshold)
            yield batch.filter(pa.array(np.concatenate(good), pa.bool_()))

    return docs.mapInArrow(trimmed(work), docs.schema)


def score(docs: DataFrame, model: Model | Prior, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone.

    Null text is empty; a very long text is one chain, of which some numbers a line are held. A :class:`Prior` gives every row the same
    score. Rows that repeat score alike; other columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = (batch["t"].iloc[i : i + ROWS] for i in range(0, len(batch), ROWS))
            scores = np.concatenate([np.zeros(0), *(_scores(part.map(bytes).tolist(), model) for part in parts)])
            out = batch[["id", "held_out"]].assign(score=scores, predicted=(scores >= THRESHOLD).astype("int32"))
            yield out

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.encode(text_of(), "UTF-8").alias("t"))
    return in_frames(rows, work, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
