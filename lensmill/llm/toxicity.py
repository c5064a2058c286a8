"""Toxic spans by a linear-chain conditional random field over word tokens; document scores from its marginals.

Labels exist for documents only. Token labels are derived from them: in a toxic document, a word is labelled toxic
if it, or its beginning of 4 to 6 letters, occurs in toxic documents far more often than chance allows. The chain
is trained on those labelled tokens by gradient ascent with exact forward-backward expectations. A document's
score is a logistic function of its marginals (log of the expected number of toxic tokens, and the largest
marginal); offending tokens are those whose marginal is at least one half, given as code point offsets.

The fit uses at most ``max_docs`` labelled documents of each label, chosen by a hash of id and text, so it is
bounded and the same in every run. Every row is scored over its whole text, without a shuffle.

Defined results: null and empty texts, and all texts where no training row exists of either label, get the prior
(score of no evidence, below one half unless most labels are toxic); null labels teach nothing; texts equal in text and
label teach once; repeated rows are scored each; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import held_out, rows_of, short, stretch, to_batch, trained

FEATURE_BITS = 18
LANE = 64
#: Labelled documents of each label that a fit reads at most.
MAX_DOCS = 3000
MEMO_ENTRIES = 300_000
#: Words and beginnings whose neighbours the fit counts at a time.
FOLLOWED = 1000
_WORD = re.compile(r"\S+").finditer
_STRIP = re.compile(r"^[\W_]+|[\W_]+$").sub


def normal(token: str) -> str:
    return token if token.isalpha() else _STRIP("", token)


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, its beginnings of 4 to 6 letters, its last 3."""
    mask = (1 << FEATURE_BITS) - 1
    named = ["w" + word, *(f"p{n}" + word[:n] for n in (4, 5, 6) if len(word) >= n), "s" + word[-3:]]
    return [crc32(x.encode()) & mask for x in named]


def _chained(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of label 1 against 0 at each position (lanes x LANE), given the odds e of each token alone.

    odds_i = e_i (t01 + odds t11) / (t00 + odds t10), or e_i at a text's first token. Each lane is composed as one such
    map, the lanes' maps are chained, then every lane runs from its own start.
    """
    lanes = e.shape[0]
    (t00, t01), (t10, t11) = t
    # The map (a odds + b) / (c odds + d); a first token's map is the constant e.
    ma, mb = np.where(first, 0.0, e * t11), np.where(first, e, e * t01)
    mc, md = np.where(first, 0.0, t10), np.where(first, 1.0, t00)
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for i in range(LANE):
        a, b, c, d = ma[:, i] * a + mb[:, i] * c, ma[:, i] * b + mb[:, i] * d, mc[:, i] * a + md[:, i] * c, mc[:, i] * b + md[:, i] * d
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    odds, now = np.empty(lanes), 1.0
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        odds[k] = now
        now = (ka * now + kb) / (kc * now + kd)
    out = np.empty_like(e)
    for i in range(LANE):
        odds = (ma[:, i] * odds + mb[:, i]) / (mc[:, i] * odds + md[:, i])
        out[:, i] = odds
    return out


def marginals(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(label 1) of each token, and the sum of P(label a, next label b).

    scores: log-odds of label 1 of each token of all texts, one after another; starts: True at a text's first token.
    trans: 2x2 log weights. Forward and backward odds run in lanes of LANE tokens side by side.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    lanes = -(-n // LANE)
    e, first = np.ones(lanes * LANE), np.ones(lanes * LANE, bool)
    e[:n], first[:n] = np.exp(np.clip(scores, -30, 30)), starts
    t = np.exp(trans - trans.max())
    ahead = _chained(e.reshape(lanes, LANE), first.reshape(lanes, LANE), t).ravel()
    ends = np.append(first[1:], True)
    back = _chained(e[::-1].reshape(lanes, LANE), ends[::-1].reshape(lanes, LANE), t.T).ravel()[::-1]
    odds = ahead * back / e  # both hold the token's own odds
    p = (odds / (1 + odds))[:n]
    if not pairs:
        return p, None
    inner = ~first[1:n]
    a, b = ahead[: n - 1][inner], back[1:n][inner]
    joint = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * b, t[1, 0] * a, t[1, 1] * a * b])
    return p, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    doc: np.ndarray
    memo: dict = field(default_factory=dict, repr=False, compare=False)
    sparse: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        used = np.flatnonzero(self.weights)
        return {"used": used, "values": self.weights[used], "bias": self.bias, "trans": self.trans, "doc": self.doc}

    def __setstate__(self, s):
        self.weights = np.zeros(1 << FEATURE_BITS)
        self.weights[s["used"]] = s["values"]
        self.bias, self.trans, self.doc, self.memo, self.sparse = s["bias"], s["trans"], s["doc"], {}, {}

    def token_score(self, token: str) -> float:
        if not self.sparse:
            used = np.flatnonzero(self.weights)
            self.sparse = dict(zip(used.tolist(), self.weights[used].tolist(), strict=True)) or {-1: 0.0}
        word, weight = normal(token), self.sparse.get
        return self.bias + sum(weight(f, 0.0) for f in features(word)) if word else self.bias

    def scores(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            missing = [t for t in set(tokens) if t not in memo]
            if len(memo) + len(missing) > MEMO_ENTRIES:
                memo.clear()
                missing = list(set(tokens))
            memo.update((t, self.token_score(t)) for t in missing)
            found = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            return found

    def of_tokens(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each text's tokens."""
        lengths = np.array([len(t) for t in texts], np.int64)
        filled = [self.scores(t) for t in texts if t]
        if not filled:
            return [np.zeros(0) for _ in texts]
        starts = np.zeros(lengths.sum(), bool)
        starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        p, _ = marginals(np.concatenate(filled), starts, self.trans, pairs=False)
        return np.split(p, np.cumsum(lengths)[:-1])

    def doc_score(self, p: np.ndarray) -> float:
        x = np.array([1.0, np.log1p(p.sum()), p.max() if len(p) else 0.0])
        return float(1 / (1 + np.exp(-np.clip(self.doc @ x, -35, 35))))


def _parts(w: str) -> set[str]:
    return {w} | {w[:n] for n in (4, 5, 6) if len(w) >= n} if w else set()


def _tell_tales(docs: list[tuple[np.ndarray, int]], words: list[str], chance: float = 1e-7, ratio: float = 15, most: int = 400) -> set[str]:
    """Words and beginnings that occur in toxic documents far more often than chance allows; documents are places in words.

    Occurrences count by their distinct neighbours (up to ``most``), so that the rare words of a text with many copies
    count once. They are counted in arrays, since a set a word would hold most of the driver's memory.
    """
    n1 = sum(label for _, label in docs)
    n0 = len(docs) - n1
    share = n1 / max(1, n0 + n1)
    seen = [np.zeros(len(words), np.int64) for _ in range(2)]
    for tokens, label in docs:
        seen[label] += np.bincount(tokens, minlength=len(words))
    # Only what stands in toxic documents often enough to pass at all is followed with its neighbours.
    often = Counter()
    for k in np.flatnonzero(seen[1]).tolist():
        for part in _parts(words[k]):
            often[part] += int(seen[1][k])
    followed = sorted(w for w, n in often.items() if n * np.log(1 / share) > np.log(1 / chance))
    place = {w: k for k, w in enumerate(followed)}
    pairs = np.array([(k, place[x]) for k, w in enumerate(words) for x in _parts(w) if x in place], np.int64).reshape(-1, 2)
    counts = []
    for label in (0, 1):
        own = [tokens for tokens, x in docs if x == label and len(tokens)]
        tokens = np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64)
        inner = np.ones(len(tokens) + 1, bool)
        inner[np.cumsum([0, *map(len, own)])] = False
        sides = np.zeros(len(tokens), np.uint64)
        sides[1:] = np.where(inner[1:-1], tokens[:-1] + 1, 0)
        sides *= np.uint64(len(words) + 1)
        sides[:-1] += np.where(inner[1:-1], tokens[1:] + 1, 0).astype(np.uint64)
        sides = sides * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        found = np.zeros(len(followed), np.int64)
        # Some parts at a time, so that the arrays stay short; the upper bits say which part, the lower 40 which neighbours.
        for at in range(0, len(followed), FOLLOWED):
            some = pairs[(pairs[:, 1] >= at) & (pairs[:, 1] < at + FOLLOWED)]
            many = np.bincount(some[:, 0], minlength=len(words))
            first = np.cumsum(many) - many
            where = np.flatnonzero(many[tokens])
            n = many[tokens[where]]
            part = some[np.repeat(first[tokens[where]] - np.cumsum(n) + n, n) + np.arange(n.sum()), 1] - at
            keys = part.astype(np.uint64) << np.uint64(40) | np.repeat(sides[where], n)
            keys.sort()
            fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            found[at : at + FOLLOWED] = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=FOLLOWED)[: len(found) - at]
        counts.append(np.minimum(found, most))
    b, a = counts
    keep = (a * np.log(1 / share) > np.log(1 / chance) + b * np.log(n0 + n1)) & ((a + 0.5) / (n1 + 1) > ratio * (b + 0.5) / (n0 + 1))
    return {followed[k] for k in np.flatnonzero(keep)}


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = 20_000, max_tokens: int = 300_000, rounds: int = 30) -> ToxicModel:
    """labelled: text, toxic 0/1 and an order column ``pick``, as sample() gives them.

    Bounds: 2 * max_docs rows in order of pick, of a longer text max_chars code points from a hashed place, and for the
    chain itself max_tokens words, of which one text gives a fiftieth at most. The fit runs in one task.
    """
    rows = labelled.where(F.col("text").isNotNull()).select("pick", stretch("text", "pick", max_chars).alias("text"), "toxic")
    return trained(rows.orderBy("pick", "toxic", F.xxhash64("text")).limit(2 * max_docs), lambda found: fit_rows(found[::-1], max_tokens, rounds))


def fit_rows(rows: list[tuple[int, str, int]], max_tokens: int = 300_000, rounds: int = 30) -> ToxicModel:
    """The fit itself, of (pick, text, toxic) in falling order; rows is emptied on the way, texts are held as places in a vocabulary.

    Rows equal in text and label teach once.
    """
    named: dict[str, int] = {}
    docs, seen = [], set()
    while rows:
        _, text, label = rows.pop()
        mark = (hashlib.blake2b(text.encode(), digest_size=16).digest(), int(label))
        if mark in seen:
            continue
        seen.add(mark)
        docs.append((np.array([named.setdefault(t, len(named)) for t in text.lower().split()], np.int32), int(label)))
    tokens, names = list(named), {}
    as_word = np.array([names.setdefault(normal(t), len(names)) for t in tokens], np.int32)
    named.clear()
    n1 = sum(label for _, label in docs)
    if not n1 or n1 == len(docs):
        prior = (n1 + 1) / (len(docs) + 3)
        return ToxicModel(np.zeros(1 << FEATURE_BITS), -8.0, np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0, 0]))
    words = list(names)
    tales = _tell_tales([(as_word[t], label) for t, label in docs], words)
    toxic_word = np.array([w in tales or w[:4] in tales or w[:5] in tales or w[:6] in tales for w in words])
    ids, labels, starts, budget = [], [], [], max_tokens
    for t, label in docs:
        t = t[: max(1, max_tokens // 50)]
        if budget <= 0:
            break
        if not len(t):
            continue
        budget -= len(t)
        starts.append(np.arange(len(t)) == 0)
        ids.append(as_word[t])
        labels.append(toxic_word[as_word[t]] & bool(label))
    known, ids = np.unique(np.concatenate(ids), return_inverse=True)
    y, starts = np.concatenate(labels).astype(float), np.concatenate(starts)
    listed = [features(words[k]) if words[k] else [] for k in known]
    owner, flat = np.repeat(np.arange(len(listed)), [len(f) for f in listed]), np.array([k for f in listed for k in f], np.int64)
    size = 1 << FEATURE_BITS
    model = ToxicModel(np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros((2, 2)), np.zeros(3))
    pair = np.zeros((2, 2))
    inside = ~starts[1:]
    np.add.at(pair, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    g2, t2 = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        of_word = np.bincount(owner, model.weights[flat], minlength=len(listed)) + model.bias
        p, expected = marginals(of_word[ids], starts, model.trans)
        by_word = np.bincount(ids, y - p, minlength=len(listed))
        g = np.bincount(flat, by_word[owner], minlength=size) - 1e-2 * model.weights
        g2 += g * g
        model.weights += np.where(np.abs(g) > 1e-9, 0.7 * g / np.sqrt(g2), 0)
        gt = pair - expected - 1e-2 * model.trans
        t2 += gt * gt
        model.trans += 0.2 * gt / np.sqrt(t2)
    model.weights[np.abs(model.weights) < 1e-3] = 0
    x, label = [], []
    for at in range(0, len(docs), 64):
        for p, (_, own) in zip(model.of_tokens([[tokens[k] for k in t] for t, _ in docs[at : at + 64]]), docs[at : at + 64], strict=True):
            x.append([1.0, np.log1p(p.sum()), p.max() if len(p) else 0.0])
            label.append(own)
    model.doc = _logistic(np.array(x), np.array(label, float))
    model.memo.clear()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton's method; the ridge keeps separable data finite."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * b), -3, 3)
    return b


def score(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_toxic_tokens, offending array<struct<start,end,p>> (code points) of every row."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_toxic_tokens", pa.int64()), ("offending", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for (t,) in rows_of(part, "text")]
                found = model.of_tokens([t.lower().split() for t in texts])
                scores, counts, spans = [], [], []
                for text, p in zip(texts, found, strict=True):
                    scores.append(model.doc_score(p))
                    hot = np.flatnonzero(p >= 0.5)
                    counts.append(len(hot))
                    spans.append([])
                    if len(hot):
                        wanted = set(hot.tolist())
                        for k, m in enumerate(_WORD(text)):
                            if k in wanted:
                                spans[-1].append({"start": m.start(), "end": m.end(), "p": float(p[k])})
                yield to_batch(schema, [part.column(0).to_pylist(), scores, counts, spans])

    ddl = "doc_id bigint, score double, n_toxic_tokens bigint, offending array<struct<start:int,end:int,p:double>>"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def sample(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """text, toxic, pick of at most max_docs ids of each label that are not held out, by a hash of the id.

    An id and label count once, however many rows and labels repeat them, and teach the least of its texts. The choice
    reads ids and labels only; the chosen ids (at most 2 * max_docs rows, so safe to broadcast) then pick
    their texts in one scan without a shuffle of texts.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    own = own.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("pick")).distinct()
    parts = [own.where(F.col("toxic") == v).orderBy("pick", "label_id").limit(max_docs) for v in (0, 1)]
    texts = documents.select("doc_id", "text")
    found = texts.join(F.broadcast(parts[0].unionAll(parts[1])), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id", "toxic", "pick").agg(F.min("text").alias("text")).select("text", "toxic", "pick")


def keep_clean(df: DataFrame, model: ToxicModel, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose score is under the limit; one pass, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = model.of_tokens([(t or "").lower().split() for (t,) in rows_of(part, text_col)])
                yield part.filter(pa.array([model.doc_score(p) < limit for p in found]))

    return df.mapInArrow(run, df.schema)
