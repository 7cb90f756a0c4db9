"""Toxic spans by a linear-chain conditional random field.

Each token is clean (0) or toxic (1).  A token's potential is a sum of weights of hashed features (the word, its
first 4 to 6 bytes, its last 4) that three documents of the fit sample have; transitions and starts have their own.  Forward-backward gives every token's
marginal; tokens of at least ``span_at`` make the offending spans, and a logistic function of the largest marginal
and of the expected number of toxic tokens gives the document's score.

Labels are known for documents only, so token labels come first: in the fit sample, a feature is *telling* if far
more toxic than clean documents have it (log-odds and a likelihood ratio test); a toxic document's tokens with a
telling feature are labelled 1, all others 0, and toxic documents without such a token are left out of the field's
fit (not of the score's).

The fit takes a bounded sample: up to ``max_fit_docs`` toxic and twice as many clean labelled rows in hash order, each
of up to ``max_fit_bytes`` bytes, less copies.  Scoring takes every whole text.  Nothing but the text goes into a score.

Null, empty and wordless texts have no tokens and score what the fit gives for none.  Labels with a null id or
class are left out; an id labelled more than once is toxic if any of its labels is.  With no labels of a class, or
none at all, every score is the share of toxic labels (0 with none).  A very long text is scored whole, in segments.
Repeated rows each get a row; other columns stay, and added ones take other names where they clash.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, modest_batches
from .substring_dedup import BLOCK_BYTES, P, inverse, mix, powers, rolled

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
SUFFIX = 4
STEP = 64  # tokens of a segment
PART = 100_000  # tokens of a part of the fit sample

LETTER = np.zeros(256, np.uint64)
LETTER[128:] = np.arange(128, 256)
for low, high, to in ((0x30, 0x3A, 0x30), (0x61, 0x7B, 0x61), (0x41, 0x5B, 0x61)):
    LETTER[low:high] = np.arange(to, to + high - low)
IS_WORD = (LETTER > 0).astype(np.int8)


@dataclass
class Model:
    """weights and checks by slot: a feature counts if its slot holds its own check."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    checks: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.uint32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = 0.0


@dataclass
class Tokens:
    """Of some texts in a row: the feature hashes of each token (0: it has none such), its bytes, and the first and the end token of each text."""

    features: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    """Byte places count from the start of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    turn = np.flatnonzero(np.diff(IS_WORD[raw], prepend=0))
    begins, ends = turn[0::2], turn[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTER[raw] * powers(P, len(raw)), out=total[1:])
    back = powers(inverse(P), len(raw))
    size = ends - begins

    def part(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((total[b] - total[a]) * back[a] + np.uint64(salt)) | np.uint64(1)

    columns = [part(begins, ends, 1)]
    for k in PREFIXES:
        columns.append(np.where(size >= k, part(begins, np.minimum(begins + k, ends), 10 + k), np.uint64(0)))
    columns.append(np.where(size >= SUFFIX, part(np.maximum(ends - SUFFIX, begins), ends, 30), np.uint64(0)))
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    cuts = np.searchsorted(begins, bounds)
    shift = np.repeat(bounds[:-1], np.diff(cuts))
    return Tokens(np.stack(columns, 1) if len(begins) else np.zeros((0, 2 + len(PREFIXES)), np.uint64), begins - shift, ends - shift, cuts[:-1], cuts[1:])


def slots(features: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The slot of each feature; 0 for those that the model does not know."""
    at = (features % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return np.where((checks[at] == (features >> np.uint64(32)).astype(np.uint32)) & (features != 0), at, 0)


def known_features(features: np.ndarray, kind: np.ndarray, doc: np.ndarray, width: int, least_docs: int = 3) -> np.ndarray:
    """Checks for the features that ``least_docs`` documents or more have; of two in one slot the more frequent stays."""
    pairs = np.unique(kind.astype(np.int64) * width + doc)
    k, d = pairs // width, pairs % width
    found, often = [], []
    for column in features.T:
        values, at = np.unique(column, return_inverse=True)
        seen = np.unique(at[k].astype(np.int64) * width + d) // width
        n = np.bincount(seen, minlength=len(values))
        ok = (n >= least_docs) & (values != 0)
        found.append(values[ok])
        often.append(n[ok])
    values, n = np.concatenate(found), np.concatenate(often)
    values = values[np.argsort(n, kind="stable")]
    checks = np.zeros(BUCKETS, np.uint32)
    checks[(values % np.uint64(BUCKETS - 1)).astype(np.int32) + 1] = (values >> np.uint64(32)).astype(np.uint32)
    return checks


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES together."""
    a, used = 0, 0
    for k, t in enumerate(texts):
        if k > a and used + len(t) > BLOCK_BYTES:
            yield a, k
            a, used = k, 0
        used += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def forward_backward(emission: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Marginals of label 1 and, if asked, expected counts of (previous, label) pairs.

    Texts are cut into segments of STEP tokens.  The products of each segment's matrices come first (all segments at
    once), then each text's run over its segments, then the messages inside the segments: exact, with no loop over
    tokens or texts.
    """
    n = last - first
    on = n > 0
    first, n = first[on], n[on]
    if not len(n):
        return np.zeros(0), np.zeros((2, 2))
    e = np.clip(emission, -30, 30)
    p0, p1 = np.exp(np.minimum(-e, 0)), np.exp(np.minimum(e, 0))
    t = np.exp(step)
    m = np.empty((4, len(e)))
    m[0], m[1], m[2], m[3] = t[0, 0] * p0, t[0, 1] * p1, t[1, 0] * p0, t[1, 1] * p1
    s = np.exp(start)
    for k in (0, 2):
        m[k, first], m[k + 1, first] = s[0] * p0[first], s[1] * p1[first]
    per = -(-n // STEP)
    head = np.cumsum(per) - per
    total = int(per.sum())
    within = np.arange(len(e)) - np.repeat(first, n)
    seg = np.repeat(head, n) + within // STEP
    off = within % STEP
    x = np.zeros((4, STEP, total))
    x[0] = x[3] = 1.0
    x[:, off, seg] = m
    prod = np.zeros((4, total))
    prod[0] = prod[3] = 1.0
    for k in range(STEP):
        a, b, c, d = prod
        w, y, z, v = x[:, k]
        prod = np.stack((a * w + b * z, a * y + b * v, c * w + d * z, c * y + d * v))
        prod /= prod.max(axis=0)
    alpha, beta = np.full((2, total), 0.5), np.full((2, total), 0.5)
    order = np.argsort(-per, kind="stable")
    longest = per[order]
    deep = int(longest[0])
    count = np.searchsorted(-longest, -np.arange(deep), "left")  # texts with more than k segments
    for k in range(1, deep):
        at = head[order[: count[k]]] + k
        v = np.stack((alpha[0, at - 1] * prod[0, at - 1] + alpha[1, at - 1] * prod[2, at - 1], alpha[0, at - 1] * prod[1, at - 1] + alpha[1, at - 1] * prod[3, at - 1]))
        alpha[:, at] = v / v.sum(axis=0)
    for k in range(deep - 1, 0, -1):
        at = head[order[: count[k]]] + k
        v = np.stack((prod[0, at] * beta[0, at] + prod[1, at] * beta[1, at], prod[2, at] * beta[0, at] + prod[3, at] * beta[1, at]))
        beta[:, at - 1] = v / v.sum(axis=0)
    fore, back = np.empty((2, STEP, total)), np.empty((2, STEP, total))
    a = alpha
    for k in range(STEP):
        w = x[:, k]
        a = np.stack((a[0] * w[0] + a[1] * w[2], a[0] * w[1] + a[1] * w[3]))
        a = a / a.sum(axis=0)
        fore[:, k] = a
    b = beta
    for k in range(STEP - 1, -1, -1):
        back[:, k] = b
        w = x[:, k]
        b = np.stack((w[0] * b[0] + w[1] * b[1], w[2] * b[0] + w[3] * b[1]))
        b = b / b.sum(axis=0)
    f, g = fore[:, off, seg], back[:, off, seg]
    both = f * g
    marginal = both[1] / both.sum(axis=0)
    if not pairs:
        return marginal, np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    joint = np.stack([f[i, at - 1] * m[2 * i + j, at] * g[j, at] for i in (0, 1) for j in (0, 1)])
    joint /= joint.sum(axis=0)
    return marginal, joint.sum(axis=1).reshape(2, 2)


def telling(kind_features: np.ndarray, kind: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features far more toxic than clean documents have.

    kind_features: the features of each kind of token; kind, doc: of each token.
    """
    width = np.int64(len(toxic))
    pairs = np.unique(kind.astype(np.int64) * width + doc)
    k, d = pairs // width, pairs % width
    t, c = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for column in kind_features.T:  # one sort of a column at a time bounds the memory
        seen = np.unique(column[k].astype(np.int64) * width + d)
        f, bad = seen // width, toxic[seen % width]
        t += np.bincount(f[bad], minlength=BUCKETS)
        c += np.bincount(f[~bad], minlength=BUCKETS)
    nt, nc = float(toxic.sum()), float((~toxic).sum())
    odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    share = nt / (nt + nc)
    with np.errstate(divide="ignore", invalid="ignore"):
        test = 2 * (np.where(t > 0, t * np.log(t / (t + c) / share), 0) + np.where(c > 0, c * np.log(c / (t + c) / (1 - share)), 0))
    out = (odds > 2.3) & (test > 20)
    out[0] = False
    return out


def originals(texts: list[bytes], window: int = 5) -> list[int]:
    """The first of each group of copies and near copies: texts that share none of four least hashes of their word
    windows with one before.  Copies of one toxic text would make all its words telling."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, raw in enumerate(texts):
        words = tokens([raw]).features[:, 0]
        grams = rolled(words, window, P) if len(words) >= window else mix(words)
        least = {(j, int(mix(grams + np.uint64(j)).min())) for j in range(4)} if len(grams) else {(0, 0)}
        if not least & seen:
            out.append(k)
        seen |= least
    return out


def kinds_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each kind of token, kind of each token, first and end token of each text)."""
    width = 2 + len(PREFIXES)
    keys, firsts, lasts, own_keys, own_features, base = [], [], [], [], [], 0
    for a, b in blocks(texts):
        x = tokens(texts[a:b])
        key = np.zeros(len(x.features), np.uint64)
        for column in x.features.T:
            key = mix(key * P + column)
        keys.append(key)
        firsts.append(x.first + base)
        lasts.append(x.last + base)
        base += len(key)
        at = np.unique(key, return_index=True)[1]
        own_keys.append(key[at])
        own_features.append(x.features[at])
    some = np.concatenate(own_keys) if own_keys else np.empty(0, np.uint64)
    order, at = np.unique(some, return_index=True)
    features = np.concatenate(own_features)[at] if own_features else np.zeros((0, width), np.uint64)
    kind = np.concatenate([np.searchsorted(order, k).astype(np.int32) for k in keys]) if keys else np.empty(0, np.int32)
    return features, kind, np.concatenate(firsts) if firsts else np.empty(0, int), np.concatenate(lasts) if lasts else np.empty(0, int)


def fit(texts: list[bytes], toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), rounds: int = 30, rate: float = 0.5, ridge: float = 1e-6) -> Model:
    """A model from whole texts and their labels, by gradient steps on the field's likelihood.

    weight: what a clean and a toxic text stand for in the score.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(constant=float(toxic.mean()) if len(texts) else 0.0)
    own = originals(texts)
    weight = tuple(w * (toxic == t).sum() / max(1, (toxic[own] == t).sum()) for t, w in enumerate(weight))
    texts, toxic = [texts[k] for k in own], toxic[own]
    features, kind, first, last = kinds_of(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), last - first)
    checks = known_features(features, kind, doc, len(texts))
    features = slots(features, checks)
    label = telling(features, kind, doc, toxic)[features].any(axis=1)[kind] & toxic[doc]
    used = ~toxic
    used[doc[label]] = True
    parts, size = [[]], 0  # of whole texts, so many tokens together that messages stay small
    for k in np.flatnonzero(used & (last > first)):
        if size > PART:
            parts.append([])
            size = 0
        parts[-1].append(k)
        size += last[k] - first[k]
    made = []
    for own in parts:
        n = (last - first)[own]
        ends = np.cumsum(n)
        at = np.concatenate([np.arange(first[k], last[k]) for k in own]) if own else np.empty(0, int)
        made.append((kind[at], label[at], ends - n, ends))
    total = sum(len(k) for k, _, _, _ in made)
    ones = sum(int(y.sum()) for _, y, _, _ in made)
    bias = np.log((ones + 1) / (total - ones + 1))
    model = Model(constant=None, checks=checks, start=np.array([0.0, bias]), step=np.array([[0.0, bias], [0.0, bias]]))
    w = np.zeros(BUCKETS)
    w_sum, b_sum, s_sum = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(rounds):
        per_kind, b_grad, s_grad = np.zeros(len(features)), np.zeros((2, 2)), np.zeros(2)
        emission = w[features].sum(axis=1)
        for own, y, begin, end in made:
            if not len(own):
                continue
            g, joint = forward_backward(emission[own], begin, end, model.start, model.step, True)
            per_kind += np.bincount(own, weights=y - g, minlength=len(features))
            inner = np.ones(len(own), bool)
            inner[begin] = False
            at = np.flatnonzero(inner)
            b_grad += np.bincount(2 * y[at - 1].astype(int) + y[at], minlength=4).reshape(2, 2) - joint
            s_grad += np.array([-1, 1]) * (y[begin] - g[begin]).sum()
        grad = -ridge * total * w
        for column in features.T:
            grad += np.bincount(column, weights=per_kind, minlength=BUCKETS)
        grad[0] = 0.0
        for value, g, seen, speed in ((w, grad, w_sum, rate), (model.step, b_grad, b_sum, 0.2 * rate), (model.start, s_grad, s_sum, 0.2 * rate)):
            seen += g * g
            value += speed * g / np.sqrt(seen)
    model.weights = w.astype(np.float32)
    emission = w[features].sum(axis=1)
    rows = []
    for a in range(0, len(texts), 200):
        b = min(a + 200, len(texts))
        g, _ = forward_backward(emission[kind[first[a] : last[b - 1]]], first[a:b] - first[a], last[a:b] - first[a], model.start, model.step)
        rows.append(summary(g, first[a:b] - first[a], last[a:b] - first[a]))
    model.score = logistic(np.concatenate(rows), toxic.astype(float), np.where(toxic, weight[1], weight[0]))
    return model


def summary(marginal: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(1, largest marginal, log of one and the expected toxic tokens) of each text."""
    out = np.zeros((len(first), 3))
    out[:, 0] = 1
    on = last > first
    if on.any():
        out[on, 1] = np.maximum.reduceat(marginal, first[on])
        out[on, 2] = np.log1p(np.add.reduceat(marginal, first[on]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        d = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
        b = b + np.clip(d, -4, 4)
        if np.abs(d).max() < 1e-6:
            break
    return b


def apply(model: Model, texts: list[bytes], span_at: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of each text, and its spans in characters."""
    if model.constant is not None:
        return np.full(len(texts), model.constant), [[] for _ in texts]
    scores, spans = [], []
    for a, b in blocks(texts):
        x = tokens(texts[a:b])
        e = model.weights[slots(x.features, model.checks)].sum(axis=1, dtype=np.float64)
        g, _ = forward_backward(e, x.first, x.last, model.start, model.step)
        scores.append(1 / (1 + np.exp(-np.clip(summary(g, x.first, x.last) @ model.score, -30, 30))))
        hits = np.flatnonzero(g >= span_at)
        cut = np.searchsorted(hits, np.append(x.first, x.last[-1:]))
        for k, raw in enumerate(texts[a:b]):
            own = hits[cut[k] : cut[k + 1]]
            out: list[dict] = []
            if len(own):
                place = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    out.append({"start": int(place[x.begins[run[0]]]), "end": int(place[x.ends[run[-1]]]), "p": float(g[run].max())})
            spans.append(out)
    return np.concatenate(scores) if scores else np.zeros(0), spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_docs: int = 1000, max_fit_bytes: int = 20_000) -> Model:
    """A model fit on a bounded sample of the labelled rows that are not held out."""
    most = {0: 2 * max_fit_docs, 1: max_fit_docs}
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    own = own.where(~held_out("id")).groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    total = dict(own.groupBy("y").count().collect())
    # twice what is needed, for ids without a document and texts over the bound
    some = [r for y in (0, 1) for r in own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * most[y]).collect()]
    if not some:
        return fit([], np.zeros(0, bool))
    chosen = docs.sparkSession.createDataFrame(some, own.schema)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= max_fit_bytes)
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("rank", F.xxhash64("id"))
    rows = [r for y in (0, 1) for r in found.where(F.col("y") == y).orderBy("rank", "id").limit(most[y]).collect()]
    toxic = np.array([r.y == 1 for r in rows], bool)
    weight = tuple(total.get(y, 0) / max(1, int((toxic == bool(y)).sum())) for y in (0, 1))
    return fit([r.text.encode() for r in rows], toxic, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (double) and ``spans`` (start, end in characters, largest marginal)."""
    modest_batches(docs.sparkSession)
    score_col, spans_col = fresh(docs, "score", "spans")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(spans_col, SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            s, spans = apply(model, texts, span_at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(spans, kind)], names=[*batch.schema.names, score_col, spans_col])
            give_back()

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    out = score(slim, fit_sample(slim, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
