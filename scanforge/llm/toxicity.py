"""Op 8 - toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the embedding of its hash joined with the mean embedding of its hashed character 3- to 5-grams, word
edges included; its gate inputs are computed once for each distinct word of a block.  Two gated recurrent layers, one
in each direction, read windows of ``WINDOW`` words; attention pools their states into one logit.  Windows overlap
(``STRIDE`` < ``WINDOW``), cover the whole text, and the highest logit is the document's, so a long text is judged by
its worst passage and never by a prefix.

The network is fitted in one task on a bounded sample of labelled rows (a lost one is repeated): the ``SAMPLE`` toxic and twice as many clean
ones with the smallest hashes.  Of a sampled text over ``LONGEST`` characters it learns from stretches spread evenly
over the whole of it, so the sample is bounded and holds texts of every length.  A window is learned from each sampled
document: at first any, then the one the network itself scores highest.  A part of the sample is set aside to fit the
final scale.  Everything else is a map over documents: no shuffle, bounded memory.

Defined results: null and empty texts, and those without words, get the logit of an empty window; without labelled rows
of both kinds (an empty labels table among them) every score is 0.  Repeated rows are each scored, and alike; of labels
that repeat a doc_id the largest counts; a doc_id that several texts have lends its label to the least of them.  All columns but the
text pass unchanged, and an input column named ``score`` is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, NUMBER, blocks, char_kinds, forget
from .common import byte_slices, lean

SAMPLE, LONGEST, PIECE = 800, 30_000, 1000
#: Characters that are scored at a time, at least one whole text.
BLOCK = 400_000
#: Distinct words whose inputs are made at a time.
PART = 20_000
WINDOW, STRIDE, HIDDEN, EMBED, BUCKETS = 32, 24, 8, 8, 1 << 18
STEPS, TURN, BATCH, LEAST_TEXTS = 240, 20, 128, 4
GRAMS = (3, 4, 5)
_mix = np.random.default_rng(8).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Features:
    """Distinct words of a block of texts, and the words of each text as numbers of distinct ones."""

    def __init__(self, texts: list[str]):
        big = " " + " ".join(t.lower() + " " for t in texts) + " "
        cp = np.frombuffer(big.encode("utf-32-le", "replace"), "<u4")
        kind = char_kinds()[cp]
        word = (kind == LETTER) | (kind == NUMBER)
        cp = np.where(word, cp, 32).astype(np.uint64)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        size = end - begin
        stops = np.cumsum([len(t.lower()) + 2 for t in texts])
        self.text_cut = np.searchsorted(begin, stops)
        if not len(begin):
            self.which = np.zeros(0, np.int64)
            self.word, self.mark = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.gram, self.gram_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        head = np.r_[0, np.cumsum(size)]
        place = np.arange(head[-1]) - np.repeat(head[:-1], size)
        spread = (cp[place + np.repeat(begin, size)] + np.uint64(77)) * _mix[place & 31] * (np.uint64(1) + (place >> 5).astype(np.uint64))
        mark = np.add.reduceat(spread ^ spread >> np.uint64(29), head[:-1])
        self.mark, first, self.which = np.unique(mark, return_index=True, return_inverse=True)
        self.word = (mark[first] >> np.uint64(20)).astype(np.int64) % BUCKETS
        begin, size = begin[first], size[first]
        grams, own = [], []
        for n in GRAMS:
            many = np.maximum(size + 3 - n, 0)
            who = np.repeat(np.arange(len(size)), many)
            at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + begin[who] - 1
            h = np.full(len(at), np.uint64(n))
            for i in range(n):
                h = h * _mix[40] + cp[at + i] * _mix[41 + i]
            grams.append((h >> np.uint64(33)).astype(np.int64) % BUCKETS)
            own.append(who)
        order = np.argsort(np.concatenate(own), kind="stable")
        self.gram = np.concatenate(grams)[order]
        self.gram_at = np.concatenate(own)[order]

    @classmethod
    def of_many(cls, texts: list[str]) -> Features:
        """The same for many texts, made block by block: of each block only the words that are new are kept."""
        known, n = np.zeros(0, np.uint64), 0
        marks, cuts, new, held = [], [], [], []
        for some in blocks(texts, BLOCK):
            f = cls(some)
            fresh = np.flatnonzero(~np.isin(f.mark, known))
            new.append(f.mark[fresh])
            held.append(subset(f, fresh))
            marks.append(f.mark[f.which] if len(f.which) else f.mark)
            cuts.append(f.text_cut + n)
            known, n = np.union1d(known, f.mark), n + len(f.which)
        if not held:
            return cls([])
        order = np.argsort(np.concatenate(new))
        out = object.__new__(cls)
        out.mark = known
        out.which, out.text_cut = np.searchsorted(known, np.concatenate(marks)), np.concatenate(cuts)
        out.word = np.concatenate([f.word for f in held])[order]
        starts = np.cumsum([0] + [len(f.word) for f in held])
        all_ = object.__new__(cls)
        all_.word = np.zeros(len(order), np.int64)
        all_.gram, all_.gram_at = np.concatenate([f.gram for f in held]), np.concatenate([f.gram_at + a for f, a in zip(held, starts)])
        own = subset(all_, order)
        out.gram, out.gram_at = own.gram, own.gram_at
        return out

    def inputs(self, p: dict) -> np.ndarray:
        """Word and character inputs of each distinct word."""
        n = len(self.word)
        if not n:
            return np.zeros((0, 2 * EMBED), np.float32)
        starts = np.searchsorted(self.gram_at, np.arange(n))
        self.many = np.diff(np.r_[starts, len(self.gram)])
        out = np.empty((n, 2 * EMBED), np.result_type(p["word"], np.float32))
        out[:, :EMBED] = p["word"][self.word]
        for low in range(0, n, PART):
            own = starts[low : low + PART]
            last = starts[low + PART] if low + PART < n else len(self.gram)
            out[low : low + PART, EMBED:] = np.add.reduceat(p["gram"][self.gram[own[0] : last]], own - own[0], axis=0) / self.many[low : low + PART, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW numbers of distinct words, -1 beyond a short text) and the text of each window."""
        low = np.r_[0, self.text_cut[:-1]]
        n = self.text_cut - low
        many = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = np.minimum(nth * STRIDE, np.maximum(n[text] - WINDOW, 0))
        at = start[:, None] + np.arange(WINDOW)
        real = at < n[text][:, None]
        if not len(self.which):
            return np.full(at.shape, -1), text
        return np.where(real, self.which[np.minimum(at + low[text][:, None], len(self.which) - 1)], -1), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int = 1) -> dict:
    r, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
    return {"word": np.zeros((BUCKETS, EMBED), np.float32), "gram": np.zeros((BUCKETS, EMBED), np.float32), "in": draw(2, 2 * EMBED, 3 * h, k=0.4), "in_b": np.zeros((2, 1, 3 * h), np.float32), "rec": draw(2, h, 3 * h, k=0.3), "att": draw(2 * h, h, k=0.3), "att_v": draw(h, k=0.5), "out": draw(2 * h, k=0.5), "out_b": np.zeros(1, np.float32)}


def forward(p: dict, gates: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logits of windows; ``gates`` (distinct words + 1, 2, 3 HIDDEN) has the empty word last."""
    n, h = len(at), HIDDEN
    mask = at >= 0
    full = bool(mask.all())
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((WINDOW, 2, n, h), np.float32)
    saved = []
    for t in range(WINDOW):
        x = np.stack([gates[at[:, t], 0], gates[at[:, WINDOW - 1 - t], 1]])
        u = state @ p["rec"]
        zr = 1 / (1 + np.exp(-(x[..., : 2 * h] + u[..., : 2 * h])))
        z, r = zr[..., :h], zr[..., h:]
        new = np.tanh(x[..., 2 * h :] + r * u[..., 2 * h :])
        nxt = new + z * (state - new)
        if not full:
            m = np.stack([mask[:, t], mask[:, WINDOW - 1 - t]])[..., None]
            nxt = np.where(m, nxt, state)
        if keep:
            saved.append((state, z, r, new, u[..., 2 * h :]))
        state = nxt
        states[t] = state
    both = np.concatenate([states[:, 0], states[::-1, 1]], 2)
    act = np.tanh(both @ p["att"])
    e = act @ p["att_v"]
    if not full:
        e = np.where(mask.T, e, -30)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, both)
    logit = pooled @ p["out"] + p["out_b"]
    return (logit, (mask, saved, both, act, a, pooled)) if keep else logit


def gates_of(p: dict, x: np.ndarray) -> np.ndarray:
    x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    return np.stack([x @ p["in"][d] + p["in_b"][d] for d in range(2)], 1).astype(np.float32)


def backward(p: dict, feats: Features, x: np.ndarray, at: np.ndarray, held: tuple, dlogit: np.ndarray) -> dict:
    mask, saved, both, act, a, pooled = held
    h, g = HIDDEN, {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
    g["out"], g["out_b"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
    dpool = dlogit[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", dpool, both)
    de = a * (da - (a * da).sum(0))
    de = np.where(mask.T, de, 0)
    dact = de[..., None] * p["att_v"] * (1 - act**2)
    g["att_v"] = np.einsum("tn,tnh->h", de, act)
    g["att"] = np.einsum("tnh,tnk->hk", both, dact)
    dboth = a[..., None] * dpool + dact @ p["att"].T
    ds = np.stack([dboth[..., :h], dboth[::-1, :, h:]], 1)
    dgates = np.zeros((len(x) + 1, 2, 3 * h), np.float32)
    dh = np.zeros_like(saved[0][0])
    for t in range(WINDOW - 1, -1, -1):
        state, z, r, new, un = saved[t]
        dh = dh + ds[t]
        m = np.stack([mask[:, t], mask[:, WINDOW - 1 - t]])[..., None]
        dn = np.where(m, dh * (1 - z) * (1 - new**2), 0)
        dz = np.where(m, dh * (state - new) * z * (1 - z), 0)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], 2)
        dx = np.concatenate([dz, dr, dn], 2)
        g["rec"] += state.transpose(0, 2, 1) @ du
        dh = np.where(m, dh * z, dh) + du @ p["rec"].transpose(0, 2, 1)
        for d, col in ((0, t), (1, WINDOW - 1 - t)):
            np.add.at(dgates[:, d], at[:, col], dx[d])
    dgates = dgates[:-1]
    dx = np.zeros_like(x)
    for d in range(2):
        g["in"][d] = x.T @ dgates[:, d]
        g["in_b"][d] = dgates[:, d].sum(0)
        dx += dgates[:, d] @ p["in"][d].T
    g["word"] = (feats.word, dx[:, :EMBED])
    g["gram"] = (feats.gram, (dx[:, EMBED:] / feats.many[:, None])[feats.gram_at])
    return g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, d in g.items():
            if isinstance(d, tuple):
                if not len(d[0]):
                    continue
                rows, back = np.unique(d[0], return_inverse=True)
                order = np.argsort(back, kind="stable")
                d = np.add.reduceat(d[1][order], np.searchsorted(back[order], np.arange(len(rows))), axis=0)
            else:
                rows = slice(None)
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * d
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * d * d
            self.p[k][rows] -= fix * m / (np.sqrt(v) + 1e-7)


def window_logits(p: dict, feats: Features, at: np.ndarray, step: int = 1024) -> np.ndarray:
    gates = gates_of(p, feats.inputs(p))
    return np.concatenate([forward(p, gates, at[i : i + step]) for i in range(0, len(at), step)]) if len(at) else np.zeros(0)


def highest(p: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the highest window logit, and which of the block's windows has it."""
    feats = Features(texts)
    at, text = feats.windows()
    logit = window_logits(p, feats, at)
    starts = np.searchsorted(text, np.arange(len(texts)))
    best = np.maximum.reduceat(logit, starts)
    first = np.flatnonzero(logit == best[text])
    return best, first[np.searchsorted(text[first], np.arange(len(texts)))]


def train(texts: list[str], label: np.ndarray, steps: int = STEPS, seed: int = 1) -> dict:
    """Fit the network; ``scale`` and ``shift`` turn a logit into the final one."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    aside, own = order[: len(order) // 5], order[len(order) // 5 :]
    p = start(seed)
    adam = Adam(p, 0.01)
    y = label.astype(np.float32)
    kinds = [np.flatnonzero(y[own] == k) for k in (0, 1)]
    held = Features.of_many([texts[i] for i in own])
    at, text = held.windows()
    starts = np.searchsorted(text, np.arange(len(own)))
    many = np.diff(np.r_[starts, len(text)])
    known = frequent(held, starts_of=np.r_[0, held.text_cut])
    best: tuple[float, dict] | None = None
    for step in range(steps):
        if step >= steps // 2 and step % TURN == 0:
            best = better(p, [texts[i] for i in aside], y[aside], best)
        if step >= steps // 4 and step % TURN == 0:
            logit = window_logits(p, held, at)
            first = np.flatnonzero(logit == np.maximum.reduceat(logit, starts)[text])
            top = first[np.searchsorted(text[first], np.arange(len(own)))]
        elif step < steps // 4:
            top = starts + (r.random(len(own)) * many).astype(np.int64)
        some = np.concatenate([r.choice(k, BATCH // 2) for k in kinds if len(k)])
        # of clean texts also windows that are not the highest
        any_ = starts + (r.random(len(own)) * many).astype(np.int64)
        pick = np.where((y[own[some]] == 0) & (r.random(len(some)) < 0.3), any_[some], top[some])
        rows = at[pick]
        distinct, back = np.unique(rows, return_inverse=True)
        off = int(distinct[0] < 0)
        part = subset(held, distinct[off:])
        local = back.reshape(rows.shape) - off
        x = part.inputs(p).astype(np.float32)
        logit, kept = forward(p, gates_of(p, x), local, True)
        d = (sigmoid(logit) - y[own[some]]) / len(some)
        grad = backward(p, part, x, local, kept, d.astype(np.float32))
        for name in ("word", "gram"):
            own_rows = known[name][grad[name][0]]
            grad[name] = (grad[name][0][own_rows], grad[name][1][own_rows])
        adam.step(grad)
    return better(p, [texts[i] for i in aside], y[aside], best)[1]


def better(p: dict, texts: list[str], y: np.ndarray, best: tuple[float, dict] | None) -> tuple[float, dict]:
    """The parameters, scaled on the texts set aside, if they predict those better than the best so far."""
    logit = np.concatenate([highest(p, some)[0] for some in blocks(texts, BLOCK)])
    fit_ = scale(logit, y)
    q = np.clip(sigmoid(fit_["scale"] * logit + fit_["shift"]), 1e-6, 1 - 1e-6)
    loss = float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    return (loss, {k: v.copy() for k, v in p.items()} | fit_) if best is None or loss < best[0] else best


def frequent(feats: Features, starts_of: np.ndarray) -> dict:
    """Buckets of words and grams that stand in several sampled texts; others would only be learned by heart."""
    texts = np.zeros(len(feats.word), np.int64)
    for low, high in zip(starts_of, starts_of[1:]):
        texts[np.unique(feats.which[low:high])] += 1
    word = np.bincount(feats.word, texts, BUCKETS) >= LEAST_TEXTS
    gram = np.bincount(feats.gram, texts[feats.gram_at], BUCKETS) >= LEAST_TEXTS
    return {"word": word, "gram": gram}


def subset(feats: Features, rows: np.ndarray) -> Features:
    out = object.__new__(Features)
    out.word = feats.word[rows]
    starts = np.searchsorted(feats.gram_at, rows)
    many = np.searchsorted(feats.gram_at, rows, side="right") - starts
    out.gram_at = np.repeat(np.arange(len(rows)), many)
    out.gram = feats.gram[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)]
    return out


def scale(logit: np.ndarray, y: np.ndarray) -> dict:
    """Logistic fit of labels on document logits, with a little weight on the starting line."""
    a, b, x = 1.0, 0.0, np.asarray(logit, np.float64)
    for _ in range(200):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        ga, gb = ((q - y) * x).sum() + 0.1 * (a - 1), (q - y).sum() + 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return {"scale": np.float64(max(a, 1e-3)), "shift": np.float64(b)}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> dict | None:
    """Train on at most ``sample`` toxic and twice as many clean rows, none of them held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    near = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    ids = [r for y, n in ((1, sample), (0, 2 * sample)) for r in known.where(F.col("toxic") == y).orderBy(*near).limit(n).collect()]
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "doc_id long, toxic int")
    # documents that repeat a sampled doc_id are one text each, so that the sample stays bounded
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample_ = found.select("doc_id", "toxic", spread(F.col("text"), longest).alias("text")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = sorted(((r["doc_id"], r["toxic"], r["text"] or "") for batch in batches for r in batch.to_pylist()), key=lambda r: r[0])
        y = np.array([r[1] for r in rows])
        if len(rows) >= 10 and len(set(y.tolist())) == 2:
            model = zlib.compress(pickle.dumps(train([r[2] for r in rows], y)), 1)
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = sample_.mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(zlib.decompress(got[0]["model"])) if got else None


def spread(text: Column, longest: int, piece: int = PIECE) -> Column:
    """A text of up to ``longest`` characters itself, of a longer one so many in pieces spread evenly over it."""
    n = max(longest // piece, 2)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.length(text) - piece) / (n - 1)).cast("int"))
    return F.when(F.length(text) > longest, F.concat_ws(" ", F.transform(at, lambda a: F.substring(text, a + 1, F.lit(piece))))).otherwise(text)


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` without its text plus ``score``, which replaces a column of that name."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in (text, "score")]
    out = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        forget()  # a worker that scores has no use for the tables of an encoder it ran before
        for batch in byte_slices(batches, text):
            got: list[float] = []
            for some in blocks(batch.column(text).to_pylist(), BLOCK):
                if p is None:
                    got += [0.0] * len(some)
                else:
                    logit = highest(p, some)[0].astype(np.float64)
                    got += sigmoid(p["scale"] * logit + p["shift"]).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(got, pa.float64())], names=out.names)

    return docs.mapInArrow(lean(run), out)
