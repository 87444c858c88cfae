"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a hashed word embedding, the mean of its hashed character 4-gram embeddings, and three shrunken
log-odds of the label: of the word, of its beginning, and the greatest of its 4-grams. A window of words runs through a gated
recurrent unit in either direction; attention pools the states, and the pooled state gives the window's logit. Every
window of a text is scored, one for each start; the text's score is the highest. Training is plain numpy on a bounded,
documented sample of labelled rows, each with all windows of its whole text; the log-odds that a row trains with are
counted over other rows, so that words of one text teach nothing. Scoring runs in the tasks that hold the texts,
with the model broadcast (about 3 MB whatever the corpus).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from listenlake.llm import _text as T
from listenlake.runtime import ship_package

#: Words of a window, words between training windows' starts (every word is in one; scoring takes every start), hidden units of a direction.
WIDTH, STRIDE, HIDDEN = 16, 12, 8
#: Width of an embedding, its hash buckets, those of the log-odds, bytes of a word's beginning with its mark, width of a word's input.
DIM, BUCKETS, ODDS, HEAD = 8, 1 << 13, 1 << 18, 6
INPUT = 2 * DIM + 3
#: Rows that the log-odds are shrunk by, and parts of the sample whose rows train with the others' counts.
SHRINK, FOLDS = 3, 10
#: Defaults of the training sample's bounds: documents with label 1, with label 0, and bytes of text.
SAMPLE_1, SAMPLE_0, SAMPLE_BYTES = 800, 1200, 64 << 20
#: Windows whose states are held at once in training.
_CHUNK = 4096
#: Fixed value: held out is the row whose crc32(doc_id as text) leaves this remainder modulo 4.
HELD_OUT = 2
_BLOCK, _FULL, _GRAM = 4096, 2048, 4


class Words:
    """Distinct words of some texts as hashed features."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        h, first, self.inverse = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        bucket = lambda x, n: (x % np.uint64(n)).astype(np.int64)
        self.word, self.word_odds = bucket(h, BUCKETS), bucket(h, ODDS)
        s, e = starts[first], ends[first]
        n = e - s + 2  # with a mark at each end
        cum = np.cumsum(n) - n
        marked = np.zeros(int(n.sum()) + _GRAM, np.uint64)
        at = np.arange(int((e - s).sum())) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
        marked[np.repeat(cum + 1, e - s) + at] = buf[np.repeat(s, e - s) + at]
        code = np.zeros(len(marked) - _GRAM, np.uint64)
        for j in range(_GRAM):
            code = code * np.uint64(257) + marked[j : j + len(code)]
        grams = np.maximum(n - _GRAM + 1, 1)
        at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
        code = T.mix64(code[np.repeat(cum, grams) + at])
        self.gram, self.gram_odds = bucket(code, BUCKETS), bucket(code, ODDS)
        self.gram_start, self.grams = np.cumsum(grams) - grams, grams
        head = np.zeros(len(s), np.uint64)
        for j in range(HEAD):
            head = head * np.uint64(257) + np.where(j < n, marked[np.minimum(cum + j, len(marked) - 1)], 0).astype(np.uint64)
        self.head_odds = bucket(T.mix64(head + np.uint64(1)), ODDS)


def windows(counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of each window over rows of ``counts`` words; a row without words has none."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WIDTH) // stride)), 0)
    row = np.repeat(np.arange(len(counts)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    first = np.cumsum(counts) - counts
    return row, first[row] + at, np.minimum(counts[row] - at, WIDTH)


def squash(x: np.ndarray) -> np.ndarray:
    """The units' S-curve from -1 to 1, x / (1 + |x|); its slope is (1 - |squash(x)|) ** 2. A third of tanh's time."""
    return x / (np.float32(1) + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    """The S-curve from 0 to 1."""
    return np.float32(0.5) + np.float32(0.5) * squash(x)


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their place ``at`` among n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
        out[sorted_at[first]] = np.add.reduceat(rows[order], first)
    return out


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *shape, s=0.1: g.normal(0, s, shape).astype(np.float32)
        self.odds = {k: np.zeros(ODDS, np.float32) for k in ("word", "head", "gram")}
        self.p = {"word": r(BUCKETS, DIM, s=0.02), "gram": r(BUCKETS, DIM, s=0.02), "att": r(2 * HIDDEN), "out": r(2 * HIDDEN, s=0.3), "bias": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": r(INPUT, 3 * HIDDEN, s=0.4), f"U{d}": r(HIDDEN, 3 * HIDDEN, s=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, w: Words, odds: dict | None = None) -> np.ndarray:
        """Each distinct word's input; one row more, of zeros, for places past a window's end. odds: others than the network's."""
        odds = odds or self.odds
        x = np.zeros((len(w.word) + 1, INPUT), np.float32)
        if len(w.word):
            x[:-1, :DIM] = self.p["word"][w.word]
            x[:-1, DIM : 2 * DIM] = np.add.reduceat(self.p["gram"][w.gram], w.gram_start) / w.grams[:, None]
            x[:-1, 2 * DIM] = odds["word"][w.word_odds]
            x[:-1, 2 * DIM + 1] = odds["head"][w.head_odds]
            x[:-1, 2 * DIM + 2] = np.maximum.reduceat(odds["gram"][w.gram_odds], w.gram_start)
        return x

    def _direction(self, d: str, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        states = np.zeros((WIDTH, len(ids), HIDDEN), np.float32)
        h = np.zeros((len(ids), HIDDEN), np.float32)
        u, k = self.p[f"U{d}"], HIDDEN
        full = mask.all(0)
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            x, hu = gates[ids[:, t]], h @ u
            rz = gate(x[:, : 2 * k] + hu[:, : 2 * k])
            n = squash(x[:, 2 * k :] + rz[:, :k] * hu[:, 2 * k :])
            new = n + rz[:, k:] * (h - n)
            new = new if full[t] else np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, hu, rz, n))
            h = states[t] = new
        return states

    def logits(self, gates: dict, ids: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window of word ids; gates: the inputs' share of the gates, per distinct word and direction."""
        mask = np.arange(WIDTH) < lengths[:, None]
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self._direction(d, gates[d], ids, mask, kept[d]) for d in "fb"], axis=2)
        e = np.where(mask.T, s @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbk->bk", a, s)
        if keep is not None:
            keep |= {"mask": mask, "s": s, "a": a, "pooled": pooled, **kept}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gates(self, x: np.ndarray) -> dict:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _full(self, gates: dict, at: np.ndarray) -> np.ndarray:
        """Logits of full windows that start at ``at``: ``logits`` without masks and kept states; gates: three hidden rows a word place."""
        k, n = HIDDEN, len(at)
        sides = {}
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u = np.ascontiguousarray(self.p[f"U{d}"].T)
            u[2 * k :] *= np.float32(0.5)  # gates are kept at twice their value
            ends = np.stack((self.p["att"][part], self.p["out"][part]))
            h, side = np.zeros((k, n), np.float32), np.empty((WIDTH, 2, n), np.float32)
            hu, rz, size, new = (np.empty((rows * k, n), np.float32) for rows in (3, 2, 2, 1))
            close = int(at[-1]) - int(at[0]) == n - 1
            for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
                x = gates[d][:, at[0] + t : at[-1] + t + 1] if close else gates[d][:, at + t]
                np.matmul(u, h, out=hu)
                np.add(x[: 2 * k], hu[: 2 * k], out=rz)
                np.abs(rz, out=size)
                size += np.float32(1)
                rz /= size
                rz += np.float32(1)
                np.multiply(rz[:k], hu[2 * k :], out=new)
                new += x[2 * k :]
                np.abs(new, out=size[:k])
                size[:k] += np.float32(1)
                new /= size[:k]
                h -= new
                h *= rz[k:]
                h *= np.float32(0.5)
                h += new
                np.matmul(ends, h, out=side[t])
            sides[d] = side
        both = sides["f"]
        both += sides["b"]
        e = np.exp(both[:, 0] - both[:, 0].max(0))
        return np.einsum("tn,tn->n", e, both[:, 1]) / e.sum(0) + self.p["bias"][0]

    def score(self, w: Words, counts: np.ndarray) -> np.ndarray:
        """The highest window probability of each row; a row without words gets the bias's own."""
        row, first, length = windows(counts, 1)
        best = np.full(len(counts), -np.inf, np.float32)
        best[counts == 0] = self.p["bias"][0]
        gates = self.gates(self.inputs(w))
        padded = np.concatenate((w.inverse, np.full(WIDTH, len(w.word))))
        full = length == WIDTH
        short = np.flatnonzero(~full)
        for i in range(0, len(short), _BLOCK):
            some = short[i : i + _BLOCK]
            ids = np.where(np.arange(WIDTH) < length[some, None], padded[first[some, None] + np.arange(WIDTH)], len(w.word))
            np.maximum.at(best, row[some], self.logits(gates, ids, length[some]))
        row, first = row[full], first[full]
        for i in range(0, len(row), _FULL):
            at = first[i : i + _FULL]
            ids = padded[at[0] : at[-1] + WIDTH]
            placed = {d: np.ascontiguousarray(g[ids].T) for d, g in gates.items()}
            np.maximum.at(best, row[i : i + _FULL], self._full(placed, at - at[0]))
        return 1 / (1 + np.exp(-best.astype(np.float64)))

    def gradients(self, w: Words, ids: np.ndarray, lengths: np.ndarray, row: np.ndarray, label: np.ndarray, mask: np.ndarray | None = None, odds: dict | None = None) -> tuple[float, dict]:
        """Mean loss of the rows' labels and its gradients. A row's logit is its windows' softmax-weighted mean logit.

        Windows pass in chunks of a bounded number. mask: factors on the distinct words' inputs (dropout).
        """
        x = self.inputs(w, odds)
        if mask is not None:
            x[:-1] *= mask
        gates, n = self.gates(x), len(label)
        cuts = [slice(i, i + _CHUNK) for i in range(0, len(ids), _CHUNK)]
        keeps: list[dict] = [{} for _ in cuts]
        z = np.concatenate([self.logits(gates, ids[c], lengths[c], keep if len(cuts) == 1 else None) for c, keep in zip(cuts, keeps, strict=True)])
        top = np.full(n, -np.inf, np.float32)
        np.maximum.at(top, row, z)
        q = np.exp(z - top[row])
        q /= np.bincount(row, q, n)[row]
        doc = np.bincount(row, q * z, n)
        p = 1 / (1 + np.exp(-doc))
        loss = float(-np.mean(label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7)))
        dz = (((p - label) / n)[row] * q * (1 + z - doc[row])).astype(self.p["out"].dtype)
        g: dict = {}
        dgates = {d: np.zeros((len(x), 3 * HIDDEN), np.float32) for d in "fb"}
        for c, keep in zip(cuts, keeps, strict=True):
            if not keep:
                self.logits(gates, ids[c], lengths[c], keep)
            for k, v in self._backward(keep, ids[c], dz[c], dgates).items():
                g[k] = g[k] + v if k in g else v
        dx = np.zeros_like(x)
        for d in "fb":
            g[f"W{d}"], g[f"c{d}"] = x.T @ dgates[d], dgates[d][:-1].sum(0)
            dx += dgates[d] @ self.p[f"W{d}"].T
        if mask is not None:
            dx[:-1] *= mask
        g["word"] = _sums(dx[:-1, :DIM], w.word, BUCKETS)
        g["gram"] = _sums(np.repeat(dx[:-1, DIM : 2 * DIM] / w.grams[:, None], w.grams, axis=0), w.gram, BUCKETS)
        return loss, g

    def _backward(self, keep: dict, ids: np.ndarray, dz: np.ndarray, dgates: dict) -> dict:
        """Gradients of a chunk's windows; those of the distinct words' gates are added to ``dgates``."""
        g = {"out": keep["pooled"].T @ dz, "bias": np.array([dz.sum()], np.float32)}
        dpool = dz[:, None] * self.p["out"]
        s, a = keep["s"], keep["a"]
        da = np.einsum("tbk,bk->tb", s, dpool)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tb,tbk->k", de, s)
        ds = a[:, :, None] * dpool + de[:, :, None] * self.p["att"]
        k = HIDDEN
        slope = lambda y: (1 - np.abs(2 * y - 1)) ** 2 / 2  # noqa: E731  of a gate at value y
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u = self.p[f"U{d}"]
            du, each = np.zeros_like(u), np.empty((WIDTH, len(ids), 3 * k), np.float32)
            dh = np.zeros((len(ids), k), np.float32)
            for t, h, hu, rz, nn in reversed(keep[d]):
                dh = dh + ds[t][:, part]
                m = keep["mask"][:, t, None]
                dn_ = np.where(m, dh, 0)
                r, zz = rz[:, :k], rz[:, k:]
                dzz = dn_ * (h - nn) * slope(zz)
                dn = dn_ * (1 - zz) * (1 - np.abs(nn)) ** 2
                dr = dn * hu[:, 2 * k :] * slope(r)
                dg = np.concatenate((dr, dzz, dn), axis=1)
                dhu = np.concatenate((dr, dzz, dn * r), axis=1)
                du += h.T @ dhu
                each[t] = dg
                dh = np.where(m, dn_ * zz, dh) + dhu @ u.T
            dgates[d] += _sums(each.reshape(-1, 3 * k), ids.T.ravel(), len(dgates[d]))
            g[f"U{d}"] = du
        return g


def _words_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    buf, offs = T.flat(texts)
    buf = T.LOWER[buf]
    starts, ends, first = T.words(buf, offs, T.NOT_ALNUM)
    return Words(buf, starts, ends), np.diff(first)


def _windows_of(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, word ids and length of each training window) of whole texts."""
    w, counts = _words_of(texts)
    row, first, length = windows(counts)
    padded = np.concatenate((w.inverse, np.full(WIDTH, len(w.word))))
    return w, row, np.where(np.arange(WIDTH) < length[:, None], padded[first[:, None] + np.arange(WIDTH)], len(w.word)), length


def _odds(texts: list[str], labels: np.ndarray, part: np.ndarray) -> list[dict]:
    """Log-odds of the label by bucket, as tables for words, beginnings and 4-grams: all rows', then those without each part's."""
    n = np.zeros((FOLDS, 2))
    held = {k: np.zeros((FOLDS, 2, ODDS), np.float32) for k in ("word", "head", "gram")}
    for x, y, f in zip(texts, labels.astype(int).tolist(), part.tolist(), strict=True):
        w, _ = _words_of(pa.array([x], pa.large_string()))
        n[f, y] += 1
        for k in held:
            held[k][f, y][np.unique(getattr(w, f"{k}_odds"))] += 1

    def table(c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        prior = (rows[1] + 1) / (rows.sum() + 2)
        return np.log((c[1] + SHRINK * prior) / (c[0] + SHRINK * (1 - prior)) * ((1 - prior) / prior)).astype(np.float32)

    whole = {k: c.sum(0) for k, c in held.items()}
    return [{k: table(c - (held[k][f] if f >= 0 else 0), n.sum(0) - (n[f] if f >= 0 else 0)) for k, c in whole.items()} for f in range(-1, FOLDS)]


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.03, decay: float = 0.1, drop: float = 0.8, seed: int = 7) -> Network:
    """Fit a network to whole texts and their labels, by all windows of each.

    Against learning texts by heart, embeddings of a distinct word are dropped at random in a step, weights decay, and
    log-odds are those of other parts of the sample. The order, the dropout and the start come from ``seed``.
    """
    net = Network(seed)
    g = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    labels = np.asarray(labels, np.float64)
    part = np.empty(len(texts), np.int64)
    for y in (0, 1):  # both labels spread evenly
        own = g.permutation(np.flatnonzero(labels == y))
        part[own] = np.arange(len(own)) % FOLDS
    net.odds, *others = _odds(texts, labels, part)
    step, steps = 0, 0
    for _ in range(epochs):
        batches = []
        for f in range(FOLDS):
            own = g.permutation(np.flatnonzero(part == f))
            batches += [(f, own[i : i + batch]) for i in range(0, len(own), batch)]
        steps = steps or epochs * len(batches)
        for i in g.permutation(len(batches)):
            f, pick = batches[i]
            w, row, ids, length = _windows_of(pa.array([texts[j] for j in pick], pa.large_string()))
            some, own = np.unique(row, return_inverse=True)
            if len(some) == 0:
                continue
            mask = np.ones((len(w.word), INPUT), np.float32)
            mask[:, : 2 * DIM] = np.repeat((g.random((len(w.word), 2)) >= drop) / (1 - drop), DIM, axis=1)
            _, grad = net.gradients(w, ids, length, own, labels[pick[some]], mask, others[f])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, x in grad.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                if k != "bias":
                    net.p[k] *= np.float32(1 - now * decay)
    return net


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_1: int | None = None, sample_0: int | None = None, sample_bytes: int | None = None,
) -> Network:
    """Train on whole texts of labelled documents that are not held out.

    Bounds of the sample: at most ``sample_1`` and ``sample_0`` documents of either label (SAMPLE_1, SAMPLE_0), the least by
    a hash of the id, and of these, in that order, as many as hold ``sample_bytes`` of text together (SAMPLE_BYTES).
    Rows without id or label are left out; of several labels of one id the greatest counts, of several texts
    the least. Without any label the network stays untrained. Both labels are counted over all permitted rows; where
    a bound changes their ratio, the bias is set back by the log of the odds' ratio, so that scores mean the same at every size.
    """
    ship_package(docs.sparkSession)
    most = {1: SAMPLE_1 if sample_1 is None else sample_1, 0: SAMPLE_0 if sample_0 is None else sample_0}
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
    some = F.broadcast(least(1).union(least(0)))  # at most sample_1 + sample_0 rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", "toxic", "text", F.sum(F.octet_length("text").cast("long")).over(order).alias("held"))
    kept = sizes.where(F.col("held") <= (SAMPLE_BYTES if sample_bytes is None else sample_bytes)).select("doc_id", "toxic", "text").toPandas()
    if kept.empty:
        return Network()
    kept = kept.sort_values("doc_id")
    net = train(kept.text.tolist(), kept.toxic.to_numpy())
    n = dict(known.groupBy("toxic").count().collect())
    if len(n) == 2 and min(most.values()) > 0:
        net.p["bias"] += np.float32(np.log(n[1] / n[0] * min(n[0], most[0]) / min(n[1], most[1])))
    return net


def _score(net):
    def run(batches):
        for b in T.pieces(batches):
            yield pa.record_batch([b.column(0), pa.array(net.value.score(*_words_of(b.column(1))))], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of each row's whole text.

    Null text counts as empty and gets the score of no evidence; repeated rows are each scored; null ids stay null;
    other columns are ignored; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
