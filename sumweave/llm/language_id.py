"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's bytes, blanks included, are read by overlapping windows: CORE positions that get their labels from a window, and
CONTEXT bytes on both sides that both directions read before. Beyond the ends of a text stands the symbol EDGE, which holds
the states at zero; so a label depends on the text alone, whatever else is in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textbytes import Texts, chunks

HIDDEN = 12
CORE = 256
CONTEXT = 16
EDGE = 256
#: The model is fitted on so many labelled documents of each language at most, those of least hash. From each whole text,
#: whatever its length, DRAWN windows of TRAINED bytes at most are drawn at even odds; they are what the driver gets.
SAMPLE_DOCS = 400
DRAWN = 8
TRAINED = 64
#: Windows of all languages together that an epoch learns from, and the least of each language.
WINDOWS, LEAST_WINDOWS = 10_000, 50
EPOCHS = 3
BATCH = 128
#: Numbers (windows x positions x languages) that are worked on at once.
HELD = 1 << 21
#: Up to so many languages are broadcast to the scan that samples them; more are joined.
FEW_LANGS = 10_000
_SEED = 7


def _init(rng: np.random.Generator, n_out: int, hidden: int) -> dict[str, np.ndarray]:
    p = {"out": rng.normal(0, 0.2, (2 * hidden, n_out)), "bias": np.zeros(n_out)}
    for d in "fb":
        p |= {"x" + d: rng.normal(0, 0.3, (257, 3 * hidden)), "h" + d: rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))}
        # closed gates and no news: the state is zero after an EDGE
        p["x" + d][EDGE] = np.repeat([-80.0, -80.0, 0.0], hidden)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _forward(p: dict, d: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States of one direction at each position: length x hidden x n. x: length x n."""
    length, n = x.shape
    into, over = p["x" + d], np.ascontiguousarray(p["h" + d].T)
    size = over.shape[1]
    h, out = np.zeros((size, n), over.dtype), np.empty((length, size, n), over.dtype)
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        a, u = into[x[t]].T, over @ h
        gates = _gate(a[: 2 * size] + u[: 2 * size])
        r, z = gates[:size], gates[size:]
        new = u[2 * size :] * r
        new += a[2 * size :]
        np.tanh(new, out=new)
        if tape is not None:
            tape.append((t, h, r, z, new, u[2 * size :]))
        h = h - new
        h *= z
        h += new
        out[t] = h
    return out


def _backward(p: dict, d: str, x: np.ndarray, tape: list, grad: np.ndarray, g: dict) -> None:
    over = p["h" + d]
    size = over.shape[0]
    carried = np.zeros((size, x.shape[1]), over.dtype)
    steps = np.empty((x.shape[0], 3 * size, x.shape[1]), over.dtype)
    for t, h, r, z, new, u in reversed(tape):
        dh = grad[t] + carried
        dz = dh * (h - new) * z * (1 - z)
        da = dh * (1 - z) * (1 - new * new)
        dr = da * u * r * (1 - r)
        du = np.concatenate([dr, dz, da * r])
        carried = dh * z + over @ du
        g["h" + d] += h @ du.T
        steps[t, : 2 * size], steps[t, 2 * size :] = du[: 2 * size], da
    rows = x.ravel()
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
    g["x" + d][rows[order[first]]] = np.add.reduceat(steps.transpose(0, 2, 1).reshape(len(rows), -1)[order], first)
    g["x" + d][EDGE] = 0  # fixed


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the second of three axes."""
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    return x


def _chances(p: dict, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
    size = forth.shape[1]
    return _softmax(p["out"][:size].T @ forth + p["out"][size:].T @ back + p["bias"][:, None])


def label(p: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at each position: length x languages x n. x: symbols, length x n."""
    return _chances(p, _forward(p, "f", x), _forward(p, "b", x))


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions that are no EDGE, and its gradients, by backpropagation through time.
    x: symbols, length x n; y: languages."""
    tapes: dict[str, list] = {"f": [], "b": []}
    h = {d: _forward(p, d, x, tapes[d]) for d in "fb"}
    q = _chances(p, h["f"], h["b"])
    n, inside = np.arange(len(y)), x != EDGE
    many = max(1, inside.sum())
    loss = -(np.log(q[:, y, n] + 1e-9) * inside).sum() / many
    q[:, y, n] -= 1
    q *= (inside / many)[:, None, :]
    size = p["hf"].shape[0]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for k, d in enumerate("fb"):
        rows = slice(k * size, (k + 1) * size)
        g["out"][rows] = np.einsum("lhn,lkn->hk", h[d], q, optimize=True)
        _backward(p, d, x, tapes[d], p["out"][rows] @ q, g)
    g["bias"] = q.sum((0, 2))
    return float(loss), g


def train(windows: list[bytes], labels: np.ndarray, n_out: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = _SEED) -> dict[str, np.ndarray]:
    """Adam over batches of windows; a shorter window is filled up with EDGE."""
    rng = np.random.default_rng(seed)
    p = _init(rng, n_out, hidden)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    data = np.full((max(map(len, windows)), len(windows)), EDGE, np.int16)
    for i, w in enumerate(windows):
        data[: len(w), i] = np.frombuffer(w, np.uint8)
    steps = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), -(-len(windows) // BATCH)):
            _, g = gradients(p, data[:, part], labels[part])
            rate = 0.01 * (1 - step / steps)
            step += 1
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
                p[key] = (p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return p


def _folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return np.where((buf >= 65) & (buf < 91), buf + 32, buf).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    """Null ids aren't held out; they aren't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each whole text, from places that its hash h decides."""
    for b in batches:
        hashes, out = b.column(b.schema.get_field_index("h")).to_numpy(), []
        for lo, _, t in chunks(b):
            for i in range(t.n):
                x = _folded(t.buf[t.offs[i] : t.offs[i + 1]])
                many = min(DRAWN, -(-len(x) // TRAINED))
                places = np.random.default_rng([_SEED, int(hashes[lo + i])]).integers(0, max(1, len(x) - TRAINED + 1), many)
                out.append([x[k : k + TRAINED].tobytes() for k in places.tolist()])
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("lang", "h", "doc_id")] + [pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "doc_id", "windows"])


def fit(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, model) from text and lang of labelled documents that aren't held out; (["und"], None) without any.

    Every language with a document of some text is learned, however long its texts are. The sample grows with the
    languages, not with the documents."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0) & ~held_out(F.col("doc_id")))
    own = own.select("lang", "doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(1 << 32)).alias("h"))
    # counted first, so that about twice the sample is drawn and shuffled, whatever the input
    counts = own.groupBy("lang").agg(F.count("*").cast("decimal(20,0)").alias("n")).collect()
    if not counts:
        return ["und"], None
    table = spark.createDataFrame(counts, "lang string, n decimal(20,0)")
    near = own.join(F.broadcast(table) if len(counts) <= FEW_LANGS else table, "lang").where(F.col("h") * F.col("n") < F.lit((2 * SAMPLE_DOCS + 100) << 32))
    drawn = near.select("lang", "h", "doc_id", "text").mapInArrow(_draw, f"lang string, h long, doc_id {kind}, windows array<binary>")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "windows")
    sample = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).orderBy("lang", "k").select("lang", "windows").collect()
    by: dict[str, list[bytes]] = {}
    for r in sample:
        by.setdefault(r["lang"], []).extend(map(bytes, r["windows"]))
    langs = sorted(by)
    rng = np.random.default_rng(_SEED)
    windows, labels = [], []
    each = max(LEAST_WINDOWS, WINDOWS // len(langs))
    for k, lang in enumerate(langs):
        pool = by[lang]
        picked = rng.permutation(len(pool))[:each] if len(pool) >= each else rng.integers(0, len(pool), each)
        windows += [pool[i] for i in picked]
        labels += [k] * each
    return langs, train(windows, np.array(labels), len(langs))


def pooled(p: dict, t: Texts) -> np.ndarray:
    """Mean probabilities of each text's positions; zeros for an empty text."""
    buf, sizes = _folded(t.buf), np.diff(t.offs)
    many = -(-sizes // CORE)
    doc = np.repeat(np.arange(t.n), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = t.offs[:-1][doc] + nth * CORE
    size = np.minimum(CORE, t.offs[1:][doc] - first)
    sums = np.zeros((len(p["bias"]), t.n))
    order = np.argsort(-size, kind="stable")  # windows of like sizes together
    width = max(16, min(2048, HELD // (CORE + 2 * CONTEXT) // len(p["bias"])))
    for lo in range(0, len(order), width):
        own = order[lo : lo + width]
        at = first[own] + np.arange(-CONTEXT, size[own[0]] + CONTEXT)[:, None]
        inside = (at >= t.offs[doc[own]]) & (at < t.offs[doc[own] + 1])
        x = np.where(inside, buf[np.clip(at, 0, len(buf) - 1)], np.int16(EDGE))
        q = label(p, x)[CONTEXT : CONTEXT + size[own[0]]]
        mine = np.arange(len(q))[:, None] < size[own]
        got = np.einsum("lkn,ln->kn", q, mine.astype(q.dtype))
        for k in range(len(sums)):
            sums[k] += np.bincount(doc[own], weights=got[k], minlength=t.n)
    return (sums / np.maximum(sizes, 1)).T


def predict(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text).

    Null text or one without a letter: und, score 0. Every byte of a text is labelled, whatever its length; a very long
    text is worked on by some thousand windows at once. Of languages with equal probabilities the first by name is taken.
    Repeated rows are predicted alike; no documents give no rows; other columns are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = pc.fill_null(pc.match_substring_regex(b.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, t in chunks(b):
                q = pooled(model, t) if model is not None else np.zeros((t.n, 1))
                best, some = q.argmax(1), lettered[lo:hi] & (model is not None)
                pred = np.where(some, np.array(langs, object)[best], "und")
                score = np.where(some, np.clip(q[np.arange(t.n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs))
