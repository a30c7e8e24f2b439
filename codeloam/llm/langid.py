"""Language identification of words in context by a linear-chain conditional random field.

Words are the runs of letters of a text. A word's emission score for a language is the sum of weights of
its features: the whole word (a lexicon), prefixes and suffixes, and character n-grams, all hashed into
one table. Transitions between languages are learned with the emissions, from sequences spliced out of
passages in one or two languages, so code-switched text keeps a path for each. A document's languages are
the forward-backward marginals of its words; both passes run over all words of a batch at once, as blocked
scans of transition matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _LETTER, _classes
from .common import mapped, tidy

#: Feature buckets; languages that a model may have; labelled documents and words of each that it may be fitted on, and
#: bytes of a word from which it isn't learned from.
BUCKETS, LANGUAGES, SAMPLE_DOCS, SAMPLE_WORDS, WORD_BYTES = 1 << 17, 256, 1600, 4000, 256
#: Passages that a longer text's words are taken from.
PASSAGES = 20
#: Length of the spliced training sequences, how many make a step, and steps.
LENGTH, BATCH, STEPS = 24, 256, 260
#: Words that are scored side by side, and the length of a block of the scans.
CHUNK_WORDS, BLOCK = 1 << 17, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def learnable() -> Column:
    """Documents that a model may learn from: all but a fifth by the CRC-32 of their id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased, and how many each text has."""
    joined = "\n".join(texts).lower()
    data = joined.encode("utf-8", "surrogatepass")
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _classes()[cp] == _LETTER, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    lower_sizes = np.array([len(t.lower()) for t in texts], np.int64)
    limits = np.cumsum(lower_sizes + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    width = (cp > 0x7F).view(np.uint8) + (cp > 0x7FF).view(np.uint8) + (cp > 0xFFFF).view(np.uint8)
    at = np.arange(len(cp) + 1) + np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    a, b = at[starts], at[ends]
    length = b - a
    offsets = np.concatenate([[0], np.cumsum(length)])
    raw = np.frombuffer(data, np.uint8)
    flat = raw[np.repeat(a - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]), counts


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, word by word, and how many each has.

    By bytes: the word, its first and last 2, 3 and 4, and all runs of 3 and 4 with the edges marked."""
    _, cuts, held = words.buffers()
    cuts = np.frombuffer(cuts, np.int32)[: len(words) + 1].astype(np.int64)
    raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    size = np.diff(cuts)
    marked = np.full(int((size + 2).sum()), 1, np.uint64)  # each word between two edge marks
    base = np.concatenate([[0], np.cumsum(size + 2)])
    inner = np.repeat(base[:-1] + 1 - cuts[:-1], size) + np.arange(cuts[-1])
    marked[inner] = raw[: cuts[-1]] + np.uint64(2)
    n = size + 2
    owner_all, bucket_all = [], []

    def add(owner: np.ndarray, code: np.ndarray, kind: int) -> None:
        mixed = (code + np.uint64(kind << 56)) * _MIX
        bucket_all.append(((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - 17)).astype(np.int64))
        owner_all.append(owner)

    ids = np.arange(len(words))
    where = np.repeat(ids, n)
    room = base[where + 1] - np.arange(len(marked))  # marks from here to the word's end
    padded = np.concatenate([marked, np.zeros(8, np.uint64)])
    run = marked.copy()
    for k in range(2, 6):
        run = run * np.uint64(257) + padded[k - 1 : k - 1 + len(marked)]
        if k in (3, 4):
            ok = np.flatnonzero(room >= k)
            add(where[ok], run[ok], k)
        if k in (3, 4, 5):  # affixes of 2, 3 and 4 bytes with their edge
            ok = ids[n >= k]
            add(ok, run[base[ok]], 8 + k)
            add(ok, run[base[ok + 1] - k], 16 + k)
    # the word itself, as a polynomial over its bytes
    power = np.uint64(1000003) ** (np.arange(len(marked)) - base[where]).astype(np.uint64)
    whole = np.add.reduceat(marked * power, base[:-1]) if len(words) else np.zeros(0, np.uint64)
    add(ids, whole & np.uint64((1 << 56) - 1), 1)
    owner, bucket = np.concatenate(owner_all), np.concatenate(bucket_all)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """Languages, emission weights [BUCKETS, languages], transitions [from, to] and initial scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    initial: np.ndarray

    def emissions(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros((0, len(self.languages)), np.float32)
        bucket, counts = features(words)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(self.weights[bucket], first, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model | None:
    """A model of the labels, by stochastic gradients of the conditional log-likelihood."""
    languages = sorted(set(labels))
    if not languages:
        return None
    k = len(languages)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.eye(k, dtype=np.float32), np.zeros(k, np.float32))
    language = {name: i for i, name in enumerate(languages)}
    held, usable, total = [], [], 0
    for at in range(0, len(texts), 50):  # a few texts at once: the driver is small
        words, counts = words_of(texts[at : at + 50])
        start = 0
        for n, name in zip(counts.tolist(), labels[at : at + 50]):
            if n:
                held.append(words.slice(start, n))
                usable.append((total, total + n, language[name]))
                total += n
            start += n
        held = [pa.concat_arrays(held)] if held else []
    if not usable or k == 1:
        return model
    coded = held.pop().dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy(), coded.dictionary
    spoken = [[u for u in usable if u[2] == i] for i in range(k)]
    rng = np.random.default_rng(seed)
    squares = np.full((BUCKETS, k), 1e-6, np.float32)
    t_squares, i_squares = np.full((k, k), 1e-6, np.float32), np.full(k, 1e-6, np.float32)
    for _ in range(STEPS):
        token = np.zeros((BATCH, LENGTH), np.int64)
        truth = np.zeros((BATCH, LENGTH), np.int64)
        for r in range(BATCH):
            cut = int(rng.integers(4, LENGTH - 3)) if rng.random() < 0.5 else LENGTH
            for a, b in ((0, cut), (cut, LENGTH)):
                if a < b:
                    own = spoken[int(rng.integers(k))] or usable
                    lo, hi, lang = own[int(rng.integers(len(own)))]
                    start = int(rng.integers(lo, max(lo + 1, hi - (b - a) + 1)))
                    token[r, a:b] = ids[np.minimum(np.arange(start, start + b - a), hi - 1)]
                    truth[r, a:b] = lang
        unique, place = np.unique(token, return_inverse=True)
        place = place.reshape(token.shape)
        rows, spans = features(pa.concat_arrays([vocabulary.take(pa.array(unique))]))
        edge, scale = np.concatenate([[0], np.cumsum(spans)[:-1]]), 1 / np.sqrt(spans).astype(np.float32)
        scores = np.add.reduceat(model.weights[rows], edge, axis=0) * scale[:, None]
        marginal, pairs = _posterior(scores[place], model.transitions, model.initial)
        target = np.eye(k, dtype=np.float32)[truth]
        delta = np.zeros((len(unique), k), np.float32)
        np.add.at(delta, place.ravel(), (target - marginal).reshape(-1, k))
        grad = np.repeat(delta * scale[:, None], spans, axis=0)
        touched, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(touched), k), np.float32)
        np.add.at(total, at, grad)
        squares[touched] += total**2
        model.weights[touched] += 0.3 * total / np.sqrt(squares[touched])
        seen = np.einsum("rti,rtj->ij", target[:, :-1], target[:, 1:])
        t_grad = (seen - pairs) / BATCH
        t_squares += t_grad**2
        model.transitions += 0.1 * t_grad / np.sqrt(t_squares)
        i_grad = (target[:, 0] - marginal[:, 0]).mean(0)
        i_squares += i_grad**2
        model.initial += 0.1 * i_grad / np.sqrt(i_squares)
    return model


def _posterior(scores: np.ndarray, transitions: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences [rows, length, languages] side by side, and the expected transitions."""
    rows, length, k = scores.shape
    e, t = np.exp(scores - scores.max(-1, keepdims=True)), np.exp(transitions)
    forward, backward = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = e[:, 0] * np.exp(initial)
    forward[:, 0] /= forward[:, 0].sum(-1, keepdims=True)
    for i in range(1, length):
        forward[:, i] = (forward[:, i - 1] @ t) * e[:, i]
        forward[:, i] /= forward[:, i].sum(-1, keepdims=True)
    backward[:, -1] = 1
    for i in range(length - 2, -1, -1):
        backward[:, i] = (backward[:, i + 1] * e[:, i + 1]) @ t.T
        backward[:, i] /= backward[:, i].sum(-1, keepdims=True)
    both = forward * backward
    pairs = forward[:, :-1, :, None] * t * (backward[:, 1:] * e[:, 1:])[:, :, None, :]
    return both / both.sum(-1, keepdims=True), (pairs / pairs.sum((-1, -2), keepdims=True)).sum((0, 1))


def marginals(scores: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Marginals of chains laid end to end; starts: where each begins.

    Forward: a word's matrix is the transitions times its own likelihoods, at a start rank one. Blocks
    multiply their matrices side by side, the products are scanned, and each block replays. Backward is
    the same from the other end."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(-1, keepdims=True))
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    e = np.concatenate([e, np.ones((pad, k), e.dtype)])
    begins = np.zeros(n + pad, bool)
    begins[starts] = True
    begins[n:] = True
    t, init = np.exp(model.transitions), np.exp(model.initial)
    fresh = np.broadcast_to(init, (k, k))
    forward = _scan(e, begins, t, fresh, blocks)
    ends = np.concatenate([begins[1:], [True]])
    backward = _scan(np.concatenate([e[1:], np.ones((1, k), e.dtype)])[::-1], ends[::-1], t.T, None, blocks)[::-1]
    both = (forward * backward)[:n]
    return both / both.sum(-1, keepdims=True)


def _scan(e: np.ndarray, resets: np.ndarray, t: np.ndarray, fresh: np.ndarray | None, blocks: int) -> np.ndarray:
    """Running vectors: forward (v t) * e, with v t = fresh at a reset; backward (v * e) t, with 1 at a reset."""
    k = e.shape[1]
    e, resets = e.reshape(blocks, BLOCK, k), resets.reshape(blocks, BLOCK)
    one = np.ones((1, k), e.dtype)

    def step(v: np.ndarray, i: int) -> np.ndarray:
        """v: [blocks, rows, k]"""
        if fresh is not None:
            v = np.where(resets[:, i, None, None], v.sum(-1, keepdims=True) * fresh[0], v @ t) * e[:, i, None, :]
        else:
            v = np.where(resets[:, i, None, None], v.sum(-1, keepdims=True) * one, (v * e[:, i, None, :]) @ t)
        return v / np.maximum(v.sum((-1, -2), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(k, dtype=e.dtype), (blocks, k, k))
    for i in range(BLOCK):
        product = step(product, i)
    span, product = 1, product.copy()
    while span < blocks:  # inclusive scan of the blocks' products
        ahead = product[:-span] @ product[span:]
        product[span:] = ahead / np.maximum(ahead.sum((-1, -2), keepdims=True), 1e-300)
        span *= 2
    v = np.concatenate([one[None], (one / k) @ product[:-1]])
    out = np.empty_like(e)
    for i in range(BLOCK):
        v = step(v, i)
        out[:, i] = v[:, 0]
    return out.reshape(-1, k)


def label(texts: list[str], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text: the language with the largest sum of word marginals, and its share.

    'und' and 0 for a text without a letter."""
    words, counts = words_of(texts)
    k = len(model.languages)
    sums = np.zeros((len(texts), k))
    if len(words):
        coded = words.dictionary_encode()
        scores = model.emissions(coded.dictionary)[coded.indices.to_numpy()]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        some = counts > 0
        sums[some] = np.add.reduceat(marginals(scores.astype(np.float64), first[some], model), first[some], axis=0)
    best = sums.argmax(1)
    return [(model.languages[b], float(s[b] / c)) if c else ("und", 0.0) for b, s, c in zip(best, sums, counts)]


def excerpt(text: str) -> str:
    """At most SAMPLE_WORDS words of a text, from evenly spaced passages of all of it, without overlong ones."""
    words, _ = words_of([text])
    words = words.filter(pc.less_equal(pc.binary_length(words), WORD_BYTES))
    n, each = len(words), SAMPLE_WORDS // PASSAGES
    if n > SAMPLE_WORDS:
        words = pa.concat_arrays([words.slice(k * (n - each) // (PASSAGES - 1), each) for k in range(PASSAGES)])
    return b" ".join(words.to_pylist()).decode("utf-8", "replace")


def train(docs: DataFrame) -> Model | None:
    """Fit on at most SAMPLE_DOCS labelled documents, the first by the hash of their ids, in equal parts of
    each language; of each at most SAMPLE_WORDS words leave the tasks. None without a label; ValueError with more than
    LANGUAGES labels, as a model of so many is not of languages."""
    tidy(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different labels in lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [excerpt(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["h", "text"])

    texts, labels = [], []
    for name, n in counts.items():
        wanted = max(1, SAMPLE_DOCS // len(counts))
        own = rows.where(F.col("lang") == name).select("h", "text")
        # about twice as many as are wanted leave the tasks, however many tasks there are
        top = min(1.0, (2 * wanted + 50) / n)
        some = own if top == 1.0 else own.where(F.col("h") < F.lit(int(top * (1 << 64)) - (1 << 63)))
        short = lambda df: mapped(df, cut, "h long, text string").orderBy("h", "text").limit(wanted).collect()  # noqa: E731, B023
        found = short(some)
        if len(found) < min(wanted, n):
            found = short(own)
        texts += [r.text for r in found]
        labels += [name] * len(found)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs, all rows and columns, with the language and the score of each whole text under the two names.

    lang, source and doc_id are not read. Null texts and texts without a letter, or any without a model:
    'und' and 0. Columns of docs that have one of the names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    text = kept.index("text")
    shape = T.StructType([docs.schema[c] for c in kept] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            out: list[tuple[str, float]] = []
            while len(out) < len(texts):
                if own is None:
                    out = [("und", 0.0)] * len(texts)
                    break
                stop, size = len(out), 0
                while stop < len(texts) and size < 6 * CHUNK_WORDS:
                    size += len(texts[stop]) + 1
                    stop += 1
                out += label(texts[len(out) : stop], own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*kept, *names])

    return mapped(docs.select(*kept), run, shape)


def predict(docs: DataFrame) -> DataFrame:
    """Train on docs(doc_id, text, lang) and identify all of them."""
    found = identify(docs.select("doc_id", "text"), train(docs)).drop("text")
    return found.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")
