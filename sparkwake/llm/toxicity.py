"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, giving_back, pieces, small_batches

#: Bounds of the training sample: clean and toxic rows, bytes of text of each, and of a single text; longer texts take no part.
SAMPLE_ROWS = (2500, 1000)
SAMPLE_BYTES, TEXT_BYTES = 12 << 20, 1 << 20
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIM = 8
NGRAMS = (3, 6)
WINDOW, STEP = 4, 2
THRESHOLD = 0.7
EPOCHS, ROUNDS, BATCH = (2, 2), 8, 32
#: Distinct words whose sums a worker remembers.
WORDS = 200_000
#: Code points from which a text's words are not held.
GIANT = 1 << 20

_BLANK = dict.fromkeys(map(ord, ".,;:!?\"()"), " ")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams, ends marked, and of the word itself: (word's place, bucket) pairs.

    A rolling hash over all words laid end to end; windows that would leave their word are dropped.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(chars * _POWERS[place % len(_POWERS)], starts) if len(words) else np.zeros(0, np.uint64)
    owners, hashes = [np.arange(len(words))], [whole]
    rolling = chars.copy()
    for n in range(2, NGRAMS[1] + 1):
        rolling = rolling[:-1] * _PRIME + chars[n - 1 :]
        if n >= NGRAMS[0]:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            owners.append(owner[: len(rolling)][inside])
            hashes.append(rolling[inside] + np.uint64(n))
    mixed = np.concatenate(hashes) * _PRIME
    return np.concatenate(owners), ((mixed ^ (mixed >> np.uint64(32))) * _PRIME >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Model:
    """What scoring needs: each bucket's share in the difference of the two logits, and the bias."""

    share: np.ndarray
    bias: float


class _Bags:
    """Bags of words, each word a run of subwords in one flat array."""

    def __init__(self, bags: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.bags, self.flat, self.starts, self.sizes = bags, flat, starts, sizes

    def take(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([self.bags[i] for i in picked])
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[words] - (ends - sizes), sizes)
        per_bag = np.add.reduceat(sizes, np.cumsum([0] + [len(self.bags[i]) for i in picked[:-1]]))
        return self.flat[at], per_bag


def _descend(bags: _Bags, y: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, grad2: list, epochs: int, rng) -> None:
    """Adagrad on the softmax loss, embeddings and output layer together."""
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            flat, sizes = bags.take(picked)
            ends = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[flat], ends, axis=0) / sizes[:, None]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), y[picked]] -= 1
            p /= len(picked)
            d_mean = (p @ out.T) / sizes[:, None]
            d_out, d_bias = mean.T @ p, p.sum(axis=0)
            rows, back = np.unique(flat, return_inverse=True)
            d_emb = np.zeros((len(rows), emb.shape[1]), np.float32)
            np.add.at(d_emb, back, np.repeat(d_mean.astype(np.float32), sizes, axis=0))
            grad2[0][rows] += (d_emb**2).sum(axis=1)
            emb[rows] -= 0.5 * d_emb / np.sqrt(grad2[0][rows] + 1e-8)[:, None]
            grad2[1] += d_out**2
            out -= 0.2 * d_out / np.sqrt(grad2[1] + 1e-6)
            grad2[2] += d_bias**2
            bias -= 0.2 * d_bias / np.sqrt(grad2[2] + 1e-6)


def words_of(text: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return text.lower().translate(_BLANK).split()


def _windows(n: int) -> np.ndarray:
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def _window_logits(sums: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logit difference of every window; sums: per word, shares summed (real) and counted (imaginary)."""
    starts = _windows(len(sums))
    total = np.concatenate([[0], np.cumsum(sums)])
    bag = total[np.minimum(starts + WINDOW, len(sums))] - total[starts]
    return starts, bag.real / np.maximum(bag.imag, 1) + model.bias


def _laid_out(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of all words, word after word, and how many each has."""
    flat, sizes = [], []
    for i in range(0, len(words), at_once):
        owner, bucket = subwords(words[i : i + at_once])
        flat.append(bucket[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(words[i : i + at_once])))
    return np.concatenate(flat or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Fit on whole texts, then on the windows that decide: a toxic text is so by its worst passage.

    First every text is one bag. Then, ROUNDS times, the four highest-scoring windows of each toxic text stand for it, against
    the two highest and a random one of each clean text, and training goes on from there.
    """
    rng = np.random.default_rng(seed)
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), 9.0 if toxic and toxic[0] else -9.0)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    held = [i for i, doc in enumerate(docs) if len(doc)]
    docs, y = [docs[i] for i in held], y[held]
    flat, sizes = _laid_out(list(vocabulary))
    del vocabulary
    starts = np.cumsum(sizes) - sizes
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    grad2 = [np.zeros(BUCKETS), np.zeros_like(out), np.zeros(2)]
    _descend(_Bags([np.unique(doc) for doc in docs], flat, starts, sizes), y, emb, out, bias, grad2, EPOCHS[0], rng)
    for _ in range(ROUNDS):
        model = Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
        known = np.add.reduceat(model.share[flat], starts) + 1j * sizes
        bags, marks = [], []
        for doc, label in zip(docs, y, strict=True):
            windows, logits = _window_logits(known[doc], model)
            best = np.argsort(-logits, kind="stable")
            picked = [*windows[best[:4]]] if label else [*windows[best[:2]], *rng.choice(windows, 1)]
            bags += [doc[s : s + WINDOW] for s in picked]
            marks += [label] * len(picked)
        _descend(_Bags(bags, flat, starts, sizes), np.array(marks, np.int64), emb, out, bias, grad2, EPOCHS[1], rng)
    return Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A bounded training sample in seeded order: at most SAMPLE_ROWS and about SAMPLE_BYTES of each label. Columns text, y, turn and the id.

    Labels without a document, and documents over TEXT_BYTES, use up nothing of it. Only ids and sizes are looked at until the rows are
    chosen. Of rows that share an id one counts; labels that contradict each other count as toxic; other labels than 0 and 1, and null ids, do not count.
    """
    marked = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(id_col, F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("key")).where(F.col("n") <= TEXT_BYTES)
    known = sized.join(marked, id_col).groupBy(id_col, "y").agg(F.min(F.struct("n", "key")).alias("m"))
    turns = known.select(id_col, "y", "m.n", "m.key", F.xxhash64(F.lit(7), id_col).alias("turn"))
    chosen = turns.where("y = 0").orderBy("turn", id_col).limit(SAMPLE_ROWS[0]).unionByName(
        turns.where("y = 1").orderBy("turn", id_col).limit(SAMPLE_ROWS[1])
    )
    before = Window.partitionBy("y").orderBy("turn", id_col).rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES).drop("n", "before")
    texts = docs.select(id_col, text.alias("text")).withColumn("key", F.xxhash64("text")).join(chosen, [id_col, "key"])
    return texts.select("y", "turn", F.col(id_col).alias("id"), "text").dropDuplicates(["id"])


def learn_sums(words: set[str], sums: dict[str, complex], share: np.ndarray) -> None:
    """Add to sums: word -> complex(sum of its subwords' shares, their number)."""
    fresh = sorted(w for w in words if w not in sums)
    if fresh:
        owner, bucket = subwords(fresh)
        made = np.bincount(owner, share[bucket], len(fresh)) + 1j * np.bincount(owner, minlength=len(fresh))
        sums.update(zip(fresh, made.tolist(), strict=True))


def probability(words: list[str], sums: dict[str, complex], model: Model) -> float:
    """That of the worst window; of the empty bag if there are no words."""
    return _probability(np.fromiter(map(sums.__getitem__, words), complex, len(words)), model)


def _probability(each: np.ndarray, model: Model) -> float:
    logit = float(_window_logits(each, model)[1].max()) if len(each) else model.bias
    return float(1 / (1 + np.exp(-min(max(logit, -60), 60))))


def score_batches(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, complex] = {}
        for batch in batches:
            texts = [text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]
            if len(sums) > WORDS:
                sums = {}
            # the words of a giant text are read twice rather than held
            held = [list(map(words_of, pieces(text))) if len(text) < GIANT else None for text in texts]
            words_in = lambda text, kept: map(words_of, pieces(text)) if kept is None else kept
            learn_sums({w for pair in zip(texts, held, strict=True) for words in words_in(*pair) for w in words}, sums, model.share)
            scores = []
            for pair in zip(texts, held, strict=True):
                parts = [np.fromiter(map(sums.__getitem__, words), complex, len(words)) for words in words_in(*pair)]
                scores.append(_probability(np.concatenate(parts) if parts else np.zeros(0, complex), model))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names)

    return run


def _train_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["y"], r["turn"], str(r["id"]), r["text"]))
    texts, marks = [r["text"] for r in rows], [r["y"] for r in rows]
    del rows
    model = train(texts, marks)
    del texts
    give_back()
    return pa.table({"share": pa.array([model.share.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, **names: str) -> Model:
    """The model of the bounded sample, trained in one task; the driver gets one float per bucket and the bias."""
    small_batches(docs.sparkSession)
    made = sample(docs, labels, **names).groupBy(F.lit(0).alias("all")).applyInArrow(_train_group, "share binary, bias double").collect()
    if not made:
        return train([], [])
    return Model(np.frombuffer(made[0]["share"], np.float32).astype(np.float64), made[0]["bias"])


def score(
    docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), score_col: str = "score"
) -> DataFrame:
    """Probability of toxicity of every whole text: that of its worst window of WINDOW words.

    A window is the mean of its words' subword vectors, put through the softmax. Null and empty texts get the
    score of an empty bag, the bias; rows that repeat are scored each; of other columns those in ``carry`` are kept.

    Returns the carried columns and the score.
    """
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, F.col(text_col).alias("__text")).mapInArrow(
        giving_back(score_batches(model, [*carry, score_col])), f"{kinds}, `{score_col}` double"
    )
