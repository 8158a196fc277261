"""Language of words and texts by a linear-chain conditional random field.

Each word is labelled with a language. Its features are its beginnings and ends
of one to three letters, its n-grams of two and three letters, and whether it is
in a language's lexicon; transitions between the labels of neighbouring words
are learned as well, from training sequences that switch between languages.
Forward-backward gives each word's chances; a text's language is the one with
the largest mean chance over its words, and that mean is its score.

Only documents with a language whose crc32(doc_id as text) mod 4 is not 2 are
learned from, and of those a bounded sample: ``per_language`` documents of each
language by a hash, ``sequences`` training sequences in all. Prediction
is one narrow pass over whole texts; a text is cut into blocks, whose transfer
matrices are multiplied all at once and then chained, so long texts cost no more
a word than short ones.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
equal chances go to the alphabetically first language; if nothing can be learned
every text is ``und``; repeated rows give repeated results; a null doc_id is
never held out nor learned from; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import BoundedMemo, keep_rows, text_slices, worker_state
from loglattice.llm.toxicity import SharedModel

#: Documents of each language, training sequences and their words.
PER_LANGUAGE, SEQUENCES, SEQUENCE = 300, 3000, 48
#: Languages that are learned at most, and characters of a training text.
LANGUAGES, TRAINING_CHARS = 100, 20_000
#: Features and lexicon entries at most; a feature has to occur so often.
FEATURES, LEXICON, LEAST = 60_000, 4000, 3
BLOCK = 32
UNDETERMINED = "und"
ACCEPT = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(chunk: str) -> str:
    """The letters of a stretch of text without blanks, in lower case; empty if it has none."""
    return "".join(_LETTERS.findall(chunk)).lower()


def features(word: str) -> list[str]:
    marked = f"<{word}>"
    found = [f"={word}"]
    for n in (1, 2, 3):
        found += [f"^{word[:n]}", f"${word[-n:]}"]
    for n in (2, 3):
        found += [marked[k : k + n] for k in range(len(marked) - n + 1)]
    return found


@dataclass
class Model:
    languages: list[str]
    number: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray


class Labeller:
    """Applies a model; keeps the emission scores of each stretch of text."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.languages)
        self.memo = BoundedMemo(300_000)
        self.step = np.exp(model.transitions)

    def _compute(self, chunks: list[str]) -> list[bytes]:
        words = [letters(chunk) for chunk in chunks]
        emitted = iter(emissions(self.model, [w for w in words if w]))
        return [next(emitted).tobytes() if word else b"" for word in words]

    def emit(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(text or "").split() for text in texts]
        self.memo.admit({c for chunks in split for c in chunks}, self._compute)
        get = self.memo.young.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), np.float32).reshape(-1, self.width) for chunks in split]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The language of each text, its score, and how sure its words are: the mean of their largest chances."""
        none = (UNDETERMINED, 0.0, 0.0)
        if not self.width:
            return [none] * len(texts)
        emitted = self.emit(texts)
        full = [i for i, e in enumerate(emitted) if len(e)]
        out = [none] * len(texts)
        if full:
            for i, mean, sure in zip(full, *mean_chances([emitted[i] for i in full], self.step), strict=True):
                best = int(mean.argmax())
                out[i] = (self.model.languages[best], float(min(1.0, mean[best])), float(min(1.0, sure)))
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each stretch with a letter, and its own language: for code-switched text."""
        chunks = [c for c in text.split() if letters(c)]
        if not chunks or not self.width:
            return []
        emitted = np.frombuffer(b"".join(self._compute(chunks)), np.float32).reshape(-1, self.width)
        chances = chances_of([emitted], self.step)[0]
        return [(c, self.model.languages[k]) for c, k in zip(chunks, chances.argmax(axis=1).tolist(), strict=True)]


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """The sum of the weights of each word's features, as 32-bit floats."""
    number = model.number
    found = [[number[f] for f in features(word) if f in number] for word in words]
    n = np.array([len(x) for x in found])
    out = np.zeros((len(words), len(model.languages)), np.float32)
    flat = [i for x in found for i in x]
    if flat:
        some = np.flatnonzero(n)
        starts = np.cumsum(n[some]) - n[some]
        out[some] = np.add.reduceat(model.weights[flat], starts, axis=0)
    return out


def _blocks(emitted: list[np.ndarray], step: np.ndarray) -> tuple:
    """Chances of each word, by blocks: forward and backward over all blocks at once."""
    width = step.shape[0]
    sizes = np.array([len(e) for e in emitted])
    flat = np.concatenate(emitted).astype(np.float64)
    flat = np.exp(np.maximum(flat - flat.max(axis=1, keepdims=True), -30.0))
    each = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(sizes[text] - nth * BLOCK, BLOCK)
    begin = (np.cumsum(sizes) - sizes)[text] + nth * BLOCK
    order = np.argsort(-length, kind="stable")
    text, nth, length, begin = text[order], nth[order], length[order], begin[order]
    at = begin[:, None] + np.arange(BLOCK)
    e = np.where((np.arange(BLOCK) < length[:, None])[:, :, None], flat[np.minimum(at, len(flat) - 1)], 0.0)
    active = [int((length > j).sum()) for j in range(BLOCK)]
    # The transfer matrix of each block.
    transfer = np.broadcast_to(np.eye(width), (len(text), width, width)).copy()
    for j in range(int(length.max())):
        k = active[j]
        part = (transfer[:k].reshape(-1, width) @ step).reshape(k, width, width) * e[:k, j, None, :]
        if j % 8 == 7:
            part /= np.maximum(part.sum(axis=(1, 2), keepdims=True), 1e-300)
        transfer[:k] = part
    transfer /= np.maximum(transfer.sum(axis=(1, 2), keepdims=True), 1e-300)
    # Chained over the blocks of a text, from either end.
    where = np.full((len(sizes), int(each.max())), -1)
    where[text, nth] = np.arange(len(text))
    by_count = np.argsort(-each, kind="stable")
    where, count = where[by_count], each[by_count]
    into, behind = np.empty((len(text), width)), np.empty((len(text), width))
    state = np.full((len(sizes), width), 1 / width)
    for t in range(where.shape[1]):
        k = int((count > t).sum())
        b = where[:k, t]
        into[b] = state[:k]
        new = np.einsum("ni,nij->nj", state[:k], transfer[b])
        state[:k] = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
    state = np.full((len(sizes), width), 1.0)
    for t in range(where.shape[1] - 1, -1, -1):
        k = int((count > t).sum())
        b = where[:k, t]
        behind[b] = state[:k]
        new = np.einsum("nij,nj->ni", transfer[b], state[:k])
        state[:k] = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
    forward = np.zeros((len(text), BLOCK, width))
    state = into
    for j in range(int(length.max())):
        k = active[j]
        state = (state[:k] @ step) * e[:k, j]
        state /= np.maximum(state.sum(axis=1, keepdims=True), 1e-300)
        forward[:k, j] = state
    # Backwards, a block begins at its own last word.
    state = behind.copy()
    for j in range(int(length.max()) - 1, -1, -1):
        k = active[j]
        forward[:k, j] *= state[:k]
        new = (e[:k, j] * state[:k]) @ step.T
        state[:k] = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
    forward /= np.maximum(forward.sum(axis=2, keepdims=True), 1e-300)
    return forward, text, nth, length, sizes


def mean_chances(emitted: list[np.ndarray], step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean chances over its words, and the mean of its words' largest chances."""
    chances, text, _, _, sizes = _blocks(emitted, step)
    total, largest = np.zeros((len(sizes), step.shape[0])), np.zeros(len(sizes))
    np.add.at(total, text, chances.sum(axis=1))
    np.add.at(largest, text, chances.max(axis=2).sum(axis=1))
    return total / sizes[:, None], largest / sizes


def chances_of(emitted: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """The chances of each word of each text."""
    chances, text, nth, length, sizes = _blocks(emitted, step)
    out = [np.zeros((n, step.shape[0])) for n in sizes]
    for k in range(len(text)):
        out[text[k]][nth[k] * BLOCK : nth[k] * BLOCK + length[k]] = chances[k, : length[k]]
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the identifier as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, chars: int = TRAINING_CHARS) -> list[tuple[str, str]]:
    """(language, text) of ``per_language`` documents of each of the ``languages`` most frequent languages, by a hash of doc_id and text.

    Of a training text longer than ``chars`` letters a stretch of that length is
    taken, where the hash says. So what comes to the driver is bounded by the
    three numbers, and is the same in every run.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    common = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {row.lang: row.n for row in common.collect()}
    if not counts:
        return []
    space = 1 << 40
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(space, 2 * space * per_language // n)))])
    digest = F.xxhash64("doc_id", "text")
    start = 1 + F.pmod(digest, F.greatest(F.lit(1), F.char_length("text") - chars + 1)).cast("int")
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.coalesce(share[F.col("lang")], F.lit(0))).select("lang", F.substr("text", start, F.lit(chars)).alias("text"), digest.alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    rows = chosen.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).collect()
    return [(row.lang, row.text) for row in sorted(rows, key=lambda r: (r.lang, r.h, r.text))]


def training_sequences(texts: list[tuple[str, str]], languages: list[str], sequences: int, words: int) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of ``words`` words that switch between languages, and their labels."""
    rng = np.random.default_rng(11)
    by_language: list[list[list[str]]] = [[] for _ in languages]
    for lang, text in texts:
        found = [w for w in map(letters, text.split()) if w]
        if found:
            by_language[languages.index(lang)].append(found)
    usable = [k for k, docs in enumerate(by_language) if docs]
    out, labels = [], []
    for _ in range(sequences if usable else 0):
        seq: list[str] = []
        own: list[int] = []
        while len(seq) < words:
            k = usable[rng.integers(len(usable))]
            doc = by_language[k][rng.integers(len(by_language[k]))]
            n = int(rng.integers(4, words))
            at = int(rng.integers(len(doc)))
            part = doc[at : at + n][: words - len(seq)]
            seq += part
            own += [k] * len(part)
        out.append(seq)
        labels.append(own)
    return out, np.array(labels, np.int64).reshape(-1, words)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sequences: int = SEQUENCES) -> Model:
    """The model of ``docs`` (doc_id, text, lang)."""
    return fit_texts(training_texts(docs, per_language), sequences)


def fit_texts(texts: list[tuple[str, str]], sequences: int = SEQUENCES, words: int = SEQUENCE, steps: int = 60) -> Model:
    languages = sorted({lang for lang, text in texts if letters("".join(text.split()))})
    width = len(languages)
    seqs, labels = training_sequences(texts, languages, sequences, words)
    if not seqs:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
    ids = np.array([[vocabulary[w] for w in s] for s in seqs])
    times = np.bincount(ids.ravel(), minlength=len(vocabulary))
    every = [features(w) for w in vocabulary]
    count: Counter[str] = Counter()
    for found, n in zip(every, times.tolist(), strict=True):
        for f in found:
            count[f] += n
    lexicon = {f for f, _ in sorted(((f, n) for f, n in count.items() if f[0] == "="), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    names = [f for f, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= LEAST and (f[0] != "=" or f in lexicon)][:FEATURES]
    number = {f: i for i, f in enumerate(names)}
    flat = [[number[f] for f in found if f in number] for found in every]
    word = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    feature = np.array([i for x in flat for i in x], np.int64)
    observed = np.zeros((len(vocabulary), width))
    np.add.at(observed, (ids.ravel(), labels.ravel()), 1.0)
    moved = np.zeros((width, width))
    np.add.at(moved, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1.0)
    weights, transitions = np.zeros((len(names), width)), np.zeros((width, width))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, transitions)]
    by_word = lambda x: np.stack([np.bincount(word, x[feature, k], minlength=len(vocabulary)) for k in range(width)], axis=1)
    by_feature = lambda x: np.stack([np.bincount(feature, x[word, k], minlength=len(names)) for k in range(width)], axis=1)
    for t in range(1, steps + 1):
        expected, pairs = expectations(by_word(weights)[ids], np.exp(transitions))
        chance = np.stack([np.bincount(ids.ravel(), expected[:, :, k].ravel(), minlength=len(vocabulary)) for k in range(width)], axis=1)
        for p, s, g in ((weights, state[0], by_feature(observed - chance) - 0.5 * weights), (transitions, state[1], moved - pairs - 0.1 * transitions)):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p += 0.1 * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)
    return Model(languages, number, weights.astype(np.float32), transitions)


def expectations(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences of one length: chances of labels, and of pairs in all."""
    n, words, width = scores.shape
    e = np.exp(np.maximum(scores - scores.max(axis=2, keepdims=True), -30.0))
    forward, backward = np.empty_like(e), np.empty_like(e)
    state = np.full((n, width), 1 / width)
    for j in range(words):
        state = (state @ step) * e[:, j]
        state /= state.sum(axis=1, keepdims=True)
        forward[:, j] = state
    state = np.ones((n, width))
    for j in range(words - 1, -1, -1):
        backward[:, j] = state
        state = (e[:, j] * state) @ step.T
        state /= state.sum(axis=1, keepdims=True)
    chance = forward * backward
    chance /= chance.sum(axis=2, keepdims=True)
    pairs = np.zeros((width, width))
    for j in range(1, words):
        joint = forward[:, j - 1, :, None] * step * (e[:, j] * backward[:, j])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return chance, pairs


def labeller(shared: SharedModel) -> Labeller:
    """The worker's labeller of a broadcast model; made once a worker."""
    return worker_state(("langid", shared.id), lambda: Labeller(shared.value))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    shared = SharedModel(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(shared)
        for batch in batches:
            found = [x for _, texts in text_slices(batch.column(2)) for x in own.label(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows_in.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose words have a language that is sure by ACCEPT or more.

    How sure a text is is the mean of its words' largest chances, so a text that
    switches between languages stays. Texts without a letter go. Where no
    language was learned nothing can be told, and all rows stay.
    """
    if not model.languages:
        return docs
    shared = SharedModel(docs.sparkSession, model)
    return keep_rows(docs, lambda: lambda texts: [k != UNDETERMINED and sure >= ACCEPT for k, _, sure in labeller(shared).label(texts)])
