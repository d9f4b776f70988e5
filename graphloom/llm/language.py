"""Language identification with a linear-chain conditional random field.

Words are labelled one by one, so code-switched text gets mixed labels. A word's evidence is a sum
of learned weights of hashed features: the word itself (lexicon), its affixes, and character n-grams.
Learned transition weights tie neighbours together, and forward-backward turns both into posterior
probabilities of every word's language. A document gets the language with the greatest mean
posterior over its words, and that mean is its score.

Learning uses a bounded sample: at most ``TRAIN_ROWS`` texts for each language, those of the smallest
hashes, and of those as many as have ``TRAIN_CHARACTERS`` together (one at least); their words carry
their document's language. Prediction reads whole texts: a chain is a whole text, and its blocks of
``BLOCK`` words, which are worked on at once, are linked exactly by their transfer matrices.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any row to
learn from every text is; ties go to the alphabetically first language; words without a letter are
passed over; scripts without blanks are cut into short runs that count as words; words and texts may be
of any length; an empty table gives an empty result; repeated rows give repeated results; a row without
``doc_id`` counts as not held out and is not learned from; columns other than ``doc_id``, ``text`` and, for
learning, ``lang`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import pieces
from graphloom.llm.shared import sample_by_hash, text_or_empty, worker_state

TRAIN_ROWS, TRAIN_CHARACTERS = 150, 2_000_000
#: Words of a chain that are worked on one after another; blocks of them go side by side.
BLOCK = 256
BUCKETS = 1 << 17
#: A word's n-grams are taken from overlapping slices of so many characters and both end marks.
WIDTH = 20
STEPS, RATE, DECAY = 20, 0.25, 1e-4
#: A worker forgets its words' evidence beyond so many (it is only a cache).
MEMO_WORDS, MEMO_CHARACTERS = 250_000, 5_000_000
#: Fixed value: scripts that write no blanks between words (South-East Asian ones, kana, Chinese characters).
UNSPACED = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u312f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]"
RUNS = re.compile(f"{UNSPACED}{{1,4}}|(?:(?!{UNSPACED}).)+", re.DOTALL)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def words_of(text: str) -> list[str]:
    """The words between white space; scripts without blanks are cut into runs of at most four characters."""
    words = text.split()
    if text.isascii() or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() < 0x0E00:
        return words
    return [run for w in words for run in ((w,) if w.isascii() else RUNS.findall(w))]


def feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word's slices, one row per slice, and each word's first row; BUCKETS stands for none.

    Every n-gram of the word belongs to one slice only.
    """
    lower = [w.lower() for w in words]
    width, step = WIDTH + 2, WIDTH - 1
    counts = np.array([max(0, -((width - 2 - len(w)) // step)) + 1 for w in lower], np.int64)
    first = np.cumsum(counts) - counts
    more = np.ones(counts.sum(), bool)
    more[first + counts - 1] = False
    text = "".join(part.ljust(width, "\0") for w in lower for part in ((f"\x02{w}\x03",) if len(w) <= WIDTH else _slices(f"\x02{w}\x03", width, step)))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(more), width).astype(np.uint64)
    present = codes > 0
    columns = []
    hashed, whole = np.zeros_like(codes), present.copy()
    # n-grams of one to four characters; with the marks at both ends they are affixes too
    for n in range(1, 5):
        m = codes.shape[1] - n + 1
        hashed = (hashed[:, :m] * np.uint64(0x9E3779B97F4A7C15) + codes[:, n - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
        whole = whole[:, :m] & present[:, n - 1 :]
        if n == 4:
            # only the affixes of three characters
            whole = whole & ((codes[:, :m] == 2) | (codes[:, n - 1 :] == 3))
        # the next slice begins with those that start beyond the step
        own = whole & ~(more[:, None] & (np.arange(m) >= step))
        columns.append(np.where(own, (hashed >> np.uint64(40)) % np.uint64(BUCKETS), np.uint64(BUCKETS)))
    lexicon = np.full((len(more), 1), BUCKETS, np.uint64)
    lexicon[first, 0] = [hash_word(w) for w in lower]
    return np.concatenate([*columns, lexicon], 1).astype(np.int32), first


def _slices(word: str, width: int, step: int):
    """Slices that overlap by width - step; the last one has the word's end."""
    return (word[k : k + width] for k in range(0, max(len(word) - width, 0) + step, step))


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def evidence(model_weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features; the row beyond BUCKETS is zero."""
    out = np.zeros((len(ids), model_weights.shape[1]), np.float32)
    for k in range(ids.shape[1]):
        out += model_weights[ids[:, k]]
    return out if len(first) == len(ids) else np.add.reduceat(out, first, axis=0)


def _blocks(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, chain and place of the blocks of chains that follow each other."""
    parts = -(-lens // BLOCK)
    chain = np.repeat(np.arange(len(lens)), parts)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = (np.cumsum(lens) - lens)[chain] + place * BLOCK
    return starts, np.minimum(BLOCK, lens[chain] - place * BLOCK), chain, place


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows, or matrices, that sum to one."""
    axes = tuple(range(1, x.ndim))
    return x / np.maximum(x.sum(axes, keepdims=True), 1e-300)


def forward_backward(scores: np.ndarray, lens: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posteriors of every word, and expected transitions, of chains that follow each other in ``scores``.

    All blocks advance together, longest first, so that those still running are a prefix. A block that
    continues a chain is first reduced to the product of its steps; a pass over these products carries
    what lies before and behind into every block.
    """
    starts, sizes, chain, place = _blocks(lens)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, chain, place = starts[order], sizes[order], chain[order], place[order]
    local = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    step = np.exp(transitions - transitions.max())
    n, labels = scores.shape
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    before, behind = _carried(local, step, starts, sizes, chain, place)
    later = place > 0
    forward = np.zeros((n, labels))
    a = None
    for t in range(longest):
        m = running[t]
        at = starts[:m] + t
        a = np.where(later[:m, None], before[:m] @ step, 1.0) * local[at] if t == 0 else (a[:m] @ step) * local[at]
        a = forward[at] = _scaled(a)
    posterior, expected = np.zeros((n, labels)), np.zeros((labels, labels))
    b = np.ones((0, labels))
    for t in range(longest - 1, -1, -1):
        m = running[t]
        at = starts[:m] + t
        back = behind[:m].copy()
        back[: len(b)] = b
        posterior[at] = _scaled(forward[at] * back)
        inner = back * local[at]
        if pairs:
            some = slice(None) if t else later[:m]
            expected += _scaled(forward[at[some] - 1][:, :, None] * step[None] * inner[some][:, None, :]).sum(0)
        b = _scaled(inner @ step.T)
    return posterior, expected


def _carried(local: np.ndarray, step: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every block the forward vector of the word before it and the backward vector of its last word."""
    labels = local.shape[1]
    before, behind = np.ones((len(starts), labels)), np.ones((len(starts), labels))
    many = np.flatnonzero(np.isin(chain, chain[place > 0]))
    if not len(many):
        return before, behind
    # blocks of one chain only matter where it has several; sizes fall, so those running are a prefix
    own, length = starts[many], sizes[many]
    first = place[many] == 0
    product = np.broadcast_to(np.eye(labels), (len(many), labels, labels)).copy()
    for t in range(int(length[0])):
        m = np.searchsorted(-length, -t, side="left")
        moved = product[:m] @ step if t else np.where(first[:m, None, None], product[:m], product[:m] @ step)
        product[:m] = _scaled(moved * local[own[:m] + t][:, None, :])
    by_place = np.lexsort((chain[many], place[many]))
    bounds = np.flatnonzero(np.diff(place[many][by_place], prepend=-1))
    levels = np.split(by_place, bounds[1:])
    ends = np.ones((int(chain.max()) + 1, labels))
    for level in levels:
        c = chain[many][level]
        before[many[level]] = ends[c]
        ends[c] = _scaled((ends[c][:, None, :] @ product[level])[:, 0])
    ends[:] = 1.0
    for level in reversed(levels):
        c = chain[many][level]
        behind[many[level]] = ends[c]
        ends[c] = _scaled((product[level] @ ends[c][:, :, None])[:, :, 0])
    return before, behind


def fit(texts: list[str], langs: list[str]) -> Model:
    """Maximise the conditional likelihood of the sample's labels by adaptive gradient steps."""
    labels = sorted(set(langs))
    known: dict[str, int] = {}
    words, lens = [], []
    for t in texts:
        own = [known.setdefault(w, len(known)) for w in words_of(t) if has_letter(w)]
        words.append(np.array(own, np.int64))
        lens.append(len(own))
    lens = np.array(lens, np.int64)
    size = len(labels)
    weights, transitions = np.zeros((BUCKETS + 1, size), np.float32), np.zeros((size, size))
    if not lens.sum():
        return Model(labels, weights, transitions)
    flat = np.concatenate(words)
    truth = np.repeat(np.array([labels.index(x) for x in langs]), lens)
    ids, first = feature_ids(list(known))
    slices = np.diff(np.append(first, len(ids)))
    gold = np.zeros((size, size))
    inner = np.ones(len(flat), bool)
    inner[(np.cumsum(lens) - lens)[lens > 0]] = False
    np.add.at(gold, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
    share = 1.0 / len(flat)
    grown_w, grown_t = np.full(weights.shape, 1e-10, np.float32), np.full(transitions.shape, 1e-8)
    flat_ids = ids.ravel()
    for _ in range(STEPS):
        scores = evidence(weights, ids, first)[flat]
        posterior, expected = forward_backward(scores, lens, transitions, pairs=True)
        posterior[np.arange(len(flat)), truth] -= 1
        for k in range(size):
            by_word = np.bincount(flat, posterior[:, k], len(known)) * share
            g = np.bincount(flat_ids, np.repeat(by_word, slices * ids.shape[1]), BUCKETS + 1).astype(np.float32) + DECAY * share * weights[:, k]
            g[BUCKETS] = 0
            grown_w[:, k] += g * g
            weights[:, k] -= RATE * g / np.sqrt(grown_w[:, k])
        weights[BUCKETS] = 0
        g = (expected - gold) * share + 1e-3 * transitions
        grown_t += g * g
        transitions -= RATE * g / np.sqrt(grown_t)
    return Model(labels, weights, transitions)


def train(docs: DataFrame) -> Model | None:
    """Learn from rows with text and language that are not held out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(42)), "text")
    sample = sample_by_hash(rows, TRAIN_ROWS, "lang").withColumn("n", F.row_number().over(order)).withColumn("total", F.sum(F.length("text")).over(order))
    sample = sample.where((F.col("n") == 1) | (F.col("total") <= TRAIN_CHARACTERS)).select("lang", "text").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.lang, r.text))
    return fit([r.text for r in sample], [r.lang for r in sample])


def held_out():
    """Whether crc32 of the id's text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Labeller:
    """Applies a model; remembers the evidence of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.characters = 0
        self.scores = np.zeros((1 << 12, len(self.model.labels)), np.float32)
        self.worded = np.zeros(1 << 12, bool)

    def _learn(self, new: list[str]) -> None:
        known = len(self.memo)
        while known + len(new) > len(self.scores):
            self.scores, self.worded = np.concatenate([self.scores, self.scores]), np.concatenate([self.worded, self.worded])
        # parts of bounded length, though a word may be as long as a text
        ends = np.cumsum([max(len(w), WIDTH) for w in new])
        self.characters += int(ends[-1])
        cuts = np.flatnonzero(np.diff(ends // (20_000 * WIDTH))) + 1
        for k, until in zip([0, *cuts], [*cuts, len(new)], strict=True):
            self.scores[known + k : known + until] = evidence(self.model.weights, *feature_ids(new[k:until]))
        self.worded[known : known + len(new)] = [has_letter(w) for w in new]
        self.memo.update(zip(new, range(known, known + len(new)), strict=True))

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words with a letter, and their number in each text."""
        if len(self.memo) > MEMO_WORDS or self.characters > MEMO_WORDS * WIDTH + MEMO_CHARACTERS:
            self.forget()
        split = [words_of(t) for t in texts]
        memo = self.memo
        new = {w for row in split for w in row if w not in memo}
        if new:
            self._learn(sorted(new))
        lens = np.array([len(row) for row in split], np.int64)
        index = np.fromiter((memo[w] for row in split for w in row), np.int64, int(lens.sum()))
        worded = self.worded[index]
        lens = np.bincount(np.repeat(np.arange(len(texts)), lens)[worded], minlength=len(texts))
        scores = self.scores[index[worded]]
        return forward_backward(scores, lens, self.model.transitions)[0], lens

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        posterior, lens = self.posteriors(texts)
        owner = np.repeat(np.arange(len(texts)), lens)
        mean = np.stack([np.bincount(owner, posterior[:, k], len(texts)) for k in range(posterior.shape[1])], 1) / np.maximum(lens, 1)[:, None]
        best = mean.argmax(1)
        score = np.clip(mean[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.model.labels[k] if n else "und" for k, n in zip(best, lens, strict=True)], np.where(lens > 0, score, 0.0).tolist()


def _labeller(key: str, shared) -> Labeller:
    """The worker's labeller for a broadcast model, kept between tasks."""
    return worker_state(("language", key), lambda: Labeller(shared.value))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        own = _labeller(key, shared)
        for batch in batches:
            for piece in pieces(batch):
                langs, scores = own.label(piece.column(1).to_pylist())
                yield pa.record_batch([piece.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


#: Mean posterior below which a document's language counts as undecided.
LEAST_SCORE = 0.35


def keep(docs: DataFrame) -> DataFrame:
    """The documents whose language is decided, with all their columns; ids must tell them apart.

    Rejected are texts without a letter and texts that fit no learned language better than chance.
    """
    model = train(docs)
    if model is None:
        return docs.where("false")
    shared, key, columns = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns

    def run(batches):
        own = _labeller(key, shared)
        for batch in batches:
            for piece in pieces(batch, columns.index("text")):
                langs, scores = own.label([t or "" for t in piece.column(columns.index("text")).to_pylist()])
                yield piece.filter(pa.array([x != "und" and s >= LEAST_SCORE for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    # names with dots would be taken for fields of structs
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model learned from the rows not held out."""
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
