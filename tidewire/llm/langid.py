"""Language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability, fitted
by expectation maximisation. The probability of a word is the sum over all ways to cut
it into pieces, computed by a forward algorithm; that of a text is the product over
its words. Words are runs of letters in lower case with a word-start marker.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import keep_cache
from tidewire.operators.checkpoints import cut

MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")  # a word may hold signs like ½ and ² too
SHORT = 32  #: the segmentations of a word up to this length can't underflow when summed
_VOCAB: dict[str, list[str]] = {}


def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model, by id."""
    if path not in _VOCAB:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
        _VOCAB[path] = [p for p in pieces if (p == MARK or p.removeprefix(MARK).isalpha()) and p == p.lower() and len(p.lower()) == len(p)]
    return _VOCAB[path]


def words_of(text: str) -> list[str]:
    """The marked words of a text, each whole."""
    out = []
    for found in _WORD.findall(text.lower()):
        out += [MARK + w for w in ([found] if found.isalpha() else _LETTERS.findall(found))]
    return out


class Trie:
    """The pieces as a trie whose edges lie in one open hash table, so that arrays of steps are looked up at once."""

    def __init__(self, pieces: list[str]):
        nodes, edges, self.piece = {"": 0}, [], [-1]
        for n, p in enumerate(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    self.piece.append(-1)
                    edges.append((nodes[p[: k - 1]] << 21 | ord(p[k - 1]), nodes[p[:k]]))
            self.piece[nodes[p]] = n
        self.piece = np.array(self.piece)
        self.mask = (1 << max(4, (4 * len(edges)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.child = np.full(self.mask + 1, -1, np.int64)
        for key, child in edges:
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.child[at] = key, child

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that follow; -1 where there is none."""
        keys = node << 21 | char
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], -1)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while more.size:
            at[more] = (at[more] + 1) & self.mask
            found = self.keys[at[more]]
            out[more] = np.where(found == keys[more], self.child[at[more]], -1)
            more = more[(found != keys[more]) & (found >= 0)]
        return out


class Unigrams:
    """Scores words: table holds the log probabilities of distinct words by language."""

    def __init__(self, pieces: list[str], probs: np.ndarray, unknown: float = 1e-7):
        """probs: (pieces, languages)."""
        self.trie, self.probs, self.unknown = Trie(pieces), probs, unknown
        self.reach = max(map(len, pieces), default=1)
        self.langs = probs.shape[1]
        self.table: dict[str, int] = {}
        self.letters = 0  # of the words in the table
        self.most = max(10_000, 1_000_000 // max(1, self.langs))
        self.scores = np.zeros((0, self.langs))

    def forward(self, words: list[str], cells: int = 1 << 20) -> np.ndarray:
        """(words, languages): log of the summed probability of all segmentations."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        out, lo = np.zeros((len(words), self.langs)), 0
        while lo < len(order):
            # words of like length together, so that few cells are empty
            hi = min(len(order), lo + max(1, cells // ((len(words[order[lo]]) + 1) * self.langs)))
            out[order[lo:hi]] = self._forward([words[k] for k in order[lo:hi]])
            lo = hi
        return out

    def _forward(self, ws: list[str]) -> np.ndarray:
        """As forward(), of words from the longest to the shortest.

        A place is reached from no further than the longest piece, so only so many places
        are held, in a ring, however long a word is.
        """
        top, n, ring = len(ws[0]), len(ws), self.reach + 1
        lengths = np.array([len(w) for w in ws])
        chars = np.frombuffer("".join(w.ljust(top) for w in ws).encode("utf-32-le"), np.uint32).reshape(n, top)
        longer = np.searchsorted(-lengths, -np.arange(top + 2), side="right").tolist()  # words of length k or more
        alpha = np.zeros((ring, n, self.langs))
        alpha[0] = 1.0
        logs, out = np.zeros((n, self.langs)), np.zeros((n, self.langs))
        for i in range(top + 1):
            ends = slice(longer[i + 1], longer[i])
            if ends.start < ends.stop:
                out[ends] = np.log(np.maximum(alpha[i % ring, ends], 1e-300)) + logs[ends]
            m = longer[i + 1]
            if not m:
                break
            if i and i % 8 == 0:
                low = alpha[i % ring, :m] < 1e-120
                if low.any():
                    factor = np.where(low, 1e120, 1.0)
                    alpha[:, :m] *= factor
                    logs[:m] -= np.log(factor)
            here, on, node = alpha[i % ring, :m].copy(), np.arange(m), np.zeros(m, np.int64)
            alpha[i % ring] = 0.0
            for k in range(1, self.reach + 1):
                inside = int(np.searchsorted(on, longer[i + k])) if i + k <= top else 0
                on, node = on[:inside], node[:inside]
                if not inside:
                    break
                node = self.trie.step(node, chars[on, i + k - 1].astype(np.int64))
                piece = np.where(node >= 0, self.trie.piece[node], -1)
                hit = piece >= 0
                at = on[hit]
                alpha[(i + k) % ring, at] += here[at] * self.probs[piece[hit]]
                if k == 1:
                    at = on[~hit]
                    alpha[(i + 1) % ring, at] += here[at] * self.unknown
                on, node = on[node >= 0], node[node >= 0]
        return out

    def add(self, texts_words: list[list[str]]) -> None:
        """Score the words that the table lacks; empty it first when it is full."""
        if len(self.table) > self.most or self.letters > 32 * self.most:
            self.table, self.scores, self.letters = {}, np.zeros((0, self.langs)), 0
        new = list({w for ws in texts_words for w in ws if w not in self.table})
        if new:
            self.table.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, self.forward(new)])
            self.letters += sum(map(len, new))

    def of(self, words: list[str]) -> np.ndarray:
        """(words, languages): the scores of words that add() has met."""
        get = self.table.__getitem__
        return self.scores[[get(w) for w in words]]

    def totals(self, words: list[str]) -> np.ndarray:
        return self.of(words).sum(axis=0)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _spans(w: str, ids: dict[str, int], reach: int, probs: list[float], unknown: float) -> list[list[tuple[int, int, float]]]:
    """For each place in a word, the pieces that end there: (start, piece or -1, probability)."""
    out: list[list[tuple[int, int, float]]] = [[]]
    for j in range(1, len(w) + 1):
        own = []
        for i in range(max(0, j - reach), j):
            k = ids.get(w[i:j])
            if k is not None:
                own.append((i, k, probs[k]))
            elif i == j - 1:
                own.append((i, -1, unknown))
        out.append(own)
    return out


def expected_counts(pieces: list[str], probs: np.ndarray, unknown: float, words: Counter) -> dict[int, float]:
    """Expected uses of each piece in the words of one language, given its probabilities.

    Over all segmentations of each whole word. Those of short words are summed as they
    are; of longer ones their logarithms, which can't underflow.
    """
    ids, reach, out = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces), default=1), Counter()
    for w, times in words.items():
        n, spans = len(w), _spans(w, ids, reach, probs, unknown)
        if n > SHORT:
            forward, backward = [0.0] * (n + 1), [[] for _ in range(n)] + [[0.0]]
            for j in range(1, n + 1):
                forward[j] = _log_sum([forward[i] + math.log(p) for i, _, p in spans[j]])
            for j in range(n, 0, -1):
                rest = _log_sum(backward[j])
                backward[j] = []
                for i, k, p in spans[j]:
                    backward[i].append(rest + math.log(p))
                    if k >= 0:
                        out[k] += times * math.exp(forward[i] + math.log(p) + rest - forward[n])
            continue
        alpha = [1.0] + [0.0] * n
        for j in range(1, n + 1):
            alpha[j] = sum(alpha[i] * p for i, _, p in spans[j])
        beta = [0.0] * n + [1.0]
        for j in range(n, 0, -1):
            share = beta[j] * times / alpha[n]
            for i, k, p in spans[j]:
                beta[i] += p * beta[j]
                if k >= 0:
                    out[k] += alpha[i] * p * share
    return out


def _sample(docs: DataFrame, per_lang: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame | None]:
    """The languages in order, and (lang, text) of about ``per_lang`` documents of each."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").collect())
    if not langs:
        return langs, None
    share = F.least(F.lit(1_000_000), F.ceil(F.lit(1_000_000) * per_lang / F.col("n")))
    drawn = labelled.join(counts, "lang").where(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) < share)
    return langs, drawn.select("lang", "text")


def fit(docs: DataFrame, model: str, *, per_lang: int = 400, rounds: int = 2, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, probabilities by piece and language), languages in order.

    Fits on about ``per_lang`` documents of each language (all, if fewer), drawn by a
    hash of the id; that bounds what a round reads in and the driver gets, at most a
    count for each piece and language. Rows with a null text or language are left out.
    Words are learned from whole, however long. The model, pieces by languages, reaches
    the driver and every task, so its size grows with the number of languages alone.
    """
    pieces = vocabulary(model)
    langs, sample = _sample(docs, per_lang, id_col, text_col, lang_col)
    start = np.array([1.0 / (10 + i) for i in range(len(pieces))])
    probs = np.tile((start / start.sum())[:, None], (1, max(1, len(langs))))
    if not langs:
        return langs, probs
    at, sample = {k: i for i, k in enumerate(langs)}, cut(sample)
    for _ in range(rounds):
        now = probs.astype(np.float64)

        def count(batches, now=now):
            words: dict[str, Counter] = {}
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text.as_py()))
            names = vocabulary(model)
            for lang, held in words.items():
                found = expected_counts(names, now[:, at[lang]].tolist(), 1e-7, held)
                yield pa.RecordBatch.from_arrays([pa.array([at[lang]] * len(found), pa.int32()), pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], names=["lang", "piece", "n"])

        got = sample.mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        fresh = np.full(probs.shape, smoothing)
        fresh[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probs = fresh / fresh.sum(axis=0)
    return langs, probs


def usual(docs: DataFrame, fitted, model: str, *, per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """(languages, 2): the log likelihood of a character of a language in its own documents, and how far a word's strays from it.

    Taken over the documents that fit() drew; for each language six sums reach the driver.
    """
    langs, probs = fitted
    _, sample = _sample(docs, per_lang, id_col, text_col, lang_col)
    out = np.tile([0.0, np.inf], (max(1, len(langs)), 1))
    if not langs or sample is None:
        return out
    packed, width, at = probs.astype(np.float32).tobytes(), probs.shape[1], {k: i for i, k in enumerate(langs)}

    def sums(batches):
        for b in batches:
            scorer = _scorer(model, packed, width)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                if words and lang in at:
                    scorer.add([words])
                    own, size = scorer.of(words)[:, at[lang]], np.array([len(w) for w in words], np.float64)
                    row = [len(words), size.sum(), own.sum(), own @ own, own @ size, size @ size]
                    yield pa.RecordBatch.from_arrays([pa.array([at[lang]], pa.int32()), *[pa.array([float(x)]) for x in row]], names=["lang", *"ncltxs"])

    got = sample.mapInArrow(sums, "lang int, n double, c double, l double, t double, x double, s double").groupBy("lang").agg(*[F.sum(x).alias(x) for x in "ncltxs"]).collect()
    for r in got:
        rate = r.l / r.c
        out[r.lang] = rate, math.sqrt(max(0.0, r.t - 2 * rate * r.x + rate * rate * r.s) / r.n)
    return out


#: Distinct words that a task counts before it hands them on.
_COUNTED = 200_000


def word_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n: how often each word occurs in all texts of each language; null texts and languages are left out."""

    def count(batches):
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.update((lang, w) for w in words_of(text.as_py()))
                if len(held) > _COUNTED:
                    yield out()
                    held.clear()
        if held:
            yield out()

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    return labelled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_all(docs: DataFrame, model: str, *, rounds: int = 2, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang"):
    """fit() and usual() over all documents: ((languages, probabilities), what is usual).

    Both are sums over words, so texts are read twice, for the languages and for their
    words, and rounds go over the distinct words with their counts. At most a count for
    each piece and language, and six sums for a language, reach the driver.
    """
    pieces = vocabulary(model)
    langs = sorted(r.lang for r in docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang")).distinct().collect())
    start = np.array([1.0 / (10 + i) for i in range(len(pieces))])
    probs = np.tile((start / start.sum())[:, None], (1, max(1, len(langs))))
    if not langs:
        return (langs, probs), np.tile([0.0, np.inf], (1, 1))
    at, words = {k: i for i, k in enumerate(langs)}, cut(word_counts(docs, text_col=text_col, lang_col=lang_col))

    def by_language(b) -> dict[str, Counter]:
        held: dict[str, Counter] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.setdefault(lang, Counter())[word] = n
        return held

    for _ in range(rounds):
        now = probs.astype(np.float64)

        def expect(batches, now=now):
            names, found = vocabulary(model), {}
            for b in batches:
                for lang, held in by_language(b).items():
                    mine = found.setdefault(lang, Counter())
                    for k, n in expected_counts(names, now[:, at[lang]].tolist(), 1e-7, held).items():
                        mine[k] += n
            for lang, mine in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([at[lang]] * len(mine), pa.int32()), pa.array(list(mine), pa.int32()), pa.array(list(mine.values()), pa.float64())], names=["lang", "piece", "n"])

        got = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        fresh = np.full(probs.shape, smoothing)
        fresh[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probs = fresh / fresh.sum(axis=0)
    packed, width = probs.astype(np.float32).tobytes(), probs.shape[1]

    def sums(batches):
        for b in batches:
            scorer = _scorer(model, packed, width)
            for lang, held in by_language(b).items():
                told_ = list(held)
                scorer.add([told_])
                own, size, n = scorer.of(told_)[:, at[lang]], np.array([len(w) for w in told_], np.float64), np.array(list(held.values()), np.float64)
                row = [n.sum(), n @ size, n @ own, n @ (own * own), n @ (own * size), n @ (size * size)]
                yield pa.RecordBatch.from_arrays([pa.array([at[lang]], pa.int32()), *[pa.array([float(x)]) for x in row]], names=["lang", *"ncltxs"])

    out = np.tile([0.0, np.inf], (len(langs), 1))
    for r in words.mapInArrow(sums, "lang int, n double, c double, l double, t double, x double, s double").groupBy("lang").agg(*[F.sum(x).alias(x) for x in "ncltxs"]).collect():
        rate = r.l / r.c
        out[r.lang] = rate, math.sqrt(max(0.0, r.t - 2 * rate * r.x + rate * rate * r.s) / r.n)
    return (langs, probs), out


_MODELS: dict[int, tuple[bytes, Unigrams]] = {}


def _scorer(model: str, probs: bytes, langs: int) -> Unigrams:
    """One scorer for each model and worker, so that its table outlives a task."""
    keep_cache("languages", _MODELS.clear)
    key = hash(probs)
    if key not in _MODELS:
        _MODELS.clear()
        pieces = vocabulary(model)
        _MODELS[key] = (probs, Unigrams(pieces, np.frombuffer(probs, dtype=np.float32).astype(np.float64).reshape(len(pieces), langs)))
    return _MODELS[key][1]


def _predictor(fitted, model: str):
    langs, probs = fitted
    packed, width = probs.astype(np.float32).tobytes(), probs.shape[1]

    def predicted(texts) -> tuple[list[str], list[float]]:
        scorer, preds, scores = _scorer(model, packed, width), [], []
        for lo in range(0, len(texts), 256):
            held = [words_of(t.as_py()) if t.is_valid else [] for t in texts.slice(lo, 256)]
            scorer.add(held)
            for words in held:
                if not words or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = scorer.totals(words)
                k = int(np.argmax(total))
                preds.append(langs[k])
                scores.append(float(1.0 / np.exp((total - total[k]) / math.sqrt(len(words))).sum()))
        return preds, scores

    return predicted


def told(scores: np.ndarray, sizes: np.ndarray, usual_: np.ndarray, *, margin: float = 1 / 3, slack: float = 1.5, strays: float = 3.0) -> bool:
    """Whether words are of one of the learned languages, by their log likelihoods (words, languages) and lengths.

    Not if they are torn: of the evidence between the best language and any other, the
    other's words carry over half as much as the best one's (a ``margin`` under 1/3 of
    all of it). Nor if they are of none: the text is less likely in its best language
    than ``slack`` times that language's usual log likelihood for its length, and
    ``strays`` deviations of so many words.
    """
    total = scores.sum(axis=0)
    k = int(np.argmax(total))
    rate, spread = usual_[k]
    if total[k] < slack * rate * sizes.sum() - strays * spread * math.sqrt(len(sizes)):
        return False
    apart = np.delete(scores[:, [k]] - scores, k, axis=1)
    return bool((apart.sum(axis=0) > margin * np.abs(apart).sum(axis=0)).all())


def keep_known(docs: DataFrame, fitted, usual_: np.ndarray, model: str, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language can be told: with letters, and see told(). None if nothing was learned."""
    langs, probs = fitted
    packed, width = probs.astype(np.float32).tobytes(), probs.shape[1]

    def known(scorer: Unigrams, words: list[str]) -> bool:
        return bool(words and langs) and told(scorer.of(words), np.array([len(w) for w in words], np.float64), usual_)

    def run(batches):
        for b in batches:
            scorer, texts, kept = _scorer(model, packed, width), b.column(b.schema.get_field_index(text_col)), []
            for lo in range(0, len(texts), 256):
                held = [words_of(t.as_py()) if t.is_valid else [] for t in texts.slice(lo, 256)]
                scorer.add(held)
                kept += [known(scorer, words) for words in held]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, fitted, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score in 0..1.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. The score is the language's posterior with log odds divided by the square
    root of the number of words, so that it says something for long texts too. Equal
    likelihoods go to the first language by name. Texts and words count whole, however
    long. Null ids and repeated rows are kept; other columns aren't carried; an empty
    table gives no rows.
    """
    predicted = _predictor(fitted, model)

    def run(batches):
        for b in batches:
            preds, scores = predicted(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, model: str, **fit_options) -> DataFrame:
    """Fit on what isn't held out, predict all: id, held_out, lang_pred, score.

    Null texts, languages and ids, empty and long texts, repeated rows, extra columns and
    empty tables are as in fit() and predict(); a row without an id is held out, and
    repeated ids are held out or learned from together.
    """
    fitted = fit(docs.where(~held_out()), model, **fit_options)
    return predict(docs, fitted, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
