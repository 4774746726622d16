"""Language ID by a linear-chain conditional random field (operator 4).

Each word of a text has a hidden language.  Emission weights come from affixes,
character n-grams and a lexicon of frequent words, transition weights from
neighbouring words; both are learned together by gradient ascent on the
likelihood of labelled text.  Forward-backward gives each word's distribution
over the languages, so code-switched passages keep their own; a document's
language is the one with the most words in expectation.  Labelled texts hold one
language each, so half of the training chains are spliced from two of them:
transitions learn what a switch looks like.

The field is fitted on a bounded sample of labelled rows and broadcast; its
size is fixed by ``BUCKETS`` and the number of languages.  Every document is
then labelled where it is read, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxflow.llm.scratch import Scratch

#: Labelled documents of the sample over all languages, at least of each of them, characters taken of each, and words that are fitted;
#: all bound the driver's work.
SAMPLE_DOCS = 2000
SAMPLE_DOCS_EACH = 20
SAMPLE_CHARS = 8000
SAMPLE_WORDS = 400_000
#: Feature weights per language.
BUCKETS = 1 << 17
#: Words of a chain; longer texts are cut into consecutive chains.
CHAIN = 64
#: Lexicon entries per language.
LEXICON = 300
SLICE_WORDS = 100_000
CACHE_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall((text or "").lower())


def _spread(key: np.ndarray) -> np.ndarray:
    key = key * _MULTIPLY
    return key ^ (key >> np.uint64(31))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): hashed prefixes and suffixes of one to three letters, n-grams of two and three, and the whole word."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], dtype=np.int64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    keys, at = [], []

    def add(kind: int, n: int, first: np.ndarray, whose: np.ndarray):
        key = np.full(len(first), kind * 16 + n, dtype=np.uint64)
        for i in range(n):
            key = _spread(key ^ points[first + i])
        keys.append(key)
        at.append(whose)

    every = np.arange(len(words))
    for n in (1, 2, 3):
        fits = length - 2 >= n
        add(1, n, (start + 1)[fits], every[fits])
        add(2, n, (start + length - 1 - n)[fits], every[fits])
    for n in (2, 3):
        first = np.arange(max(0, len(points) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        add(3, n, first, owner[first])
    whole = np.zeros(len(words), np.uint64)
    np.add.at(whole, owner, _spread(points * np.uint64(31) + (np.arange(len(points)) - start[owner]).astype(np.uint64)))
    keys.append(_spread(whole))
    at.append(every)
    return (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(at)


@dataclass
class Field:
    """Learned weights: languages, feature weights, transitions, first states, lexicon weights."""

    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transition: np.ndarray
    initial: np.ndarray
    lexicon: dict[str, int]  # word -> index into lexicon_weights
    lexicon_weights: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        if words:
            bucket, word = features(words)
            count = np.bincount(word, minlength=len(words))[:, None]
            for j in range(out.shape[1]):
                out[:, j] = np.bincount(word, self.weights[bucket, j], minlength=len(words))
            out /= np.sqrt(count)
            known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
            if known:
                i, j = np.array(known).T
                out[i] += self.lexicon_weights[j]
        return out

    def marginals(self, emission: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains x CHAIN x languages: word marginals, and summed pair marginals."""
        n, steps, size = emission.shape
        move = np.exp(self.transition - self.transition.max())
        out = np.exp(emission - emission.max(2, keepdims=True))
        out[~present] = 1.0
        ahead = np.empty_like(out)
        state = np.exp(self.initial - self.initial.max()) * out[:, 0]
        ahead[:, 0] = state / state.sum(1, keepdims=True)
        for t in range(1, steps):
            state = (ahead[:, t - 1] @ move) * out[:, t]
            ahead[:, t] = state / state.sum(1, keepdims=True)
        back = np.ones((n, size))
        pairs = np.zeros((size, size))
        post = np.empty_like(out)
        post[:, -1] = ahead[:, -1]
        for t in range(steps - 2, -1, -1):
            scaled = out[:, t + 1] * back
            both = ahead[:, t][:, :, None] * move[None] * scaled[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pairs += both[present[:, t + 1]].sum(0)
            back = np.where(present[:, t + 1, None], scaled @ move.T, 1.0)
            back /= back.sum(1, keepdims=True)
            post[:, t] = ahead[:, t] * back
            post[:, t] /= post[:, t].sum(1, keepdims=True)
        return post, pairs


def chains(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and step of each word, given its text in order; and the number of chains."""
    first = np.searchsorted(doc, np.arange(n_docs))
    within = np.arange(len(doc)) - first[doc]
    per = -(-np.bincount(doc, minlength=n_docs) // CHAIN)
    begin = np.cumsum(per) - per
    return begin[doc] + within // CHAIN, within % CHAIN, int(per.sum())


def fit(rows: list[tuple[str, str]], rounds: int = 2, step: float = 0.5, seed: int = 1) -> Field:
    """Fit a field on (text, language) rows by AdaGrad; at most SAMPLE_WORDS words, whole chains chosen at random.

    Every second chain goes over, at a random word, into a chain of another text.
    """
    languages = sorted({lang for _, lang in rows})
    number = {x: i for i, x in enumerate(languages)}
    rnd, pieces = np.random.default_rng(seed), []
    for text, lang in rows:
        found = words_of(text)
        pieces += [(found[i : i + CHAIN], number[lang]) for i in range(0, len(found), CHAIN)]
    pieces = [pieces[i] for i in rnd.permutation(len(pieces))]
    total = np.cumsum([len(p) for p, _ in pieces]) if pieces else np.zeros(0)
    pieces = pieces[: int(np.searchsorted(total, SAMPLE_WORDS)) + 1]

    size = len(languages)
    counts: list[dict[str, int]] = [{} for _ in languages]
    for found, y in pieces:
        for w in found:
            counts[y][w] = counts[y].get(w, 0) + 1
    whole, pieces = pieces, []
    for i, (found, y) in enumerate(whole):
        labels = [y] * len(found)
        if i % 2:
            more, z = whole[int(rnd.integers(len(whole)))]
            a, b = int(rnd.integers(len(found) + 1)), int(rnd.integers(len(more) + 1))
            found, labels = (found[:a] + more[b:])[:CHAIN], (labels[:a] + [z] * (len(more) - b))[:CHAIN]
        if found:
            pieces.append((found, labels))
    lexicon: dict[str, int] = {}
    for c in counts:
        for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    field = Field(languages, np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size), lexicon, np.zeros((max(1, len(lexicon)), size)))
    slow = [np.full(x.shape, 1e-2) for x in (field.weights, field.transition, field.initial, field.lexicon_weights)]
    batch = 128
    for _ in range(rounds if size > 1 else 0):
        for lo in range(0, len(pieces), batch):
            part = pieces[lo : lo + batch]
            flat = [w for found, _ in part for w in found]
            vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            index = np.array([vocabulary[w] for w in flat])
            chain = np.repeat(np.arange(len(part)), [len(f) for f, _ in part])
            pos = np.concatenate([np.arange(len(f)) for f, _ in part])
            names = list(vocabulary)
            emission = np.zeros((len(part), CHAIN, size))
            present = np.zeros((len(part), CHAIN), bool)
            emission[chain, pos] = field.emissions(names)[index]
            present[chain, pos] = True
            post, pairs = field.marginals(emission, present)
            label = np.array([y for _, labels in part for y in labels])
            error = -post[chain, pos]
            error[np.arange(len(flat)), label] += 1.0
            by_word = np.zeros((len(names), size))
            np.add.at(by_word, index, error)
            bucket, word = features(names)
            scale = 1 / np.sqrt(np.bincount(word, minlength=len(names)))
            gradient = np.zeros_like(field.weights)
            for j in range(size):
                gradient[:, j] = np.bincount(bucket, (by_word[:, j] * scale)[word], minlength=BUCKETS)
            told = np.zeros_like(field.lexicon_weights)
            for w, i in vocabulary.items():
                if w in lexicon:
                    told[lexicon[w]] = by_word[i]
            seen = np.zeros_like(pairs)
            follows = np.flatnonzero(chain[1:] == chain[:-1])
            np.add.at(seen, (label[follows], label[follows + 1]), 1.0)
            begins = np.bincount(label[pos == 0], minlength=size) - post[:, 0].sum(0)
            for x, g, s in zip((field.weights, field.transition, field.initial, field.lexicon_weights), (gradient, seen - pairs, begins, told), slow):
                g = g / len(part) - 1e-4 * x
                s += g * g
                x += step * 0.2 * g / np.sqrt(s)
    return field


def _label(held):
    def run(batches):
        field: Field = held.value
        size = len(field.languages)
        cache: dict[str, int] = {}
        known = np.zeros((0, size))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [], []
            lo = 0
            while lo < len(texts):
                found, hi, n = [], lo, 0
                while hi < len(texts) and (n == 0 or n < SLICE_WORDS):
                    found.append(words_of(texts[hi]))
                    n += len(found[-1])
                    hi += 1
                flat = [w for f in found for w in f]
                if len(cache) > CACHE_WORDS:
                    cache, known = {}, known[:0]
                new = [w for w in dict.fromkeys(flat) if w not in cache]
                cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                known = np.concatenate([known, field.emissions(new)]) if new else known
                doc = np.repeat(np.arange(hi - lo), [len(f) for f in found])
                mass = np.zeros((hi - lo, size))
                if flat and size:
                    chain, pos, m = chains(doc, hi - lo)
                    emission, present = np.zeros((m, CHAIN, size)), np.zeros((m, CHAIN), bool)
                    emission[chain, pos] = known[[cache[w] for w in flat]]
                    present[chain, pos] = True
                    post, _ = field.marginals(emission, present)
                    np.add.at(mass, doc, post[chain, pos])
                total = mass.sum(1)
                best = mass.argmax(1) if size else np.zeros(hi - lo, int)
                names += [field.languages[b] if t > 0 else "und" for b, t in zip(best, total)]
                scores += [float(min(1.0, mass[i, b] / t)) if (t := total[i]) > 0 else 0.0 for i, b in enumerate(best)]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(id_column: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(5)) == 0, F.lit(False))


def fitting_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, lang) of labelled documents that aren't held out, as many of each language.

    ``sample_docs`` over all languages, at least SAMPLE_DOCS_EACH of each where
    it has them: the first by a hash of id and text.  Ties of that hash are equal
    rows.  Texts are cut to SAMPLE_CHARS characters before they are collected.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    of = Scratch(docs.sparkSession, "language-sizes").write(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    each = max(SAMPLE_DOCS_EACH, sample_docs // max(1, of.count()))
    share = F.pmod("h", F.lit(1 << 31)) / F.lit(float(1 << 31))
    # twice the share that is needed, and then exactly; the window runs over those few
    few = labelled.join(of, "lang").where(share * F.col("n") < 2 * each + 20).select("h", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "text"))
    return few.withColumn("place", place).where(F.col("place") <= each).select("h", "text", "lang")


def language_id(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text.

    Learned from text and non-null lang of the documents of ``fitting_sample``.
    ``score`` is the share of the words, in expectation, that are in the
    predicted language.

    ``und`` with score 0: null text, text without a letter, and every text when
    no row is labelled.  A null doc_id counts as not held out.  Repeated rows
    get a row each; further columns are not read.  An empty table gives no rows.
    """
    sample = sorted((r["h"], r["text"], r["lang"]) for r in fitting_sample(docs, sample_docs).collect())  # bounded by rows and characters
    field = docs.sparkSession.sparkContext.broadcast(fit([(text, lang) for _, text, lang in sample]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_label(field), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
