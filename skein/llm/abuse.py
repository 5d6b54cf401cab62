"""Abusive, hateful or sexual passages.

Method: a noisy channel.  Tokens that were disguised (digits and signs for
letters, letters of another alphabet, stretched, spaced or masked letters) are
lattices of the characters that they may stand for; an exact Viterbi search under
a character language model of the whole corpus restores them.  The restored text
is scored passage by passage with a linear model, fitted on a bounded sample of
reviewed documents; a document's score is that of its worst passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import written

#: Reviewed documents to fit on, at most (chosen by a hash of the id).
SAMPLE_DOCS = 20_000
#: Share of all n-grams that one must have to be in the language model, which so has ``1 / GRAM_SHARE`` at most at any size.
GRAM_SHARE = 2e-7
ORDER = 4
#: Contexts that the first search for a reading keeps; the second one keeps all that may win.
FIRST_WIDTH = 100
#: Words of a window within a long passage.
WINDOW = 14
#: A word needs no restoring from this share of all words on (and 30 uses), so that the same text decides the same way in a corpus of any size.
KNOWN_SHARE = 2.9e-5

# --- fixed values: what signs stand for, and words that weigh before any review is read -----------
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t", "£": "l"}
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝвмнтклгАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwbmhtklrABEKMHOPCTXIJS"))
SEEDS = (
    "idiot idiots moron morons imbecile cretin dickhead brainless spineless asshole bullshit scum wanker bastard bitch fuck fucking shit loser trash pathetic disgusting stupid crap cunt slut whore "
    "retarded vermin subhuman parasites filthy deport criminals thief porn porno nude naked xxx horny undress escorts sex tape cams "
    "idiot vollidiot arschloch fresse drecksack drecksvolk ungeziefer abschaum schlampe hurensohn wichser pornos nackte nackt "
    "imbécil cabrón mierda cállate idiota puta gilipollas basura plaga desnudas porno ratas "
    "imbécile salaud connard ordure gueule merde pute parasites nues porno chassez vermine "
    "ідіот тварюко мерзотник покидьки пельку заткни порно голі сволота паразити"
)
# --- end of fixed values --------------------------------------------------------------------------

_SEEDS = frozenset(SEEDS.split())
_REVERSED = {b: a for a, b in LOOKALIKES.items() if b.islower() and a not in "мнтклгв"}
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![\w*])(?:[^\W_]([ .\-_·/]))(?:[^\W_]\1){2,}[^\W_](?![\w*]|[.\-_·/]\w)")
_TOKEN = re.compile(r"[\w*@$€£'’]+(?:[!|+][\w*@$€£]+)*", re.U)
_PASSAGE = re.compile(r"(?<=[.!?…])[\s]+|\n\s*\n|\n(?=\s*[->\d•*])")
_STRETCH = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1")
_LATIN, _CYRILLIC = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ѐ-ӿ]")
_SIGNS = re.compile(r"[0-9@$!|€+£*]")


def _grams(word: str) -> Iterator[str]:
    padded = "^" * (ORDER - 1) + word + "$"
    for k in range(ORDER - 1, len(padded)):
        yield padded[k - ORDER + 1 : k + 1]


class CharModel:
    """Character n-gram model with backoff, from counts of n-grams of whole words."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts: Counter[str] = Counter()
        for gram, n in counts.items():
            for k in range(ORDER):
                self.counts[gram[k:]] += n
                self.counts[gram[k:-1] + "\0"] += n
        self.letters = sorted({g[-1] for g in counts if g[-1].isalpha()})
        self.log = lru_cache(maxsize=200_000)(self._log)

    def _log(self, context: str, c: str) -> float:
        penalty = 0.0
        for k in range(len(context) + 1):
            n = self.counts.get(context[k:] + c, 0)
            if n:
                return math.log(n / self.counts[context[k:] + "\0"]) + penalty
            penalty -= 1.6
        return -14.0 + penalty

    def restore(self, token: str) -> str:
        """Most likely reading of a disguised token, in the alphabet that fits better if it has two."""
        latin, cyrillic = _LATIN.search(token), _CYRILLIC.search(token)
        if latin and cyrillic:
            return max(self._read(token, False), self._read(token, True))[1]
        return self._read(token, bool(cyrillic))[1]

    def _read(self, token: str, cyrillic: bool) -> tuple[float, str]:
        """The best reading, exactly.

        A first search keeps the best contexts only and gives a score that the
        best reading has at least.  If that left contexts out, a second one keeps
        all that this score does not rule out: letters still to come cost
        something, so a context below it can't win.
        """
        best, text, whole = self._search(token, cyrillic, -1e18, FIRST_WIDTH)
        return (best, text) if whole else self._search(token, cyrillic, best, None)[:2]

    def _search(self, token: str, cyrillic: bool, floor: float, width: int | None) -> tuple[float, str, bool]:
        # The state is the context of the model, so that the best reading of each is all that has to be kept.
        states: dict[str, tuple[float, str]] = {"^" * (ORDER - 1): (0.0, "")}
        k, whole = 0, True
        while k < len(token):
            c = token[k]
            run = 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            if c == "*":
                steps, options = run, [(x, -1.0) for x in self._wild(cyrillic)]
            else:
                steps, options = 1, [(x, -0.7) for x in STANDS_FOR.get(c, "")]
                if c in LOOKALIKES and not cyrillic:
                    options.append((LOOKALIKES[c].lower(), -0.3))
                elif c in _REVERSED and cyrillic:
                    options.append((_REVERSED[c], -0.3))
                elif c.isalpha():
                    options.append((c, 0.0))
                if not options:
                    options = [("", -1.0)]
                if run > 1:
                    options += [(x * 2, s - 0.2) for x, s in options if x]
            for _ in range(steps):
                states = self._step(states, options, floor - 1e-9)
                if width and len(states) > width:
                    states, whole = dict(sorted(states.items(), key=lambda e: -e[1][0])[:width]), False
            k += run
        best, text = -1e18, token
        for context, (score, read) in states.items():
            score += self.log(context, "$")
            if score > best:
                best, text = score, read
        return best, text, whole

    def _wild(self, cyrillic: bool) -> list[str]:
        return [x for x in self.letters if bool(_CYRILLIC.match(x)) == cyrillic]

    def _step(self, states: dict[str, tuple[float, str]], options: list[tuple[str, float]], floor: float) -> dict[str, tuple[float, str]]:
        out: dict[str, tuple[float, str]] = {}
        for context, (score, read) in states.items():
            for x, cost in options:
                s, ctx = score + cost, context
                for ch in x:
                    s += self.log(ctx, ch)
                    ctx = ctx[1:] + ch
                if s >= floor and (ctx not in out or s > out[ctx][0]):
                    out[ctx] = (s, read + x)
        return out


def _disguised(token: str) -> bool:
    if not any(c.isalpha() for c in token):
        return False
    if _SIGNS.search(token):
        return True
    return bool(_LATIN.search(token) and _CYRILLIC.search(token))


def _odd(word: str) -> bool:
    """A word of two alphabets, or a stretched one."""
    return bool(_LATIN.search(word) and _CYRILLIC.search(word) or _STRETCH.search(word))


def restored_words(text: str, model: CharModel, cache: dict[str, str], known: frozenset[str] = frozenset()) -> list[str]:
    """Words of a passage in lower case, disguises undone, numbers left out."""
    text = _HIDDEN.sub("", text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·/]", "", m.group()), text)
    out = []
    for token in _TOKEN.findall(text):
        if token.isdigit():
            continue
        low = token.lower()
        if low not in known and (_disguised(low) or _STRETCH.search(low) or (_DOUBLE.search(low) and len(low) > 3)):
            read = cache.get(low)
            if read is None:
                if len(cache) > 100_000:
                    cache.clear()
                read = cache[low] = model.restore(low)
            low = read
        if low:
            out.append(low)
    return out


def _features(words: list[str]) -> list[str]:
    out = list(words)
    out += [a + " " + b for a, b in zip(words, words[1:])]
    if any(w in _SEEDS for w in words):
        out.append("\0seed")
    return out


class PassageModel:
    """Weights of words and word pairs, and a threshold."""

    def __init__(self, weights: dict[str, float], bias: float, threshold: float) -> None:
        self.weights, self.bias, self.threshold = weights, bias, threshold

    def passage(self, words: list[str]) -> float:
        """Score of a passage, or of the worst window of a long one."""
        if not words:
            return -20.0
        w = self.weights
        seed = w.get("\0seed", 0.0)
        if len(words) <= WINDOW + 4:
            s = self.bias + sum(w.get(x, 0.0) for x in words) + sum(w.get(a + " " + b, 0.0) for a, b in zip(words, words[1:]))
            return s + (seed if any(x in _SEEDS for x in words) else 0.0)
        one = np.array([w.get(x, 0.0) for x in words])
        two = np.array([w.get(a + " " + b, 0.0) for a, b in zip(words, words[1:])] + [0.0])
        marks = np.array([x in _SEEDS for x in words], np.int32)
        c1, c2, c3 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (one, two, marks))
        best = -20.0
        for size in (6, 10, WINDOW):
            score = c1[size:] - c1[:-size] + (c2[size - 1 :][: len(c1) - size] - c2[: len(c1) - size]) + seed * ((c3[size:] - c3[:-size]) > 0)
            best = max(best, self.bias + float(score.max()))
        return best


def fit(docs: list[tuple[list[list[str]], bool]], rounds: int = 4, steps: int = 120) -> PassageModel:
    """Fit on documents as lists of passages and a verdict each.

    Of a document with a bad verdict only the worst passage (as the model sees
    it) is taken for bad; verdicts that disagree with it count less.
    """
    count: Counter[str] = Counter()
    in_bad: Counter[str] = Counter()
    rows: list[tuple[int, list[str]]] = []
    for d, (passages, verdict) in enumerate(docs):
        features = [_features(p) for p in passages]
        some = {f for fs in features for f in fs}
        count.update(some)
        if verdict:
            in_bad.update(some)
        rows += [(d, fs) for fs in features]
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 3 or f == "\0seed"))}
    prior = np.zeros(len(vocabulary))
    if "\0seed" in vocabulary:
        prior[vocabulary["\0seed"]] = 3.0
    for word in _SEEDS & vocabulary.keys():
        prior[vocabulary[word]] = 1.0
    # What occurs in bad documents many times as often as in clean ones weighs from the beginning.
    n_bad = sum(b for _, b in docs)
    for f, n in in_bad.items():
        if n >= 4 and f in vocabulary and f != "\0seed" and math.log((n + 0.5) / (n_bad + 1) * (len(docs) - n_bad + 1) / (count[f] - n + 0.5)) >= 2.7:
            prior[vocabulary[f]] = max(prior[vocabulary[f]], 1.0)
    r = np.array([k for k, (_, f) in enumerate(rows) for x in f if x in vocabulary], np.int64)
    c = np.array([vocabulary[x] for _, f in rows for x in f if x in vocabulary], np.int64)
    of = np.array([d for d, _ in rows], np.int64)
    bad = np.array([b for _, b in docs], bool)
    weights, bias = prior.copy(), -4.0
    n = len(rows)
    for turn in range(rounds):
        z = bias + np.bincount(r, weights[c], minlength=n)
        worst = np.full(len(docs), -np.inf)
        np.maximum.at(worst, of, z)
        target = bad[of] & (z >= worst[of] - 1e-9)
        # Verdicts that the model contradicts are likely wrong; what no seed points at waits for the second turn.
        weight = np.where(target, np.where(z > (-2.5 if turn == 0 else -2.0 if turn == rounds - 1 else -1.5), 1.0, 0.0 if turn in (0, rounds - 1) else 0.15), np.where(bad[of], np.where(z < -2.0, 1.0, 0.0), np.where((z > 2.0) & (turn > 0), 0.3, 1.0)))
        y, g1, g2 = target.astype(float), np.full(len(weights), 1e-6), 1e-6
        weight = weight * np.where(target, 2.0, 1.0)
        for _ in range(steps):
            z = bias + np.bincount(r, weights[c], minlength=n)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            grad = np.bincount(c, err[r], minlength=len(weights)) + 1.2 * (weights - prior)
            g1 += grad * grad
            weights -= 0.4 * grad / np.sqrt(g1)
            gb = err.sum()
            g2 += gb * gb
            bias -= 0.3 * gb / math.sqrt(g2)
    return PassageModel({f: float(weights[k]) for f, k in vocabulary.items() if abs(weights[k]) > 1e-3}, float(bias), 0.0)


def _passages(text: str) -> list[str]:
    return [p for p in _PASSAGE.split(text) if p and not p.isspace()]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of all documents in lower case with their counts, written once: ``(w, n)``."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).where(F.length("w") > 1)
    return written(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")


def char_model(words: DataFrame) -> CharModel:
    """Character model of the words of all documents; words of two alphabets and stretched ones teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams: Counter[str] = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not _odd(w):
                    for g in _grams(w):
                        grams[g] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["g", "n"])

    grams = written(words.mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return CharModel({r["g"]: r["n"] for r in grams.where(F.col("n") >= GRAM_SHARE * total).collect()})


def frequent_words(words: DataFrame, least: int = 30, share: float = KNOWN_SHARE) -> frozenset[str]:
    """Words so frequent in the corpus that they need no restoring: at most ``1 / share``.

    Words of two alphabets and stretched ones are disguises however frequent
    (except for seed words that are written so, as xxx).
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = (r["w"] for r in words.where(F.col("n") >= max(least, share * total)).select("w").collect())
    return frozenset(w for w in found if w in _SEEDS or not _odd(w))


def passage_model(docs: DataFrame, labels: DataFrame, chars: CharModel, known: frozenset[str], *, key: str = "doc_id", text: str = "text", verdict: str = "verdict", sample: int = SAMPLE_DOCS) -> PassageModel:
    """Fit on at most ``sample`` reviewed documents; verdicts of one document are settled by majority, ties count as bad."""
    said = labels.select(F.col(key).alias("k"), F.col(verdict).alias("v")).where("k is not null and v is not null").groupBy("k").agg((F.avg((F.col("v") != "clean").cast("double")) >= 0.5).alias("bad"))
    chosen = said.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k").orderBy("k").limit(sample).collect()
    cache: dict[str, str] = {}
    return fit([([restored_words(p, chars, cache, known) for p in _passages(r["t"])], r["bad"]) for r in rows])


def scored_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), sample: int = SAMPLE_DOCS) -> DataFrame:
    """Score of every document: ``(doc_id, score, flagged)`` and the columns ``keep``.

    The score is the log-odds of the document's worst passage; documents above the
    model's threshold are flagged.  Whole texts are read.  Null and empty texts score -20.  A
    repeated row gives a repeated row.  Without labels only the seed words weigh.
    """
    words = word_counts(docs, text)
    chars, known = char_model(words), frequent_words(words)
    model = passage_model(docs, labels, chars, known, key=key, text=text, sample=sample)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((dict(chars.counts), chars.letters, known, model.weights, model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letters, known, weights, bias, threshold = shared.value
        chars = CharModel({})
        chars.counts, chars.letters = Counter(), letters
        chars.counts = counts
        scorer = PassageModel(weights, bias, threshold)
        cache: dict[str, str] = {}
        for b in batches:
            scores = [max((scorer.passage(restored_words(p, chars, cache, known)) for p in _passages(t)), default=-20.0) if t else -20.0 for t in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array(scores, pa.float64()), pa.array([s > threshold for s in scores], pa.bool_()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "score", "flagged", *keep])

    fields = ", ".join([f"`{key}` {dict(docs.dtypes)[key]}", "score double", "flagged boolean", *[f"`{c}` {dict(docs.dtypes)[c]}" for c in keep]])
    return docs.select(key, text, *keep).mapInArrow(run, fields)
