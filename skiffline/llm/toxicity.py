"""Abusive, hateful and sexual content by non-negative positive-unlabelled learning (problem 7).

For each category a linear classifier on hashed character n-grams of normalised sentences
is fitted in numpy from confirmed examples and unlabelled sentences of the corpus.  The
risk is corrected by the class prior pi (the share of the category among unlabelled
sentences): pi R_P+ + max(0, R_U- - pi R_P-).
Words as such don't decide: a report, rule or title that quotes an insult is common among
the unlabelled, an insult is as rare there as its prior says.

The prior is an upper bound, not an estimate: labelled examples are no random sample of
what occurs (patterns rare in the corpus are labelled as often as frequent ones), so the
least ratio of unlabelled to held-out positive scores, a usual estimate, comes out at a
third of the true share or less, and with it patterns without labels are learned as
negative.  Examples labelled clean are known negatives: each counts as ``CLEAN_WEIGHT``
unlabelled sentences, unless usable examples of a category contradict it.

A labelled text may hold neutral sentences beside the one it was labelled for, and some
labels are wrong: sentences that are common in the corpus, or that more clean texts hold,
are no examples; of the rest the one that scores highest is.  A text's score is that of its
highest sentence.  Being common alone rules no labelled text out: if all its sentences are,
those that ``CONFIRMED`` texts of the category agree on stay examples.  Between the rounds
of fitting, unlabelled sentences that are likelier of a category than not join its examples,
so that what varies in them is learned too.

How common a sentence is comes from counts over all distinct texts, so copies count once.
The fit uses all labels and at most ``SAMPLE_TEXTS`` distinct unlabelled texts; its time grows
with the distinct labels.  How often a label is repeated counts by the median of that, so
several copies of the table are as one.
Scoring is a narrow map over all rows, rates are plain partial aggregates.

Defined cases: NULL and empty texts score 0 and have no category; several hits give the
highest category; repeated rows give repeated rows; no labels give score 0 everywhere; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.llm.langid import sample
from skiffline.llm.textvec import Grams, fast_sums, grams, summed, with_nothing
from skiffline.session import Scratch

CATEGORIES = ["abuse", "hate", "sexual"]
ORDERS = (3, 4, 5)
BITS = 19
SAMPLE_TEXTS = 16_000  #: unlabelled texts that the fit uses, at most about this many
PRIOR = 0.02  #: class prior: the share of a category among unlabelled sentences, an upper bound (see above)
EPOCHS = (4, 6, 6, 6, 6, 10)  #: passes over the unlabelled sentences in each round
THRESHOLD = 0.42  #: texts whose score is above it have a category
GRAM_BITS = 20  #: buckets of the five-grams whose frequencies are counted
COMMON = 0.0015  #: a five-gram in this share of unlabelled sentences is common
CONFIRMED = 3  #: labelled texts whose agreement makes a common sentence an example
CLEAN_WEIGHT = 10  #: how many unlabelled sentences a sentence labelled clean counts for
ALIKE = 0.8  #: share of five-grams that two sentences of one pattern have in common

# Letters of another script that look like a Latin one, and the way back.
_LOOKALIKE = dict(zip("асеорхуіѕјԁкмтвн", "aceopxyisjdkmtbh"))
_TO_LATIN = str.maketrans(_LOOKALIKE)
_TO_CYRILLIC = str.maketrans({v: k for k, v in _LOOKALIKE.items() if k in "асеорхуікмтвн"})
_SPLIT = re.compile(r"(?<=[.!?…。！？؟।])[\"”»“’)\]]*\s+|(?<=[。！？।])|\s*\n[\s\-]*|\s[|/]\s|\s—\s(?=[^\W\d_a-zа-яё])")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[ .\-_*·][^\W\d_]){2,}(?![^\W\d_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_OTHER = re.compile(r"(?:https?://\S+|[@#]\w*|[^\w*@#]|\d)+")
_TOUCHING = re.compile(r"[a-z][а-џԁ-ԛ]|[а-џԁ-ԛ][a-z]")
_MIXED = re.compile(r"\w*(?:[a-z][а-џԁ-ԛ]|[а-џԁ-ԛ][a-z])\w*")


def _same_script(m: re.Match) -> str:
    word = m.group()
    latin = sum("a" <= c <= "z" for c in word)
    return word.translate(_TO_LATIN if 2 * latin >= len(word) or not word.translate(_TO_LATIN).strip("abcdefghijklmnopqrstuvwxyz") else _TO_CYRILLIC)


class _Bare(dict):
    """Code points to their letters without accents, looked up once each."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return self[code]


_BARE = _Bare()


def normalise(sentence: str) -> str:
    """Small letters without accents, look-alikes, stretching or spacing; other signs become blanks."""
    t = sentence.lower()
    if not t.isascii():
        t = t.translate(_BARE)
        if _TOUCHING.search(t):
            t = _MIXED.sub(_same_script, t)
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), t)
    t = _LONG.sub(r"\1", t)
    return _OTHER.sub(" ", t).strip()


def sentences_of(text: str) -> list[str]:
    return [s for piece in _SPLIT.split(text) if piece and (s := normalise(piece))]


@dataclass
class Model:
    """``table``: a weight per bucket and category, a row of zeros last; texts above ``threshold`` have a category."""

    table: np.ndarray
    bias: np.ndarray
    threshold: float = THRESHOLD

    def scores(self, pieces: list[str]) -> np.ndarray:
        """Probabilities, sentences x categories."""
        total, n = fast_sums(self.table, pieces, ORDERS, BITS)
        return sigmoid(total / _norm(n)[:, None] + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _norm(n: np.ndarray) -> np.ndarray:
    """What a sum over n n-grams is divided by: their root, for very long sentences in proportion to n."""
    return np.maximum(np.sqrt(n), n / 20).astype(np.float32)


def raw(table: np.ndarray, bias: np.ndarray, g: Grams) -> np.ndarray:
    return summed(table, g) / _norm(np.diff(np.append(g.starts, len(g.ids))))[:, None] + bias


def _take(g: Grams, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.append(g.starts, len(g.ids))
    ln = np.diff(bounds)[rows]
    starts = np.cumsum(ln) - ln
    return g.ids[np.arange(ln.sum()) - np.repeat(starts, ln) + np.repeat(bounds[rows], ln)], starts, ln


class Part:
    """Some rows of a table of n-grams, with what is needed to sum over their n-grams and, for each bucket, over the rows that hold it."""

    def __init__(self, g: Grams, rows: np.ndarray):
        self.ids, self.starts, self.lengths = _take(g, rows)
        self.scale = (1 / _norm(self.lengths))[:, None]
        self.by = np.argsort(self.ids, kind="stable")
        ordered = self.ids[self.by]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.touched = ordered[self.first]
        self.owner = np.repeat(np.arange(len(rows)), self.lengths)[self.by]

    def scores(self, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.ids], self.starts, axis=0) * self.scale + bias

    def step(self, grad: np.ndarray) -> np.ndarray:
        return np.add.reduceat((grad * self.scale)[self.owner], self.first, axis=0)


def batches_of(g: Grams, unlabelled: np.ndarray, batch: int = 1024, seed: int = 11) -> list[Part]:
    order = np.random.default_rng(seed).permutation(unlabelled)
    return [Part(g, order[i : i + batch]) for i in range(0, len(order), batch)]


def nn_pu(positive: list[np.ndarray], g: Grams, batches: list[Part], prior: np.ndarray, epochs: int, rate: float = 0.3, decay: float = 1e-6, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Minimises the non-negative risk with logistic loss by AdaGrad, batches of unlabelled rows beside all positives."""
    k = len(positive)
    table, square = np.zeros((1 << BITS, k), np.float32), np.full((1 << BITS, k), 1e-8, np.float32)
    bias, bias_square = np.full(k, -2.0, np.float32), np.full(k, 1e-8, np.float32)
    total, held = np.zeros((1 << BITS, k), np.float32), np.zeros(1 << BITS, bool)
    members = np.concatenate(positive)
    mine = np.zeros((len(members), k), np.float32)  # each positive's weight in its own category
    at = 0
    for c, rows in enumerate(positive):
        mine[at : at + len(rows), c] = 1 / max(1, len(rows))
        at += len(rows)
    given = Part(g, members)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            part = batches[b]
            pp, pu = sigmoid(given.scores(table, bias)), sigmoid(part.scores(table, bias))
            risk = -np.log(np.maximum(1 - pu, 1e-9)).mean(axis=0) + prior * (np.log(np.maximum(1 - pp, 1e-9)) * mine).sum(axis=0)
            keep = (risk >= 0).astype(np.float32)
            on_given = np.where(keep, -prior * mine, prior * mine * (pp - 1)).astype(np.float32)
            on_part = keep * pu / len(part.starts)
            total[given.touched] = given.step(on_given)
            held[given.touched] = held[part.touched] = True
            total[part.touched] += part.step(on_part)
            touched = np.flatnonzero(held)
            step = total[touched] + decay * table[touched]
            square[touched] += step * step
            table[touched] -= rate * step / np.sqrt(square[touched])
            total[touched], held[touched] = 0, False
            whole = on_given.sum(axis=0) + on_part.sum(axis=0)
            bias_square += whole * whole
            bias -= rate * whole / np.sqrt(bias_square)
    return table, bias


class _Sets:
    """The sets of five-grams of the first ``n`` sentences, with the sentences that hold each five-gram."""

    def __init__(self, g: Grams, n: int):
        bounds = np.append(g.starts, len(g.ids))[: n + 1]
        pairs = np.unique(np.repeat(np.arange(n), np.diff(bounds)) << GRAM_BITS | g.ids[: bounds[n]])
        owner, self.ids = pairs >> GRAM_BITS, pairs & ((1 << GRAM_BITS) - 1)
        self.sizes = np.bincount(owner, minlength=n)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        by = np.argsort(self.ids, kind="stable")
        self.holders = owner[by]
        self.first = np.searchsorted(self.ids[by], np.arange((1 << GRAM_BITS) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def alike(self, i: int) -> np.ndarray:
        """Which sentences are of the pattern of sentence ``i``."""
        own = self.of(i)
        both = np.bincount(np.concatenate([self.holders[self.first[b] : self.first[b + 1]] for b in own]), minlength=len(self.sizes))
        return (both >= ALIKE * np.minimum(len(own), self.sizes)) & (both >= ALIKE * 0.8 * np.maximum(len(own), self.sizes))


def _five_grams(pieces: list[str]) -> Grams:
    return grams([s.ljust(5) for s in pieces], (5,), GRAM_BITS)


def frequencies(pieces: list[str]) -> np.ndarray:
    """How often each bucket of five-grams occurs in the sentences."""
    return np.bincount(_five_grams(pieces).ids, minlength=1 << GRAM_BITS)


def examples(flat: list[str], owner: np.ndarray, wanted: np.ndarray, clean: list[str], pool: list[str], df: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Which sentences of labelled texts can be what the label is about, which of the pool are ordinary, and which clean ones no usable one contradicts.

    Common is a sentence most of whose five-grams many of ``total`` sentences hold (``df``).
    Such a one is an example only if its text has no rarer one and ``CONFIRMED`` texts of the
    category hold its pattern: wrong labels are few and don't agree.  A sentence that stands in
    more texts labelled clean than in texts of its category was labelled wrongly.
    """
    g = _five_grams([*flat, *clean, *pool])
    bounds = np.append(g.starts, len(g.ids))
    at = len(flat) + len(clean)
    often = (df[g.ids] >= max(3, COMMON * total)).astype(np.float32)
    common = np.add.reduceat(often, g.starts) / np.diff(bounds) >= 0.65
    sets = _Sets(g, at)
    rare = np.zeros(int(owner.max()) + 1, bool)
    np.logical_or.at(rare, owner, ~common[: len(flat)])
    open_to = ~common[: len(flat)]
    lone = ~open_to & ~rare[owner]
    confirmed = [i for i in np.flatnonzero(lone) if len(np.unique(owner[lone & (wanted == wanted[i]) & sets.alike(i)[: len(flat)]])) >= CONFIRMED]
    open_to[confirmed] = True
    usable = open_to.copy()
    for i in np.flatnonzero(open_to):
        same = sets.alike(i)
        against = same[len(flat) :].sum()
        if against and against >= len(np.unique(owner[open_to & (wanted == wanted[i]) & same[: len(flat)]])):
            usable[i] = False
    kept = np.append(usable, np.zeros(len(clean), bool))
    vetoed = np.flatnonzero(~kept & ~common[:at])
    doubtful = [i for i in vetoed if not (sets.alike(i) & kept).any()]

    def mostly(members: list[int] | np.ndarray) -> np.ndarray:
        """Sentences most of whose five-grams stand in ``members``."""
        known = np.zeros(1 << GRAM_BITS, bool)
        for i in members:
            known[sets.of(i)] = True
        return np.add.reduceat(known[g.ids].astype(np.float32), g.starts) / np.diff(bounds) >= ALIKE

    frequent = mostly(np.flatnonzero(usable & common[: len(flat)]))
    negative = [j - len(flat) for j in range(len(flat), at) if not (sets.alike(j) & kept).any()]
    return usable, ((common & ~frequent) | mostly(doubtful))[at:], [clean[j] for j in negative]


@dataclass
class _Rows:
    """Labelled and unlabelled sentences as rows of one table of n-grams."""

    g: Grams
    owner: np.ndarray  #: which labelled text a labelled sentence is of
    wanted: np.ndarray  #: and of which category that is
    usable: np.ndarray
    unlabelled: np.ndarray
    ordinary: np.ndarray

    def by_category(self, chosen: np.ndarray) -> list[np.ndarray]:
        return [chosen[self.wanted[chosen] == c] for c in range(len(CATEGORIES))]

    def raw(self, fitted: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        return raw(*fitted, Grams(*_take(self.g, rows)[:2]))

    def focus(self, fitted: tuple[np.ndarray, np.ndarray], chosen: np.ndarray) -> np.ndarray:
        """Of the sentences of a text the one that scores highest is what the label is about."""
        score = self.raw(fitted, chosen)[np.arange(len(chosen)), self.wanted[chosen]]
        top = np.full(int(self.owner.max()) + 1, -np.inf)
        np.maximum.at(top, self.owner[chosen], score)
        return chosen[score == top[self.owner[chosen]]]


def _rounds(rows: _Rows, chosen: np.ndarray, prior: np.ndarray, epochs: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Fits on chosen labelled sentences; between the rounds unlabelled ones that are likelier of a category than not join them."""
    batches = batches_of(rows.g, rows.unlabelled)
    fitted = nn_pu(rows.by_category(chosen), rows.g, batches, prior, epochs[0])
    given = rows.by_category(rows.focus(fitted, chosen))
    positive = given
    for i, n in enumerate(epochs[1:]):
        fitted = nn_pu(positive, rows.g, batches, prior, n)
        if i < len(epochs) - 2:
            score = rows.raw(fitted, rows.unlabelled)
            kind = score.argmax(axis=1)
            positive = [np.concatenate([own, rows.unlabelled[(kind == c) & (score[:, c] > 0) & ~rows.ordinary]]) for c, own in enumerate(given)]
    return fitted


def fit(labels: list[tuple[str, str]], unlabelled: list[str], prior: float = PRIOR, epochs: tuple[int, ...] = EPOCHS, counts: tuple[np.ndarray, int] | None = None) -> Model:
    """``labels``: (text, category); ``unlabelled``: texts; ``counts``: frequencies and number of sentences, if of more than ``unlabelled``."""
    texts = [(s, c) for t, c in labels if t and c in CATEGORIES and (s := sentences_of(t))]
    clean = [s for t, c in labels if t and c == "clean" for s in sentences_of(t)]
    pool = [s for t in dict.fromkeys(unlabelled) if t for s in sentences_of(t)] + clean
    if not texts or not pool:
        return Model(np.zeros(((1 << BITS) + 1, len(CATEGORIES)), np.float32), np.full(len(CATEGORIES), -20, np.float32))
    flat = [s for own, _ in texts for s in own]
    owner = np.repeat(np.arange(len(texts)), [len(own) for own, _ in texts])
    wanted = np.array([CATEGORIES.index(c) for _, c in texts])[owner]
    df, total = (frequencies(pool), len(pool)) if counts is None else (counts[0] + frequencies(clean), counts[1] + len(clean))
    usable, ordinary, negative = examples(flat, owner, wanted, clean, pool, df, total)
    pool += negative * CLEAN_WEIGHT
    ordinary = np.concatenate([ordinary, np.ones(len(pool) - len(ordinary), bool)])
    rows = _Rows(grams(flat + pool, ORDERS, BITS), owner, wanted, usable, np.arange(len(flat), len(flat) + len(pool)), ordinary)
    table, bias = _rounds(rows, np.flatnonzero(usable), np.full(len(CATEGORIES), prior), epochs)
    return Model(with_nothing(table), bias)


def _counted(batches):
    """A task's five-gram frequencies; bucket -1 has the number of sentences."""
    df, total = np.zeros(1 << GRAM_BITS, np.int64), 0
    for batch in batches:
        pieces = [s for t in batch.column(0).to_pylist() for s in sentences_of(t)]
        for i in range(0, len(pieces), 5000):
            df += frequencies(pieces[i : i + 5000])
        total += len(pieces)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int64()), pa.array(np.append(df[held], total), pa.int64())], ["b", "n"])


def corpus_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """``frequencies`` over all rows of a table with one text column, and the number of sentences; 2^GRAM_BITS rows come back at most."""
    rows = texts.mapInArrow(_counted, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    buckets, n = rows["b"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    df = np.zeros(1 << GRAM_BITS, np.int64)
    df[buckets[buckets >= 0]] = n[buckets >= 0]
    return df, int(n[buckets < 0].sum())


def labelled(labels: DataFrame, text: Column, category: Column) -> list[tuple[str, str]]:
    """All labels as (text, category), each as often as it is repeated more than most are.

    The table may be held several times over: repeats count by their median, and only what
    stands out against it (a text that several people labelled) stays several.
    """
    rows = labels.select(text.alias("t"), category.alias("c")).where("t is not null and c is not null").groupBy("t", "c").count().collect()
    usual = float(np.median([r["count"] for r in rows])) if rows else 1.0
    return [(r.t, r.c) for r in sorted(rows) for _ in range(max(1, round(r["count"] / usual)))]


def fit_on(labels: DataFrame, text: Column, category: Column, corpus: DataFrame, corpus_text: Column, texts: int = SAMPLE_TEXTS) -> Model:
    """Fits on all of a labelled table, a bounded sample of the corpus' distinct texts and counts over all of these."""
    given = labelled(labels, text, category)
    scratch = Scratch(corpus.sparkSession, "toxicity")
    distinct, path = scratch.write(corpus.select(corpus_text.alias("t")).where("t is not null and t <> ''").distinct())
    pool = sample(distinct, F.col("t"), texts).toPandas()["t"].sort_values()
    counts = corpus_counts(distinct)
    scratch.drop(path)
    return fit(given, list(pool), counts=counts)


_ARROW = pa.schema([("item", pa.string()), ("item_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("category", pa.string())])


def _score(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            items, ids, sources, texts = (batch.column(i).to_pylist() for i in range(4))
            pieces, counts = [], []
            for t in texts:
                own = sentences_of(t) if t else []
                pieces += own
                counts.append(len(own))
            n = np.array(counts)
            best, kinds = np.zeros(len(texts)), [None] * len(texts)
            if pieces:
                once = {s: i for i, s in enumerate(dict.fromkeys(pieces))}
                p = model.scores(list(once))[[once[s] for s in pieces]]
                top, kind = p.max(axis=1), p.argmax(axis=1)
                have = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[have]
                best[have] = np.maximum.reduceat(top, starts)
                firsts = np.cumsum(n) - n
                for i in np.flatnonzero(best > model.threshold):
                    a = int(firsts[i])
                    j = a + int(top[a : a + counts[i]].argmax())
                    kinds[i] = CATEGORIES[kind[j]]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(best, pa.float64()), pa.array(kinds, pa.string())], schema=_ARROW)

    return run


def scores(df: DataFrame, model: Model, item: Column, item_id: Column, source: Column, text: Column) -> DataFrame:
    """item, item_id, source, score and category (NULL below the threshold) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS x 3 floats, whatever the data
    slim = df.select(item.cast("string").alias("item"), item_id.cast("bigint").alias("item_id"), source.cast("string").alias("source"), text.alias("text"))
    return slim.mapInArrow(_score(shared), "item string, item_id bigint, source string, score double, category string")


def rates(scored: DataFrame) -> DataFrame:
    """Texts and share of each category per source."""
    return scored.groupBy("item", "source").agg(F.count("*").alias("n_texts"), *[F.avg((F.coalesce("category", F.lit("")) == c).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
