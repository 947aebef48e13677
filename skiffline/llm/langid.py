"""Language of texts and of their parts (problem 4).

A sparse multinomial logistic regression on TF-IDF character n-grams (hashed), fitted
with follow-the-regularised-leader and an elastic net, then calibrated by one
temperature on held-out sentences and their delivered labels, whose share of wrong ones is
estimated with it.  A sentence's vector has the length of one whose term frequencies are
square roots, so that repeats within it count for less.  It is fitted at run time on a bounded sample of the
delivered labels (``SAMPLE_ROWS``), which are partly wrong: after the first pass a
sentence whose label the model firmly contradicts is relabelled, and the fit repeated.

Texts are cut into sentences; each is scored, and the best sequence of languages under a
penalty for switching (Viterbi) gives the parts.  Scoring is a narrow map over all rows.

Defined cases: NULL or empty texts have no part; a text without a sentence (tags, links,
mentions, numbers, contact data, emoji, single words) has no part; repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.llm.textvec import Grams, fast_sums, grams, summed, with_nothing

LANGUAGES = ["ar", "de", "en", "es", "fr", "hi", "id", "it", "ja", "nl", "pl", "pt", "ru", "th", "tr", "uk", "zh"]
# The other ISO 639 codes of these languages.
CODES = {
    "ara": "ar", "deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "hin": "hi", "ind": "id", "in": "id", "ita": "it", "jpn": "ja",
    "nld": "nl", "dut": "nl", "pol": "pl", "por": "pt", "rus": "ru", "tha": "th", "tur": "tr", "ukr": "uk", "zho": "zh", "chi": "zh", "cmn": "zh",
}
ORDERS = (2, 3, 4)
BITS = 16
SAMPLE_ROWS = 20_000  #: labelled rows the classifier is fitted on, at most about this many
SCALE = 10.0  #: what a sentence's vector of unit length is multiplied by
RARE = 6  #: n-grams of fewer sentences are left out
SWITCH = 2.5  #: nats that a change of language between sentences costs

_NOISE = re.compile(
    r"https?://\S+"
    r"|[A-Za-z0-9][\w.+-]*\s?(?:@|＠|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?)[A-Za-z]{2,})+"
    r"|(?:FN|TEL|EMAIL):"
    r"|[@#]\w+"
    r"|\bext\.\s*\d+"
    r"|[+(]?\d[\d().\- ]{5,}\d"
    r"|[\U0001F000-\U0001FAFF☀-➿️‍←-⇿⬀-⯿]+",
    re.ASCII,
)
_CUT = re.compile(r"(?<=[.!?…。！？؟।۔])[\"”’»“)\]）」』.!?…]*(?:\s+|$)|(?<=[。！？।۔])[」』）”]*|\s*\n[\s\-]*|\s[|/—–]\s|(?<=[\u0e00-\u0e7f])\s+(?=(?:[A-Za-z][a-z’']*[ ,]+){3})")
_MARK = re.compile(r"[.!?…。！？؟।۔]")
_WORD = re.compile(r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*")
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_FOLD = str.maketrans({c: " " for c in "0123456789０１２３４５６７８９٠١٢٣٤٥٦٧٨٩०१२३४५६७८९_*~`|<>[]{}=+/\\^%$&;:\"“”„«»()（）「」『』,.!?…。！？؟।、，،-—–•"})
_BLANKS = re.compile(r" {2,}")


@lru_cache(4096)
def normal_label(label: str | None) -> str | None:
    """The two-letter code of a label in any notation; None if it is missing or names no known language."""
    if label is None:
        return None
    base = re.split(r"[-_.@ ]", label.strip().lower(), maxsplit=1)[0]
    base = CODES.get(base, base)
    return base if base in LANGUAGES else None


def sentences_of(text: str) -> list[str]:
    """The sentences of a text, in order, folded for scoring; fragments of abbreviations stay with what follows."""
    out, held = [], ""
    for piece in _CUT.split(_NOISE.sub(" ", text)):
        if not piece or piece.isspace():
            continue
        held = f"{held} {piece}" if held else piece
        words = _WORD.findall(held)
        dense = 0 if held.isascii() else len(_DENSE.findall(held))
        letters = sum(map(len, words))
        marked = _MARK.search(held) is not None
        if dense >= 8 or (dense >= 5 and (marked or _THAI.search(held))) or (dense < 5 and (marked and len(words) >= 3 and letters >= 8 or len(words) >= 5 and letters >= 18)):
            out.append(_BLANKS.sub(" ", held.lower().translate(_FOLD)).strip())
            held = ""
        elif not marked:
            held = ""  # words without a sentence
    return out


_SCRIPTS = [(re.compile(r"[\u3040-\u30ff]"), ["ja"]), (re.compile(r"[\u4e00-\u9fff]"), ["zh", "ja"]), (_THAI, ["th"]), (re.compile(r"[\u0900-\u097f]"), ["hi"]), (re.compile(r"[\u0600-\u06ff]"), ["ar"]), (re.compile(r"[\u0400-\u04ff]"), ["ru", "uk"])]


def script_languages(piece: str) -> list[str] | None:
    """The languages that the prevailing script of a sentence leaves open; None if it is Latin, in which any may be written."""
    if piece.isascii():
        return None
    latin = sum(map(len, re.findall(r"[a-zà-ɏ]+", piece)))
    for pattern, languages in _SCRIPTS:
        n = len(pattern.findall(piece))
        if n and (2 * n > latin or len(languages) == 1 and languages[0] in ("ja", "th") and n > 3):
            return languages
    return None


@dataclass
class Model:
    """``table``: per bucket the weights times idf of each language and, last, the squared idf; a row of zeros beyond the buckets."""

    table: np.ndarray
    temperature: float
    noise: float = 0.0  #: the share of delivered labels that are wrong, as estimated with the temperature

    def log_probabilities(self, pieces: list[str]) -> np.ndarray:
        sums, _ = fast_sums(self.table, pieces, ORDERS, BITS)
        score = sums[:, :-1] / (np.sqrt(sums[:, -1:]) + 1e-6) * (SCALE / self.temperature)
        return log_softmax(masked(score, pieces))


def masked(score: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Scores with the languages ruled out that a sentence's script isn't used for."""
    for i, piece in enumerate(pieces):
        if not piece.isascii() and (open_to := script_languages(piece)):
            score[i, _CLOSED[tuple(open_to)]] -= 50
    return score


_CLOSED = {tuple(ls): np.array([i for i, x in enumerate(LANGUAGES) if x not in ls]) for _, ls in _SCRIPTS}


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def logits(table: np.ndarray, idf2: np.ndarray, g: Grams) -> np.ndarray:
    norm = np.sqrt(summed(idf2[:, None], g)) + 1e-6
    return summed(table, g) / norm * SCALE


def ftrl(g: Grams, y: np.ndarray, idf: np.ndarray, k: int, epochs: int = 3, batch: int = 128, alpha: float = 0.02, beta: float = 0.02, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal over mini-batches: weights, buckets x k, many of them exactly zero."""
    size = len(idf)
    z, n = np.zeros((size, k), np.float32), np.zeros((size, k), np.float32)
    w = np.zeros((size, k), np.float32)
    bounds = np.append(g.starts, len(g.ids))
    lengths = np.diff(bounds)
    rng = np.random.default_rng(seed)
    norm = np.sqrt(summed((idf**2)[:, None], g)[:, 0]) + 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(g.starts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ln = lengths[rows]
            local = np.repeat(np.cumsum(ln) - ln, ln)
            ids = g.ids[np.arange(ln.sum()) - local + np.repeat(bounds[rows], ln)]
            val = idf[ids] / np.repeat(norm[rows], ln) * SCALE
            starts = np.cumsum(ln) - ln
            score = np.add.reduceat(w[ids] * val[:, None], starts, axis=0)
            p = np.exp(log_softmax(score))
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            by = np.argsort(ids, kind="stable")
            sorted_ids = ids[by]
            first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
            touched = sorted_ids[first]
            grad = np.add.reduceat(np.repeat(p, ln, axis=0)[by] * val[by, None], first, axis=0)
            square = grad * grad
            sigma = (np.sqrt(n[touched] + square) - np.sqrt(n[touched])) / alpha
            z[touched] += grad - sigma * w[touched]
            n[touched] += square
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= l1, 0, -(zt - np.sign(zt) * l1) / ((beta + np.sqrt(n[touched])) / alpha + l2))
    return w


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature and share of wrong labels under which delivered labels of held-out sentences are likeliest.

    A wrong label is any of the languages alike; without that share the wrong ones would be
    taken for doubt and every confidence come out too low.
    """
    best = (np.inf, 1.0, 0.0)
    mine = np.arange(len(y))
    for t in np.geomspace(0.2, 5, 25):
        p = np.exp(log_softmax(score / t))[mine, y]
        for noise in np.linspace(0, 0.3, 31):
            loss = -np.log(np.maximum((1 - noise) * p + noise / score.shape[1], 1e-12)).mean()
            if loss < best[0]:
                best = (loss, float(t), float(noise))
    return best[1], best[2]


def fit(pieces: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits on sentences with partly wrong labels; one in eight is held out, from relabelling and frequencies too, for the temperature."""
    k, labels = len(LANGUAGES), list(labels)
    if not pieces:
        return Model(with_nothing(np.concatenate([np.zeros((1 << BITS, k), np.float32), np.ones((1 << BITS, 1), np.float32)], axis=1)), 1.0)
    delivered = np.array([LANGUAGES.index(x) for x in labels])
    for i, piece in enumerate(pieces):
        open_to = script_languages(piece)
        if open_to and labels[i] not in open_to:
            labels[i] = open_to[0]
    y = np.array([LANGUAGES.index(x) for x in labels])
    g = grams(pieces, ORDERS, BITS)
    bounds = np.append(g.starts, len(g.ids))
    held = np.random.default_rng(seed).random(len(pieces)) < 0.125
    held &= len(pieces) >= 64
    train = np.flatnonzero(~held)

    def subset(rows: np.ndarray) -> Grams:
        ln = np.diff(bounds)[rows]
        starts = np.cumsum(ln) - ln
        return Grams(g.ids[np.arange(ln.sum()) - np.repeat(starts, ln) + np.repeat(bounds[rows], ln)], starts)

    inner = subset(train)
    owner = np.repeat(np.arange(len(train)), np.diff(np.append(inner.starts, len(inner.ids))))
    seen = np.unique(owner * (1 << BITS) + inner.ids) & ((1 << BITS) - 1)
    df = np.bincount(seen, minlength=1 << BITS)
    # What few sentences hold (names, mostly) says nothing of a language and would only learn wrong labels by heart.
    idf = np.where(df >= min(RARE, 1 + len(train) // 200), np.log((1 + len(train)) / (1 + df)), 0).astype(np.float32)
    y = y[train]
    w = ftrl(inner, y, idf, k, epochs=1, l1=1e-3, l2=0.1)
    closed = [(i, _CLOSED[tuple(x)]) for i, n in enumerate(train) if (x := script_languages(pieces[n]))]
    for sure, epochs in ((0.8, 1), (0.7, 1), (0.6, 3)):  # wrong labels: what the model contradicts takes its label
        p = np.exp(log_softmax(logits(w * idf[:, None], idf**2, inner)))
        for i, others in closed:
            p[i, others] = 0
        best = p.argmax(axis=1)
        y = np.where((p.max(axis=1) > sure) & (p[np.arange(len(y)), y] < 0.2), best, y)
        w = ftrl(inner, y, idf, k, epochs=epochs)
    table = (w * idf[:, None]).astype(np.float32)
    temperature, noise = 1.0, 0.0
    if held.any():
        rows = np.flatnonzero(held)
        temperature, noise = calibrated(masked(logits(table, idf**2, subset(rows)), [pieces[i] for i in rows]), delivered[rows])
    return Model(with_nothing(np.concatenate([table, (idf**2).astype(np.float32)[:, None]], axis=1)), temperature, noise)


def sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of a table, chosen by the hash of a key (all, if it has fewer)."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / total) + 1))


def fit_on(df: DataFrame, key: Column, text: Column, label: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on a bounded sample of a labelled table."""
    chosen = sample(df.where(label.isNotNull() & (F.length(F.trim(label)) > 0)), key, rows).select(text.alias("text"), label.alias("label")).toPandas()
    pieces, labels = [], []
    for x, y in zip(chosen["text"], chosen["label"]):
        code = normal_label(y)
        if x and code:
            own = sentences_of(x)
            pieces += own
            labels += [code] * len(own)
    return fit(pieces, labels)


def best_path(lp: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The likeliest languages of a text's sentences when each change costs ``switch``."""
    if len(lp) == 1:
        return lp.argmax(axis=1)
    total, back = lp[0].copy(), []
    for row in lp[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - switch
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - switch) + row
    path = [int(total.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


PARTS = "item string, item_id bigint, label string, seg_no int, n_parts int, lang string, confidence double, n_sentences int"
_ARROW = pa.schema([("item", pa.string()), ("item_id", pa.int64()), ("label", pa.string()), ("seg_no", pa.int32()), ("n_parts", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())])


def _tag(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            items, ids, labels, texts = (batch.column(i).to_pylist() for i in range(4))
            pieces, counts = [], []
            for t in texts:
                own = sentences_of(t)
                pieces += own
                counts.append(len(own))
            out = [[] for _ in _ARROW]
            once = {s: i for i, s in enumerate(dict.fromkeys(pieces))}
            lp = m.log_probabilities(list(once))[[once[s] for s in pieces]] if pieces else None
            best = lp.argmax(axis=1) if pieces else None
            at = 0
            for item, i, label, n in zip(items, ids, labels, counts):
                if not n:
                    continue
                own = lp[at : at + n]
                path = best[at : at + n]
                if n > 1 and (path != path[0]).any():
                    path = best_path(own)
                at += n
                cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n]
                for seg in range(len(cuts) - 1):
                    a, b = cuts[seg], cuts[seg + 1]
                    k = int(path[a])
                    row = (item, i, label, seg, len(cuts) - 1, LANGUAGES[k], float(np.exp(own[a:b, k]).mean()), b - a)
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    return run


def parts(df: DataFrame, model: Model, item: Column, item_id: Column, label: Column, text: Column) -> DataFrame:
    """One row per part of each text: language, confidence and number of sentences."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS x 17 floats, whatever the data
    slim = df.select(item.cast("string").alias("item"), item_id.cast("bigint").alias("item_id"), label.cast("string").alias("label"), text.alias("text")).where("text is not null and text <> ''")
    return slim.mapInArrow(_tag(shared), PARTS)


def label_code(label: Column) -> Column:
    """``normal_label`` as a JVM expression."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^\-_.@ ]*)", 1)
    known = F.create_map(*[F.lit(x) for pair in [*CODES.items(), *((c, c) for c in LANGUAGES)] for x in pair])
    return F.try_element_at(known, base)


def cases(rows: DataFrame) -> DataFrame:
    """The parts of texts whose label is missing or wrong, or that have several languages."""
    given = F.lower(F.trim("label"))
    missing = given.isNull() | given.isin("", "und")
    code = label_code(F.col("label"))
    # A single part carries the first part's language; of several parts all rows stay.
    return rows.where(missing | (F.col("n_parts") > 1) | code.isNull() | (code != F.col("lang")))
