"""Sentence boundaries across languages and scripts (problem 10).

Two passes over all documents.

1. Counting, per language and per script: how often each word type stands with and
   without a period, what follows a period, with which case; pre-aggregated in each
   batch, summed by Spark.  From these counts, by log-likelihood ratios and without any
   labels: abbreviations, collocations around a period, frequent sentence starters.
   Only the significant types reach the driver, not the vocabulary.
2. Cutting: quotations and brackets are units; at each remaining end mark the learned
   statistics decide, together with what follows.  Fixed rules hold for scripts without
   case or blanks, lists, line breaks and marks that trail an end.

Defined cases: NULL, empty and blank texts give no row; whole texts are read, whatever
their length; repeated documents give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.llm.langid import normal_label
from skiffline.session import Scratch

END = ".!?…。！？؟।۔"
_CLOSERS = "\"”’»“)\\]）」』》〉】"
EMOJI = "[\U0001F000-\U0001FAFF☀-➿⬀-⯿️‍]"
_TRAIL = re.compile(rf"[{re.escape(END)}{_CLOSERS}]*(?:\s?(?:{EMOJI})+)*")
_TRAIL_LINE = re.compile(rf"[{re.escape(END)}{_CLOSERS}]*(?:[^\S\n]*\n?[^\S\n]*(?:{EMOJI})+)*")
_SPAN = r"„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|《[^《》]*》|〈[^〈〉]*〉|【[^【】]*】|\([^()]*\)|（[^（）]*）|(?<![^\s(\[.!?…])\"(?=[^\s\"])[^\"]*\"|(?<=[.!?…])\"[^\s\"][^\"]*\""
_THAI = "฀-๿"
_SCAN = re.compile(rf"(?P<span>{_SPAN})|(?P<mark>[{re.escape(END)}]+)|(?P<thai>(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}]))|(?P<latin>(?<=[{_THAI}])[^\S\n]+(?=(?:[A-Za-z][a-z’']*[ ,]+){{3}}))|(?P<list>\n[^\S\n]*(?:[•*‣▪–—-]|\d{{1,3}}[.)]|[a-z]\))[^\S\n]+)")
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LIST = re.compile(r"[^\S\n]*(?:[•*‣▪–—-]|\d{1,3}[.)]|[a-z]\))[^\S\n]+\S")
_L = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u0dff\u0e31\u0e34-\u0e4e])+"  # letters with their signs
_LAST = re.compile(rf"(?:\d+(?:[.,]\d+)*|{_L}(?:[.’'\-]{_L})*)$")
_NEXT = re.compile(rf"[\"“„«(\[¿¡‘']*({_L}(?:[’'\-]{_L})*|\d+|.)", re.S)
_TOKEN = re.compile(rf"(?:\d+(?:[.,]\d+)*|{_L}(?:[.’'\-]{_L})*)(?:\.(?!\.))?(?!\w)")
_QUOTING = re.compile(r"\s*(?:[,;:，、；]|[—–-]\s|と|って|とい)")
_QUOTES = "\"“”„«»「」()（）"
NUMBER = "#"
SCRIPTS = {"ar": "arabic", "hi": "indic", "ja": "dense", "zh": "dense", "th": "thai", "ru": "cyrillic", "uk": "cyrillic"}  # else latin


def script_of(text: str) -> str:
    """A coarse name of the script that a text begins in, for pooled statistics."""
    for c in text:
        if c.isalpha():
            o = ord(c)
            return "latin" if o < 0x370 or 0x1E00 <= o < 0x1F00 else "cyrillic" if 0x400 <= o < 0x530 else "arabic" if 0x600 <= o < 0x780 else "indic" if 0x900 <= o < 0xE00 else "thai" if o < 0xE80 else "dense"
    return "latin"


def word_type(token: str) -> str:
    return NUMBER if token[:1].isdigit() else token.lower()


def count_document(text: str, label: str | None, out: list) -> None:
    """Appends what a document counts: (script, language, kind, type, following type).

    Kinds: `w` type without, `p` type with a period; `u` type with a capital; `s` type at an unambiguous begin of a
    sentence (of a text, or after an end mark that is no period); `l` type with a period
    before a small letter; `f` type with a period and the type that follows it otherwise.
    The language is empty where the label is missing or of another script than the word.
    """
    code = normal_label(label) or ""
    written = SCRIPTS.get(code, "latin")
    count = out.append
    for par in _PARAGRAPH.split(text):
        own = script_of(par)
        previous, after_period, gap_end = None, False, 0
        for m in _TOKEN.finditer(par):
            token = m.group()
            # Only a period before a blank, a mark or the end can end a sentence.
            period = token[-1] == "."
            bare = token[:-1] if period else token
            first = bare[0]
            if first.isalpha():
                kind, script = bare.lower(), "latin" if first < "\u0370" else script_of(bare)
            else:
                kind, script = NUMBER if first.isdigit() else bare.lower(), own
            if period and kind == NUMBER:
                gap = par[gap_end : m.start()]
                if not gap.rpartition("\n")[2].strip() and ("\n" in gap or previous is None):  # a list mark
                    previous, gap_end = None, m.end()
                    continue
            lang = code if script == written else ""
            count((script, lang, "p" if period else "w", kind, ""))
            if first.isupper():
                count((script, lang, "u", kind, ""))
            if previous is None:
                if not first.islower():
                    count((script, lang, "s", kind, ""))
            elif after_period:
                if first.islower():
                    count((script, lang, "l", previous, ""))
                else:
                    count((script, lang, "f", previous, kind))
            elif first.isupper():
                gap = par[gap_end : m.start()]
                if gap != " " and any(c in gap for c in "!?…") and not any(c in gap for c in _QUOTES):
                    count((script, lang, "s", kind, ""))
            previous, after_period, gap_end = kind, period, m.end()


_COUNTS = pa.schema([("script", pa.string()), ("lang", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _count(batches):
    out: Counter = Counter()
    for batch in batches:
        seen: list = []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count_document(text, label, seen)
            if len(seen) > 100_000:
                out.update(seen)
                seen = []
        out.update(seen)
        if len(out) > 200_000:
            yield _counted(out)
            out = Counter()
    yield _counted(out)


def _counted(out: Counter) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*out)] if out else [[] for _ in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, list(out.values())], _COUNTS)], schema=_COUNTS)


def counts(docs: DataFrame, text: Column, label: Column) -> DataFrame:
    """The corpus counts: grp, kind, a, b, n.  What counts for a script also counts for the language, if there is one."""
    slim = docs.select(text.alias("text"), label.cast("string").alias("label")).where("text is not null and text <> ''")
    partial = slim.mapInArrow(_count, "script string, lang string, kind string, a string, b string, n bigint")
    groups = F.when(F.col("lang") == "", F.array("script")).otherwise(F.array("script", "lang"))
    return partial.select(F.explode(groups).alias("grp"), "kind", "a", "b", "n").groupBy("grp", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _ll(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1-p)^(n-k) with 0 log 0 = 0."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(q) + (n - k) * F.log(1 - q)


def ratio(k: Column, n: Column, rest_k: Column, rest_n: Column) -> Column:
    """Dunning's -2 log lambda: is the rate k/n another than rest_k/rest_n?"""
    p, p1, p2 = (k + rest_k) / (n + rest_n), k / n, rest_k / F.greatest(rest_n, F.lit(1))
    return 2 * (_ll(k, n, p1) + _ll(rest_k, rest_n, p2) - _ll(k, n, p) - _ll(rest_k, rest_n, p))


@dataclass
class Statistics:
    """What was learned, per group (language or script)."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    ordinals: set[str] = field(default_factory=set)
    ordinary: dict[str, set[str]] = field(default_factory=dict)


SIGNIFICANT = 7.88  #: -2 log lambda beyond which a rate differs (p = 0.005)
CONTINUES = 0.7  #: share of an abbreviation's periods after which the sentence runs on


def learn(counted: DataFrame) -> Statistics:
    """Starters, abbreviations and collocations from the corpus counts; all tests run in Spark.

    1. A starter follows unambiguous ends (``!``, ``?``, a text's begin) significantly more
       often than it occurs elsewhere.
    2. An abbreviation takes a period significantly more often than other types do, and what
       follows it is mostly no sentence start: a small letter, a number, or a capital
       that is no starter.  (The likelihood ratio alone grows with the corpus and would in
       time take in every word that tends to end sentences.)
    3. A collocation is a pair around the period of an abbreviation or ordinal number that
       occurs together significantly more often than chance.
    4. An ordinary word is one that follows a period with a capital though it is mostly
       written small.
    """
    stats = Statistics()
    spark = counted.sparkSession
    sums = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in ("p", "w", "l", "s", "u")}
    types = counted.where(F.col("kind").isin(*sums)).groupBy("grp", "a").agg(*sums.values()).withColumn("seen", F.col("p") + F.col("w"))
    totals = F.broadcast(types.groupBy(F.col("grp").alias("g")).agg(F.sum("p").alias("tp"), F.sum("s").alias("ts"), F.sum("seen").alias("tn")))  # one row a group: a few dozen
    rated = types.join(totals, F.col("grp") == F.col("g"))
    k = F.least("s", "seen")
    starts = ratio(k, F.col("seen"), F.greatest(F.col("ts") - k, F.lit(0.0)), F.col("tn") - F.col("seen"))
    begun = rated.where((F.col("a") != NUMBER) & (F.col("s") >= 3) & (F.col("s") / F.col("seen") > F.col("ts") / F.col("tn")) & (starts >= SIGNIFICANT)).select("grp", "a").collect()
    for row in begun:
        stats.starters.setdefault(row.grp, set()).add(row.a)
    pairs = counted.where("kind = 'f'").select("grp", "a", "b", F.col("n").cast("double").alias("n"))
    starters = spark.createDataFrame([(r.grp, r.a) for r in begun], "sg string, sb string")
    after = pairs.join(F.broadcast(starters), (F.col("grp") == F.col("sg")) & (F.col("b") == F.col("sb")), "left").groupBy(F.col("grp").alias("fg"), F.col("a").alias("fa")).agg(F.sum(F.when(F.col("sb").isNull(), F.col("n")).otherwise(0)).alias("on"), F.sum("n").alias("all"))
    taken = rated.where(F.col("p") >= 3).join(after, (F.col("grp") == F.col("fg")) & (F.col("a") == F.col("fa")), "left").withColumn("on", F.coalesce("on", F.lit(0.0)) + F.col("l")).withColumn("all", F.coalesce("all", F.lit(0.0)) + F.col("l"))
    periods = ratio(F.col("p"), F.col("seen"), F.col("tp") - F.col("p"), F.col("tn") - F.col("seen"))
    often = (F.col("p") / F.col("seen") > F.col("tp") / F.col("tn")) & (periods >= SIGNIFICANT)
    short = F.col("a").contains(".") | (F.length("a") == 1)
    runs_on = (F.col("all") >= 2) & (F.col("on") / F.col("all") >= CONTINUES)
    found = taken.where(((F.col("a") != NUMBER) & often & (short | runs_on) & (F.col("p") >= F.col("w"))) | ((F.col("a") == NUMBER) & (F.col("l") >= 3) & (F.col("l") / F.col("p") > 0.01))).select("grp", "a").collect()
    for row in found:
        if row.a == NUMBER:
            stats.ordinals.add(row.grp)
        else:
            stats.abbreviations.setdefault(row.grp, set()).add(row.a)
    shorts = spark.createDataFrame([(r.grp, r.a) for r in found], "xg string, xa string")
    near = pairs.where(F.col("b") != NUMBER).join(F.broadcast(shorts), (F.col("grp") == F.col("xg")) & (F.col("a") == F.col("xa")), "left_semi")
    words = types.select("grp", "a", "seen")
    near = near.join(words.withColumnsRenamed({"a": "b", "seen": "nb"}), ["grp", "b"]).join(words.withColumnsRenamed({"seen": "na"}), ["grp", "a"]).join(totals, F.col("grp") == F.col("g"))
    together = F.least("n", "na")
    tied = ratio(together, F.col("na"), F.greatest(F.col("nb") - together, F.lit(0.0)), F.col("tn") - F.col("na"))
    for row in near.where((F.col("n") >= 3) & (together / F.col("na") > F.col("nb") / F.col("tn")) & (tied >= SIGNIFICANT)).select("grp", "a", "b").collect():
        stats.collocations.setdefault(row.grp, set()).add((row.a, row.b))
    follows = pairs.where(F.col("b") != NUMBER).select("grp", F.col("b").alias("a")).distinct()
    small = types.where((F.col("seen") >= 5) & (F.col("u") < 0.5 * F.col("seen")) & (F.col("u") > 0)).join(follows, ["grp", "a"], "left_semi")
    for row in small.select("grp", "a").collect():
        stats.ordinary.setdefault(row.grp, set()).add(row.a)
    return stats


class Splitter:
    """Cuts texts with learned statistics."""

    def __init__(self, stats: Statistics):
        self.stats = stats
        self.cache: dict = {}

    def _merged(self, groups: tuple[str, ...]):
        got = self.cache.get(groups)
        if got is None:
            s = self.stats
            got = tuple(set().union(*(part.get(g, ()) for g in groups)) for part in (s.abbreviations, s.starters, s.collocations, s.ordinary))
            got = (*got, bool(s.ordinals.intersection(groups)))
            self.cache[groups] = got
        return got

    def spans(self, text: str, label: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of every sentence, without white space around it."""
        code = normal_label(label)
        out: list[tuple[int, int]] = []
        at = 0
        for m in [*_PARAGRAPH.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                self._paragraph(text, at, end, code, out)
            at = m.end() if m else end
        return out

    def _paragraph(self, text: str, lo: int, hi: int, code: str | None, out: list) -> None:
        par = text[lo:hi]
        script = script_of(par)
        start, size = 0, len(par)
        in_list = _LIST.match(par) is not None

        def add(a: int, b: int) -> None:
            piece = par[a:b]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if right > left:
                out.append((lo + a + left, lo + a + right))

        pos = 0
        scan = _SCAN
        while True:
            m = scan.search(par, pos)
            if m is None:
                break
            kind, s, e = m.lastgroup, m.start(), m.end()
            if e == s:
                pos = e + 1
                continue
            pos = e
            if kind == "list":
                sign = par[s:e].strip()
                if in_list or not sign[0].isalnum() or sign[0] == "1" and len(sign) == 2:
                    add(start, s)
                    start, in_list = s, True
                continue
            if in_list:
                continue  # an item is one sentence
            if kind == "thai":
                cut = e
                add(start, s)
                start = cut
                continue
            if kind == "latin":
                add(start, s)
                start = e
                continue
            if kind == "span":
                inner = par[s + 1 : e - 1].rstrip()
                if not inner or inner[-1] not in END:
                    continue
                whole = _only_signs(par[start:s])
                tail = _TRAIL_LINE.match(par, e).end()
                rest = _NEXT.match(par, _skip(par, tail))
                if rest is None:
                    add(start, size)
                    start = pos = size
                    break
                c = rest.group(1)[0]
                if c.islower() or _QUOTING.match(par, e):
                    continue
                if not whole and not c.isupper():
                    continue
                add(start, tail)
                start = pos = tail
                in_list = tail < size and not par[tail].isspace() and _LIST.match(par, tail) is not None
                continue
            # An end mark.
            tail = _TRAIL_LINE.match(par, e).end()
            nxt = _skip(par, tail)
            if nxt >= size:
                add(start, size)
                start = pos = size
                break
            rest = _NEXT.match(par, nxt)
            word = rest.group(1)
            c = word[0]
            mark = par[s:e]
            dense = mark[-1] in "。！？।۔"
            glued = nxt == tail
            if glued and _LIST.match(par, nxt):  # a list whose line break got lost
                add(start, tail)
                start, pos, in_list = tail, nxt + 2, True
                continue
            if not dense:
                if glued and not (c.isupper() or _caseless(c) and mark[-1] in "?!…؟"):
                    if not (mark == "." and _caseless(c) and s and _caseless(par[s - 1])) and not (c.isdigit() and mark != "." and s and par[s - 1].isalpha() and len(mark) > 1):
                        continue
                if c.islower() or par[e] in ",;:،؛)" or _QUOTING.match(par, tail) and not _LIST.match(par, nxt):
                    continue
                if mark == "." and not self._ends(par, start, s, word, rest, glued, script, code):
                    continue
            add(start, tail)
            start = pos = tail
        add(start, size)

    def _ends(self, par: str, start: int, at: int, word: str, rest, glued: bool, script: str, code: str | None) -> bool:
        """Whether the single period at ``at`` ends a sentence that ``word`` doesn't continue."""
        begin = at
        while begin > start and not par[begin - 1].isspace():
            begin -= 1
        m = _LAST.search(par, begin, at)
        if m is None:
            return True
        last = m.group()
        kind = word_type(last)
        if last[0].isalpha():
            script = script_of(last)
        abbreviations, starters, collocations, ordinary, ordinals = self._merged((script, code) if code and SCRIPTS.get(code, "latin") == script else (script,))
        follow = word_type(word)
        opened = rest.start(1) > rest.start()
        tied = (kind, follow) in collocations and follow not in starters
        # A capital on a word that is mostly small begins a sentence, unless the pair belongs together.
        begins = follow in starters or follow in ordinary and word[0].isupper() and not tied
        if kind == NUMBER:
            if glued:
                return not word[0].isdigit()
            # A small ordinal number before a word that doesn't start sentences.
            return not (ordinals and len(last) <= 2 and not opened and word[0].isupper() and not begins)
        if glued and len(last) < 2:
            return False
        initial = len(last) == 1 and last.isupper()
        if kind in abbreviations or initial:
            if tied:
                return False
            if initial and kind not in abbreviations and not opened:
                return begins and len(word) > 1
            if word[0].isdigit():
                return False
            return opened or begins
        return True


def _only_signs(piece: str) -> bool:
    return not any(c.isalnum() for c in piece)


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


_WHITE = re.compile(r"\s*")


def _skip(par: str, at: int) -> int:
    return _WHITE.match(par, at).end()


def _cut(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())])

    def run(batches):
        splitter = Splitter(shared.value)
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for i, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for n, (a, b) in enumerate(splitter.spans(text, label)):
                    ids.append(i)
                    numbers.append(n)
                    starts.append(a)
                    ends.append(b)
                if len(ids) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, numbers, starts, ends), schema)], schema=schema)
                    ids, numbers, starts, ends = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, numbers, starts, ends), schema)], schema=schema)

    return run


def sentences(docs: DataFrame, doc_id: Column, text: Column, label: Column, stats: Statistics | None = None) -> DataFrame:
    """doc_id, sent_no, char_start, char_end of every sentence (code points, end exclusive)."""
    if stats is None:
        scratch = Scratch(docs.sparkSession, "sentence-counts")
        counted, path = scratch.write(counts(docs, text, label))
        stats = learn(counted)
        scratch.drop(path)
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    slim = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"), label.cast("string").alias("label")).where("text is not null and text <> ''")
    return slim.mapInArrow(_cut(shared), "doc_id bigint, sent_no int, char_start bigint, char_end bigint")
