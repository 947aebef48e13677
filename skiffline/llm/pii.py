"""Personal information in free text by a skip-chain conditional random field (problem 3).

Patterns mark the stretches of a text that could hold a piece: something shaped like an
e-mail address, a number, a postal address, or words beside a name of the lexicon (in the
text as folded one character to one, so positions stay).  The nodes of the field are the
tokens of these stretches; the labels are begin and inside of each type, and outside.
What lies in no stretch is outside.

Node potentials are log-linear in the token's shape, its place, the lexicon and the words
around.  Neighbouring tokens share chain potentials, of one kind inside a stretch and of
others between stretches.  Repeated tokens (the same word or digits) and similar ones (an
initial for the given name before the same family name, digits with the same end, an e-mail
address that holds a name) share skip potentials, however far apart they are: each is linked
to the one before it, so a token that occurs a thousand times has a thousand links and not a
million.  Loopy belief propagation over all documents of a batch at once, as array
operations, gives the labels; pieces are read off them.

Weights are fitted by pseudo-likelihood on a bounded sample (``SAMPLE_TEXTS``) whose labels
come from unambiguous shapes, cue words and the incomplete list of known names; ambiguous
stretches are filled in with the model's own beliefs and the fit repeated.  Skip potentials
are drawn to agreement (``AGREEMENT``) where a corpus has too few repeats to learn them.
Names missing from the list are learned first, from counts over all texts: words that stand
beside known names.

Defined cases: NULL or empty texts have no piece and come out as they are; whole texts are
read; repeated rows give repeated rows; an empty list of names finds names by none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiffline.llm.langid import sample
from skiffline.session import Scratch

TYPES = ["none", "email", "phone", "id_number", "address", "person"]
NONE, EMAIL, PHONE, ID, ADDRESS, PERSON = range(6)
TYPE_OF = np.array([NONE, *(t for t in range(1, len(TYPES)) for _ in "BI")])  #: labels: outside, then begin and inside of each type
DOUBT = 1.0  #: the log-potential against an address that no street word shows
AGREEMENT = 4.0  #: the log-potential of one type for two linked tokens, before anything is learned
ALLOWED = {"email": [NONE, EMAIL], "number": [NONE, PHONE, ID], "code": [NONE, ID], "address": [NONE, ADDRESS], "person": [NONE, PERSON]}
BITS = 15
SAMPLE_TEXTS = 20_000  #: texts that weights are learned from, at most about this many
ROUNDS = 8  #: of message passing

_DIGITS = {chr(z + i): str(i) for z in (0xFF10, 0x0660, 0x06F0, 0x0966, 0x0E50) for i in range(10)}
FOLD = str.maketrans({**{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **_DIGITS, " ": " ", "‑": "-", "‐": "-", " ": " "})

_EMAIL = re.compile(r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*(?:@| @ ?|\s?[(\[]at[)\]]\s?)[A-Za-z0-9\-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9\-]+)*(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z]{2,}", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![\w.,/])(?:\+|\((?=\d{3}\)))?\d[\d().\- ]{4,}\d(?![\d_]|[A-Za-z]{1,2}(?![A-Za-z]))", re.ASCII)
_CODE = re.compile(r"(?<![A-Za-z0-9\-])(?:[A-Z]{2}\d{2}(?: ?\d{4}){2,7}(?: ?\d{1,4})?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![A-Za-z])|[A-Z]{1,2}-?\d{6,9}(?:-?[A-Z](?![A-Za-z]))?)(?!\d)", re.ASCII | re.IGNORECASE)
# Words that name streets, by language.
_STREETS = r"street|st|avenue|ave|road|rd|lane|court|terrace|close|drive|way|ln|ct|ter|terr|tce|dr|pl|sq|cl|cres|place|square|row|walk|crescent|gardens|mews|parade|wharf|hill"
_ES = r"calle|avenida|paseo|plaza|camino|ronda|travesía|travesia|callejón|rua|travessa|praça|praca|largo|alameda|via|viale|piazza|corso|vicolo|calata"
_FR = r"rue|avenue|impasse|quai|boulevard|place|chemin|allée|allee|cours|passage|sentier"
_DE = r"straße|strasse|weg|gasse|allee|platz|ufer|ring|damm|steig|straat|laan|kade|gracht|plein"
_RU = r"ул|пр|пер|наб|пл|бул|просп|вул|пров"
_W = r"[^\W\d_][\w’'\-]*"
_ADDRESS = re.compile(
    rf"(?<![\w,.]\s)(?<!\w)(?:unit|flat|apt\.?|suite)\s\d+[a-z]?,\s\d{{1,4}}[a-z]?\s(?:{_W}\s){{1,3}}(?:{_STREETS})(?!\w)"
    rf"|(?<!\w)(?<!\w-)(?:(?:unit|flat|apt\.?|suite)\s\d+[a-z]?,\s)?\d{{1,4}}[a-z]?\s(?:{_W}\s){{1,3}}(?:{_STREETS})(?!\w)"
    rf"|(?<!\w)(?:{_ES})\s(?:{_W}\s){{1,5}}\d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)\d{{1,4}}(?:\s?(?:bis|ter|[a-z]))?,?\s(?:{_FR})\s(?:{_W}\s?){{1,5}}"
    rf"|(?<!\w)(?P<beside>am|an der|auf dem|im|zum|zur|aan de|op de)\s(?:{_W}\s){{1,2}}\d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)[^\W\d_]{{2,}}(?:{_DE})\s\d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<!\w)(?:{_RU})\.\s(?:{_W}[\s,]+){{1,3}}(?:(?:д|буд)\.\s?)?\d{{1,4}}",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*")
# A number and capital words, none of which names a street: an address or not, by what stands around.
_PLACE = re.compile(r"(?<!\w)(?<!\w-)(?P<unit>(?:[Uu]nit|[Ff]lat|[Aa]pt\.?|[Ss]uite)\s\d+[a-z]?,\s)?\d{1,4}[a-z]?(?:\s[A-Z][a-z]+){2}(?![\w’'])", re.ASCII)
_PART = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")
_LEFT = re.compile(r"(?<![\w@#])([^\W\d_][^\W\d_]+) $")
_RIGHT = re.compile(r" ([^\W\d_][^\W\d_]+)(?![\w@])")
_POSTCODE = re.compile(r",\s\d{4,5}")
STREET_WORDS = {w for w in re.findall(r"[^\W\d_]+", " ".join((_STREETS, _ES, _FR, _DE, _RU)))} | {"am", "an", "auf", "im", "zum", "zur", "aan", "op"}
STREET_ENDS = tuple(_DE.split("|"))
# Words beside numbers that tell what is numbered.
CUE_ID = {"id", "passport", "ausweis", "паспорт", "documento", "carte", "tax", "card", "dowód", "kimlik", "no."}
CUE_THING = {"order", "invoice", "pedido", "bestellung", "commande", "заказ", "ticket", "serial", "build", "version", "versión", "versão", "post", "ordine", "zamówienie", "bestelling", "sipariş", "замовлення", "pesanan", "beitrag", "kapitel", "seite", "raum", "saal", "zimmer", "gleis", "bericht", "hoofdstuk", "zaal"}


@dataclass
class Token:
    """A node: a token of a stretch that could hold a piece."""

    start: int
    end: int
    key: str  #: equal keys are the same thing again
    features: list[int]
    allowed: list[int]  #: labels
    weak: int | None  #: the label that shape, cue or lexicon alone give, if they do
    stretch: int
    doubt: float = 0.0  #: what counts against a piece from the outset


def begin(of: int) -> int:
    return 2 * of - 1


def inside(of: int) -> int:
    return 2 * of


def _h(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def shape(number: str) -> str:
    """Digits counted by group, separators kept: ``+999 55`` -> ``+3 2``."""
    return re.sub(r"\d+", lambda m: str(len(m.group())), number)


def _phone_shape(number: str, digits: str) -> bool:
    if not 9 <= len(digits) <= 20:
        return False
    s = shape(number)
    if number[0] == "+":
        return True
    return s.startswith(("(3) 3", "(3)3")) or re.match(r"(?:5[ \-]2[ \-]|1 2 3 2 2|4-3-4|4 3 4|3\.3\.4|3 3 4|3-3-4)", s) is not None


def _plain_shape(number: str, digits: str) -> bool:
    """Dates, decimals, versions and plain numerals."""
    s = shape(number)
    return re.fullmatch(r"4-2-2|2\.2\.4|\d+\.\d+|\d\.\d+|(?:\d\.)+\d|4-4", s) is not None or len(digits) < 7


class Finder:
    """Finds candidates with a lexicon of given and family names (small letters)."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.both = given | family

    def tokens(self, text: str) -> list[Token]:
        """The nodes of a text."""
        t = text if text.isascii() else text.translate(FOLD)
        out: list[Token] = []
        for n, found in enumerate(self._stretches(t)):
            out += self._named(t, found, n) if found[2] == "person" else self._plain(t, found, n)
        return out

    def _stretches(self, t: str) -> list:
        found: list[tuple[int, int, str, str, list[str], int | None]] = []
        taken: list[tuple[int, int]] = []
        if "@" in t or "at" in t or "AT" in t:
            for m in _EMAIL.finditer(t):
                local = re.split(r"[@(\[ ]", m.group())[0].lower()
                found.append((m.start(), m.end(), "email", local, ["email"], EMAIL))
                taken.append(m.span())
        low = t.lower()
        words = _WORD.findall(low)
        digits_in = any(c in t for c in "0123456789")
        if digits_in:
            for m in _ADDRESS.finditer(t) if not STREET_WORDS.isdisjoint(words) or any(w.endswith(STREET_ENDS) for w in words) else ():
                if _free(taken, m):
                    before = t[max(0, m.start() - 12) : m.start()].lower()
                    weak = NONE if re.search(r"(?:chapter|ch\.|kapitel|глава|capítulo)\s$", before) else ADDRESS
                    if m.group("beside"):  # a place that no street word names: only with a postcode is it sure
                        named = m.group().split()[-2]
                        if not named[0].isupper() or named.lower() in CUE_THING:
                            continue
                        weak = ADDRESS if _POSTCODE.match(t, m.end()) else None
                    found.append((m.start(), m.end(), "address", m.group().lower(), ["address"], weak))
                    taken.append(m.span())
            for m in _PLACE.finditer(t):
                if _free(taken, m):
                    found.append((m.start(), m.end(), "address", m.group().lower(), ["place", *(["unit"] if m.group("unit") else [])], ADDRESS if m.group("unit") else None))
                    taken.append(m.span())
            for m in _CODE.finditer(t):
                if _free(taken, m):
                    word = m.group()
                    s = re.sub(r"[A-Za-z]", "A", shape(word))
                    if sum(c.isdigit() for c in word) < 6:
                        continue
                    prefix = re.match(r"[A-Za-z]+-?", word).group().upper()
                    weak = ID if re.match(r"AA2(?: 4)+|AA ?2 2 2|AA7", s) else None
                    found.append((m.start(), m.end(), "code", re.sub(r"\W", "", word).lower(), ["code", "shape=" + s, "prefix=" + prefix], weak))
                    taken.append(m.span())
            for m in _NUMBER.finditer(t):
                if _free(taken, m):
                    number = m.group()
                    digits = re.sub(r"\D", "", number)
                    if len(digits) < 7:
                        continue
                    s = shape(number)
                    phone = _phone_shape(number, digits)
                    weak = PHONE if phone else NONE if _plain_shape(number, digits) else None
                    found.append((m.start(), m.end(), "number", digits, ["number", "shape=" + s, "head=" + s[:4], f"zero={digits[:2]}", f"n={len(digits)}", f"phone={phone}"], weak))
                    taken.append(m.span())
        if not self.both.isdisjoint(words) or "-" in low and any(not self.both.isdisjoint(w.split("-")) for w in words if "-" in w):
            found += self._names(t, low if len(low) == len(t) else None, taken)
        found.sort()
        return found

    def _names(self, t: str, low: str | None, taken: list) -> list:
        words = [m for m in _WORD.finditer(t)]
        lows = [m.group().lower() for m in words]
        out, i, n = [], 0, len(words)
        given, family = self.given, self.family

        def is_given(k: int) -> bool:
            return 0 <= k < n and all(part in given for part in lows[k].split("-"))

        def is_family(k: int) -> bool:
            return 0 <= k < n and lows[k] in family

        def initial(k: int) -> bool:
            return 0 <= k < n and len(lows[k]) == 1 and t[words[k].end() : words[k].end() + 1] == "."

        def joined(k: int, seps: tuple[str, ...]) -> bool:
            return 0 <= k and k + 1 < n and t[words[k].end() : words[k + 1].start()] in seps

        def new(k: int) -> bool:
            return 0 <= k < n and len(lows[k]) > 3 and words[k].group()[0].isupper() and lows[k] not in self.both

        used = -1
        while i < n:
            if is_family(i) and i > used:
                a, b, form, weak = None, i, "", None
                if joined(i - 1, (". ",)) and initial(i - 1):
                    a, form = i - 1, "initial"
                    if joined(i - 2, (" ",)) and (is_given(i - 2) or new(i - 2)):
                        a, form = i - 2, "middle"
                elif joined(i - 1, (" ",)) and is_given(i - 1):
                    a, form = i - 1, "given"
                    if joined(i - 2, (" ",)) and is_given(i - 2):
                        a = i - 2
                elif joined(i, (", ",)) and is_given(i + 1):
                    a, b, form = i, i + 1, "comma"
                elif joined(i, (" ",)) and is_given(i + 1):
                    a, b, form = i, i + 1, "reversed"
                elif (joined(i, (", ",)) or joined(i, (" ",))) and initial(i + 1):
                    a, b, form = i, i + 1, "family_initial"
                elif joined(i - 1, (" ",)) and new(i - 1) and t[words[i].start()].isupper():
                    a, form = i - 1, "new_given"
                if a is not None and a > used:
                    fam = lows[i]
                    known = fam in self.family and (form in ("initial", "family_initial") or all(p in self.given for k in (a, b) if k != i for p in lows[k].split("-") if len(p) > 1))
                    weak = PERSON if known else None
                    s, e = words[a].start(), words[b].end()
                    if not any(x <= s < y for x, y in taken) and (s == 0 or t[s - 1] not in "@#_"):
                        case = "upper" if t[s:e].isupper() else "lower" if t[s:e].islower() else "title"
                        out.append((s, e, "person", fam, ["form=" + form, "case=" + case, f"form={form} case={case}"], weak))
                        used = b
            i += 1
        # A known given name before a capital word that may be a family name.
        for k in range(n - 1):
            if is_given(k) and new(k + 1) and joined(k, (" ",)) and not any(x <= words[k].start() < y or x <= words[k + 1].start() < y for x, y in [(o[0], o[1]) for o in out] + taken) and (words[k].start() == 0 or t[words[k].start() - 1] not in "@#_"):
                out.append((words[k].start(), words[k + 1].end(), "person", lows[k + 1], ["form=new_family"], None))
        return out

    def _around(self, t: str, s: int, e: int, kind: str) -> tuple[list[str], list[str], list[str], str]:
        """Features of the words and signs around a stretch, these words, and the sign before it."""
        before = _WORD.findall(t[max(0, s - 28) : s].lower())[-2:]
        after = _WORD.findall(t[e : e + 24].lower())[:2]
        sign = t[max(0, s - 2) : s].strip()[-1:] if s else "^"
        left = ["<name>" if w in self.both else w for w in before]
        names = [f"{kind} b1={left[-1] if left else '^'}{sign if sign == ',' else ''}", f"{kind} b2={' '.join(left)}", f"{kind} a1={after[0] if after else '$'}", f"{kind} sign={sign}", *(f"{kind} near={w}" for w in left[:1])]
        return names, before, after, sign

    def _plain(self, t: str, found: tuple, n: int) -> list[Token]:
        """The tokens of anything but a name: numbers, codes and e-mail addresses are one each."""
        s, e, kind, key, features, weak = found
        around, before, after, sign = self._around(t, s, e, kind)
        if kind in ("number", "code") and weak is None or kind == "code":
            beside = {*before, *after[:1]}
            if beside & CUE_THING:
                weak = NONE
            elif beside & CUE_ID:
                weak = ID
            elif sign == "(" and kind == "number" and t[e : e + 1] == ")":
                weak = ID
        bare = features[0] == "place"  # only what stands around such a place speaks for it
        spans = [m.span() for m in _PART.finditer(t, s, e)] if kind == "address" and not bare else [(s, e)]
        out = []
        for i, (a, b) in enumerate(spans):
            may = [NONE, *(begin(k) if i == 0 else inside(k) for k in ALLOWED[kind] if k != NONE)]
            word = t[a:b].lower()
            names = [*features[1:], *around] if bare else [*features, *around] if i == 0 else [f"{features[0]} inner", f"{features[0]} w={re.sub(r'[0-9]', '0', word)}"]
            label = None if weak is None else NONE if weak == NONE else begin(weak) if i == 0 else inside(weak)
            out.append(Token(a, b, key if len(spans) == 1 else word, [_h(x) for x in names], may, label, n, DOUBT if bare else 0.0))
        return out

    def _named(self, t: str, found: tuple, n: int) -> list[Token]:
        """The tokens of a name and the word on either side of it, that may belong to it."""
        s, e, kind, _, features, weak = found
        words = [m.span() for m in _PART.finditer(t, s, e)]
        left, right = _LEFT.search(t, max(0, s - 24), s), _RIGHT.match(t, e)
        words = [*([left.span(1)] if left else []), *words, *([right.span(1)] if right else [])]
        around = self._around(t, words[0][0], words[-1][1], kind)[0]
        lows = [t[a:b].lower() for a, b in words]
        kinds = ["I" if len(w) == 1 else ("G" if all(x in self.given for x in w.split("-")) else "") + ("F" if w in self.family else "") or ("N" if t[a].isupper() else "w") for w, (a, b) in zip(lows, words)]
        out, may = [], [NONE, begin(PERSON), inside(PERSON)]
        for i, (a, b) in enumerate(words):
            mine = s <= a < e
            before, after = kinds[i - 1] if i else "^", kinds[i + 1] if i + 1 < len(words) else "$"
            names = [kind, f"lex={kinds[i]}", f"lex={before}<{kinds[i]}", f"lex={kinds[i]}>{after}", f"lex={before}<{kinds[i]}>{after}", f"gap={t[words[i - 1][1] : a] if i else '^'} {kinds[i]}"]
            if "G" not in kinds[i] and "F" not in kinds[i]:
                names.append(f"word={lows[i]}")
            names += [*features, f"{features[0]} begin={a == s}", *around] if mine else ["beside"]
            label = None if weak is None else NONE if weak == NONE or not mine else begin(PERSON) if a == s else inside(PERSON)
            out.append(Token(a, b, lows[i], [_h(x) for x in names], may, label, n))
        return out


def _free(taken: list, m: re.Match) -> bool:
    s, e = m.span()
    return all(e <= a or s >= b for a, b in taken)


# Links: 0 inside a stretch, 1 to a near stretch, 2 to a distant one, 3 the same again, 4 something similar.
LINK_KINDS, SAME, SIMILAR = 5, 3, 4


def links(nodes: list[Token]) -> list[tuple[int, int, int]]:
    """Chain and skip links (i, j, kind), i < j, of a document; linear in its nodes."""
    out, last, near = [], {}, {}
    for j, p in enumerate(nodes):
        if j:
            q = nodes[j - 1]
            out.append((j - 1, j, 0 if q.stretch == p.stretch else 1 if p.start - q.end <= 30 else 2))
        kind = p.allowed[-1]
        if len(p.key) < 3:
            continue
        if (i := last.get((kind, p.key))) is not None:
            out.append((i, j, SAME))
        else:
            for sign in _signatures(p):
                if (i := near.get(sign)) is not None and nodes[i].stretch != p.stretch:
                    out.append((i, j, SIMILAR))
                    break
        last[kind, p.key] = j
        for sign in _signatures(p):
            near[sign] = j
    return out


def _signatures(p: Token) -> list[tuple]:
    """What tokens that are alike have in common: the end of their digits, the begin of a long word, a name in an e-mail address."""
    kind, digits = p.allowed[-1], re.sub(r"\D", "", p.key)
    if kind == begin(EMAIL):
        return [("name", part[i:]) for part in re.split(r"[^a-z]+", p.key) for i in (0, 1) if len(part) - i > 4]
    if len(digits) >= 6:
        return [("digits", digits[-6:])]
    if kind == inside(PERSON):
        return [("name", p.key)] if len(p.key) > 4 else []
    return [(kind, p.key[:6])] if len(p.key) >= 6 else []


@dataclass
class Model:
    weights: np.ndarray  #: features x labels
    pairs: np.ndarray  #: link kinds x labels x labels
    given: set[str]
    family: set[str]


def no_pairs() -> np.ndarray:
    """Pair potentials before anything is learned: inside can't follow outside or another type; linked tokens are of one type."""
    n = len(TYPE_OF)
    pairs = np.zeros((LINK_KINDS, n, n))
    for i in range(n):
        for t in range(1, len(TYPES)):
            if TYPE_OF[i] != t:
                pairs[0, i, inside(t)] = CLOSED
            pairs[1:3, i, inside(t)] = CLOSED
    pairs[SAME:] = AGREEMENT * (TYPE_OF[:, None] == TYPE_OF[None, :])
    pairs[SIMILAR] /= 2
    return pairs


CLOSED = -1e4
_BLOCK = (TYPE_OF[:, None] == np.arange(len(TYPES))[None, :]).astype(float)  #: labels x types


class Batch:
    """The nodes of many documents as arrays."""

    def __init__(self, docs: list[list[Token]]):
        self.flat = [p for d in docs for p in d]
        self.ids = np.array([x for p in self.flat for x in p.features], np.int64)
        self.starts = np.cumsum([0] + [len(p.features) for p in self.flat])[:-1].astype(np.int64)
        self.closed = np.full((len(self.flat), len(TYPE_OF)), CLOSED, np.float64)
        for i, p in enumerate(self.flat):
            self.closed[i, p.allowed] = 0
            self.closed[i, p.allowed[1:]] -= p.doubt
        a, b, k, at = [], [], [], 0
        for d in docs:
            if len(d) > 1:
                for i, j, kind in links(d):
                    a.append(at + i)
                    b.append(at + j)
                    k.append(kind)
            at += len(d)
        self.a, self.b, self.k = np.array(a, np.int64), np.array(b, np.int64), np.array(k, np.int64)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.ids], self.starts, axis=0) + self.closed

    def beliefs(self, weights: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Marginals by loopy sum-product with damping, all documents at once."""
        u = self.unary(weights)
        if len(self.a):
            n = len(u)
            source, target = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
            potential = np.concatenate([pairs[self.k], pairs[self.k].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(self.a)) + len(self.a), np.arange(len(self.a))])
            m = np.zeros((len(source), len(TYPE_OF)))
            for _ in range(rounds):
                inbox = np.zeros((n, len(TYPE_OF)))
                np.add.at(inbox, target, m)
                out = (u + inbox)[source] - m[back]
                new = _lse(out[:, :, None] + potential, 1)
                new -= _lse(new, 1)[:, None]
                m = 0.5 * m + 0.5 * new
            inbox = np.zeros((n, len(TYPE_OF)))
            np.add.at(inbox, target, m)
            u = u + inbox
        return np.exp(u - _lse(u, 1)[:, None])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def pseudo_likelihood(batch: Batch, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.3, l2: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials that make each label likely given its neighbours' labels (AdaGrad).

    Skip potentials are symmetric and depend on the types only; they are drawn to agreement, the others to zero.
    """
    first = no_pairs()
    w, pairs = np.zeros((1 << BITS, len(TYPE_OF))), first.copy()
    gw, gp = np.full_like(w, 1e-6), np.full_like(pairs, 1e-6)
    sure = (weight[batch.a] > 0) & (weight[batch.b] > 0) if len(batch.a) else np.zeros(0, bool)  # links to what has no label yet say nothing
    a, b, k = batch.a[sure], batch.b[sure], batch.k[sure]
    lengths = np.diff(np.append(batch.starts, len(batch.ids)))
    owner = np.repeat(np.arange(len(batch.flat)), lengths)
    touched = np.unique(batch.ids)
    total = max(1.0, weight.sum())
    for _ in range(steps):
        score = batch.unary(w)
        if len(a):
            np.add.at(score, b, pairs[k, y[a]])
            np.add.at(score, a, pairs[k, :, y[b]])
        p = np.exp(score - _lse(score, 1)[:, None])
        p[np.arange(len(y)), y] -= 1
        p *= (weight / total)[:, None]
        grad = np.zeros_like(w)
        np.add.at(grad, batch.ids, p[owner])
        grad = grad[touched] + l2 * w[touched] / len(touched)
        gw[touched] += grad * grad
        w[touched] -= rate * grad / np.sqrt(gw[touched])
        if len(a):
            step = np.zeros_like(pairs)
            np.add.at(step, (k, y[a]), p[b])
            swapped = np.zeros_like(pairs)
            np.add.at(swapped, (k, y[b]), p[a])
            step += swapped.transpose(0, 2, 1) + l2 * (pairs - first)
            tied = _BLOCK.T @ step[SAME:] @ _BLOCK
            step[SAME:] = _BLOCK @ ((tied + tied.transpose(0, 2, 1)) / 2) @ _BLOCK.T
            gp += step * step
            pairs -= np.where(first <= CLOSED, 0, rate * step / np.sqrt(gp))
    return w, pairs


def _folded(text: str) -> str:
    t = text if text.isascii() else text.translate(FOLD)
    return _EMAIL.sub(" | ", t) if "@" in t or "(" in t or "[" in t else t


def beside(t: str, given: set[str], family: set[str]) -> tuple[set[str], set[str]]:
    """Words of a folded text that stand where a given and a family name would, beside known names."""
    g_new: set[str] = set()
    f_new: set[str] = set()
    ms = list(_WORD.finditer(t))
    lows = [m.group().lower() for m in ms]
    if given.isdisjoint(lows) and family.isdisjoint(lows):
        return g_new, f_new
    for i in range(len(ms) - 1):
        a, b = lows[i], lows[i + 1]
        if not (a in given or a in family or b in given or b in family):
            continue
        gap = t[ms[i].end() : ms[i + 1].start()]
        if len(a) < 3 or len(b) < 3:
            if len(b) == 1 and a in given and gap == " " and i + 2 < len(ms) and t[ms[i + 1].end() : ms[i + 2].start()] == ". " and ms[i + 2].group()[0].isupper():
                f_new.add(lows[i + 2])
            continue
        upper_a, upper_b = ms[i].group()[0].isupper(), ms[i + 1].group()[0].isupper()
        if gap == " ":
            if b in family and a not in family and upper_a:
                g_new.add(a)
            if a in given and b not in given and upper_b:
                f_new.add(b)
            if a in family and b not in family and upper_b and a[0] > "z":
                g_new.add(b)
            if b in given and a not in given and upper_a and b[0] > "z":
                f_new.add(a)
        elif gap == ", " and upper_a and upper_b:
            if b in given and a not in given:
                f_new.add(a)
            if a in family and b not in family:
                g_new.add(b)
    return g_new, f_new


NAME_TEXTS, NAME_SHARE = 3, 0.3  #: texts in which a word stands beside known names, at least, and their share of all texts with it


def widened(given: set[str], family: set[str], counts: list[tuple[str, int, int, int]]) -> tuple[set[str], set[str]]:
    """The lexicon with the words added whose counts (word, as given, as family, texts with it) pass."""
    as_given, as_family = {w: g for w, g, _, _ in counts}, {w: f for w, _, f, _ in counts}
    new_given = {w for w, n, _, seen in counts if n >= NAME_TEXTS and n >= NAME_SHARE * seen and w not in family}
    new_family = {w for w, _, n, seen in counts if n >= NAME_TEXTS and n >= NAME_SHARE * seen and w not in given}
    clash = new_given & new_family
    wide_given = given | {w for w in new_given if w not in clash or as_given[w] >= as_family[w]}
    return wide_given, family | {w for w in new_family if w not in clash or as_family[w] > as_given[w]}


def _closed_lexicon(given: set[str], family: set[str]) -> tuple[set[str], set[str]]:
    given = given | {p for w in given for p in w.split("-") if len(p) > 2}
    return given - family, family


def learn_names(texts: list[str], given: set[str], family: set[str], rounds: int = 2) -> tuple[set[str], set[str]]:
    """The lexicon with words added that stand beside known names more often than elsewhere."""
    given, family = set(given), set(family)
    folded = [_folded(t) for t in texts]
    seen: Counter = Counter(w for t in folded for w in set(_WORD.findall(t.lower())))
    for _ in range(rounds):
        as_given, as_family = Counter(), Counter()
        for t in folded:
            g_new, f_new = beside(t, given, family)
            as_given.update(g_new)
            as_family.update(f_new)
        given, family = widened(given, family, [(w, as_given[w], as_family[w], seen[w]) for w in as_given.keys() | as_family.keys()])
    return _closed_lexicon(given, family)


_COUNTS = pa.schema([("w", pa.string()), ("g", pa.int64()), ("f", pa.int64()), ("n", pa.int64())])


def _counted(shared, with_seen: bool, flush: int = 200_000):
    """Partial counts of a task's texts: words beside known names and, with ``with_seen``, texts with each word."""

    def batch_of(*counters: Counter) -> pa.RecordBatch:
        words = list(set().union(*counters))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counters)], schema=_COUNTS)

    def run(batches):
        given, family = shared.value
        as_given, as_family, seen = Counter(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = _folded(text)
                words = set(_WORD.findall(t.lower()))
                if with_seen:
                    seen.update(words)
                if not words.isdisjoint(given) or not words.isdisjoint(family):
                    g_new, f_new = beside(t, given, family)
                    as_given.update(g_new)
                    as_family.update(f_new)
                if len(seen) + len(as_given) + len(as_family) >= flush:
                    yield batch_of(as_given, as_family, seen)
                    as_given, as_family, seen = Counter(), Counter(), Counter()
        yield batch_of(as_given, as_family, seen)

    return run


def learn_names_on(texts: DataFrame, given: set[str], family: set[str], rounds: int = 2) -> tuple[set[str], set[str]]:
    """``learn_names`` over all rows of a table with one text column: partial counts, summed in Spark; only words that pass come back."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "names")
    slim = texts.toDF("x").where("x is not null and x <> ''")
    seen = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((given, family))  # the lexicon
        counts = slim.mapInArrow(_counted(shared, seen is None), "w string, g bigint, f bigint, n bigint").groupBy("w").agg(F.sum("g").alias("g"), F.sum("f").alias("f"), F.sum("n").alias("n"))
        if seen is None:
            counts, path = scratch.write(counts)
            seen = counts.select("w", "n")
        else:
            counts = counts.drop("n").join(seen, "w")
        passing = counts.where(F.greatest("g", "f") >= F.greatest(F.lit(NAME_TEXTS), NAME_SHARE * F.col("n")))
        given, family = widened(given, family, [(r.w, r.g, r.f, r.n) for r in passing.select("w", "g", "f", "n").collect()])
    scratch.drop(path)
    return _closed_lexicon(given, family)


def fit(texts: list[str], given: set[str], family: set[str], lexicon: tuple[set[str], set[str]] | None = None) -> Model:
    """``lexicon``: names known and learned, if they come from more than ``texts``."""
    texts = [t for t in texts if t]
    wide_given, wide_family = lexicon or learn_names(texts, given, family)
    finder = Finder(wide_given, wide_family)
    docs = [d for t in texts if (d := finder.tokens(t))]
    if not docs:
        zero = np.zeros((1 << BITS, len(TYPE_OF)))
        zero[[_h("email")], begin(EMAIL)] = zero[[_h("address")], begin(ADDRESS)] = zero[[_h("address inner")], inside(ADDRESS)] = 3
        zero[[_h("phone=True")], begin(PHONE)] = 3
        return Model(zero, no_pairs(), wide_given, wide_family)
    batch = Batch(docs)
    known = np.array([p.weak is not None for p in batch.flat])
    y = np.array([NONE if p.weak is None else p.weak for p in batch.flat])
    w, pairs = pseudo_likelihood(batch, y, known.astype(float))
    for _ in range(2):
        p = batch.beliefs(w, pairs)
        y = np.where(known, y, p.argmax(axis=1))
        w, pairs = pseudo_likelihood(batch, y, np.where(known, 1.0, 0.3 * p.max(axis=1)))
    return Model(w, pairs, wide_given, wide_family)


def fit_on(corpus: DataFrame, key: Column, text: Column, names: DataFrame, rows: int = SAMPLE_TEXTS, named: DataFrame | None = None) -> Model:
    """Fits weights on a bounded sample of a table; names are learned from all its texts, or all of ``named`` (one text column)."""
    pool = sample(corpus, key, rows).select(text.alias("t")).toPandas()["t"]
    given, family = set(), set()
    for r in names.select("name", "name_kind").collect():
        if r.name:
            (family if (r.name_kind or "").lower() == "family" else given).add(r.name.lower())
    return fit(list(pool), given, family, learn_names_on(corpus.select(text) if named is None else named, given, family))


def label(texts: list[str | None], model: Model, finder: Finder | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, end, type) of the pieces in each text."""
    finder = finder or Finder(model.given, model.family)
    docs = [finder.tokens(t) if t else [] for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(docs):
        return out
    best = Batch(docs).beliefs(model.weights, model.pairs).argmax(axis=1)
    at = 0
    for own, d in zip(out, docs):
        last = None
        for p in d:
            got = int(best[at])
            at += 1
            if got == NONE:
                last = None
            elif last is not None and got == inside(last[1]) and p.stretch == last[0]:
                own[-1] = (own[-1][0], p.end, own[-1][2])
            else:
                own.append((p.start, p.end, int(TYPE_OF[got])))
                last = (p.stretch, int(TYPE_OF[got]))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each piece replaced by its type in square brackets."""
    parts, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            parts += [text[at:s], f"[{TYPES[k].upper()}]"]
            at = e
    return "".join([*parts, text[at:]])


_FOUND = pa.schema([("item", pa.string()), ("item_id", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("pii_type", pa.string())])
_CLEAN = pa.schema([("item", pa.string()), ("item_id", pa.int64()), ("n_pieces", pa.int32()), ("text", pa.string())])


def _mapped(shared, clean: bool):
    schema = _CLEAN if clean else _FOUND

    def run(batches):
        model: Model = shared.value
        finder = Finder(model.given, model.family)
        for batch in batches:
            items, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            spans = label(texts, model, finder)
            if clean:
                rows = [(i, n, len(s), redact(t, s) if s else t) for i, n, t, s in zip(items, ids, texts, spans)]
            else:
                rows = [(i, n, s, e, TYPES[k]) for i, n, own in zip(items, ids, spans) for s, e, k in own]
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def pieces(df: DataFrame, model: Model, item: Column, item_id: Column, text: Column) -> DataFrame:
    """One row per piece: item, item_id, char_start, char_end, pii_type."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS x 11 weights and the lexicon
    slim = df.select(item.cast("string").alias("item"), item_id.cast("bigint").alias("item_id"), text.alias("text")).where("text is not null and text <> ''")
    return slim.mapInArrow(_mapped(shared, False), "item string, item_id bigint, char_start bigint, char_end bigint, pii_type string")


def redacted(df: DataFrame, model: Model, item: Column, item_id: Column, text: Column) -> DataFrame:
    """Every row with its text cleaned: item, item_id, n_pieces, text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select(item.cast("string").alias("item"), item_id.cast("bigint").alias("item_id"), text.alias("text"))
    return slim.mapInArrow(_mapped(shared, True), "item string, item_id bigint, n_pieces int, text string")
