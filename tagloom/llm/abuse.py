"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick after folding.

A hit weighs by its concept: slur, threat, contempt for a group, sexual talk,
demeaning phrase, insult, mild word.  Patterns combine persons or groups with
weaker words; one is tried only on texts in which the automaton of its anchors,
strings of which every match holds at least one, has found something.

Folding undoes what hides a word: letter case, accents, full-width and
mathematical alphabets, zero-width characters, look-alike letters of other
scripts, digits for letters, letters set apart by a sign, repeated letters, and
letters replaced by a sign each: such a word is read as every lexicon word that
it fits with two letters or more, or with its first of four if it is an oath.  Matches inside an exception phrase, or
shortly after a phrase that only names a word (rules, reports, lists of removed
posts) and in its sentence, do not count, unless they are said to somebody.  The weights that remain are summed and divided by a slowly
growing function of the length, so a long text needs more mild words than a
short one, while one strong match suffices in a text of any length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import re._parser as re_parser
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import abuse_lexicon as L
from tagloom.llm._common import fresh

#: Weight from which a hit counts as strong.
STRONG = 5.0
#: Score from which a document counts as abusive.
THRESHOLD = 1.0

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_DROP = regex.compile(r"[\p{Mn}\p{Cf}\p{Me}]+")
_APART = regex.compile(r"(?<![\p{L}\p{N}])(\p{L}|[0-9])([ ._\-·•|~+])(?:(?:\p{L}|[0-9*@#$])\2)*(?:\p{L}|[0-9*@#$])(?![\p{L}\p{N}])")
_MIXED = re.compile(r"[a-zß-ɏ0-9$€£]*(?:[a-zß-ɏ][0-9$€£]|[0-9$€£][a-zß-ɏ])[a-zß-ɏ0-9$€£*@#]*")
_SIGNS = regex.compile(r"(?<![\p{L}\p{N}*@#%])(?=[*@#%]*\p{Latin})(?=\p{Latin}*[*@#%])[\p{Latin}*@#%]+(?![\p{L}\p{N}])")
_MASK = regex.compile(r"(?<=\p{L})[*@#%]|[*@#%](?=\p{L})")
_REPEAT = re.compile(r"([^\W\d_])\1+")
#: What must stand in a text for a step of the folding to matter.
_MAY_BE_APART = re.compile(r"(?<![^\W_])[^\W_][ ._\-·•|~+][^\W_](?:[ ._\-·•|~+])[^\W_*@#$]|(?<![^\W_])[^\W_]([ ._\-·•|~+])[*@#$]\1")
_LEET_SIGN = re.compile(r"[a-zß-ɏ][0-9$€£]|[0-9$€£][a-zß-ɏ]")
_MASK_SIGN = re.compile(r"[*@#%]")
#: A full stop between letters may only hide a word, and one after a single letter shortens it.
_SENTENCE = regex.compile(r"[!?;。｡\n\r\u2028\u2029]+|(?<!(?<![\p{L}\p{N}])\p{L})\.+(?=[\s\p{P}]|$)|(?<=\p{Han})\.+(?=\s|$)")
_SENTENCE_PLAIN = re.compile(r"[!?;\n\r]+|(?<!(?<![a-z0-9])[a-z])\.+(?=[\s!-/:-@\[-`{-~]|$)")
_OTHER_PLAIN = re.compile(r"[^a-z0-9*]+")
_OTHER = regex.compile(rf"[^\p{{L}}\p{{N}}*]+")
_CJK_GAP = regex.compile(rf"(?<=[{_CJK}])[ *]+(?=[{_CJK}])")
_BORDER = regex.compile(rf"(?<=[{_CJK}])(?=[^{_CJK} ])|(?<=[^{_CJK} ])(?=[{_CJK}])")
_IS_CJK = regex.compile(rf"[{_CJK}]")
#: What stands right before an insult that is said to somebody, and before a cue that then announces one.
_ADDRESSED = regex.compile(r" (?:you|u|ya|du|ihr|tu|eres|sois|usted|youre|(?:you|u|they|he|she) (?:are|re|r|is)|du bist|ihr seid)(?: (?:all|just|such|nothing but|a|an|so|really|ein|eine|echt|un|una|tan|muy|total|fucking|bloody|stupid|dumb|little|old|absolute|complete|total|dummer|dumme|verdammter))* $|(?:你|您|妳)们?(?:们|全是|都是|就是|真是|是|真)?(?:这个|这种|这些|这群|个|这|一个|群)? ?$")
_TOLD = regex.compile(r" (?:te|os|dich|euch)(?: \p{L}+){0,2} $")
_GLYPHS = str.maketrans(L.HOMOGLYPHS)
_LEET = str.maketrans(L.LEET)


def _plain(word: str) -> str:
    return _DROP.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", word).casefold()))


_KNOWN: set[str] = set()
_BY_LENGTH: dict[int, list[str]] = {}
#: Letters that known words beside unknown ones must have together, where letters are set apart.
LEAST_APART = 5


def _known() -> set[str]:
    """Words that letters set apart or behind signs may spell: those of the lexicon, and words that join them."""
    if not _KNOWN:
        phrases = itertools.chain.from_iterable(map(_alternatives, L.PHRASES))
        _KNOWN.update(_plain(w) for p in (*L.INSULTS, *L.EXPLICIT, *L.MILD, *phrases, *L.JOINING) for w in p.split() if not _IS_CJK.search(w))
        patterns = regex.sub(r"\\p\{\p{L}+\}", " ", " ".join((*itertools.chain.from_iterable(L.PATTERNS.values()), *L.SETS.values())))
        _KNOWN.update(w for w in regex.findall(r"\p{Latin}{2,}", patterns))
        _KNOWN.update("aiouey")
    return _KNOWN


def _words_of(letters: str) -> list[str]:
    """The letters as lexicon words and what lies between them, with as few letters between and then as few words as can be."""
    known, n = _known(), len(letters)
    # state: position, letters of the known words before it (0: an unknown letter); value: cost, state before
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(n + 1)]
    whole = LEAST_APART + 1  # nothing but known words from the beginning on
    best[0][whole] = (0, 0, 0)

    def reach(j: int, k: int, cost: int, i: int, before: int) -> None:
        if k not in best[j] or cost < best[j][k][0]:
            best[j][k] = (cost, i, before)

    for i in range(n):
        for k, (cost, _, _) in list(best[i].items()):
            if k in (0, LEAST_APART) or i == 0:
                reach(i + 1, 0, cost + 1000, i, k)
            for j in range(i + 1, min(i + 24, n) + 1):
                if letters[i:j] in known:
                    reach(j, whole if k == whole else min(k + j - i, LEAST_APART), cost + 1, i, k)
                    if k == whole and j >= LEAST_APART:
                        reach(j, LEAST_APART, cost + 1, i, k)
    ends = {k: v[0] for k, v in best[n].items() if k in (0, LEAST_APART, whole)}
    out, j, k, last = [], n, min(ends, key=ends.get), False
    while j:
        _, i, before = best[j][k]
        if k == 0 and last:
            out[-1] = letters[i:j] + out[-1]
        else:
            out.append(letters[i:j])
        last = k == 0
        j, k = i, before
    return out[::-1]


def _join_apart(m: regex.Match) -> str:
    s = m.group().replace(m.group(2), "")
    # three letters at least, or it is an initial or a size
    if len(s) < 3 or s.isdigit():
        return m.group()
    if any(c in "*@#%" for c in s):
        return f" {s} "
    return f" {' '.join(_words_of(s.translate(_LEET) if not s.isalpha() else s))} "


@functools.lru_cache(100_000)
def _behind(token: str) -> tuple[str, ...]:
    """Lexicon words that a token with signs for letters may stand for; each sign is one letter."""
    if not _BY_LENGTH:
        for w in sorted(_known()):
            _BY_LENGTH.setdefault(len(w), []).append(w)
    if token[0] == "@":
        token = "a" + token[1:]
    token = token.lstrip("#%")
    if token[:1] == "*" and token[-1:] == "*":  # markup around a word
        token = token.strip("*")
    seen = sum(c.isalpha() for c in token)
    if seen == len(token):
        return (token,)
    if not seen or not (token[0].isalpha() or token[-1].isalpha()):
        return ()
    if seen == 1 and not (len(token) == 4 and token[0].isalpha()):
        return ()
    like = regex.compile("".join(c if c.isalpha() else r"\p{L}" for c in token))
    found = [w for w in _BY_LENGTH.get(len(token), ()) if like.fullmatch(w) and (seen > 1 or w in L.INSULTS or w in L.EXPLICIT or w in L.MASKED)]
    if not found and (short := _REPEAT.sub(r"\1", token)) != token:
        return _behind(short)
    return tuple(found)


class Folded(NamedTuple):
    text: str
    #: Where a sentence ends in the text.
    ends: list[int]
    #: Readings of the word behind signs that has the most.
    choices: int


def _fold(text: str, choice: int = 0) -> Folded:
    plain = text.isascii()
    if plain:
        t = text.lower()
    else:
        t = unicodedata.normalize("NFKC", text).casefold()
        t = _DROP.sub("", unicodedata.normalize("NFD", t))
        t = unicodedata.normalize("NFC", t).translate(_GLYPHS)
    # each step runs only where its signs are
    if _MAY_BE_APART.search(t):
        t = _APART.sub(_join_apart, t)
    if _LEET_SIGN.search(t):
        t = _MIXED.sub(lambda m: m.group().translate(_LEET), t)
    choices = 1
    if _MASK_SIGN.search(t):

        def unmask(m: regex.Match) -> str:
            nonlocal choices
            words = _behind(m.group())
            choices = max(choices, len(words))
            return words[choice % len(words)] if words else m.group()

        t = _MASK.sub("*", _SIGNS.sub(unmask, t))
    t = _REPEAT.sub(r"\1", t)
    out, n, ends = [], 1, []
    for part in _SENTENCE_PLAIN.split(t) if plain else _SENTENCE.split(t):
        if plain:
            part = " ".join(_OTHER_PLAIN.sub(" ", part).split())
        else:
            part = _CJK_GAP.sub("", _OTHER.sub(" ", part))
            part = " ".join(_BORDER.sub(" ", part).split())
        if not part:
            continue
        if out:
            ends.append(n - 1)
            if not plain and _IS_CJK.match(out[-1][-2]) and _IS_CJK.match(part):
                out[-1] = out[-1][:-1]
                n -= 1
        out.append(f"{part} ")
        n += len(part) + 1
    return Folded(" " + "".join(out), ends, choices)


def fold(text: str) -> str:
    """The folded form: lower-case Latin words between single spaces; runs of CJK characters without any."""
    return _fold(text).text


def folds(text: str) -> Iterator[Folded]:
    """The folded forms: one, or as many as a word behind signs may be lexicon words."""
    first = _fold(text)
    yield first
    for choice in range(1, first.choices):
        yield _fold(text, choice)


def _alternatives(phrase: str) -> list[str]:
    parts = regex.split(r"\{([^}]*)\}", phrase)
    return ["".join(x) for x in itertools.product(*[p.split("|") if i % 2 else [p] for i, p in enumerate(parts)])]


def _cjk_forms(word: str) -> Iterator[str]:
    """The word, and with one character written as pinyin or a look-alike."""
    yield word
    for i, c in enumerate(word):
        for v in L.CJK_VARIANTS.get(c, ()):
            yield word[:i] + v + word[i + 1 :]


def _pattern(p: str) -> str:
    for _ in range(2):
        p = regex.sub(r"\{([a-z\u7fa4]+)\}", lambda m: L.SETS[m[1]], p)
    # folded text has no doubled letters, and spaces at the ends may belong to two matches
    p = p.replace("~", r"(?:\p{L}+ ){0,2}")
    p = regex.sub(r"(?<![\\\p{L}{])(\p{Latin}+)|\\p\{\p{L}+\}", lambda m: _REPEAT.sub(r"\1", m[1]) if m[1] else m[0], p)
    p = regex.sub("^_", r"(?<=\\s)", p).replace("_", r"(?=\s)")
    return p.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{Han}", "[\u4e00-\u9fff]")


def _exact(seq) -> list[set[str] | None]:
    """A parsed pattern as pieces in a row: the strings that a piece may be, or None if that is open."""
    out: list[set[str] | None] = []
    for op, arg in seq:
        name = str(op)
        if name == "LITERAL":
            piece: list[set[str] | None] = [{chr(arg)}]
        elif name == "SUBPATTERN":
            piece = _exact(arg[3])
        elif name == "BRANCH":
            ways = [_joined(_exact(x)) for x in arg[1]]
            piece = [set().union(*[w[0] for w in ways])] if all(len(w) == 1 and w[0] is not None for w in ways) else [None]
        elif name == "MAX_REPEAT" and arg[1] == 1:
            inner = _joined(_exact(arg[2]))
            piece = [inner[0] | {""}] if len(inner) == 1 and inner[0] is not None else [None]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            piece = []
        else:
            piece = [None]
        out += piece
    return out


def _joined(pieces: list[set[str] | None], most: int = 3000) -> list[set[str] | None]:
    """Neighbouring pieces made one as long as that has few strings."""
    out: list[set[str] | None] = []
    for p in pieces:
        if p is not None and out and out[-1] is not None and len(out[-1]) * len(p) <= most:
            out[-1] = {a + b for a in out[-1] for b in p}
        else:
            out.append(p)
    return out or [{""}]


def anchors(pattern: str) -> set[str]:
    """Strings of which every match of the pattern holds at least one, as telling ones as can be; none if there are no such."""
    common = set(L.JOINING) | set("i you u ya will am going want wants your me her him them are is should must and have has had be been do dont not".split())

    def worth(strings: set[str]) -> tuple[int, int]:
        letters = min(sum(len(w) * (4 if _IS_CJK.match(w) else 1) for w in x.split() if w not in common) for x in strings)
        return (min(letters, 8), -len(strings))

    # every split of a run of pieces is a choice as well, so that a common beginning need not stand for all
    parsed = _exact(re_parser.parse(pattern))
    choices = [p for p in (*parsed, *_joined(parsed)) if p is not None and "" not in p]
    best = max(choices, key=worth, default=set())
    return {x for x in best} if best and worth(best)[0] > 0 else set()


class Lexicon:
    """Compiled automata; one per Python worker."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        self.safe = ahocorasick.Automaton()
        self.cues = ahocorasick.Automaton()
        weights: dict[str, float] = {}

        def add(form: str, weight: float) -> None:
            weights[form] = max(weights.get(form, 0.0), weight)

        w = L.WEIGHTS
        by_weight = [(w["mild"], L.MILD), (w["insult"], L.INSULTS), (w["slur"], L.SLURS), (w["sexual"], L.EXPLICIT), (w["phrase"], itertools.chain.from_iterable(map(_alternatives, L.PHRASES)))]
        for w, phrases in by_weight:
            for p in phrases:
                if _IS_CJK.search(p):
                    for form in _cjk_forms(p):
                        f = fold(form)
                        # runs of CJK have no borders; a Latin part at an end has one
                        f = (f if not _IS_CJK.match(f.strip()[0]) else f.lstrip()) if f.strip() else f
                        add(f.rstrip() if _IS_CJK.match(f.strip()[-1]) else f, w)
                else:
                    add(fold(p), w)
        self.patterns = [(L.WEIGHTS[c], re.compile(_pattern(p))) for c, ps in L.PATTERNS.items() for p in ps]
        self.anchors = ahocorasick.Automaton()
        held: dict[str, set[int]] = {}
        for i, (_, p) in enumerate(self.patterns):
            for x in anchors(p.pattern) or {""}:
                held.setdefault(x, set()).add(i)
        self.always = held.pop("", set())
        for x, ids in held.items():
            self.anchors.add_word(x, ids)
        for form, w in weights.items():
            self.words.add_word(form, (len(form), w))
        for p in L.HARMLESS:
            f = fold(p)
            f = f.strip() if _IS_CJK.search(p) else f
            self.safe.add_word(f, len(f))
        for p, n in L.NAMED_AFTER:
            f = fold(p)
            self.cues.add_word(f, (len(f), n, True))
        for p, n in L.NAMED_BEFORE:
            f = fold(p)
            self.cues.add_word(f, (len(f), -n, True))
        for p, n in L.NAMED_AFTER_CJK:
            f = fold(p).strip()
            self.cues.add_word(f, (len(f), n, False))
        for a in (self.words, self.safe, self.cues, self.anchors):
            a.make_automaton()

    def _excepted(self, t: str, ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Spans of harmless phrases, and spans in which words are only named, which end with the sentence of their cue."""
        safe = [(e - n + 1, e + 1) for e, n in self.safe.iter(t)]
        named = []
        for e, (n, reach, by_word) in self.cues.iter(t):
            end, first = e + 1, e - n + 1
            at = bisect.bisect_left(ends, e)
            if reach < 0:
                start = first + 1
                for _ in range(-reach):
                    start = max(t.rfind(" ", 0, max(start - 1, 0)), 0)
                before = bisect.bisect_right(ends, first) - 1
                named.append((max(start, ends[before] if before >= 0 else 0), end))
                continue
            if _TOLD.search(t, max(0, first - 24), first + 1):
                continue
            if by_word:
                for _ in range(reach):
                    nxt = t.find(" ", end)
                    end = nxt + 1 if nxt >= 0 else len(t)
            else:
                end += reach
            named.append((first, min(end, ends[at] + (t[ends[at]] == " ")) if at < len(ends) else end))
        return safe, named

    def weigh(self, text: str | None) -> tuple[float, float, int]:
        """(sum of weights, score, strong matches) of a text; zeros for NULL and for empty text."""
        if not text:
            return 0.0, 0.0, 0
        return max(map(self._weigh, folds(text)), key=lambda x: x[1])

    def _weigh(self, f: Folded) -> tuple[float, float, int]:
        t = f.text
        safe, named = self._excepted(t, f.ends)
        within = lambda a, b, spans: any(x <= a + 1 and b - (t[b - 1] == " ") <= y for x, y in spans)
        total, strong = 0.0, 0
        found = [(e - n + 1, e + 1, w) for e, (n, w) in self.words.iter(t)]
        # weaker words count together within a sentence only: a border is a line break, put in where no space is
        marked, put, last = [], [], 0
        for x in f.ends:
            marked += [t[last:x], "\n"]
            last = x + (t[x] == " ")
            if t[x] != " ":
                put.append(x + len(put))
        whole = "".join([*marked, t[last:]])
        may = self.always.union(*[ids for _, ids in self.anchors.iter(whole)])
        for i in sorted(may):
            weight, p = self.patterns[i]
            for m in p.finditer(whole):
                a, b = m.start() - bisect.bisect_left(put, m.start()), m.end() - bisect.bisect_left(put, m.end())
                found.append((a - (t[a - 1] == " "), b + (t[b : b + 1] == " "), weight))
        for a, b, w in found:
            if within(a, b, safe) or within(a, b, named) and not _ADDRESSED.search(t, max(0, a - 40), a + (t[a] == " ")):
                continue
            if w >= STRONG:
                strong += 1
            total += w
        words = len(t) / 6
        return total, total / (1 + math.log10(1 + words / 50)), strong


_READY: list[Lexicon] = []


def lexicon() -> Lexicon:
    if not _READY:
        _READY.append(Lexicon())
    return _READY[0]


def score_documents(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns, ``weight``, ``score``, ``n_strong`` and ``abusive`` of every document.

    NULL, empty and blank texts score 0.  Whole texts are scored, whatever their
    length; rows stay where they are (no shuffle).
    """
    src = df.select(*keep, F.col(text).cast("string").alias(fresh(df, "_value")))
    k = len(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + (", " if keep else "") + "weight double, score double, n_strong int, abusive boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon()
        for batch in batches:
            got = [lex.weigh(x) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[1] >= THRESHOLD for g in got], pa.bool_())],
                [*keep, "weight", "score", "n_strong", "abusive"],
            )

    return src.mapInArrow(run, schema)


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, abusive documents and their rate per source; a NULL source is a source of its own."""
    return scored.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"))
