"""A linear-chain tagger of sentence boundaries: weights and transitions learned, tags decoded by Viterbi.

The chain runs over the characters of a paragraph. Characters that no sentence can end at (letters, digits, signs other
than end marks) have one tag, inside, so the chain is decoded over the others, its events: end marks with the quotes and
brackets that close right after them, spaces beside letters of scripts without end marks, and quotes and brackets. A
state holds the last tag and whether the position is outside quotes and brackets, in a group after which the sentence
goes on (no boundary within) or in one that ends with its sentence. The score of a boundary is the sum of the weights of
its features (the mark, the tokens before and after and their shapes, how tokens stand before full stops elsewhere); that
of a transition depends on the tags and the distance. An inside tag scores 0. All weights are learned: none is set by hand.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from itertools import chain as laid
from math import log

import numpy as np

from terravane.llm.prose import BREAK, FORMULA, NOTE, REFERENCE, SKIP, VOID, masked, units

# End marks of scripts, scripts without them (letters and vowel signs), quotes and brackets in pairs.
END_MARKS = ".!?…。！？｡।॥؟۔։።፧᙮᠃᠉။༎༑។៕꓿᱾᱿‼⁇⁈⁉﹒﹗"
UNMARKED = "ก-ฺเ-๎ກ-຺ເ-໎က-ဿក-៓"
_PAIRS = {"``": "''", "“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
_CLOSING = frozenset("''|”|»|›|」|』|)|）|]|】|》".split("|"))
_OPENERS = "“„«(\"`¿¡[‹「『（【《"
_BLANK = " \n\t\r\xa0 " + VOID + SKIP
_SOLE = "぀-ヿ㐀-鿿"
# All begin with one set of characters, which the search then skips to: marks in a run, two of ` or ', or one other sign.
_SIGNS = "\"“”„«»‹›「」『』()（）\\[\\]【】《》}'’"
_EVENT = re.compile(f"[{END_MARKS};`{_SIGNS}](?:(?<=[{END_MARKS};])[{END_MARKS};]*|(?<=`)`|(?<=')'|(?<!`))")
_EVENT_UNMARKED = re.compile(f"[{END_MARKS};]+|``|''|[{_SIGNS}]|(?<=[{UNMARKED}])[ \n]+(?=\\S)|(?<=\\S)[ \n]+(?=[{UNMARKED}])")
_IN_UNMARKED = re.compile(f"[{UNMARKED}]")
_MARKS = frozenset(END_MARKS + ";")
# Letters and the marks that Indic and other scripts set on them.
_L = r"(?:[^\W\d_]++|[̀-֑ͯ-ׇً-ٟऀ-ॣॱ-෿]++)++"
_RUN = r"(?:[^\W\d_]++|[̀-֑ͯ-ׇً-ٟऀ-ॣॱ-෿]++)++"
_TOKEN = re.compile(rf"[{UNMARKED}]{{1,3}}|[{_SOLE}]{{1,2}}|{_L}|\d+|\S")
_NEXT = re.compile(rf"[\s{VOID}{SKIP}{{]*")
#: What follows a mark: blanks, openers, a token.
_AHEAD = re.compile(rf"({_NEXT.pattern}+)(?:([{_OPENERS}])[{_OPENERS}\s{VOID}{SKIP}{{]*+)?({_TOKEN.pattern})?")
_WORDS = re.compile(rf"{_RUN}(?:[.\-]{_RUN})*+\.?")


def _as_set(pattern: str) -> str:
    """A set of the characters below U+10000 that the pattern matches: sets are searched by table."""
    found = re.compile(pattern).findall("".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000))))
    codes = sorted(ord(c) for piece in found for c in piece)
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    stops = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, stops)) + "]"


#: As ``_WORDS``, for texts without characters beyond U+FFFF.
_SET = _as_set(_RUN)
_COMMON_WORDS = re.compile(f"{_SET}++(?:[.\\-]{_SET}++)*+\\.?")
_UNCOMMON = re.compile("[\U00010000-\U0010ffff]")
_TAIL = ")}'\"”»"
_PROSE = re.compile(r"[^\W_]")
_STRIPPED = " \n\t\r" + VOID + SKIP
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_NO = float("-inf")

#: An event: kind (``cand``, ``open``, ``shut``), position (of a cand or shut: past its last character), key of its features:
#: what they are made of, with signs of breaks between, which no unit holds.
Event = tuple[str, int, "str | None"]
#: A unit as it is decoded: where it begins in the text, its length, past its last letter or formula, past all but notes, its events.
Unit = tuple[int, int, int, int, list[Event]]


def _shape(token: str) -> str:
    """Class of a token by its first letter and length."""
    c = token[0]
    if c.isdigit():
        return f"d{min(len(token), 3)}"
    if c.islower():
        return "l1" if len(token) == 1 else "l"
    if c.isupper():
        return "U1" if len(token) == 1 else "U"
    if c == FORMULA:
        return "f"
    if c == REFERENCE:
        return "r"
    if c.isalpha():
        return "x1" if len(token) == 1 else "x"
    if c in ",:;،，、；：؛/":
        return ","
    if c in "–—-":
        return "-"
    return "c" if c in ")]»”’'」』）】》›}" else "?"


def _token_before(unit: str, at: int) -> tuple[int, str]:
    """Where the token that ends before ``at`` begins, and the token: a number, a word (inner dots and hyphens included) or a sign."""
    while at and unit[at - 1] in _BLANK:
        at -= 1
    stop = at
    space = unit.rfind(" ", at - 40 if at > 40 else 0, at) + 1
    whole = 0 < space < at and unit[space:at].isalnum()
    if whole:
        at = space  # a whole word: what the loop would find
    while at and not whole:
        c = unit[at - 1]
        if c.isalnum() or (c > "˿" and unicodedata.category(c)[0] == "M"):
            at -= 1
        elif c in ".,-" and at < stop and unit[at].isalnum() and at > 1 and unit[at - 2].isalnum():
            at -= 1
        else:
            break
    if at == stop:
        return max(at - 1, 0), unit[max(at - 1, 0) : stop]
    token = unit[at:stop]
    if len(token) > 2 and "぀" <= token[-1] <= "鿿":
        token = token[-2:]
    return at, token


def _key(unit: str, start: int, mark: str, end: int, last: int, shut: bool) -> str | None:
    """What the features of a boundary at a mark are made of; None at the end of the unit, where a sentence ends anyway."""
    if end >= last:
        return None
    blank, opener, token = (ahead := _AHEAD.match(unit, end)).groups("")
    follow = ahead.end(1)
    if follow >= last:
        return None
    c = unit[follow]
    token = token or c
    beyond = ""
    if c == REFERENCE:  # what follows a citation right after the mark
        stop = follow
        while stop < last and unit[stop] == REFERENCE:
            stop += 1
        stop = _NEXT.match(unit, stop).end()
        m = _TOKEN.match(unit, stop) if stop < last else None
        beyond = _shape(m.group()) if m else "e"
    spaced = "s" if blank == " " or blank and not _SPACES.isdisjoint(blank) else ""
    begin, word = _token_before(unit, start)
    further = ""
    if len(word) <= 3 or "." in word or word[0].isdigit():
        further = _token_before(unit, begin)[1] if begin else "^"
        if further and further[0].isdigit():
            further = "#"
        elif len(further) > 24:
            further = "&"
    sign = mark if len(mark) == 1 else mark[-1] + "+"
    closers = unit[start + len(mark) : end].translate(_UNBLANK)[-3:] if end > start + len(mark) else ""
    if len(word) > 24:
        word = word[:1] + "&"
    if len(token) > 24:
        token = token[:1] + "&"
    return f"{sign}{BREAK}{closers}{BREAK}{spaced}{BREAK}{'S' if shut else ''}{BREAK}{word}{BREAK}{further}{BREAK}{opener}{BREAK}{token}{BREAK}{beyond}"


_SPACES = frozenset(" \n\t\r\x00")
_UNBLANK = {ord(c): None for c in _BLANK}


def _space_key(unit: str, at: int, end: int) -> str:
    """The features of a space beside letters of a script without end marks: only the letters around it count."""
    return BREAK.join(("space", "", "s", "", unit[max(0, at - 3) : at], "", "", unit[end : end + 3], ""))


def events(unit: str, last: int, upto: int | None = None, marked: bool = False) -> tuple[list[Event], tuple[int, str] | None]:
    """The events of a unit in order, and start and signs of the mark of the last one, if it is a mark that nothing follows.

    Events past ``upto`` may be left out. ``marked``: the unit is known to hold no script without end marks.
    """
    chain: list[Event] = []
    stack: list[str] = []
    pending: tuple[int, str] | None = None
    end, shut = 0, False
    greek: bool | None = None
    pattern = _EVENT_UNMARKED if not marked and _IN_UNMARKED.search(unit) else _EVENT
    for m in pattern.finditer(unit, 0, last):
        piece = m[0]
        at, stop = m.span()
        sign = piece[-1]
        if upto is not None and at > upto and sign != "»":
            break
        is_mark = sign in _MARKS
        if is_mark:
            if sign == ";":
                if greek is None:
                    greek = bool(_GREEK.search(unit))
                if not greek:
                    continue
            elif piece == "." and stop < last and unit[stop].isalnum():
                continue  # within a number, an abbreviation or a name
        elif sign == "»" and pending and at > end and not unit[end:at].strip(" \xa0 \n"):
            end = at  # French quotation marks stand apart
        touching = pending is not None and at == end
        if not is_mark and sign in "}'’" and piece != "''":
            if touching:
                end = stop
            continue
        closes = False
        if not is_mark and stack:
            if _PAIRS[stack[-1]] == piece:
                closes = True
                stack.pop()
            elif piece in _CLOSING and any(_PAIRS[s] == piece for s in stack):
                closes = True
                while _PAIRS[stack.pop()] != piece:
                    pass
        if closes and touching:
            end, shut = stop, shut or not stack
            continue
        if not closes and touching and piece in _CLOSING:
            end = stop
            continue
        if pending is not None:
            chain.append(("shut" if shut else "cand", end, _key(unit, pending[0], pending[1], end, last, shut)))
            pending = None
        if is_mark:
            pending, end, shut = (at, piece), stop, False
        elif closes:
            if not stack:
                chain.append(("shut", stop, None if stop >= last else ""))
        elif piece in _PAIRS:
            if not stack:
                chain.append(("open", at, None))
            stack.append(piece)
        elif sign in " \n":
            chain.append(("cand", at, _space_key(unit, at, stop)))
    if pending is not None:
        chain.append(("shut" if shut else "cand", end, _key(unit, pending[0], pending[1], end, last, shut)))
    return chain, pending


_GAPS = "0000111222222333333333333"


def _gap(n: int) -> str:
    """Class of the distance between two boundaries or candidates."""
    return "4" if n > 24 else _GAPS[n] if n > 0 else "0"


#: Weights of the transitions after a distance: inside to inside, inside to boundary, boundary to inside, boundary to boundary.
Turns = dict[str, tuple[float, float, float, float]]


class Lexicon:
    """How tokens stand in the texts, counted without any labels: before full stops, and before those at ends of paragraphs.

    An occurrence says nothing about itself: ``ends`` leaves out one that does not end a paragraph, ``sure`` one that does.
    """

    def __init__(self, dotted: dict[str, int] | None = None, ends: dict[str, int] | None = None, sure: dict[str, int] | None = None):
        self.dotted, self.ends, self.sure = dotted or {}, ends or {}, sure or {}

    @staticmethod
    def count(paragraphs: Iterable[str], words: Counter, closing: Counter) -> None:
        """Counts words, a full stop right after them included, and those with one that end a paragraph."""
        for unit in paragraphs:
            found = (_WORDS if _UNCOMMON.search(unit) else _COMMON_WORDS).findall(unit)
            words.update(found)
            if found and found[-1][-1] == "." and unit.rstrip(_TAIL).endswith(found[-1]):
                closing[found[-1]] += 1

    @staticmethod
    def of(dotted: Iterable[tuple[str, int, int, int]], totals: tuple[int, int, int]) -> Lexicon:
        """From every token seen before a full stop: how often before one, before none, before one that ends a paragraph.

        ``totals`` are these counts of all tokens.
        """

        def odds(yes: int, no: int, a: int, b: int) -> int:
            """Whole log-odds, within 3."""
            return max(-3, min(3, round(log((yes + 0.2) / (a + 1)) - log((no + 0.2) / (b + 1)))))

        dots, bare, closing = totals
        out = Lexicon()
        for token, d, n, c in dotted:  # tokens seen often enough
            if d + n >= 3:
                out.dotted[token] = odds(d, n, dots, bare)
            if d > 3:
                out.ends[token] = odds(c, max(d - c - 1, 0), closing, max(dots - closing - 1, 0))
                out.sure[token] = odds(max(c - 1, 0), d - max(c, 1), max(closing - 1, 0), dots - closing)
        return out


def features(key: str, lexicon: Lexicon, sure: bool = False, paired: bool = True) -> list[str]:
    """Names of the features of a boundary; ``sure`` if it is one that the lexicon counted as the end of a paragraph.

    Without ``paired`` those of two tokens are left out.
    """
    sign, closers, spaced, shut, word, further, opener, token, beyond = key.split(BREAK)
    if sign == "space":
        sides = ("T" if _IN_UNMARKED.match(word[-1:]) else _shape(word[-1:] or " ")) + ("T" if _IN_UNMARKED.match(token) else _shape(token or " "))
        return ["bs", f"s{sides}", f"sb{word}", f"sa{token}"]
    after, before = (opener and "o") + _shape(token) + beyond, _shape(word)
    lower = word.lower()
    ends = lexicon.sure if sure and sign == "." else lexicon.ends
    place = f"{sign}{spaced or 't'}{shut}{'c' if closers else ''}"
    if not paired:
        out = [
            f"b{sign}", f"m{place}", f"a{place}|{after}", f"p{sign}{before}", f"P{sign}{before}|{after}", f"w{sign}{lower}",
            f"n{token}", f"d{sign}{lexicon.dotted.get(word, 9)}", f"D{sign}{ends.get(word, 9)}|{after}",
        ]
        if token[0] > "⿿":
            out.append(f"n{token[0]}")
        if further:
            out.append(f"f{further.lower()}|{before}")
        if closers:
            out.append(f"c{closers}|{after}")
        return out
    out = [
        f"b{sign}", f"m{place}", f"a{place}|{after}", f"p{sign}{before}", f"P{sign}{before}|{after}", f"w{sign}{lower}", f"W{sign}{lower}|{after}",
        f"n{token}", f"N{place}{token}", f"d{sign}{lexicon.dotted.get(word, 9)}", f"D{sign}{ends.get(word, 9)}|{after}",
    ]
    if token[0] > "⿿":
        out += [f"n{token[0]}", f"N{place}{token[0]}"]
    if further:
        out += [f"f{further.lower()}|{before}", f"F{further.lower()}|{lower}"]
    if closers:
        out += [f"c{closers}|{after}", f"C{closers}{token}"]
    return out


class Model:
    """Weights of features and transitions, and the decoder."""

    #: Scores kept for keys that come again; cleared when full.
    MEMO = 200_000

    def __init__(self, weights: dict[str, float] | None = None, lexicon: Lexicon | None = None):
        self.weights, self.lexicon = weights or {}, lexicon or Lexicon()
        self._memo: dict[str, float] = {}
        w = self.weights.get
        self.turns: Turns = {g: tuple(w(f"t{a}{b}{g}", 0.0) for a in (0, 1) for b in (0, 1)) for g in "01234"}
        self._sway = sway(self.turns)

    def score(self, key: str | None) -> float:
        """Log-odds of a boundary; certain at the unit's end, ruled out where a group closes without end mark."""
        if key is None:
            return 1e6
        if not key:
            return _NO
        found = self._memo.get(key)
        if found is None:
            w = self.weights
            found = sum([w[f] for f in features(key, self.lexicon) if f in w])
            if len(self._memo) >= self.MEMO:
                self._memo.clear()
            self._memo[key] = found
        return found

    def tags(self, chain: list[Event]) -> list[int]:
        """The best tags (1: boundary) of the chain's events."""
        memo = self._memo.get
        scores = []
        for kind, _, key in chain:
            found = memo(key) if key else None
            scores.append(0.0 if kind == "open" else self.score(key) if found is None else found)
        return decoded(chain, scores, self.turns, self._sway, groups(chain))

    def cuts(self, unit: Unit) -> list[int]:
        """Ends of the unit's sentences, relative to it."""
        _, last, prose, solid, chain = unit
        found = [event[1] for event, tag in zip(chain, self.tags(chain)) if tag] if chain else []
        if not found or found[-1] < last:
            at = found[-1] if found else 0
            if at < prose:
                found.append(last)
            elif found and at >= solid:
                found[-1] = last
        return found

    def ends(self, unit: str) -> list[int]:
        """Ends of the unit's sentences, relative to it. A unit without letters or digits holds none."""
        last = len(unit.rstrip(_STRIPPED))
        return self.cuts(_unit(unit, last, 0, events(unit, last)[0])) if last and _PROSE.search(unit) else []


def _unit(unit: str, last: int, begin: int, chain: list[Event]) -> Unit:
    """What is decoded of a unit that begins at ``begin`` and is blank from ``last`` on."""
    prose = last
    while prose and not (unit[prose - 1].isalnum() or unit[prose - 1] == FORMULA):
        prose -= 1
    return begin, last, prose, len(unit[:last].rstrip(_STRIPPED + NOTE)), chain


def sway(turns: Turns) -> float:
    """What transitions can add at most to the score of a tag, whatever the tags beside it: beyond it a score decides by itself."""
    into = max(abs(t[2 * a + 1] - t[2 * a]) for t in turns.values() for a in (0, 1))
    out = max(abs(t[2 + b] - t[b]) for t in turns.values() for b in (0, 1))
    return into + out + 1e-6


def groups(chain: list[Event]) -> list[tuple[int, int]]:
    """Where groups open and shut in a chain; -1 for one that is not shut."""
    found, opened = [], -1
    for k, event in enumerate(chain):
        if event[0] != "cand":
            if event[0] == "open":
                if opened >= 0:
                    found.append((opened, -2))  # opened twice
                opened = k
            elif opened >= 0:
                found.append((opened, k))
                opened = -1
            else:
                found.append((k, -2))  # shut alone
    if opened >= 0:
        found.append((opened, -1))
    return found


def decoded(chain: list[Event], scores: list[float], turns: Turns, most: float, grouped: list[tuple[int, int]]) -> list[int]:
    """The tags that ``viterbi`` finds, the sooner the more of the scores decide by themselves (are beyond ``most``).

    Only runs of events between those are decoded. Nothing is a boundary in a group that does not end its sentence for
    certain; one that surely does, or that is never shut, rules nothing out. Chains with other groups are left to ``viterbi``.
    """
    tags = [1 if s > most else 0 if s < -most else 2 for s in scores]
    for opened, shut in grouped:
        if shut == -1 or shut >= 0 and tags[shut] == 1:
            tags[opened] = 3
        elif shut >= 0 and (scores[shut] == _NO or tags[shut] == 0 and not any(tags[opened + 1 : shut])):
            tags[opened : shut + 1] = [3] + [0] * (shut - opened)
        else:
            return viterbi(chain, scores, turns)
    size, k = len(tags), 0
    while 2 in tags:
        k = first = tags.index(2, k)
        last, at_last = 0, -1000
        while first:
            first -= 1
            if tags[first] != 3:
                last, at_last = tags[first], chain[first][1]
                break
        best, back, run = (_NO, 0.0) if last else (0.0, _NO), [], []
        while k < size and tags[k] > 1:
            if tags[k] == 2:
                at, score = chain[k][1], scores[k]
                t00, t01, t10, t11 = turns[_gap(at - at_last)]
                at_last = at
                n0, m0, n1, m1 = best[0] + t00, best[1] + t10, best[0] + score + t01, best[1] + score + t11
                back.append((m0 > n0, m1 > n1))
                best = (m0 if m0 > n0 else n0), (m1 if m1 > n1 else n1)
                run.append(k)
            k += 1
        if k < size:
            turn, following = turns[_gap(chain[k][1] - at_last)], tags[k]
            best = best[0] + turn[following], best[1] + turn[2 + following]
        state = int(best[1] > best[0])
        for j, came in zip(reversed(run), reversed(back)):
            tags[j] = state
            state = int(came[state])
    return [t & 1 if t < 3 else 0 for t in tags] if grouped else tags


def viterbi(chain: list[Event], scores: list[float], turns: Turns, fixed: dict[int, int] | None = None) -> list[int]:
    """Best tags. States are 2 * mode + last tag; mode 0 outside, 1 in a group after which the sentence goes on, 2 in one
    that ends with it. A boundary in mode 1 is ruled out; a group left open at the unit's end rules nothing out."""
    best = [0.0, _NO, _NO, _NO, _NO, _NO]
    back: list[list[int] | tuple[int, int]] = []  # where each state came from: 8 * state before + tag
    at_last, grouped = -1000, False
    for k, ((kind, at, _), score) in enumerate(zip(chain, scores)):
        if kind == "open":
            new, step = [_NO] * 6, [0] * 6
            for t in (0, 1):
                for mode in (1, 2):  # from outside, or from a group whose outer end is missing
                    source = t if best[t] > _NO else 2 * mode + t
                    new[2 * mode + t], step[2 * mode + t] = best[source], 8 * source
            best, grouped = new, True
            back.append(step)
            continue
        turn = turns[_gap(at - at_last)]
        at_last = at
        must = fixed.get(k) if fixed else None
        if not grouped:  # two states
            b0, b1 = best[0], best[1]
            n0 = n1 = _NO
            from0, from1 = 0, 1
            if must != 1:
                n0, other = b0 + turn[0], b1 + turn[2]
                if other > n0:
                    n0, from0 = other, 8
            if must != 0:
                n1, other = b0 + score + turn[1], b1 + score + turn[3]
                if other > n1:
                    n1, from1 = other, 9
            if n0 == n1 == _NO:  # fixed tags that the chain does not allow
                n0, n1, from0, from1 = b0, b1, 0, 8
            best = [n0, n1, _NO, _NO, _NO, _NO]
            back.append((from0, from1))
            continue
        new, step = [_NO] * 6, [0] * 6
        for state in range(6):
            value = best[state]
            if value == _NO:
                continue
            mode, t = state >> 1, state & 1
            if must != 1 or (mode == 1 and kind == "cand"):
                to = 0 if kind == "shut" else 2 * mode
                stays = value + turn[2 * t]
                if kind == "shut" and mode == 2:
                    stays = _NO  # leaving a group that ends with its sentence is a boundary
                if stays > new[to]:
                    new[to], step[to] = stays, 8 * state
            if mode != 1 and must != 0:
                to = 1 if kind == "shut" else 2 * mode + 1
                cuts = value + score + turn[2 * t + 1]
                if cuts > new[to]:
                    new[to], step[to] = cuts, 8 * state + 1
        if max(new) == _NO:  # fixed tags that the chain does not allow
            new, step = list(best), [8 * s for s in range(6)]
        best, grouped = new, max(new[2:]) > _NO
        back.append(step)
    state = max((0, 1, 4, 5, 2, 3), key=lambda s: best[s])
    out = [0] * len(chain)
    for k in range(len(chain) - 1, -1, -1):
        came = back[k][state]
        out[k] = came & 1
        state = came >> 3
    return out


def _joined(first: str, second: str) -> tuple[str, int]:
    """Two paragraphs as one text, and where the first ends in it: with a space, but none beside scripts without spaces.

    In scripts without end marks any marks at the first one's end are stripped, so that only the letters remain.
    """
    if _IN_UNMARKED.match(second):
        bare = first.rstrip(END_MARKS + _STRIPPED)
        if _IN_UNMARKED.match(bare[-1:]):
            first = bare
    return first + ("" if _dense(first, second) else " ") + second, len(first)


def _dense(first: str, second: str) -> bool:
    """Whether paragraphs are joined without a space."""
    return second[:1] > "\x7f" and bool(re.search("[\u2fff-\uffef][”’]?$", first[-2:]))


def _continued(first: str, chain: list[Event], pending: tuple[int, str] | None, second: str, marked: bool) -> tuple[list[Event], int]:
    """The chain of a paragraph continued by the next one, from its chain alone, and the place of the known boundary (-1: none).

    What comes next shows in the last event only, but in rare cases, in which the joined text is read.
    """
    both, joint = _joined(first, second)
    own = None
    if not (
        (not marked and _IN_UNMARKED.search(both))
        or (";" in first and _GREEK.search(second) and not _GREEK.search(first))
        or first[-1] in _OPENERS + "{"
        or first[-1].isspace()
        or second.lstrip()[:1] == "»"
        or (_dense(first, second) and not (second[0].isalnum() and pending and chain[-1][1] == joint))
        or [True for kind, _, key in chain[:-1] if (key is None or key[-1:] == "e") and kind != "open"]
    ):
        own = chain
        kind, at, key = chain[-1] if chain else ("open", 0, None)
        if kind != "open" and (key is None or key[-1:] == "e"):
            if pending:
                own = [*chain[:-1], (kind, at, _key(both, *pending, at, len(both), kind == "shut"))]
            else:
                own = [*chain[:-1], (kind, at, "")] if kind == "shut" and at == joint else None
    if own is None:
        own = [e for e in events(both, len(both), joint)[0] if e[1] <= joint]
    if own and own[-1][1] == joint and own[-1][2]:
        return own, len(own) - 1
    return own, next((k for k in range(len(own) - 1, -1, -1) if own[k][0] != "open" and own[k][1] == joint and own[k][2]), -1)


def read(text: str) -> tuple[list[Unit], list[tuple[list[Event], int]], list[str]]:
    """The units of a text as they are decoded, chains to learn from (each paragraph continued by the next) with the place
    of the known boundary in each (-1: none), and the paragraphs.

    That the sentences of one paragraph end before the next begins is all that is known about boundaries.
    """
    body, start = masked(text)
    marked = not _IN_UNMARKED.search(body)
    found, alone, parts = [], [], []
    for a, b in units(body):
        whole = body[a:b]
        if not _PROSE.search(whole):
            continue
        part = whole.lstrip(_STRIPPED)
        begin = b - len(part)
        part = part.rstrip(_STRIPPED)
        chain, pending = events(part, len(part), marked=marked)
        parts.append(part)
        alone.append((chain, pending))
        if len(part) < len(whole) and ((not marked and _IN_UNMARKED.search(part)) or (begin > a and any("^" in key for _, _, key in chain if key))):  # blanks before or after show in the keys
            last = begin - a + len(part)
            found.append(_unit(whole, last, start + a, events(whole, last)[0]))
        else:
            found.append(_unit(part, len(part), start + begin, chain))
    return found, [_continued(first, *own, second, marked) for first, own, second in zip(parts, alone, parts[1:])], parts


def examples(texts: Iterable[str]) -> tuple[list[list[Event]], list[int], Lexicon]:
    """Chains and known boundaries of all texts, and the lexicon of their paragraphs."""
    chains, known = [], []
    words, closing = Counter(), Counter()
    for text in texts:
        _, own, paragraphs = read(text)
        chains += [chain for chain, _ in own]
        known += [at for _, at in own]
        Lexicon.count(paragraphs, words, closing)
    dotted = [(w[:-1], n, words[w[:-1]], closing[w]) for w, n in words.items() if w[-1] == "."]
    dots = sum(n for _, n, _, _ in dotted)
    return chains, known, Lexicon.of(dotted, (dots, words.total() - dots, closing.total()))


class _Rows:
    """Distinct events as rows of feature numbers, laid end to end."""

    def __init__(self, rows: list[list[int]], size: int):
        self.lengths = lengths = np.array([len(r) for r in rows])
        self.flat, self.size = np.fromiter(laid.from_iterable(rows), np.int64, int(lengths.sum())), size
        self.start = np.cumsum(lengths) - lengths

    @cached_property
    def columns(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rows from the longest on, and their features by column: sums run over rows side by side."""
        order = np.argsort(-self.lengths, kind="stable")
        start, lengths = self.start[order], self.lengths[order]
        return order, [self.flat[start[: np.count_nonzero(lengths > k)] + k] for k in range(int(lengths[0]))]

    @cached_property
    def by_feature(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of every feature laid end to end, the features, where the rows of each start, and room for values."""
        order = np.argsort(self.flat, kind="stable")
        rows = np.repeat(np.arange(len(self.lengths)), self.lengths)[order]
        return rows, *np.unique(self.flat[order], return_index=True), np.empty(len(rows))

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Sums of the rows' weights."""
        order, columns = self.columns
        added = w.take(columns[0])
        for column in columns[1:]:
            added[: len(column)] += w.take(column)
        out = np.empty_like(added)
        out[order] = added
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of the rows' values by feature."""
        out = np.zeros(self.size)
        rows, present, start, room = self.by_feature
        out[present] = np.add.reduceat(x.take(rows, out=room, mode="clip"), start)
        return out

    def regression(self, yes: np.ndarray, no: np.ndarray, ridge: float, rounds: int = 120) -> np.ndarray:
        """Weights of a logistic regression of rows seen ``yes`` and ``no`` times: full-batch gradients, adaptive steps."""
        w, first, second = (np.zeros(self.size) for _ in range(3))
        for k in range(1, rounds + 1):
            p = 1.0 / (1.0 + np.exp(-np.clip(self.scores(w), -30, 30)))
            gradient = self.sums(yes * (1.0 - p) - no * p) - ridge * w
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            w += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
        return w


def _told_apart(rows: _Rows, known: np.ndarray, other: np.ndarray, share: float = 40.0, ridge: float = 1.0) -> np.ndarray:
    """Weights of features whose sum is the log-odds that an event is one of the known boundaries and not one of the others.

    ``known`` and ``other`` count by fold how often each distinct event is of either kind; known ones weigh ``share``
    times as much in all, so where both kinds are alike the score is well above 0, and it is below where the others hold
    what known boundaries do not show. The weights are the mean over regressions that each leave one fold out, so few of
    them know an event that is rare.
    """
    out = np.zeros(rows.size)
    for fold in range(known.shape[1]):
        yes, no = (counts.sum(axis=1) - counts[:, fold] for counts in (known, other))
        out += rows.regression(yes * (share * no.sum() / max(yes.sum(), 1.0)), no, ridge)
    return out / known.shape[1]


#: Features of two tokens, too rare to label by.
_PAIRED = "NWFC"
#: How far the perceptron moves the weights of features, and those of transitions, which are few and move often.
STEP, TURN_STEP = 0.3, 0.05
#: Features that name tokens.
_TOKENS = "wnfNWFC"
#: Folds of a shard, each left out of one regression.
FOLDS = 3

#: Learned weights by the name of the feature, each with how often the feature was seen.
Learned = dict[str, tuple[float, int]]


class _Places(dict):
    """The row of a key in a shard, made when first asked for; -1 where there are no features."""

    def __init__(self, sure: bool, lexicon: Lexicon, names: dict[str, int], rows: list[list[int]], paired: bool):
        super().__init__({None: -1, "": -1})
        self.sure, self.lexicon, self.names, self.rows, self.paired = sure, lexicon, names, rows, paired

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self.rows)
        number, names = self.names.setdefault, self.names
        self.rows.append([number(f, len(names)) for f in features(key, self.lexicon, self.sure, self.paired)])
        return place


class Shard:
    """Chains that are learned from together, their distinct events as rows of feature numbers.

    First known boundaries (ends of paragraphs, continued by the next) are told apart from other events by a logistic
    regression, which labels all events (``labeller``). Then weights, started from a regression on these labels, and
    transitions are learned by an averaged structured perceptron (``fitted``): every chain is decoded with its labels and
    without, and features move by what differs. Labels inside a group that does not end with its sentence give way to the
    chain. What shards learned is mixed between the two steps and after them: the mean by feature, weighted by how often
    each shard saw it.
    """

    def __init__(self, lexicon: Lexicon, paired: bool = True):
        """Without ``paired`` features of two tokens are left out, which only ``labeller`` does without."""
        self.names: dict[str, int] = {}
        self.rows: list[list[int]] = []
        self.places = tuple(_Places(sure, lexicon, self.names, self.rows, paired) for sure in (False, True))  # of other events and of known boundaries
        self.chains: list[list[Event]] = []
        self.at: list[list[int]] = []  # by chain, the rows of its events, or -1
        self.known: list[int] = []

    def add(self, chains: Iterable[tuple[list[Event], int]]) -> None:
        """Chains, each with the place of the known boundary in it."""
        others, ends = self.places
        for chain, sure in chains:
            self.chains.append(chain)
            self.known.append(sure)
            if sure < 0:
                self.at.append([others[key] for _, _, key in chain])
            else:
                self.at.append([others[key] for _, _, key in chain[:sure]] + [ends[chain[sure][2]]] + [others[key] for _, _, key in chain[sure + 1 :]])

    def _learned(self, rows: _Rows, weights: np.ndarray, tally: np.ndarray) -> Learned:
        seen = rows.sums(tally).astype(int).tolist()
        return {f: (w, n) for f, w, n in zip(self.names, weights.tolist(), seen) if n}

    def labeller(self) -> Learned:
        """What tells known boundaries apart; empty if none is known."""
        size, at, yes = len(self.rows), [], []
        for c, (places, sure) in enumerate(zip(self.at, self.known)):
            fold = c % FOLDS
            at += [place * FOLDS + fold for place in places if place >= 0]
            if sure >= 0:  # a row of its own: no other event has it
                yes.append(places[sure] * FOLDS + fold)
        if not yes:
            return {}
        both, known = (np.bincount(np.array(found, dtype=np.int64), minlength=size * FOLDS).astype(float).reshape(size, FOLDS) for found in (at, yes))
        single = [f[0] not in _PAIRED for f in self.names]
        plain = _Rows(self.rows if all(single) else [[i for i in row if single[i]] for row in self.rows], len(self.names))
        return self._learned(plain, _told_apart(plain, known, both - known), both.sum(axis=1))

    def _labels(self, labeller: dict[str, float], rows: _Rows) -> list[dict[int, int]]:
        """Tags by event of each chain."""
        said = (rows.scores(np.array([labeller.get(f, 0.0) for f in self.names])) > 0).tolist()
        labels = []
        for chain, places, sure in zip(self.chains, self.at, self.known):
            tags = {k: int(k == sure or said[place]) for k, place in enumerate(places) if place >= 0}
            opened = None
            for k, (kind, _, _) in enumerate(chain):  # what lies in a group whose end is inside is inside
                if kind == "open":
                    opened = k
                elif kind == "shut" and opened is not None:
                    if not tags.get(k):
                        tags.update({j: 0 for j in range(opened, k) if j in tags})
                    opened = None
            labels.append(tags)
        return labels

    def fitted(self, labeller: dict[str, float], rounds: int = 3) -> Learned:
        """Weights of features and transitions learned from the labels."""
        if not self.rows:
            return {}
        rows = _Rows(self.rows, len(self.names))
        labels = self._labels(labeller, rows)
        at = [tag * len(self.rows) + places[k] for places, tags in zip(self.at, labels) for k, tag in tags.items()]
        tagged = np.bincount(np.array(at, dtype=np.int64), minlength=2 * len(self.rows)).astype(float).reshape(2, -1)
        weights = self._perceptron(labels, rows.regression(tagged[1], tagged[0], 0.3).tolist(), rounds)
        out = self._learned(rows, np.array(weights[: rows.size]), tagged.sum(axis=0))
        return out | {f: (w, len(at)) for f, w in zip(_TURNED, weights[rows.size :])}

    def _perceptron(self, labels: list[dict[int, int]], first: list[float], rounds: int) -> list[float]:
        """Mean weights of the features, then of the transitions, over all visits."""
        size = len(first)
        turns = {(a, b, g): size + i for i, (a, b, g) in enumerate((a, b, g) for a in (0, 1) for b in (0, 1) for g in "01234")}
        weights, sums = first + [0.0] * len(turns), [0.0] * (size + len(turns))
        same = np.array(weights)  # for sums over many rows
        step = 1

        def move(i: int, by: float) -> None:
            weights[i] += by
            sums[i] += step * by
            same[i] = weights[i]

        def walked(chain: list[Event], tags: list[int]) -> Counter:
            found: Counter = Counter()
            last, at_last = 0, -1000
            for (kind, at, _), tag in zip(chain, tags):
                if kind != "open":
                    found[turns[last, tag, _gap(at - at_last)]] += 1
                    last, at_last = tag, at
            return found

        # In half of the visits an event hides its tokens, so that shapes and marks are learned for tokens never seen.
        hidden = {i for f, i in self.names.items() if f[0] in _TOKENS}
        by_hidden = (self.rows, [[i for i in ids if i not in hidden] for ids in self.rows])
        grouped = [groups(chain) for chain in self.chains]
        visits = _Visits(self, labels, grouped, _Rows(by_hidden[0] + by_hidden[1], size))
        order = np.random.default_rng(1)
        for _ in range(rounds):
            visits.draw(order)
            now: Turns = {}
            v = done = 0
            while v < len(self.chains):
                if not now:
                    now = {g: tuple(weights[turns[a, b, g]] for a in (0, 1) for b in (0, 1)) for g in "01234"}
                    most, limits, added = sway(now), _limits(now), _added(now)
                doubted, stop = visits.doubted(v, same, limits, added)
                for v in doubted:
                    c, hides = visits.visit(v)
                    chain = self.chains[c]
                    step, done = step + int(visits.before[v] - done), int(visits.before[v])
                    used = [by_hidden[hide][place] if place >= 0 else [] for place, hide in zip(self.at[c], hides)]
                    scores = [sum([weights[i] for i in ids]) if ids else _NO for ids in used]
                    got = decoded(chain, scores, now, most, grouped[c])
                    if all([got[k] == tag for k, tag in labels[c].items()]):
                        continue
                    want = viterbi(chain, scores, now, labels[c])
                    for ids, a, b in zip(used, want, got):
                        if a != b:
                            for i in ids:
                                move(i, STEP if a else -STEP)
                    gold, guess = walked(chain, want), walked(chain, got)
                    for i in {*gold, *guess}:
                        if gold[i] != guess[i]:
                            move(i, TURN_STEP * (gold[i] - guess[i]))
                    now, stop = {}, v + 1
                    break
                v = stop
            step += int(visits.before[-1] - done)
        return [w - s / step for w, s in zip(weights, sums)]


def _limits(turns: Turns) -> np.ndarray:
    """As ``sway``, by the classes of the distances before and after (5: nothing comes after), six to a row."""
    into = [max(abs(t[2 * a + 1] - t[2 * a]) for a in (0, 1)) for t in (turns[g] for g in "01234")]
    out = [max(abs(t[2 + b] - t[b]) for b in (0, 1)) for t in (turns[g] for g in "01234")] + [0.0]
    return np.add.outer(into, out).ravel() + 1e-6


def _added(turns: Turns) -> np.ndarray:
    """What transitions add to the score of a boundary, by the classes of distances as in ``_limits`` and the tags before and after."""
    out = [[t[2 + b] - t[b] for b in (0, 1)] for t in (turns[g] for g in "01234")] + [[0.0, 0.0]]
    return np.array([turns[g][2 * a + 1] - turns[g][2 * a] + after[b] for g in "01234" for after in out for a in (0, 1) for b in (0, 1)])


def _ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as counted, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(start - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Visits:
    """Visits of a shard's chains in random order: those are found together whose labels the weights surely reproduce.

    They do where the score of every labelled event is beyond what transitions can add, or a group rules it out; or else
    beyond what they do add, if both events beside it are sure.
    """

    #: Visits that are looked at together.
    BLOCK = 96

    def __init__(self, shard: Shard, labels: list[dict[int, int]], grouped: list[list[tuple[int, int]]], rows: _Rows):
        self.rows, self.distinct = rows, len(rows.start) // 2
        self.lengths = np.array([len(chain) for chain in shard.chains], dtype=np.int64)
        total = int(self.lengths.sum())
        begin = np.cumsum(self.lengths) - self.lengths
        events = [event for chain in shard.chains for event in chain]
        label = np.full(total, -1)
        label[[at + k for at, tags in zip(begin.tolist(), labels) for k in tags]] = [tag for tags in labels for tag in tags.values()]
        hard, ruled = np.zeros(total, bool), np.zeros(total, bool)
        for at, size, own, found in zip(begin.tolist(), self.lengths.tolist(), shard.at, grouped):
            for opened, shut in found:
                if shut == -2:
                    hard[at : at + size] = True
                elif shut >= 0 and own[shut] < 0:
                    ruled[at + opened : at + shut + 1] = True
        tagged = np.array([k for k, event in enumerate(events) if event[0] != "open"], dtype=np.int64)
        of = np.repeat(np.arange(len(begin)), self.lengths)[tagged]
        first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
        final = np.concatenate([first[1:], [True]])[: len(of)]
        gaps = np.diff(np.array([events[k][1] for k in tagged.tolist()], dtype=np.int64), prepend=0)
        gaps = np.where(first, 4, np.array([int(_gap(n)) for n in range(26)])[np.clip(gaps, 0, 25)])
        tag = np.maximum(label[tagged], 0)
        code = 6 * gaps + np.where(final, 5, np.roll(gaps, -1))
        beside = 4 * code + 2 * np.where(first, 0, np.roll(tag, 1)) + np.where(final, 0, np.roll(tag, -1))
        known = label[tagged] >= 0
        at = tagged[known]
        self.code, self.beside, self.position = code[known], beside[known], at - begin[of[known]]
        self.places = np.fromiter(laid.from_iterable(shard.at), np.int64, total)[at]
        self.sign = np.where(hard[at], 0, 2 * label[at] - 1)
        self.ruled = ruled[at] & ~hard[at] & (label[at] == 0)
        self.counts = np.array([len(tags) for tags in labels], dtype=np.int64)
        self.start = np.cumsum(self.counts) - self.counts

    def draw(self, order: np.random.Generator) -> None:
        """The next round: an order of the chains, and which events hide their tokens."""
        self.chain = order.permutation(len(self.lengths))
        lengths, counts = self.lengths[self.chain], self.counts[self.chain]
        self.hides = order.random(int(lengths.sum())) < 0.5
        self.drawn = np.cumsum(lengths) - lengths
        self.before = np.concatenate([[0], np.cumsum(lengths > 0)])  # visits of chains with events before each
        self.event = _ranges(self.start[self.chain], counts)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.of = np.repeat(np.arange(len(counts)), counts)
        row = self.places[self.event] + self.distinct * self.hides[np.repeat(self.drawn, counts) + self.position[self.event]]
        sizes = self.rows.lengths[row]
        self.flat = self.rows.flat[_ranges(self.rows.start[row], sizes)]
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def visit(self, v: int) -> tuple[int, list[bool]]:
        """The chain of a visit, and which of its events hide their tokens."""
        c = int(self.chain[v])
        return c, self.hides[self.drawn[v] : self.drawn[v] + self.lengths[c]].tolist()

    def doubted(self, v: int, weights: np.ndarray, limits: np.ndarray, added: np.ndarray) -> tuple[list[int], int]:
        """Of the visits from ``v`` on those that are to be decoded, and where the looked at ones end."""
        stop = min(v + self.BLOCK, len(self.chain))
        a, b = self.bounds[v], self.bounds[stop]
        if a == b:
            return [], stop
        first = self.first[a : b + 1]
        scores = np.add.reduceat(weights[self.flat[first[0] : first[-1]]], first[:-1] - first[0])
        event = self.event[a:b]
        sign, of = self.sign[event], self.of[a:b]
        sure = (scores * sign > limits[self.code[event]]) | self.ruled[event]
        other = np.flatnonzero(~sure)
        if len(other):
            # An event beside it that has no label is ruled out; the first and last of a visit have one neighbour.
            padded = np.concatenate([[True], sure, [True]])
            visit = np.concatenate([[-1], of, [-1]])
            alone = (padded[other] | (visit[other] != of[other])) & (padded[other + 2] | (visit[other + 2] != of[other]))
            decided = alone & ((scores[other] + added[self.beside[event[other]]]) * sign[other] > 1e-6)
            other = other[~decided]
        return np.unique(of[other]).tolist(), stop


_TURNED = [f"t{a}{b}{g}" for a in (0, 1) for b in (0, 1) for g in "01234"]


def kept(weights: dict[str, float]) -> dict[str, float]:
    """Weights as a model holds them: rounded, without those of next to nothing."""
    return {name: round(w, 4) for name, w in weights.items() if abs(w) > 1e-3}


def learn(texts: Iterable[str], rounds: int = 3) -> Model:
    """A model learned from texts alone, as one shard: no labels, no word lists."""
    chains, known, lexicon = examples(texts)
    shard = Shard(lexicon)
    shard.add(zip(chains, known))
    labeller = shard.labeller()
    if not labeller:
        return Model({}, lexicon)
    return Model(kept({f: w for f, (w, _) in shard.fitted({f: w for f, (w, _) in labeller.items()}, rounds).items()}), lexicon)
