"""What LaTeX-like markup says in letters: macros expanded, accents composed, commands and references dropped."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

_HEAD = re.compile(
    r"\\(?:(?P<kind>(?:re)?newcommand|providecommand|DeclareRobustCommand)\*?\s*(?:\{\s*\\(?P<n1>[A-Za-z]+)\s*\}|\\(?P<n2>[A-Za-z]+))\s*(?:\[\d\])?(?:\[[^\]]*\])?"
    r"|[gex]?def\s*\\(?P<n3>[A-Za-z]+)[#\d]*)\s*\{"
)
_BRACE = re.compile(r"\\.|[{}]", re.S)
#: What is normalised as one: a letter with its marks, a syllable of conjoining letters.
_CLUSTER = regex.compile(r"\X")
_PARAMETER = re.compile(r"#+\d")
#: A macro that would stand for more characters than this (macros that double each other) stands for nothing, as it would stop TeX.
LONGEST_MACRO = 1_000_000
# Combining marks of accent commands, and letters that have a command.
ACCENTS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307",
    "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331",
}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "i", "j": "j", "dh": "ð", "th": "þ"}
#: Commands whose arguments are names, not text.
_NAMING = (
    r"(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|label|input|include|includegraphics|bibitem|usepackage|documentclass"
    r"|begin|end|bibliography|bibliographystyle|pagestyle|thispagestyle|vspace|hspace|url|graphicspath)\*?"
)
_COMMAND = re.compile(
    r"\\(?:"
    rf"(?P<names>{_NAMING})(?![A-Za-z])\s*(?:\[[^\]]*\]\s*)*(?:\{{[^{{}}]*\}})*"
    r"|(?P<sign>[\"'`^~=.])\s*(?:\{\s*\\?(?P<l1>[A-Za-z])\s*\}|\\?(?P<l2>[A-Za-z]))"
    r"|(?P<hook>[cvuHkrdb])(?:\s*\{\s*\\?(?P<l3>[A-Za-z])\s*\}|\s+(?P<l4>[A-Za-z]))"
    r"|(?P<word>[A-Za-z]+)\*?(?:\s*\{\})?\s?"
    r"|(?P<other>[^A-Za-z]|$))"
    r"|\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]"
)


def closing_brace(text: str, at: int) -> int:
    """Where the group that the brace at ``at`` opens ends (past its closing brace); -1 if it is not closed."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        sign = m.group()
        if sign == "{":
            depth += 1
        elif sign == "}":
            depth -= 1
            if not depth:
                return m.end()
    return -1


def definitions(text: str) -> list[tuple[int, int, str, str, bool]]:
    """Macro definitions in order: bounds, name, body, and whether it only counts if there is none yet.

    Braces may nest in a body to any depth; a definition whose body is not closed is none.
    """
    if "\\newcommand" not in text and "def\\" not in text and "def \\" not in text and "\\providecommand" not in text and "\\renewcommand" not in text and "\\DeclareRobust" not in text:
        return []
    out, at, dead = [], 0, False
    for m in _HEAD.finditer(text):
        if m.start() < at or dead:
            continue
        stop = closing_brace(text, m.end() - 1)
        if stop < 0:  # nor is any brace after it that it would hold
            dead = True
            continue
        out.append((m.start(), stop, m.group("n1") or m.group("n2") or m.group("n3"), text[m.end() : stop - 1], m.group("kind") == "providecommand"))
        at = stop
    return out


def macros(text: str) -> tuple[str, dict[str, str]]:
    """The text without its definitions, and what each defined command stands for; a later definition replaces one."""
    found: dict[str, str] = {}
    pieces, at = [], 0
    for start, stop, name, body, provided in definitions(text):
        if not provided or name not in found:
            found[name] = _PARAMETER.sub("", body)
        pieces += [text[at:start], " "]
        at = stop
    return ("".join(pieces) + text[at:] if pieces else text), found


class _Sayings:
    """What commands say where they stand: macros of a document resolved to the end, each once.

    A macro that needs itself stands for nothing there.
    """

    def __init__(self, known: dict[str, str]):
        self.known, self.resolved = known, {}

    def _uses(self, body: str) -> list[str]:
        return [m.group("word") for m in _COMMAND.finditer(body) if m.lastgroup == "word" and m.group("word") in self.known] if "\\" in body else []

    def _resolve(self, name: str) -> str:
        """Depth first with a stack of its own, as chains of macros may be longer than Python's."""
        path, opened = [(name, iter(self._uses(self.known[name])))], {name}
        while path:
            top, rest = path[-1]
            following = next((w for w in rest if w not in self.resolved and w not in opened), None)
            if following is not None:
                path.append((following, iter(self._uses(self.known[following]))))
                opened.add(following)
                continue
            said = _COMMAND.sub(self._within, self.known[top]) if "\\" in self.known[top] else self.known[top]
            self.resolved[top] = said if len(said) <= LONGEST_MACRO else ""
            path.pop()
            opened.discard(top)
        return self.resolved[name]

    def _within(self, m: re.Match) -> str:
        return self.resolved.get(m.group("word"), "") if m.lastgroup == "word" and m.group("word") in self.known else self(m)

    def __call__(self, m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "word":
            word = m.group("word")
            if word in self.known:
                return self.resolved[word] if word in self.resolved else self._resolve(word)
            return LETTERS.get(word, "")
        if kind in ("l1", "l2"):
            return m.group(kind) + ACCENTS[m.group("sign")]
        if kind in ("l3", "l4"):
            return m.group(kind) + ACCENTS[m.group("hook")]
        return ""


def readable(text: str) -> str:
    """The text with macros in place and commands, references, citations and numbers in brackets taken out."""
    if "\\" not in text and "[" not in text:
        return text
    text, known = macros(text)
    return _COMMAND.sub(_Sayings(known), text)


def traced_letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of ``letters_only(readable(text))``, and for each the bounds of what it stands for in ``text``.

    Letters of a command's text have the bounds of the command.
    """
    pieces: list[tuple[str, int, int]] = []  # text, bounds; -1 for the second bound: letter by letter

    def plain(start: int, stop: int) -> None:
        at = start
        for m in _COMMAND.finditer(text, start, stop):
            pieces.append((text[at : m.start()], at, -1))
            pieces.append((say(m), m.start(), m.end()))
            at = m.end()
        pieces.append((text[at:stop], at, -1))

    found = definitions(text)
    say = _Sayings(macros(text)[1])
    at = 0
    for start, stop, *_ in found:
        plain(at, start)
        pieces.append((" ", start, stop))
        at = stop
    plain(at, len(text))
    codes, first, last = [], [], []

    def note(cluster: str, start: int, stop: int) -> None:
        letters = ([ord(cluster.lower())] if cluster.isalnum() else []) if len(cluster) == 1 and cluster < "\x80" else letters_only(cluster).tolist()
        codes.extend(letters)
        first.extend([start] * len(letters))
        last.extend([stop] * len(letters))

    held, held_from, held_to = "", 0, 0  # a base letter waits for marks that a command may add to it
    for piece, start, stop in pieces:
        for m in _CLUSTER.finditer(piece):
            a, b = (start + m.start(), start + m.end()) if stop < 0 else (start, stop)
            if held and unicodedata.combining(m.group()[0]):
                held, held_to = held + m.group(), b
                continue
            if held:
                note(held, held_from, held_to)
            held, held_from, held_to = m.group(), a, b
    if held:
        note(held, held_from, held_to)
    return np.array(codes, np.uint32), np.array(first, np.int64), np.array(last, np.int64)


_LETTER = np.array([chr(c).isalnum() for c in range(0x10000)])


def letters_only(text: str) -> np.ndarray:
    """Code points of letters and digits in compatibility form and without case."""
    text = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        keep = _LETTER[np.minimum(codes, 0xFFFF)]
        keep[high] = [chr(c).isalnum() for c in codes[high]]
        return codes[keep]
    return codes[_LETTER[codes]]
