"""The prose of LaTeX-like documents: everything else masked, lengths kept, and its paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from terravane.llm.markup import closing_brace, definitions

# Masks keep the length of the text: nothing, a break, transparent markup, a formula, a reference, a footnote.
VOID, BREAK, SKIP, FORMULA, REFERENCE, NOTE = "\x00", "\x01", "\x02", "\ue000", "\ue001", "\ue002"
_OPTION = r"(?:\s*\[[^\]]*\])?"
# Environments without prose, environments that are formulas, commands that head or stand alone.
_NO_PROSE = "figure|table|tabular|tabularx|longtable|thebibliography|wrapfigure|tikzpicture|picture|verbatim|lstlisting|algorithm|algorithmic|comment|filecontents|titlepage"
_MATHS = "equation|align|eqnarray|gather|multline|displaymath|math|flalign|alignat|subequations"
_HEADS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title|author|date|affiliation|address|email|keywords|thanks|caption|subtitle"
_ALONE = (
    "maketitle|tableofcontents|listoffigures|listoftables|input|include|documentclass|usepackage|bibliography|bibliographystyle|includegraphics"
    "|newpage|clearpage|appendix|centering|newtheorem|theoremstyle|pagestyle|thispagestyle|setlength|setcounter|vspace|bigskip|medskip|smallskip|hline|graphicspath"
)
# A look-behind stands after the sign it looks behind, and commands share one backslash: the search then skips to them.
_COMMENT = re.compile(r"%(?<!\\%)[^\n]*")
_UNREAD = re.compile(r"(?<!\\)%[^\n]*|\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)", re.S)
_BLOCKS = re.compile(rf"\\begin\{{({_NO_PROSE})(\*?)\}}.*?(?:\\end\{{\1\2\}}|\Z)", re.S)
_DISPLAY = re.compile(rf"\\(?:begin\{{({_MATHS})(\*?)\}}.*?(?:\\end\{{\1\2\}}|\Z)|\[.*?(?:\\\]|\Z)|\((?:[^\n]|\n(?![ \t]*\n))*?\\\))", re.S)
_DOLLARS = re.compile(r"\$(?<!\\\$)(?:\$.*?(?:\$\$|\Z)|(?:[^$\\\n]|\\.|\n(?![ \t]*\n))+\$)", re.S)
# A footnote and a heading end with the brace that closes their argument, however deep braces nest in it.
_COMMANDS = re.compile(
    r"\\(?:"
    rf"(?P<note>footnote{_OPTION}\{{)"
    rf"|(?P<ref>(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|footnotemark|url)\*?{_OPTION}{_OPTION}(?:\s*\{{[^{{}}]*\}})?|[lc]?dots(?![A-Za-z])(?:\{{\}})?)"
    r"|(?P<label>label\{[^{}]*\})"
    rf"|(?P<head>(?:{_HEADS})\*?{_OPTION}\s*\{{)"
    rf"|(?P<alone>(?:{_ALONE})(?![A-Za-z])\*?(?:\s*\[[^\]]*\]|\{{[^{{}}]*\}})*)"
    rf"|(?P<env>(?:begin|end)\{{[^{{}}]*\}}(?:\[[^\]]*\])?(?:\{{[^{{}}\n]*\}})*|item(?![A-Za-z])(?:\[[^\]]*\])?)"
    r"|(?P<letter>[\"'`^~=.]\s*(?:\{\\?[A-Za-z]\}|\\?[A-Za-z])|[cvuHkrdb]\{\\?[A-Za-z]\}|(?:ss|ae|AE|oe|OE|o|O|l|L|aa|AA)(?![A-Za-z])(?:\{\})?)"
    r"|(?P<word>[A-Za-z]+(?:\*|\{\})?|[^A-Za-z]))"
)
_FILL = {"note": NOTE, "ref": REFERENCE, "label": VOID, "head": BREAK, "alone": BREAK, "env": BREAK}
_LABEL = re.compile(r"\s*\\label\{[^{}]*\}")
_PARTS = re.compile(r"\x01\x01*|\n[ \t\r]*\n[ \t\r\n]*")


def _fill(m: re.Match) -> str:
    """What takes the place of a command other than a footnote or heading, as long as it."""
    kind, size = m.lastgroup, m.end() - m.start()
    if kind == "letter":
        return next(c for c in reversed(m.group()) if c.isalpha()) * size
    if kind != "word":
        return _FILL[kind] * size
    piece = m.group()
    if piece.endswith("{}"):
        return REFERENCE * size
    return " " * size if piece in ("\\\\", "\\ ", "\\,") else SKIP * size


def _masked_commands(body: str) -> str:
    out, at = [], 0
    for m in _COMMANDS.finditer(body):
        if m.start() < at:  # within the argument of a heading or footnote
            continue
        kind, stop = m.lastgroup, m.end()
        out.append(body[at : m.start()])
        if kind in ("note", "head"):
            stop = closing_brace(body, m.end() - 1)
            if stop < 0:  # never closed: markup alone
                out.append(SKIP * (m.end() - m.start()))
                at = m.end()
                continue
            label = _LABEL.match(body, stop) if kind == "head" else None
            stop = label.end() if label else stop
            out.append(_FILL[kind] * (stop - m.start()))
        else:
            out.append(_fill(m))
        at = stop
    out.append(body[at:])
    return "".join(out)


def masked(text: str) -> tuple[str, int]:
    """The body with all that is not prose masked, and where the body begins; lengths are those of the text."""
    at = text.find("\\begin{document}")
    begin = at + len("\\begin{document}") if at >= 0 else 0
    stop = text.find("\\end{document}", begin)
    body = text[begin : stop if stop >= 0 else len(text)]
    if "\\" not in body and "%" not in body and "$" not in body:
        return body.replace("~", " "), begin
    cover = lambda sign: lambda m: sign * len(m.group())
    if "%" in body or "\\iffalse" in body:
        body = (_UNREAD if "\\iffalse" in body else _COMMENT).sub(cover(VOID), body)
    body = _BLOCKS.sub(cover(BREAK), body)
    body = _DISPLAY.sub(cover(FORMULA), body)
    if "$" in body:
        body = _DOLLARS.sub(cover(FORMULA), body)
    pieces, at = [], 0
    for start, stop, _, _, _ in definitions(body):
        pieces += [body[at:start], BREAK * (stop - start)]
        at = stop
    body = "".join(pieces) + body[at:]
    return _masked_commands(body).replace("~", " "), begin


def units(body: str) -> Iterator[tuple[int, int]]:
    """Bounds of paragraphs, list items and the like that hold prose."""
    begin = 0
    for m in _PARTS.finditer(body):
        if m.start() > begin:
            yield begin, m.start()
        begin = m.end()
    if begin < len(body):
        yield begin, len(body)
