"""Live prose of articles in typesetting markup.

Live prose is what a reader reads as running text in abstract and sections: no preamble, comments,
disabled passages, formulas, tables, figures, headings, references or bibliography.
"""

from __future__ import annotations

import re

#: Environments whose content is no live prose; the hidden ones may hold headings too.
_HIDDEN = "comment verbatim lstlisting"
_DEAD = "equation align gather multline eqnarray displaymath math figure table tabular tabularx tabulary longtable array thebibliography algorithm algorithmic tikzpicture wrapfigure subfigure"
#: Commands whose text arguments show in the prose.
_SHOWN = frozenset("emph textbf textit textsc textsf texttt textrm textup textmd textnormal textsl underline uline mbox hbox text enquote foreignlanguage textcolor item footnote".split())
#: Commands that take a text argument which is no running text.
_HEADS = frozenset("section subsection subsubsection chapter part paragraph subparagraph title author date caption thanks keywords affiliation address email".split())

_COMMENT = re.compile("%[^\n]*")
# a block that is never closed ends before the next heading; so does one without headings of its own
_HEADING = r"\\(?:sub)*section\b|\\chapter\b"
_ENDLESS = rf"(?=(?:{_HEADING})|\Z)"
_BLOCKS = re.compile(
    rf"\\iffalse\b(?:.*?\\fi\b|.*?{_ENDLESS})|\\begin\{{({'|'.join(_HIDDEN.split())})(\*?)\}}(?:.*?\\end\{{\1\2\}}|.*?{_ENDLESS})"
    rf"|\\begin\{{({'|'.join(_DEAD.split())})(\*?)\}}[^\\]*(?:\\(?!(?:sub)*section\b|chapter\b|end\{{\3\4\}})[^\\]*)*(?:\\end\{{\3\4\}})?",
    re.S,
)
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_COMMAND = re.compile(r"\\([a-zA-Z@]+)\*?((?:\[[^\]\n]*\])*)((?:\{[^{}]*\})*)|\\[^a-zA-Z@]")
_STRAY = (("~", " "), ("{", ""), ("}", ""), ("\\", " "), ("\x00", "%"), ("\x01", "$"))
_ARGUMENT = re.compile(r"\{([^{}]*)\}")
_PREAMBLE = re.compile(r"\\(?:documentclass|usepackage|newcommand|begin|section)\b")


def _command(m: re.Match) -> str:
    name = m.group(1)
    if name is None:
        return " "
    if name in ("begin", "end"):
        return "\n\n"
    if name in _SHOWN:
        args = _ARGUMENT.findall(m.group(3))
        return args[-1] if args else " "
    return "\n\n" if name in _HEADS or name == "par" else ""


def live_prose(text: str | None) -> str:
    """The live prose, blocks parted by empty lines; "" for null, blank or markup without prose.

    Without ``\\begin{document}`` the whole text counts as body; an environment or disabled passage
    that never ends takes the rest of its section.
    """
    if not text or text.isspace():
        return ""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "%" in text:
        text = _COMMENT.sub("", text.replace("\\%", "\x00"))
    start = text.find("\\begin{document}")
    if start >= 0:
        end = text.find("\\end{document}", start)
        text = text[start + 16 : end if end >= 0 else len(text)]
    if "\\" in text:
        text = _BLOCKS.sub("\n\n", text)
    if "$" in text or "\\[" in text or "\\(" in text:
        text = _MATH.sub(" ", text.replace("\\$", "\x01"))
    if "\\" in text:
        text = _COMMAND.sub(_command, text)
        # what an argument with braces of its own left behind
        if "\\" in text:
            text = _COMMAND.sub(_command, text)
    for stray, shown in _STRAY:
        text = text.replace(stray, shown)
    return text


_END = re.compile(r"[.!?…।]+[\"'”’»)\]]*\s+(?=[A-ZÀ-ÞĀ-ſΑ-ΩА-Я¿¡\"“«„(])|\n[ \t]*\n")


#: Abbreviations after which a capital or bracket does not begin a sentence.
_ABBREVIATIONS = frozenset("dr mr mrs ms prof st sr sra fig figs eq eqs sec ref refs tab al cf vs no nr abb bzw vgl etc e.g i.e z.b d.h u.a p.ej p.ex".split())
_LAST_WORD = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*\Z")


def sentences(prose: str) -> list[str]:
    """Sentences of prose; a blank line also ends one, a full stop after an abbreviation does not."""
    out, start = [], 0
    for m in _END.finditer(prose):
        if m[0][0] == ".":
            last = _LAST_WORD.search(prose, max(start, m.start() - 12), m.start())
            if last and last[0].lower() in _ABBREVIATIONS:
                continue
        out.append(prose[start : m.start()])
        start = m.end()
    out.append(prose[start:])
    return [s for s in out if s and not s.isspace()]
