"""Pages to blocks: the text between two neighbouring tags that are not inline."""

from __future__ import annotations

import html as _html
import re

# --- fixed values: elements ------------------------------------------------------------------------
INLINE = "a|b|i|em|strong|span|code|small|sub|sup|br"
VOID = {"meta", "link", "img", "hr", "input", "wbr", "area", "base", "col", "embed", "source", "track"}
#: Elements whose text is a listing.
LISTING = {"pre", "samp", "kbd"}
# --- end of fixed values --------------------------------------------------------------------------

_CLOSES_P = {"p", "li", "td", "tr", "div", "h1", "h2", "h3", "h4", "ul", "ol", "table", "section", "aside", "blockquote", "pre", "footer", "nav", "main", "article", "form"}
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)(?:</noscript\s*>|$)", re.S | re.I)
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(head|script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*$")
_A_OPEN = re.compile(r"<a(?:\s[^>]*)?>", re.I)
_A_CLOSE = re.compile(r"</a\s*>", re.I)
_BR = re.compile(r"</?br\b[^>]*>", re.I)
_OTHER_INLINE = re.compile(rf"</?(?:{INLINE})(?:\s[^>]*)?/?>", re.I)
_SPLIT = re.compile(r"(<[a-zA-Z/!?][^>]*>)")
_LINK_MARK = re.compile("([\x01\x02])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
_OPEN, _CLOSE = "\x01", "\x02"
_MARKS = re.compile("[\x01\x02]")


class Block:
    """One block: its text, element chain, linked characters, and its text without what is linked."""

    __slots__ = ("chain", "linked", "plain", "text")

    def __init__(self, text: str, chain: tuple, linked: int, plain: str) -> None:
        self.text, self.chain, self.linked, self.plain = text, chain, linked, plain


def visible_blocks(page: str) -> list[Block]:
    """Blocks of a page; a chain is ``((element id, tag, attributes), ...)`` from the outermost element."""
    page = page.replace(_OPEN, "").replace(_CLOSE, "")
    page = _DROP.sub(lambda m: "<hr>" if m.group(1) else "", page)
    page = _CUT.sub("", page)
    page = _A_CLOSE.sub(_CLOSE, _A_OPEN.sub(_OPEN, page))
    page = _OTHER_INLINE.sub("", _BR.sub(" ", page))
    out: list[Block] = []
    stack: list[tuple[int, str, str]] = []
    chain: tuple | None = ()
    linked = False
    for k, piece in enumerate(_SPLIT.split(page)):
        if k & 1:
            m = _NAME.search(piece)
            if not m or piece[1] in "!?":
                continue
            name = m.group().lower()
            if piece[1] == "/":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][1] == name:
                        del stack[i:]
                        chain = None
                        break
            elif name not in VOID:
                if stack:
                    last = stack[-1][1]
                    if (last == "p" and name in _CLOSES_P) or (last == name and name in ("li", "td", "tr")):
                        stack.pop()
                stack.append((k, name, piece[m.end() : -1]))
                chain = None
        elif piece and not piece.isspace():
            t = _html.unescape(piece) if "&" in piece else piece
            n_linked, plain = 0, None
            if linked or _OPEN in t or _CLOSE in t:
                kept = []
                for j, run in enumerate(_LINK_MARK.split(t)):
                    if j & 1:
                        linked = run == _OPEN
                    elif linked:
                        n_linked += len(run.strip())
                        kept.append(" @ ")
                    else:
                        kept.append(run)
                plain = " ".join("".join(kept).split())
                t = _MARKS.sub("", t)
            t = " ".join(t.split())
            if t:
                if chain is None:
                    chain = tuple(stack)
                out.append(Block(t, chain, n_linked, t if plain is None else plain))
    return out


def noscript_text(page: str) -> list[str]:
    """Texts inside noscript elements."""
    return [t for m in _NOSCRIPT.finditer(page) if (t := " ".join(re.sub(r"<[^>]*>", " ", _html.unescape(m.group(1))).split()))]
