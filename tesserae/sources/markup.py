"""Text of HTML, by a scan over tags; of RTF, by a scan over groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "(c)", "mdash": "—", "ndash": "–", "hellip": "…"} | dict.fromkeys(("rsquo", "lsquo"), "'") | dict.fromkeys(("ldquo", "rdquo"), '"')
_HIDDEN = frozenset("script style head noscript".split())
_BREAKS = frozenset("p div br li tr section article header footer pre blockquote".split()) | {f"h{k}" for k in range(1, 7)}
_PART = re.compile(r"<(/?)([A-Za-z0-9]*)[^>]*>|&([^;]{0,7});|(<)", re.S)


def html_text(html: str | None) -> str | None:
    """Visible text: a tag ends at the next '>', what an unclosed '<' begins is dropped; hidden elements end only at their
    own closing tag; block tags part lines, others words; carriage returns go, and three line ends or more become two."""
    if html is None:
        return None
    out: list[str] = []
    last, hidden, at = "", "", 0

    def put(s: str) -> None:
        nonlocal last
        if s:
            out.append(s)
            last = s[-1]

    for m in _PART.finditer(html):
        if not hidden:
            put(html[at : m.start()].replace("\r", ""))
        at = m.end()
        if m[4]:
            at = len(html)
            break
        if m[3] is not None:
            if hidden:
                continue
            if m[3] in _NAMED or m[3].startswith("#"):
                put(_NAMED.get(m[3], " "))
            else:
                put("&")  # no entity: what follows the sign is text and may hold tags
                at = m.start() + 1
            continue
        name = m[2].lower()
        if hidden:
            hidden = "" if m[1] and name == hidden else hidden
        elif name in _HIDDEN and not m[1]:
            hidden = name
        elif name in _BREAKS:
            put("\n" if last not in ("", "\n") else "")
        else:
            put(" " if last not in ("", " ", "\n") else "")
    if not hidden:
        put(html[at:].replace("\r", ""))
    return re.sub("\n{3,}", "\n\n", "".join(out))


def html_to_text(html: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(html_text, na_action="ignore"), "string")(html)


_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_ASIDE = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr themedata datastore listtable generator".split())
_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "page": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"', "bullet": "•"}


def rtf_text(raw: bytes) -> str:
    """Text of the groups that are shown; bytes in Windows-1252, \\u numbers with their substitutes passed over."""
    out, stack, shown, skip, over = [], [], True, 1, 0
    starred = False
    for m in _RTF.finditer(raw):
        word, number, byte, sign, brace, plain = m.groups()
        if brace == b"{":
            stack.append((shown, skip))
        elif brace == b"}":
            shown, skip = stack.pop() if stack else (True, 1)
        elif sign == b"*":
            starred = True
            continue
        elif word:
            w = word.decode()
            if starred or w in _ASIDE:
                shown = False
            elif w == "uc":
                skip = int(number or 1)
            elif w == "u" and shown:
                out.append(chr(int(number or 63) % 65536))
                over = skip
            elif w in _SIGNS and shown:
                out.append(_SIGNS[w])
        elif byte:
            if over:
                over -= 1
            elif shown:
                out.append(bytes.fromhex(byte.decode()).decode("cp1252", "replace"))
        elif sign and shown:
            out.append({b"~": " ", b"_": "-"}.get(sign, sign.decode("latin-1")))
        elif plain:
            text = plain.decode("cp1252", "replace")
            text, over = text[over:], max(0, over - len(text))
            if shown:
                out.append(text)
        starred = False
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
