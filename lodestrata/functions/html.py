"""Readable text from HTML, with paragraphs, line breaks and bullets.

The markup is read as a flow of tags and text. Text gathers in the current line; block tags ask
for a blank line before whatever follows, list items start a bullet line, indented by the depth of
their list. Scripts, styles and frames are skipped with all they hold.
"""

from __future__ import annotations

import html
import re

#: Tags that end a paragraph, that are skipped with their content, and that make lists.
BLOCKS = frozenset("p div section article header footer blockquote pre h1 h2 h3 h4 h5 h6 ul ol table tr hr".split())
SKIPPED = frozenset("script style iframe noscript svg".split())
LISTS = frozenset(("ul", "ol"))
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_RAW = {t: re.compile(rf"</{t}[\s>/]", re.I) for t in ("script", "style")}
_BLANKS = re.compile(r"[ \t\r\f\v]+")


class _Page:
    def __init__(self):
        self.lines: list[tuple[str, str]] = []  # (indent and bullet, text)
        self.mark, self.text, self.gap = "", [], False

    def add(self, text: str) -> None:
        first, *more = text.split("\n")
        self.text.append(first)
        for line in more:
            self.end()
            self.text.append(line)

    def end(self) -> None:
        """Close the current line. An empty one is a blank line, an empty bullet nothing."""
        text = _BLANKS.sub(" ", "".join(self.text)).strip()
        if text.startswith("- ") and not self.mark:
            self.mark, text = "- ", text[2:].strip()
        if text in ("", "-") and self.mark or text == "-":
            pass
        elif text:
            if self.gap and self.lines and not (self.mark and self.lines[-1][0]):
                self.lines.append(("", ""))
            self.gap = False
            self.lines.append((self.mark, text))
        else:
            self.gap = True
        self.mark, self.text = "", []

    def block(self) -> None:
        self.end()
        self.gap = True

    def waits(self) -> bool:
        """Whether a bullet still waits for its text."""
        return bool(self.mark) and not "".join(self.text).strip()


def html_to_text(raw: str | None, escaped: bool = True) -> str:
    """Plain text of HTML. ``escaped``: the markup itself is entity-escaped once more. Null gives ''."""
    if not raw:
        return ""
    markup = html.unescape(raw) if escaped else raw
    page, depth, skipped, at = _Page(), 0, 0, 0

    def text(piece: str) -> None:
        if piece and not skipped:
            plain = html.unescape(piece).replace("\xa0", " ").replace("​", "")
            page.add(plain.lstrip() if page.waits() else plain)

    while at < len(markup):
        tag = _TAG.search(markup, at)
        if tag is None:
            text(markup[at:])
            break
        text(markup[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        closing = bool(tag["close"])
        if name in SKIPPED:
            skipped = max(skipped - 1, 0) if closing else skipped + 1
            if not closing and name in _RAW:
                end = _RAW[name].search(markup, at)
                at = end.start() if end else len(markup)
        elif skipped or not name:
            continue
        elif name == "br":
            if not closing and not page.waits():
                page.end()
        elif name == "li":
            page.end()
            if not closing:
                page.mark = "  " * max(depth - 1, 0) + "- "
        elif name in BLOCKS:
            if not page.waits() or closing and name in LISTS:
                page.block()
            if name in LISTS:
                depth = max(depth - 1, 0) if closing else depth + 1
    page.end()
    return "\n".join((mark + line).rstrip() for mark, line in page.lines).strip()
