"""Tokens of the languages that nest in brackets, and the structure that brackets give."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import MalformedSourceError

WORD, NUMBER, STRING, REGEX, PUNCT = "word", "number", "string", "regex", "punct"
_CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}", "`": "`"}
# Texts are bytes read as Latin-1: a character is a byte, and bytes from 0x80 on belong to words.
_WORD = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_NUMBER = r"(?:0[xXbBoO][\w]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*"
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+|(\n)")
_SCRIPT = re.compile(
    rf"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<number>{_NUMBER})|(?P<word>{_WORD})|(?P<punct>=>|\?\.(?!\d)|\.\.\.|\+\+|--|[^\s])",
    re.DOTALL,
)
_GO = re.compile(
    rf"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|`[^`]*`)|(?P<number>{_NUMBER})|(?P<word>{_WORD})|(?P<punct>:=|<-|\.\.\.|&&|\|\||\+\+|--|[^\s])",
    re.DOTALL,
)
_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line_before: bool  # a line ends between the token before and this one


@dataclass
class Tokens:
    """Tokens, comments, and for each bracket the place of its partner."""

    text: str
    items: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def at(self, i: int) -> str:
        """Text of token i; empty outside."""
        return self.items[i].text if 0 <= i < len(self.items) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.items) and self.items[i].kind == WORD

    def after(self, i: int) -> int:
        """The token after i, or after the brackets that i opens."""
        return self.partner[i] + 1 if self.partner.get(i, -1) > i else i + 1


def read(text: str, script: bool) -> Tokens:
    """All tokens of a text; unclosed brackets, strings and comments are errors."""
    out, at, line = Tokens(text), 0, False
    open_: list[int] = []
    rule = _SCRIPT if script else _GO

    def add(kind: str, start: int, end: int) -> None:
        nonlocal line
        out.items.append(Token(kind, text[start:end], start, end, line))
        line = False

    def close(sign: str) -> None:
        if not open_ or _CLOSES[out.items[open_[-1]].text] != sign:
            raise MalformedSourceError(f"unmatched {sign} at byte {at}")
        begin = open_.pop()
        out.partner[begin], out.partner[len(out.items) - 1] = len(out.items) - 1, begin

    def template(i: int) -> int:
        """Goes on in a template literal at i, up to its end or the next expression in it."""
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                add(PUNCT, i, i + 1)
                close("`")
                return i + 1
            elif text.startswith("${", i):
                add(PUNCT, i, i + 2)
                open_.append(len(out.items) - 1)
                return i + 2
            else:
                i += 1
        raise MalformedSourceError("unclosed template")

    while at < len(text):
        if space := _SPACE.match(text, at):
            line = line or bool(space[1])
            at = space.end()
            continue
        if script and text[at] == "/" and _pattern_may_follow(out) and (found := _PATTERN.match(text, at)):
            add(REGEX, at, found.end())
            at = found.end()
            continue
        found = rule.match(text, at)
        kind = found.lastgroup if found else None
        if found is None or kind == "punct" and (found[0] in "\"'" or text.startswith("/*", at) or found[0] == "`" and not script):
            raise MalformedSourceError(f"unclosed at byte {at}")
        at = found.end()
        if kind == "comment":
            out.comments.append(found.span())
            line = line or "\n" in found[0]
            continue
        add({"word": WORD, "number": NUMBER, "string": STRING}.get(kind, PUNCT), *found.span())
        sign = found[0]
        if kind != "punct":
            continue
        if sign == "`":
            open_.append(len(out.items) - 1)
            at = template(at)
        elif sign in "([{":
            open_.append(len(out.items) - 1)
        elif sign in ")]}":
            expression = sign == "}" and open_ and out.items[open_[-1]].text == "${"
            close(sign)
            if expression:
                at = template(at)
    if open_:
        raise MalformedSourceError(f"unclosed {out.items[open_[-1]].text}")
    return out


def _pattern_may_follow(out: Tokens) -> bool:
    if not out.items:
        return True
    last = out.items[-1]
    if last.kind == WORD:
        return last.text in _BEFORE_PATTERN
    return last.kind == PUNCT and last.text not in (")", "]", "++", "--", "`")
