"""Syntax errors that neighbouring tokens show: operators without operands, statements without separators, declarations without names.

Only what no valid source has is an error, so some broken sources pass.
"""

from __future__ import annotations

from ..errors import MalformedSourceError
from .tokens import NUMBER, PUNCT, STRING, WORD, Tokens

_CLOSERS = frozenset("; ) ] } ,".split())
_WANTS_OPERAND = frozenset("= + - * / % & | ^ < . ?. ... =>".split())
#: Words behind or before which another operand may follow on the line.
_LEADS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if implements import in instanceof interface let new of package "
    "private protected public return static throw try typeof var void while with yield async await get set abstract accessor as asserts assert satisfies infer is keyof module "
    "namespace declare type unique readonly override out global using from target meta defer source constructor".split()
)
_JOINS = frozenset("in of instanceof as satisfies is extends implements from else while catch finally assert with if".split())
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_OPERATORS = frozenset("= := + - * / % & | ^ < > ! && || <-".split())
_GO_BINARY = frozenset("= := && || / %".split())


def _fail(t: Tokens, i: int) -> None:
    raise MalformedSourceError(f"unexpected {t.at(i) or 'end'} at byte {t.items[i].start if i < len(t.items) else len(t.text)}")


def _touch(t: Tokens, i: int) -> bool:
    return i > 0 and t.items[i - 1].end == t.items[i].start


def _has_markup(t: Tokens) -> bool:
    """Whether elements are written among the code; their text follows other rules."""
    return any(t.at(i) == "/" and (t.at(i - 1) == "<" and _touch(t, i) or t.at(i + 1) == ">" and _touch(t, i + 1)) for i in range(len(t.items)))


def _decorates(t: Tokens, i: int) -> bool:
    while t.at(i - 1) == ".":
        i -= 2
    return t.at(i - 1) == "@"


def check_script(t: Tokens, typed: bool) -> None:
    if _has_markup(t):
        return
    first = t.text.find("\n") if t.text.startswith("#!") else -1
    n = len(t.items)
    for i, token in enumerate(t.items):
        if token.start < first:
            continue
        sign, after = token.text, t.at(i + 1)
        if token.kind == PUNCT:
            if sign in _WANTS_OPERAND and (i + 1 == n or t.items[i + 1].kind == PUNCT and after in _CLOSERS) and not (sign == "*" and typed):
                _fail(t, i + 1)
            if sign == "." and not (t.is_word(i + 1) or after == "#"):
                _fail(t, i + 1)
            if sign == "=" and (after == "=" and not _touch(t, i + 1) or after in ("*", "%", "^") and t.at(i - 1) != "/"):
                _fail(t, i + 1)
            continue
        if token.kind == WORD and t.at(i - 1) not in (".", "?."):
            opens = t.at(i - 1) in ("", ";", "}")
            if sign in ("function", "class") and opens and (sign == "function" and after == "(" or sign == "class" and after == "{"):
                _fail(t, i + 1)
            if sign in ("const", "var") and t.at(i - 1) != "as" and (after in (";", ")", "]") or i + 1 < n and t.items[i + 1].kind == NUMBER):
                _fail(t, i + 1)
        if i + 1 == n or t.items[i + 1].line_before or t.items[i + 1].kind not in (WORD, NUMBER, STRING) or token.kind not in (WORD, NUMBER, STRING):
            continue
        leads = token.kind == WORD and (sign in _LEADS or _decorates(t, i))
        if not leads and after not in _JOINS and not _touch(t, i + 1):
            _fail(t, i + 1)


def check_go(t: Tokens) -> None:
    n = len(t.items)
    around: list[str] = []  # what kind of bracket encloses a token
    for i, token in enumerate(t.items):
        sign, after = token.text, t.at(i + 1)
        if token.kind == PUNCT:
            if sign in ("{", "(", "["):
                around.append("fields" if sign == "{" and t.at(i - 1) in ("struct", "interface") else sign)
            elif sign in ("}", ")", "]"):
                around.pop()
            if sign in _GO_OPERATORS and (i + 1 == n or t.items[i + 1].kind == PUNCT and after in _CLOSERS):
                _fail(t, i + 1)
            if sign == "." and not (t.is_word(i + 1) or after == "(" or i + 1 < n and t.items[i + 1].kind == STRING):
                _fail(t, i + 1)
            if sign in _GO_OPERATORS and after in _GO_BINARY and t.items[i + 1].kind == PUNCT and not _touch(t, i + 1):
                _fail(t, i + 1)
            continue
        if token.kind != WORD or sign in _GO_WORDS or i + 1 == n or t.items[i + 1].line_before or around and around[-1] != "{":
            continue
        begins = i == 0 or t.at(i - 1) in ("{", ";", "}") or token.line_before and not (t.items[i - 1].kind == PUNCT and t.at(i - 1) not in (")", "]", "++", "--"))
        if begins and t.at(i - 1) not in _GO_WORDS and t.items[i + 1].kind in (WORD, NUMBER, STRING) and after not in _GO_WORDS:
            _fail(t, i + 1)
