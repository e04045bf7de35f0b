"""Front ends for JavaScript, TypeScript and Go: recognisers over tokens and matched brackets.

They find the definitions, references and imports that the data model knows, not a whole
syntax tree.  Errors they notice are unmatched brackets, unclosed literals and those in ``syntax``.
"""

from __future__ import annotations

from itertools import accumulate

from ..errors import ChunkDecodeError
from .model import Definition, Import, Source, with_comments
from .syntax import check_go, check_script
from .tokens import STRING, WORD, Tokens, read

_NOT_CALLED = frozenset(
    "if for while switch catch function return typeof void delete in of instanceof new class extends super import export default case throw do else try finally with yield await".split()
)
_MODIFIERS = frozenset("static async get set public private protected override readonly abstract declare accessor".split())
_BLOCK_WORDS = frozenset("function class interface if for while try switch do enum namespace module declare export async abstract".split())
_GOES_ON = frozenset("else catch finally".split())
_OPERATORS = frozenset("= + - * / % & | ^ < > ? : , . ?. => && || ! ~ ( [ { ${ ...".split())
_NOT_IN_TYPES = frozenset("return let var if else for while switch case throw try".split())
_GO_WORDS = frozenset("func if for switch select return go defer range case var const type struct interface map chan else import package".split())


def _latin(content: bytes) -> str:
    try:
        content.decode("utf-8")
    except UnicodeDecodeError as error:
        raise ChunkDecodeError(str(error)) from error
    return content.decode("latin-1")


def _inside(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    """For each of n tokens, whether it is strictly inside one of the ranges."""
    steps = [0] * (n + 2)
    for first, last in ranges:
        if last > first:
            steps[first + 1] += 1
            steps[last] -= 1
    return [depth > 0 for depth in accumulate(steps[:n])]


class _Braces:
    """What the recognisers share."""

    def __init__(self, content: bytes, script: bool) -> None:
        self.out = Source(content)
        self.t: Tokens = read(_latin(content), script)
        self.stmt = 0

    def start(self, i: int) -> int:
        return self.t.items[i].start

    def end(self, i: int) -> int:
        return self.t.items[i].end

    def words(self, start: int, end: int) -> str:
        return self.out.text(start, end)

    def name(self, i: int) -> str:
        return self.words(self.start(i), self.end(i))

    def owner_start(self, dot: int) -> int:
        """First token of the expression before a dot."""
        t, i = self.t, dot - 1
        while i >= 0:
            if t.at(i) in (")", "]", "}", "`") and t.partner.get(i, i) < i:
                i = t.partner[i]
                before = i - 1
                if t.at(i) in ("(", "[") and (t.is_word(before) and t.at(before) not in _NOT_CALLED or t.at(before) in (")", "]", "}", "!", "`", ">")):
                    i = before
                    continue
                if t.at(i) == "`" and t.is_word(before) and t.at(before) not in _NOT_CALLED:
                    i = before
                    continue
            elif t.at(i) == "!":
                i -= 1
                continue
            if t.at(i - 1) in (".", "?."):
                i -= 2
                continue
            return i - 1 if t.at(i - 1) == "new" else i
        return 0

    def member_call(self, dot: int) -> None:
        """A call of a member, the name of which stands behind this dot."""
        first = self.owner_start(dot)
        if self.t.at(first) == "new" and not any(self.t.at(k) == "(" for k in range(first, dot)):
            return  # new a.b(): a constructor, not a call of a member
        begin, end = self.start(first), self.end(dot + 1)
        self.out.refs.append((1, f"{self.words(begin, self.end(dot - 1))}.{self.name(dot + 1)}", "call", begin, end))

    def with_comments(self, ranges: list[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int]]:
        return with_comments(ranges, self.t.comments, begin, end)

    def block(self, brace: int, split) -> list[tuple[int, int]]:
        """Children of a block: its braces, what ``split`` finds between them, and comments."""
        close = self.t.partner[brace]
        inner = split(brace + 1, close)
        ranges = [(self.start(brace), self.end(brace)), *inner, (self.start(close), self.end(close))]
        return self.with_comments(ranges, self.start(brace), self.end(close))


class _Script(_Braces):
    """JavaScript, and TypeScript with its types."""

    def __init__(self, content: bytes, typed: bool) -> None:
        super().__init__(content, True)
        check_script(self.t, typed)
        self.typed = typed
        self.scopes: list[tuple[int, int, str]] = []  # ranges that give a name to what they hold
        self.silent: list[tuple[int, int]] = []  # token ranges in which nothing is called
        self.members: set[int] = set()  # tokens that name a member and aren't calls

    # -- expressions and types ---------------------------------------------------------------------------

    def generics(self, i: int) -> int:
        """The token after type parameters or arguments that start at i, or i."""
        if self.t.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t.items):
            sign = self.t.at(j)
            if sign == "<":
                depth += 1
            elif sign == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif sign in (";", ")", "]", "}") or sign in _NOT_IN_TYPES:
                return i
            j = self.t.after(j)
        return i

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` behind the type that starts at i."""
        j, last = i, ":"
        while j < len(self.t.items):
            sign = self.t.at(j)
            if sign in stops and not (sign == "{" and last in (":", "|", "&", "=>", "<", ",", "(", "[", "is")):
                return j
            if sign in (")", "]", "}"):
                return j
            last = sign
            j = self.generics(j) if sign == "<" and self.generics(j) > j else self.t.after(j)
        return j

    def arrow(self, i: int) -> int:
        """The arrow of a function with parenthesised parameters that starts at i, or -1."""
        if self.t.at(i) == "async" and not self.t.at(i + 1) == "=>":
            i += 1
        i = self.generics(i)
        if self.t.at(i) != "(":
            return -1
        i = self.t.after(i)
        if self.t.at(i) == ":":
            i = self.type_end(i + 1, ("=>", "=", ";", ",", "{"))
        return i if self.t.at(i) == "=>" else -1

    def expression_end(self, i: int) -> int:
        """The last token of the expression that starts at i."""
        j = i
        while j < len(self.t.items):
            if self.t.at(j) in (",", ";", ")", "]", "}"):
                return j - 1
            if j > i and self.breaks(j):
                return j - 1
            j = self.t.after(j)
        return len(self.t.items) - 1

    def breaks(self, j: int) -> bool:
        """Whether a line end before token j ends a statement."""
        token = self.t.items[j]
        if not token.line_before or self.t.at(j - 1) in _OPERATORS:
            return False
        return not (token.text in _OPERATORS and token.text not in ("{", "!", "~", "...") or token.text in ("instanceof", "in", "of", "`"))

    def body_end(self, i: int) -> int:
        return self.t.partner[i] if self.t.at(i) == "{" else self.expression_end(i)

    # -- definitions ----------------------------------------------------------------------------------------

    def define(self, kind: str, name: str, first: int, last: int, body: int = -1, cls: str | None = None, members: bool = False) -> None:
        start, end = self.start(first), self.end(last)
        d = Definition(kind, name, start, end, cls, [], self.words(start, self.start(body) if body >= 0 else end).rstrip(), body >= 0)
        if body >= 0:
            d.body = self.block(body, self.split_members if members else self.split_statements)
        self.out.defs.append(d)

    def statement_start(self, i: int) -> bool:
        before = self.t.at(i - 1)
        return before in ("", ";", "{", "}", "export", "default", "declare") or before == ")" or self.breaks(i)

    def function(self, i: int) -> None:
        first = i - 1 if self.t.at(i - 1) == "async" else i
        if self.t.at(i + 1) == "*" or not self.t.is_word(i + 1):
            return
        params = self.generics(i + 2)
        if self.t.at(params) != "(":
            return
        body = self.t.after(params)
        if self.t.at(body) == ":":
            body = self.type_end(body + 1, ("{", ";"))
        if self.t.at(body) == "{" and self.statement_start(first):
            last = self.t.partner[body]
            self.define("function_declaration", self.name(i + 1), first, last, body)
            self.scopes.append((self.start(first), self.end(last), self.name(i + 1)))

    def decorated(self, i: int) -> int:
        """First token of the decorators before i, or i."""
        j = i
        while True:
            k = j - 1
            if self.t.at(k) == ")":
                k = self.t.partner[k] - 1
            while self.t.is_word(k) and self.t.at(k - 1) == ".":
                k -= 2
            if not (self.t.is_word(k) and self.t.at(k - 1) == "@"):
                return j
            j = k - 1

    def klass(self, i: int) -> None:
        named = self.t.is_word(i + 1) and self.t.at(i + 1) not in ("extends", "implements")
        j = i + 2 if named else i + 1
        while j < len(self.t.items) and self.t.at(j) != "{":
            if self.t.at(j) == "extends":
                self.heritage(j + 1)
            g = self.generics(j)
            j = g if g > j else self.t.after(j)
        if self.t.at(j) != "{":
            return
        first, last = self.decorated(i), self.t.partner[j]
        abstract = self.t.at(i - 1) == "abstract"
        declared = named and not abstract and (self.statement_start(i) or first < i)
        name = self.name(i + 1) if named else None
        if declared:
            self.define("class_declaration", name, first, last, j, members=True)
            self.scopes.append((self.start(first), self.end(last), name))
        self.class_members(j, name if declared else None)

    def heritage(self, i: int) -> None:
        j = i
        while self.t.is_word(j) and self.t.at(j + 1) == ".":
            j += 2
        stop = self.generics(j + 1) if self.typed else j + 1
        if not self.t.is_word(j) or self.t.at(stop) not in ("{", "implements") or j > i and not self.typed:
            return
        start, end = self.start(i), self.end(j)
        self.out.refs.append((2, self.words(start, end), "inheritance", start, end))

    def member(self, i: int, stop: int) -> tuple[int, int, int, int, int]:
        """A member that starts at i: first token without decorators, name, body or -1, arrow or -1, last token."""
        j = i
        while self.t.at(j) == "@":
            j += 2
            while self.t.at(j) == ".":
                j += 2
            if self.t.at(j) == "(":
                j = self.t.after(j)
        first = j
        while self.t.at(j) in _MODIFIERS and (self.t.is_word(j + 1) or self.t.items[j + 1].kind == STRING or self.t.at(j + 1) in ("[", "*", "#")):
            j += 1
        if self.t.at(j) == "*":
            j += 1
        name = j
        if self.t.at(j) == "#":
            j += 1
        j = self.t.after(j)
        if self.t.at(j) in ("?", "!"):
            j += 1
        params = self.generics(j)
        if self.t.at(params) == "(":
            body = self.t.after(params)
            if self.t.at(body) == ":":
                body = self.type_end(body + 1, ("{", ";", ","))
            if body < stop and self.t.at(body) == "{":
                return first, name, body, -1, self.t.partner[body]
            return first, name, -1, -1, max(min(body, stop) - 1, params)
        if self.t.at(j) == ":":
            j = self.type_end(j + 1, ("=", ";", ","))
        if self.t.at(j) == "=":
            arrow = self.arrow(j + 1)
            return first, name, -1, arrow, min(self.body_end(arrow + 1) if arrow >= 0 else self.expression_end(j + 1), stop - 1)
        return first, name, -1, -1, max(min(j, stop) - 1, name)

    def split_members(self, lo: int, hi: int) -> list[tuple[int, int]]:
        out, i = [], lo
        while i < hi:
            if self.t.at(i) in (";", ","):
                out.append((self.start(i), self.end(i)))
                i += 1
                continue
            first, _, _, _, last = self.member(i, hi)
            if self.typed and first > i:
                out.append((self.start(i), self.end(first - 1)))
            out.append((self.start(first if self.typed else i), self.end(last)))
            i = max(last, i) + 1
        return out

    def class_members(self, brace: int, cls: str | None) -> None:
        i, stop = brace + 1, self.t.partner[brace]
        while i < stop:
            if self.t.at(i) in (";", ","):
                i += 1
                continue
            first, name, body, arrow, last = self.member(i, stop)
            begin = first if self.typed else i
            plain = self.t.is_word(name)
            self.members.add(name)
            if plain or self.t.at(name) == "#":
                label = self.words(self.start(name), self.end(name if plain else name + 1))
                if body >= 0 or self.t.at(name + 1) != "(":
                    self.scopes.append((self.start(begin), self.end(last), label))
                if plain and body >= 0:
                    self.define("method_definition", label, begin, last, body, cls)
                elif plain and arrow >= 0:
                    self.define("public_field_definition" if self.typed else "field_definition", label, begin, last, -1, cls)
            i = max(last, i) + 1

    def object_members(self, brace: int) -> None:
        i, stop = brace + 1, self.t.partner[brace]
        while i < stop:
            j = i
            while j < stop and self.t.at(j) != ",":
                j = self.t.after(j)
            if self.t.is_word(i) or self.t.at(i) == "*":
                first, name, body, _, last = self.member(i, j)
                if body >= 0 and last == j - 1:
                    self.members.add(name)
                    if self.t.is_word(name):
                        self.define("method_definition", self.name(name), first, last, body)
                        self.scopes.append((self.start(first), self.end(last), self.name(name)))
            i = j + 1

    def declarators(self, i: int) -> None:
        j = i + 1
        while self.t.is_word(j) or self.t.at(j) in ("{", "["):
            name, k = j, self.t.after(j)
            if self.t.at(k) == "!":
                k += 1
            if self.t.at(k) == ":":
                k = self.type_end(k + 1, ("=", ",", ";"))
            last = k - 1
            if self.t.at(k) == "=":
                arrow = self.arrow(k + 1)
                last = self.body_end(arrow + 1) if arrow >= 0 else self.expression_end(k + 1)
                label = self.words(self.start(name), self.end(self.t.after(name) - 1))
                self.scopes.append((self.start(name), self.end(last), label))
                if arrow >= 0 and self.t.is_word(name):
                    self.define("variable_declarator", label, name, last)
            if self.t.at(last + 1) != ",":
                return
            j = last + 2

    # -- statements --------------------------------------------------------------------------------------------

    def split_statements(self, lo: int, hi: int) -> list[tuple[int, int]]:
        out, i = [], lo
        while i < hi:
            j, first, last = i, self.t.at(i), i
            while j < hi:
                sign = self.t.at(j)
                if sign == ";":
                    last, j = j, j + 1
                    break
                if j > i and self.breaks(j) and not (sign in _GOES_ON or sign == "while" and first == "do"):
                    break
                last = self.t.after(j) - 1
                j = last + 1
                if sign == "{" and (first in _BLOCK_WORDS or first == "{") and self.t.at(j) not in _GOES_ON and not (self.t.at(j) == "while" and first == "do"):
                    if not (first in ("export", "declare") and self.t.at(i + 1) in ("{", "const", "let", "var") or self.t.at(j) in ("from", ".", "(", "=")):
                        if self.t.at(j) == ";" and first == "export":
                            last, j = j, j + 1
                        break
            out.append((self.start(i), self.end(last)))
            i = max(j, i + 1)
        return out

    def imports(self, i: int) -> None:
        if self.t.at(i + 1) in ("(", ".") or self.t.at(i - 1) == ".":
            return
        end = i + 1
        while end < len(self.t.items) and self.t.items[end].kind != STRING and self.t.at(end) != ";":
            end = self.t.after(end)
        if end >= len(self.t.items) or self.t.items[end].kind != STRING:
            return
        module = self.name(end)
        last = end + 1 if self.t.at(end + 1) == ";" else end
        place = (self.stmt, self.start(i), self.end(last))
        relative = module.strip("\"'`").startswith(".")
        self.stmt += 1
        found, j = [], i + 1
        if self.t.at(j) == "type" and self.t.at(j + 1) != "from" and self.t.at(j + 1) != ",":
            j += 1
        while j < end and self.t.at(j) != "from":
            if self.t.at(j) == "{":
                found += self.named(j)
            elif self.t.at(j) == "*" and self.t.at(j + 1) == "as":
                found.append((self.name(j + 2), self.name(j + 2)))
                j += 2
            elif self.t.is_word(j):
                found.append((self.name(j), self.name(j)))
            j = self.t.after(j)
        for bound, alias in found:
            self.out.imports.append(Import(*place, "named", module, relative, bound, alias))
        if not found:
            self.out.imports.append(Import(*place, "none", module, relative))

    def named(self, brace: int) -> list[tuple[str, str]]:
        out, j = [], brace + 1
        while j < self.t.partner[brace]:
            if self.t.at(j) == "type" and self.t.is_word(j + 1) and self.t.at(j + 1) != "as":
                j += 1
            if self.t.is_word(j) and self.t.at(j) != "default":
                alias = j + 2 if self.t.at(j + 1) == "as" else j
                out.append((self.name(j), self.name(alias)))
                j = alias
            while j < self.t.partner[brace] and self.t.at(j) != ",":
                j += 1
            j += 1
        return out

    def run(self) -> Source:
        t = self.t
        for i, token in enumerate(t.items):
            quiet = t.at(i - 1) in (".", "?.")
            if token.kind == WORD and not quiet:
                if token.text == "function":
                    self.function(i)
                elif token.text == "class" and t.at(i + 1) != ":" and i not in self.members:
                    self.klass(i)
                elif token.text in ("const", "let", "var") and (t.is_word(i + 1) or t.at(i + 1) in ("{", "[")):
                    self.declarators(i)
                elif token.text == "import":
                    self.imports(i)
                elif token.text == "interface" and self.typed and t.is_word(i + 1) and self.statement_start(i):
                    self.interface(i)
                elif token.text == "type" and self.typed and t.is_word(i + 1) and self.statement_start(i) and t.at(self.generics(i + 2)) == "=":
                    self.silent.append((i, self.expression_end(i + 2) + 1))
                elif token.text == "new" and t.is_word(i + 1) and t.at(i + 1) not in ("class", "function", "this") and t.at(i + 2) not in (".", "?."):
                    self.out.refs.append((0, self.name(i + 1), "call", self.start(i + 1), self.end(i + 1)))
            elif token.text == "{" and t.at(i - 1) in ("=", "(", ",", ":", "[", "return", "?", "&&", "||", "default", "..."):
                self.object_members(i)
        silent = _inside(self.silent, len(t.items))
        for i in range(len(t.items)):
            if not silent[i]:
                self.call(i)
        self.name_spaces()
        self.out.root = self.with_comments(self.split_statements(0, len(t.items)), 0, len(t.text) + 1)
        return self.out

    def name_spaces(self) -> None:
        """The names of the scopes around each definition, in one sweep over both."""
        scopes, around, k = sorted(self.scopes, key=lambda x: (x[0], -x[1])), [], 0
        for d in sorted(self.out.defs, key=lambda d: d.start):
            while k < len(scopes) and scopes[k][0] <= d.start:
                around = [x for x in around if x[1] > scopes[k][0]] + [scopes[k]]
                k += 1
            around = [x for x in around if x[1] > d.start]
            d.namespace = [name for s, e, name in around if d.end <= e and (s, e) != (d.start, d.end)]

    def interface(self, i: int) -> None:
        j = i + 2
        while j < len(self.t.items) and self.t.at(j) != "{":
            g = self.generics(j)
            j = g if g > j else self.t.after(j)
        if self.t.at(j) == "{":
            last = self.t.partner[j]
            self.define("interface_declaration", self.name(i + 1), i, last, j, members=True)
            self.silent.append((j, last))

    def call(self, i: int) -> None:
        t = self.t
        if not t.is_word(i) or i in self.members:
            return
        j = i + 1
        if t.at(j) == "?." and t.at(j + 1) == "(":
            j += 1
        elif self.typed and t.at(j) == "<" and self.generics(j) > j and t.at(self.generics(j)) == "(":
            j = self.generics(j)
        if t.at(j) != "(":
            return
        before = t.at(i - 1)
        if before in (".", "?."):
            if not (before == "." and t.at(i - 2) in (".", "")):
                self.member_call(i - 1)
        elif t.items[i].text not in _NOT_CALLED and t.items[i].text != "this" and before not in ("function", "new", "#", "@#") and not (before == "*" and t.at(i - 2) == "function"):
            if t.items[i].text == "async" and t.at(t.after(j)) == "=>":
                return
            self.out.refs.append((0, self.name(i), "call", self.start(i), self.end(i)))


def parse_javascript(content: bytes, refs: bool = True) -> Source:  # noqa: ARG001
    return _Script(content, typed=False).run()


def parse_typescript(content: bytes, refs: bool = True) -> Source:  # noqa: ARG001
    return _Script(content, typed=True).run()


class _Go(_Braces):
    def __init__(self, content: bytes) -> None:
        super().__init__(content, False)
        check_go(self.t)

    def ends(self, j: int) -> bool:
        """Whether the line end before token j ends a statement: Go's rule of the token before it."""
        if not self.t.items[j].line_before:
            return False
        last = self.t.items[j - 1]
        return last.kind != "punct" and last.text not in _GO_WORDS - {"return"} or last.text in (")", "]", "}", "++", "--")

    def split_statements(self, lo: int, hi: int) -> list[tuple[int, int]]:
        out, i = [], lo
        while i < hi:
            j = self.t.after(i)
            while j < hi and self.t.at(j) != ";" and not self.ends(j):
                j = self.t.after(j)
            out.append((self.start(i), self.end(j - 1)))
            i = j + 1 if self.t.at(j) == ";" else j
        return out

    def function(self, i: int) -> None:
        t, receiver, j = self.t, None, i + 1
        if t.at(j) == "(":
            receiver, j = j, t.after(j)
        if not t.is_word(j):
            return  # a function literal
        name, j = j, j + 1
        if t.at(j) == "[":
            j = t.after(j)
        if t.at(j) != "(":
            return
        j = t.after(j)
        body = -1
        while j < len(t.items) and not self.ends(j):
            if t.at(j) == "{" and t.at(j - 1) not in ("struct", "interface"):
                body = j
                break
            j = t.after(j)
        last = t.partner[body] if body >= 0 else j - 1
        start, end = self.start(i), self.end(last)
        d = Definition("method_declaration" if receiver else "function_declaration", self.name(name), start, end, self.receiver(receiver) if receiver else None)
        d.sig = self.words(start, self.start(body) if body >= 0 else end).rstrip()
        if body >= 0:
            d.has_body, d.body = True, self.block(body, self.split_statements)
        self.out.defs.append(d)
        self.names.add(name)

    def receiver(self, i: int) -> str | None:
        """The type of a receiver (Type, *Type, name Type, name *Type); none if it has type parameters."""
        j = self.t.partner[i] - 1
        before = self.t.at(j - 1)
        return self.name(j) if self.t.is_word(j) and (before in ("(", "*") or self.t.is_word(j - 1)) else None

    def types(self, i: int) -> None:
        t, specs, j = self.t, [], i + 1
        grouped = t.at(j) == "("
        stop = t.partner[j] if grouped else len(t.items)
        j += grouped
        last = j
        while j < stop and t.is_word(j):
            kind = j + 1
            if t.at(kind) == "[" and t.is_word(kind + 1) and t.is_word(kind + 2):
                kind = t.after(kind)  # type parameters
            specs.append((j, kind))
            last = k = kind
            while k < stop and not (k > kind and (t.at(k) == ";" or self.ends(k))):
                last, k = t.after(k) - 1, t.after(k)
            if not grouped:
                break
            j = k + 1 if t.at(k) == ";" else k
        if not any(t.at(k) in ("struct", "interface") for _, k in specs):
            return
        start, end = self.start(i), self.end(stop if grouped else last)
        name, kind = specs[0]
        d = Definition("type_declaration", self.name(name), start, end)
        d.sig, d.has_body = self.words(start, self.start(kind)).rstrip(), True
        if t.at(kind) in ("struct", "interface"):
            brace = kind + 1
            d.body = [(self.start(kind), self.end(kind)), (self.start(brace), self.end(t.partner[brace]))]
        self.out.defs.append(d)

    def fields(self, brace: int) -> None:
        """Embedded types of a struct."""
        i, stop = brace + 1, self.t.partner[brace]
        while i < stop:
            j = i
            while j < stop and not (j > i and (self.t.at(j) == ";" or self.ends(j))):
                j = self.t.after(j)
            words = [k for k in range(i, j) if self.t.items[k].kind != STRING]
            if words and self.t.at(words[0]) == "*":
                words = words[1:]
            if len(words) == 1 and self.t.is_word(words[0]):
                k = words[0]
                self.out.refs.append((2, self.name(k), "inheritance", self.start(k), self.end(k)))
            i = j + 1 if self.t.at(j) == ";" else j

    def imports(self, i: int) -> None:
        t, j = self.t, i + 1
        stop = t.partner[j] if t.at(j) == "(" else j + 2
        found = []
        for k in range(j, min(stop, len(t.items))):
            if t.items[k].kind == STRING and not t.at(k).startswith("`"):
                alias = self.name(k - 1) if t.is_word(k - 1) and t.at(k - 1) not in ("import", "_") else None
                module = self.name(k)
                bound = module.strip("\"'`").rstrip("/").rsplit("/", 1)[-1]
                found.append((module, bound, alias or bound))
                last = k
                if t.at(j) != "(":
                    break
        if not found:
            return
        end = self.end(stop) if t.at(j) == "(" else self.end(last)
        for module, bound, alias in found:
            self.out.imports.append(Import(self.stmt, self.start(i), end, "module", module, False, bound, alias))
        self.stmt += 1

    def run(self) -> Source:
        t = self.t
        self.names: set[int] = set()
        for i, token in enumerate(t.items):
            if token.kind != WORD or t.at(i - 1) == ".":
                continue
            if token.text == "func":
                self.function(i)
            elif token.text == "type" and (t.is_word(i + 1) or t.at(i + 1) == "(") and (i == 0 or self.ends(i) or t.at(i - 1) in ("{", ";")):
                self.types(i)
            elif token.text == "import":
                self.imports(i)
            elif token.text == "struct" and t.at(i + 1) == "{":
                self.fields(i + 1)
        inside = _inside([(i + 1, t.partner[i + 1]) for i in range(len(t.items)) if t.at(i) == "interface" and t.at(i + 1) == "{"], len(t.items))
        for i in range(len(t.items) - 1):
            if t.is_word(i) and t.at(i + 1) == "(" and i not in self.names and t.at(i) not in _GO_WORDS and not inside[i]:
                if t.at(i - 1) == ".":
                    self.member_call(i - 1)
                else:
                    self.out.refs.append((0, self.name(i), "call", self.start(i), self.end(i)))
        self.out.root = self.with_comments(self.split_statements(0, len(t.items)), 0, len(t.text) + 1)
        return self.out


def parse_go(content: bytes, refs: bool = True) -> Source:  # noqa: ARG001
    return _Go(content).run()
