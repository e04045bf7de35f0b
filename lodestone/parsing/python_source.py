"""Front end for Python, over the interpreter's own grammar."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from ..errors import ChunkDecodeError, MalformedSourceError
from .model import Definition, Import, Source, with_comments

_BREAK = re.compile(rb"\r\n|\r|\n")
#: What holds nothing that is looked for: names, constants, operators and the like, over half of a tree, and attributes that aren't nodes.
_LEAVES = frozenset({int, str, type(None), ast.Name, ast.Constant, ast.alias, *(t for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST) and not t._fields and not t.__subclasses__())})
#: What has no statements inside, so neither definitions nor imports.
_EXPRESSIONS = frozenset({ast.arguments, ast.keyword, ast.withitem, *ast.expr.__subclasses__()})
_DEFINITIONS, _IMPORTS = frozenset({ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef}), frozenset({ast.Import, ast.ImportFrom})


class _Places:
    """Byte offsets of line and column, as the syntax tree counts them."""

    def __init__(self, content: bytes, shift: int) -> None:
        self.lines = [shift, *(m.end() for m in _BREAK.finditer(content, shift))]

    def start(self, node: ast.AST) -> int:
        return self.lines[node.lineno - 1] + node.col_offset

    def end(self, node: ast.AST) -> int:
        return self.lines[node.end_lineno - 1] + node.end_col_offset


def _comments(text: str, places: _Places) -> list[tuple[int, int]]:
    out = []
    if "#" not in text:
        return out
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                at = places.lines[t.start[0] - 1] + len(t.line[: t.start[1]].encode())
                out.append((at, at + len(t.string.encode())))
    except (tokenize.TokenError, IndentationError, IndexError):
        return out
    return out


def _own_start(node: ast.stmt, places: _Places, content: bytes) -> int:
    """Where a statement starts, decorators and their sign included."""
    decorators = getattr(node, "decorator_list", None)
    return content.rindex(b"@", 0, places.start(decorators[0]) + 1) if decorators else places.start(node)


def _block(body: list[ast.stmt], begin: int, places: _Places, content: bytes, comments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of the statements of a block and of the comments between them."""
    ranges = [(_own_start(s, places, content), places.end(s)) for s in body]
    return with_comments(ranges, comments, begin, ranges[-1][1] if ranges else len(content))


def parse(content: bytes, refs: bool = True) -> Source:
    shift = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    try:
        text = content[shift:].decode("utf-8")
    except UnicodeDecodeError as error:
        raise ChunkDecodeError(str(error)) from error
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise MalformedSourceError(str(error)) from error
    places, out = _Places(content, shift), Source(content)
    comments = _comments(text, places)
    # a comment behind a block's last statement belongs to what comes after
    module = _block(tree.body, shift, places, content, comments)
    end = module[-1][1] if module else shift
    out.root = module + [c for c in comments if c[0] >= end] if tree.body else comments
    skipped = _LEAVES if refs else _LEAVES | _EXPRESSIONS
    stack: list[tuple[ast.AST, tuple[tuple[str, str], ...]]] = [(tree, ())]  # node, names and kinds of what encloses it
    while stack:
        node, around = stack.pop()
        inside, kind = around, type(node)
        if kind is ast.Call:
            _call(node, out, places)
        elif kind in _DEFINITIONS:
            _define(node, around, out, places, comments)
            inside = (*around, (node.name, "class" if kind is ast.ClassDef else "function"))
        elif kind in _IMPORTS:
            _import(node, out, places)
        if kind is ast.ClassDef and refs:
            for base in node.bases:
                if isinstance(base, ast.Name | ast.Attribute):
                    start, stop = places.start(base), places.end(base)
                    out.refs.append((2, out.text(start, stop), "inheritance", start, stop))
        for value in vars(node).values():
            if type(value) is list:
                stack.extend([(child, inside) for child in value if type(child) not in skipped and isinstance(child, ast.AST)])
            elif type(value) not in skipped and isinstance(value, ast.AST):
                stack.append((value, inside))
    out.imports.sort(key=lambda i: i.start)  # names of a statement keep their order
    numbers = {start: number for number, start in enumerate(dict.fromkeys(i.start for i in out.imports))}
    for i in out.imports:
        i.stmt = numbers[i.start]
    return out


def _define(node, around, out: Source, places: _Places, comments) -> None:
    content, start, stop = out.content, _own_start(node, places, out.content), places.end(node)
    head = max([places.start(node), *(places.end(x) for x in _header(node))])
    body = _block(node.body, content.index(b":", head) + 1, places, content, comments)  # comments before the colon belong to the head
    classes = [name for name, kind in around if kind == "class"]
    out.defs.append(
        Definition(
            "class_definition" if isinstance(node, ast.ClassDef) else "function_definition",
            node.name,
            start,
            stop,
            classes[-1] if classes else None,
            [name for name, _ in around],
            out.text(start, body[0][0]).rstrip(),
            True,
            body,
        )
    )


def _header(node) -> list[ast.AST]:
    """Expressions of a definition's head."""
    parts: list[ast.AST] = list(getattr(node, "type_params", []))
    if isinstance(node, ast.ClassDef):
        return parts + node.bases + node.keywords
    a = node.args
    given = [*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg, *a.defaults, *a.kw_defaults, node.returns]
    return parts + [x for x in given if x is not None]


def _call(node: ast.Call, out: Source, places: _Places) -> None:
    target = node.func
    start, stop = places.start(target), places.end(target)
    if isinstance(target, ast.Name):
        out.refs.append((0, out.text(start, stop), "call", start, stop))
    elif isinstance(target, ast.Attribute):
        owner = out.content[start : stop - len(target.attr.encode())].rstrip()
        if owner.endswith(b"."):
            out.refs.append((1, f"{owner[:-1].rstrip().decode()}.{target.attr}", "call", start, stop))


def _import(node, out: Source, places: _Places) -> None:
    start, stop = places.start(node), places.end(node)
    if isinstance(node, ast.Import):
        for a in node.names:
            bound = a.asname or a.name.split(".")[0]
            out.imports.append(Import(0, start, stop, "direct", a.name, False, bound, bound, 0 if a.asname else a.name.count(".")))
        return
    if node.module == "__future__" and not node.level:
        return
    module = "." * node.level + (node.module or "")
    for a in node.names:
        if a.name == "*":
            out.imports.append(Import(0, start, stop, "wildcard", module, node.level > 0))
        else:
            out.imports.append(Import(0, start, stop, "named", module, node.level > 0, a.name, a.asname or a.name))
