"""What every front end returns for a file, and the bookkeeping that they share."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection
from dataclasses import dataclass, field
from typing import Protocol


#: Lists that the row of a file has.
LISTS = ("defs", "raw_refs", "raw_imports", "root")
_NEWLINE = re.compile(b"\n")


def with_comments(ranges: list[tuple[int, int]], comments: list[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int]]:
    """Ranges in order, with the comments between them that start from ``begin`` to before ``end``; both are in order and disjoint."""
    if not comments:
        return sorted(ranges)
    starts, out = [s for s, _ in ranges], list(ranges)
    for at in range(bisect_left(comments, (begin, -1)), len(comments)):
        c = comments[at]
        if c[0] >= end:
            break
        k = bisect_right(starts, c[0]) - 1
        if k < 0 or ranges[k][1] <= c[0]:
            out.append(c)
    return sorted(out)


@dataclass(slots=True)
class Definition:
    """A captured definition.  Byte range, names and what a skeleton of it is made of."""

    type: str
    name: str
    start: int
    end: int
    enclosing_class: str | None = None
    namespace: list[str] = field(default_factory=list)
    sig: str = ""
    has_body: bool = False
    body: list[tuple[int, int]] = field(default_factory=list)
    id: int = -1
    parent: int = -1
    ancestors: list[int] = field(default_factory=list)
    nested: int = 0


@dataclass
class Import:
    """One bound name of an import statement; form: wildcard, direct, named, module or none (binds nothing)."""

    stmt: int
    start: int
    end: int
    form: str
    module: str | None = None
    relative: bool = False
    bound: str | None = None
    alias: str | None = None
    extra: int = 0


@dataclass
class Source:
    """A parsed file.  Refs are (group, text, kind, start, end); groups order calls before attribute calls before bases."""

    content: bytes
    defs: list[Definition] = field(default_factory=list)
    refs: list[tuple[int, str, str, int, int]] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    root: list[tuple[int, int]] = field(default_factory=list)

    def text(self, start: int, end: int) -> str:
        return self.content[start:end].decode("utf-8")

    def finish(self, wanted: Collection[str] = LISTS) -> dict:
        """The row of the file: definitions nested by their ranges, every reference with its innermost definition.

        Of the lists only the wanted ones are made, the others are null.
        """
        breaks = [m.end() for m in _NEWLINE.finditer(self.content)]
        line = lambda at: bisect_right(breaks, at) + 1
        defs = sorted(self.defs, key=lambda d: (d.start, -d.end))
        stack: list[Definition] = []
        for i, d in enumerate(defs):
            while stack and stack[-1].end <= d.start:
                stack.pop()
            d.id, d.parent = i, stack[-1].id if stack else -1
            d.ancestors = [i, *(stack[-1].ancestors if stack else [])]
            for s in stack:
                s.nested += 1
            stack.append(d)
        stubs = {(d.start, d.end): d for d in defs}

        def parts(ranges: list[tuple[int, int]]) -> list[dict]:
            out = []
            for s, e in ranges:
                d = stubs.get((s, e))
                out.append({"text": None if d else self.text(s, e).strip(), "sig": f"{d.sig}..." if d else None})
            return [p for p in out if p["sig"] or p["text"]]

        starts = [d.start for d in defs]

        def innermost(start: int, end: int) -> int:
            k = bisect_right(starts, start) - 1
            while k >= 0 and defs[k].end < end:
                k = defs[k].parent
            return k

        made = {
            "defs": lambda: [
                {
                    "id": d.id, "parent": d.parent, "ancestors": d.ancestors, "nested": d.nested, "type": d.type, "name": d.name, "enclosing_class": d.enclosing_class,
                    "namespace": d.namespace, "start": d.start, "end": d.end, "start_line": line(d.start), "end_line": line(d.end), "sig": d.sig, "has_body": d.has_body, "body": parts(d.body),
                }
                for d in defs
            ],
            "raw_refs": lambda: [{"ord": i, "text": t, "kind": k, "start": s, "end": e, "def": innermost(s, e)} for i, (_, t, k, s, e) in enumerate(sorted(self.refs, key=lambda r: (r[0], r[3], r[4])))],
            "raw_imports": lambda: [{"ord": i, **vars(x)} for i, x in enumerate(self.imports)],
            "root": lambda: parts(self.root),
        }
        first = len(self.content) - len(self.content.lstrip())
        return {
            "parse_error": None,
            "start_line": line(first if first < len(self.content) else 0),
            "end_line": line(len(self.content)),
            **{name: make() if name in wanted else None for name, make in made.items()},
        }


class FrontEnd(Protocol):
    """What a language's front end is: a file's bytes to what it holds, or an IngestionError.

    It may leave out references where none are asked for.
    """

    def __call__(self, content: bytes, refs: bool = True) -> Source: ...
