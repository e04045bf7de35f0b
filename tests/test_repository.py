"""Repositories on disk, from listing to resolved references."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidChunkBudgetError
from lodestone.functions import columns as fn
from lodestone.functions import validation as v
from lodestone.plans.repository import chunk_repository
from lodestone.sources.repository import read_files, read_listing

SHAPES = '''import os
from dataclasses import dataclass


@dataclass
class Spot:
    x: int


class Sizes:
    """Sizes of things."""

    def one(self, r):
        return round(r)

    def two(self, a, b):
        def check(n):
            raise ValueError("no")
        check(a)
        return self.one(a) + self.missing()


def outside(path: str) -> bool:
    return os.path.exists(path) or print(unknown(1))
'''


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return str(root)


def table(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_listing_keeps_underscores_and_prunes_folders(spark, tmp_path):
    root = write(tmp_path, {"a/__init__.py": "", "a/_x.py": "x", "node_modules/b.py": "x", ".h/c.py": "x", "d.PY": "x", "e.txt": "x", "f.go": "x"})
    assert [os.path.relpath(p, root) for (p,) in table(read_files(spark, root), "path")] == ["a/__init__.py", "a/_x.py", "f.go"]
    listing = read_listing(spark, root)
    assert {os.path.relpath(p, root) for (p,) in table(listing, "path")} >= {"node_modules/b.py", ".h/c.py", "e.txt", "a"}
    assert listing.agg(F.sum("length")).first()[0] == 6


def test_chunks_and_references_of_a_python_file(spark, tmp_path):
    root = write(tmp_path, {"shapes.py": SHAPES})
    r = chunk_repository(spark, root)
    chunks = {c["full_name"]: c for c in r.chunks.collect()}
    path = f"{root}/shapes.py"
    assert {k: c["kind"] for k, c in chunks.items()} == {path: "file_skeleton", "Spot": "definition", "Sizes": "definition", "outside": "definition"}
    assert chunks["Sizes"]["contained_symbols"] == ["Sizes.one", "Sizes.two", "Sizes.two.check"]
    assert all(c["parent_chunk_id"] == chunks[path]["chunk_id"] for k, c in chunks.items() if k != path)
    assert chunks["Spot"]["code"] == "@dataclass\nclass Spot:\n    x: int"
    said = {(x["text"], x["status"]) for c in chunks.values() for x in c["references"]}
    assert said == {
        ("round", "builtin"), ("ValueError", "builtin"), ("check", "unresolved"), ("self.one", "local"), ("self.missing", "local"), ("os.path.exists", "external"), ("print", "builtin"), ("unknown", "unresolved"),
    }
    assert chunks[path]["code"].splitlines() == [f"# file: {path}", "import os", "from dataclasses import dataclass", "@dataclass", "class Spot:...", "class Sizes:...", "def outside(path: str) -> bool:..."]
    assert r.totals().first().asDict() == {"files": 1, "chunks": 4, "refs": 8, "local": 2, "external": 1, "builtin": 3, "unresolved": 2}
    row = r.file_rows.first()
    assert row["import_text"] == "import os\nfrom dataclasses import dataclass"
    assert [c["full_name"] for c in row["chunks"]] == [path, "Spot", "Sizes", "outside"]
    assert set(row["import_bindings"]) == {"os", "dataclass"}


def test_a_class_over_the_budget_becomes_a_skeleton(spark, tmp_path):
    text = "class Big(Base):\n    LIMIT = 1\n\n    def small(self, x=make()):\n        return x\n\n    def large(self):\n" + "        a = call(1)\n" * 30
    r = chunk_repository(spark, write(tmp_path, {"m.py": text}), budget=200)
    chunks = {c["full_name"]: c for c in r.chunks.collect()}
    big = chunks["Big"]
    assert (big["kind"], chunks["Big.small"]["kind"], chunks["Big.large"]["kind"]) == ("definition_skeleton", "definition", "definition")
    assert big["code"] == "class Big(Base):\n    LIMIT = 1\n    def small(self, x=make()):...\n    def large(self):..."
    assert [(x["text"], x["kind"]) for x in big["references"]] == [("Base", "inheritance")]
    assert [x["text"] for x in chunks["Big.small"]["references"]] == ["make"]
    assert len(chunks["Big.large"]["references"]) == 30
    assert chunks["Big.small"]["parent_chunk_id"] == big["chunk_id"]
    assert big["contained_symbols"] == []


def test_decorators_and_defaults_stay_with_the_skeleton(spark, tmp_path):
    text = "@register(make())\nclass A:\n    def f(self):\n        inner()\n\n\n@wrap(other())\ndef g(x=start()):\n    def h():\n        deep()\n    return h\n"
    r = chunk_repository(spark, write(tmp_path, {"m.py": text}), budget=30)
    refs = {c["full_name"]: sorted(x["text"] for x in c["references"]) for c in r.chunks.where("kind <> 'file_skeleton'").collect()}
    assert refs == {"A": ["make", "register"], "A.f": ["inner"], "g": ["other", "start", "wrap"], "g.h": ["deep"]}


def test_relative_aliased_and_wildcard_imports(spark, tmp_path):
    use = "from ...services import get as gu\nfrom ...services import get\nfrom ... import services\nfrom ...tools import *\nimport os\nimport os as system\nimport app.tools\n\n\ndef handler():\n    gu()\n    get()\n    services.get()\n    helper()\n    app.tools.helper()\n    system.exit()\n"
    root = write(tmp_path, {"app/__init__.py": "", "app/services.py": "def get():\n    return 1\n", "app/tools.py": "def helper():\n    return 1\n", "app/api/__init__.py": "", "app/api/routes/__init__.py": "", "app/api/routes/users.py": use})
    r = chunk_repository(spark, root)
    bound = {b["local_name"]: (b["resolved_path"], b["remote_name"], b["kind"], b["extra_segments"]) for b in r.import_bindings.where("file_path like '%users.py'").collect()}
    services, tools = f"{root}/app/services.py", f"{root}/app/tools.py"
    assert bound == {
        "gu": (services, "get", "named", 0), "get": (services, "get", "named", 0), "services": (services, "services", "module", 0), "os": (None, "os", "module", 0),
        "system": (None, "system", "module", 0), "app": (tools, "app", "module", 1),
    }
    status = {x["text"]: x["status"] for x in r.refs.where("file_path like '%users.py'").collect()}
    assert status == {"gu": "local", "get": "local", "services.get": "local", "helper": "local", "app.tools.helper": "local", "system.exit": "external"}
    assert table(r.skip_counts(), "reason", "n") == [("empty", 3)]


def test_files_that_are_skipped_have_a_reason(spark, tmp_path):
    root = write(tmp_path, {"a.py": "", "b.py": b"x\x00", "c.min.js": "x", "d.py": "x" * 201, "e.py": "def (", "f.py": "x = 1\n", "g.js": "y" * 2000, "h.go": "package p\n"})
    r = chunk_repository(spark, root, max_size_mb=0.001)
    assert sorted((os.path.basename(p), why) for p, why in table(r.skipped, "file_path", "reason")) == [
        ("a.py", "empty"), ("b.py", "binary"), ("c.min.js", "minified"), ("d.py", "minified"), ("e.py", "MalformedSourceError"), ("g.js", "oversized"),
    ]
    assert r.totals().first()["files"] == 2


@pytest.mark.parametrize(("budget", "threshold"), [(0, 1), (1, 0), (-1, 5)])
def test_budgets_must_be_positive(spark, budget, threshold):
    with pytest.raises(InvalidChunkBudgetError):
        chunk_repository(spark, "/nowhere", skeleton_threshold=threshold, budget=budget)


CASES = [
    b"", b"a" * 200, b"a" * 201, b"\n".join([b"a" * 300] * 9), b"\n".join([b"a" * 300] * 8 + [b"b"]), b"\n".join([b"a" * 300] * 7 + [b"b"] * 3), b"\n".join([b"a" * 285] * 7 + [b""] * 3), b"x\r\ny\rz\n",
    b"z" * 8192, b"z" * 8193, (b"q" * 400 + b"\n") * 30, b"\n" * 12, b"a" * 1023 + b"\x0b", b"a" * 1024 + b"\x0b", b"\x7f\x1b\x0c", b"\x1a", "ü".encode() * 150,
]


def _minified(content):
    lines = content[:8192].splitlines()
    if len(content) > 8192 and len(lines) > 1:
        lines = lines[:-1]
    long = sum(len(x) > 200 for x in lines)
    if not lines:
        return False
    return long == len(lines) if len(lines) < 10 else long / len(lines) >= 0.7 and sum(map(len, lines)) / len(lines) > 200


def test_validation_columns_agree_with_plain_code(spark):
    control = {*range(7), 0x0B, *range(0x0E, 0x1B), *range(0x1C, 0x20)}
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, content binary")
    got = {r["i"]: (r["b"], r["m"]) for r in frame.select("i", v.is_binary(F.col("content")).alias("b"), v.is_minified(F.lit("a.js"), F.col("content")).alias("m")).collect()}
    assert got == {i: (any(b in control for b in c[:1024]), _minified(c)) for i, c in enumerate(CASES)}


def test_columns_for_urls_and_names(spark):
    url = spark.createDataFrame([("https://github.com/a/b",), ("git@gitlab.com:a/b",), ("ftp://github.com/a",), ("https://u@GitHub.com:1/x",), ("https://bitbucket.org/x",)], "u string")
    got = [tuple(r) for r in url.select(fn.repository_host(F.col("u")), fn.allowed_host(F.col("u"))).collect()]
    assert got == [("github.com", True), ("gitlab.com", True), (None, False), ("github.com", True), ("bitbucket.org", False)]
    one = spark.range(1).select(fn.clean_parts(F.lit("foo(x.y).bar[1]")), fn.derived_import_name(F.lit('"a/b/c/"')), fn.join_module(F.lit(".."), F.lit("n")), fn.chunk_id(F.lit("p"), F.lit(3), F.lit("ü")))
    import hashlib

    assert list(one.first()) == [["foo", "y)", "bar"], "c", "..n", hashlib.sha1("p:3:ü".encode()).hexdigest()[:16]]
