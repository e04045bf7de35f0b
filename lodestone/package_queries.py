"""Queries over the generated packages: classes, skeletons, imports and references in four languages, with their SQL.

What the files hold is given to SQL as text; places follow from where a text begins and ends in it.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import packages as g
from .plans.repository import chunk_repository


def package_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.packages(spark, sf_dir).plain_chunks.where("kind <> 'file_skeleton'")
    return rows.select(
        "chunk_id", "file_path", "full_name", "name", "kind", "node_type", "defined_in_class", "language", "start_byte", "end_byte", "start_line", "end_line", "parent_chunk_id", "code", F.array_join("contained_symbols", ",").alias("contained")
    )


def package_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.packages(spark, sf_dir).plain_chunks.where("kind = 'file_skeleton'")
    return rows.select("chunk_id", "file_path", "full_name", "name", "start_line", "end_line", "code", F.col("size_chars").cast("long").alias("size_chars"))


def package_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = g.packages(spark, sf_dir)
    targets = r.plain_chunks.select(F.col("chunk_id").alias("points_to"), F.col("full_name").alias("target"), F.col("file_path").alias("target_path"))
    return r.refs.join(targets, "points_to", "left").select("file_path", "chunk_name", "text", "kind", "status", "target", "target_path")


def package_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.packages(spark, sf_dir).import_bindings


def package_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = g.packages(spark, sf_dir)
    ranges = F.array_join(F.transform("import_ranges", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    wild = r.wildcards.select("file_path", F.array_join("modules", ",").alias("wildcards"))
    return r.files.select("file_path", "import_text", ranges.alias("ranges")).join(wild, "file_path", "left")


def package_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.packages(spark, sf_dir).skipped


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree on disk, one folder a region, read through the sources: what is listed, read, skipped and cut into chunks.

    The tree lies in the folder that driver and executors share, or on this machine where all runs on it; it has the five
    regions' folders whatever the scale.
    """
    root = os.path.join(_mounted(spark), f"lodestone-tree-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    for row in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect():
        for name, text in _TREE.items():
            path = os.path.join(root, f"r{row['r_regionkey']}", name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text.replace("KEY", row["r_name"].title().replace(" ", "")))
    r = chunk_repository(spark, root, max_size_mb=200 / 1024 / 1024, skeleton_threshold=100)
    chunks = r.plain_chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "definition", F.col("full_name")))), ",").alias("names"))
    own = lambda c: F.substring(c, len(root) + 2, 10_000)
    files = r.checked.select("path", "length", F.sha1("content").alias("sha1")).join(r.skipped.toDF("path", "reason"), "path", "left").join(chunks.withColumnRenamed("file_path", "path"), "path", "left")
    total = r.listing.agg(F.sum("length").alias("tree_bytes"))
    return files.crossJoin(F.broadcast(total)).select(own(F.col("path")).alias("path"), "length", "sha1", "reason", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("names", F.lit("")).alias("names"), "tree_bytes")


def _mounted(spark: SparkSession) -> str:
    """A folder that all of them see as a path."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared and shared.startswith(("file:", "/")):
        return "/" + shared.removeprefix("file:").lstrip("/")
    if not shared and spark.sparkContext.master.startswith("local["):
        return tempfile.gettempdir()
    raise RuntimeError("spark.checkpoint.dir must name a mounted folder that the driver and all executors share")


_TREE = {
    "__init__.py": "from ._inner import KEY\n",
    "_inner.py": "class KEY:\n    def name(self):\n        return 'KEY'\n",
    "lib/a.js": "class KEY { say() { return 1; } }\n",
    "lib/b.PY": "x = 1\n",
    "lib/c.go": "package lib\n\nfunc KEY() {}\n",
    "lib/long.ts": "export function KEY(): void {}\n" + "// " + "x" * 300 + "\n",
    "lib/bin.py": "x = '\x01'\n",
    "lib/none.py": "",
    "node_modules/d.js": "function KEY() {}\n",
    ".git/e.py": "KEY = 1\n",
    "broken.go": "package lib\nfunc {\n",
}

QUERIES = {f.__name__: f for f in (package_chunks, package_overviews, package_refs, package_bindings, package_imports, package_skips, scanned_files)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\x01", "' || chr(1) || '") + "'"


def _values(rows: list[tuple]) -> str:
    return ",\n  ".join("(" + ", ".join("NULL" if x is None else _quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_FILES = f"""
WITH t(name, text) AS (VALUES
  {_values(list(g.FILES.items()))}
), f AS (
  SELECT s_suppkey::VARCHAR AS k, 'r' || s_suppkey || '/' || name AS path, name AS file, replace(text, 'KEY', s_suppkey::VARCHAR) AS content FROM supplier, t
)
"""

#: file, full name, name, node type, class, first text, last text, skeleton (null: whole), parent (null: none, '': the file), contained
_DEFINITIONS = [
    ("base.py", "Base", "Base", "class_definition", None, "class Base", "return 1", None, None, "Base.run"),
    ("base.py", "helper", "helper", "function_definition", None, "def helper", "return x", None, None, ""),
    ("tools/deep.py", "dig", "dig", "function_definition", None, "def dig", "return x", None, None, ""),
    ("tools/deep.py", "bury", "bury", "function_definition", None, "def bury", "return x", None, None, ""),
    (
        "app.py", "App", "App", "class_definition", None, "@wrap", "far(x)",
        '@wrap(helper(1))\nclass App(Root):\n    """Application."""\n    # moves\n    def go(self, x):...\n    async def stop(self, x=aid(2)):...', "", "",
    ),
    ("app.py", "App.go", "go", "function_definition", "App", "def go", "tools.dig(x)", None, "App", ""),
    ("app.py", "App.stop", "stop", "function_definition", "App", "async def stop", "far(x)", None, "App", ""),
    ("app.py", "late", "late", "function_definition", None, "def late", ".go(x)", None, "", ""),
    ("web.js", "View", "View", "class_declaration", None, "class View", "};\n}", "class View extends B\n    {\n    size = 1\n    ;\n    draw(a)...\n    paint(a)...\n    grow = (a) => {\n    draw(a);\n    return other(a);\n  }...\n    ;\n    }\n}", "", ""),
    ("web.js", "View.draw", "draw", "method_definition", "View", "draw(a) {", "return def(a);\n  }", None, "View", ""),
    ("web.js", "View.paint", "paint", "method_definition", "View", "paint(a) {", "parseInt(a);\n  }", None, "View", ""),
    ("web.js", "View.grow", "grow", "field_definition", "View", "grow =", "return other(a);\n  }", None, "View", ""),
    ("web.js", "make", "make", "variable_declarator", None, "make =", "View(x)", None, "", ""),
    ("web.ts", "Area", "Area", "interface_declaration", None, "interface Area", "size(): number;\n}", None, "", ""),
    (
        "web.ts", "Box", "Box", "class_declaration", None, "class Box", "};\n}",
        "class Box extends Api.Base implements Area\n    {\n    private side: number = KEY\n    ;\n    constructor(side: number)...\n    size(): number...\n    private check = (x: number): number => {\n    return area(x);\n  }...\n    ;\n    }\n}", "", "",
    ),
    ("web.ts", "Box.constructor", "constructor", "method_definition", "Box", "constructor(", "check(side);\n  }", None, "Box", ""),
    ("web.ts", "Box.size", "size", "method_definition", "Box", "size(): number {", "(1);\n  }", None, "Box", ""),
    ("web.ts", "Box.check", "check", "public_field_definition", "Box", "private check", "return area(x);\n  }", None, "Box", ""),
    ("web.ts", "area", "area", "function_declaration", None, "function area", ".size();\n}", None, "", ""),
    ("main.go", "Engine", "Engine", "type_declaration", None, "type Engine", "name string\n}", None, None, ""),
    ("main.go", "Engine.Start", "Start", "method_declaration", "Engine", "func (e *Engine)", "Twice(n)\n}", None, None, ""),
    ("main.go", "Twice", "Twice", "function_declaration", None, "func Twice", "append(n)\n}", None, None, ""),
]

#: file, owner, text, kind, status, target, file of the target
_REFERENCES = [
    ("app.py", "app.py", "len", "call", "builtin", None, None),
    ("app.py", "App", "wrap", "call", "unresolved", None, None),
    ("app.py", "App", "helper", "call", "unresolved", None, None),  # of "helper, helper as aid" the last binding stays
    ("app.py", "App", "Root", "inheritance", "local", "Base", "base.py"),
    ("app.py", "go", "self.run", "call", "local", "App", "app.py"),
    ("app.py", "go", "self.go", "call", "local", "App.go", "app.py"),
    ("app.py", "go", "dig", "call", "local", "helper", "base.py"),  # the later import
    ("app.py", "go", "bury", "call", "local", "bury", "tools/deep.py"),  # by the wildcard
    ("app.py", "go", "d.bury", "call", "local", "bury", "tools/deep.py"),
    ("app.py", "go", "tools.dig", "call", "unresolved", None, None),  # bound in the package, not defined there
    ("app.py", "stop", "aid", "call", "local", "helper", "base.py"),
    ("app.py", "stop", "rKEY.tools.deep.bury", "call", "local", "bury", "tools/deep.py"),
    ("app.py", "stop", "system.exit", "call", "external", None, None),
    ("app.py", "stop", "go", "call", "local", "App.go", "app.py"),  # by its simple name
    ("app.py", "stop", "lost", "call", "unresolved", None, None),
    ("app.py", "stop", "far", "call", "unresolved", None, None),
    ("app.py", "late", "App", "call", "local", "App", "app.py"),
    ("app.py", "late", "App(x).go", "call", "local", "App.go", "app.py"),
    ("web.js", "View", "B", "inheritance", "external", None, None),
    ("web.js", "draw", "this.paint", "call", "local", "View.paint", "web.js"),
    ("web.js", "draw", "def", "call", "external", None, None),
    ("web.js", "paint", "ns.show", "call", "external", None, None),
    ("web.js", "paint", "parseInt", "call", "builtin", None, None),
    ("web.js", "grow", "draw", "call", "local", "View.draw", "web.js"),
    ("web.js", "grow", "other", "call", "external", None, None),
    ("web.js", "make", "View", "call", "local", "View", "web.js"),
    ("web.js", "web.js", "make", "call", "local", "make", "web.js"),
    ("web.ts", "Box", "Api.Base", "inheritance", "external", None, None),
    ("web.ts", "constructor", "this.check", "call", "local", "Box.check", "web.ts"),
    ("web.ts", "size", "Math.abs", "call", "unresolved", None, None),
    ("web.ts", "size", "this.check", "call", "local", "Box.check", "web.ts"),
    ("web.ts", "check", "area", "call", "local", "area", "web.ts"),
    ("web.ts", "area", "Box", "call", "local", "Box", "web.ts"),
    ("web.ts", "area", "new Box(x).size", "call", "unresolved", None, None),
    ("main.go", "Engine", "Part", "inheritance", "unresolved", None, None),
    ("main.go", "Start", "fmt.Println", "call", "external", None, None),
    ("main.go", "Start", "len", "call", "builtin", None, None),
    ("main.go", "Start", "text.Trim", "call", "external", None, None),
    ("main.go", "Start", "e.Stop", "call", "unresolved", None, None),
    ("main.go", "Start", "Twice", "call", "local", "Twice", "main.go"),
    ("main.go", "Twice", "f", "call", "unresolved", None, None),
    ("main.go", "Twice", "append", "call", "builtin", None, None),
]

#: file, local name, file of the module, remote name, kind, extra segments
_BINDINGS = [
    ("app.py", "rKEY", "tools/deep.py", "rKEY", "module", 2),
    ("app.py", "system", None, "system", "module", 0),
    ("app.py", "Root", "base.py", "Base", "named", 0),
    ("app.py", "aid", "base.py", "helper", "named", 0),
    ("app.py", "tools", "tools/__init__.py", "tools", "module", 0),
    ("app.py", "d", "tools/deep.py", "deep", "module", 0),
    ("app.py", "dig", "base.py", "helper", "named", 0),
    ("app.py", "far", "tools/__init__.py", "dig", "named", 0),
    ("tools/__init__.py", "dig", "tools/deep.py", "dig", "named", 0),
    ("web.js", "B", None, "Base", "named", 0),
    ("web.js", "other", None, "other", "named", 0),
    ("web.js", "def", None, "def", "named", 0),
    ("web.js", "ns", None, "ns", "named", 0),
    ("web.ts", "Shape", None, "Shape", "named", 0),
    ("web.ts", "Api", None, "Api", "named", 0),
    ("main.go", "fmt", None, "fmt", "module", 0),
    ("main.go", "text", None, "v2", "module", 0),
]

#: file, overview behind its first line
_OVERVIEWS = [
    (
        "app.py",
        'import rKEY.tools.deep\nimport os as system\nfrom .base import Base as Root, helper, helper as aid\nfrom . import tools\nfrom .tools import deep as d\nfrom .tools.deep import dig\nfrom .tools.deep import *\nfrom .base import helper as dig\n'
        'from ..rKEY.tools import dig as far\n# entry\nLIMIT = len("KEY")\n@wrap(helper(1))\nclass App(Root):...\nif LIMIT:\n    def late(x):\n        return App(x).go(x)',
    ),
    ("web.js", "import { Base as B, other } from './base';\nimport def, * as ns from \"lib\";\nimport './side';\n// a view\nclass View extends B...\nconst make = (x) => new View(x);\nconst key = 'KEY';\nmake(key);"),
    (
        "web.ts",
        'import type { Shape } from "./shape";\nimport Api from "api";\nexport interface Area {\n  size(): number;\n}\nexport class Box extends Api.Base implements Area {\n  private side: number = KEY;\n  constructor(side: number) {\n    super(side);\n    this.check(side);\n  }\n'
        "  size(): number {\n    return Math.abs(this.side) + this.check<number>(1);\n  }\n  private check = (x: number): number => {\n    return area(x);\n  };\n}\nexport function area(x: number): number {\n  return new Box(x).size();\n}",
    ),
]

#: file, first and last text of each import statement
_IMPORTS = [
    ("app.py", 1, "import rKEY", "deep"), ("app.py", 2, "import os", "system"), ("app.py", 3, "from .base import Base", "aid"), ("app.py", 4, "from . import", "tools"), ("app.py", 5, "from .tools import deep", " d"),
    ("app.py", 6, "from .tools.deep import dig", "import dig"), ("app.py", 7, "from .tools.deep import *", "*"), ("app.py", 8, "from .base import helper", " dig"), ("app.py", 9, "from ..r", " far"),
    ("tools/__init__.py", 1, "from", "import dig"),
    ("web.js", 1, "import {", ";"), ("web.js", 2, "import def", ";"), ("web.js", 3, "import './side", ";"),
    ("web.ts", 1, "import type", ";"), ("web.ts", 2, "import Api", ";"),
    ("main.go", 1, "import (", "\n)"),
]

_ID = "substr(sha1(path || ':' || start || ':' || full_name), 1, 16)"
_FILE_ID = "substr(sha1(path || ':0:<file_skeleton:' || path || '>'), 1, 16)"
_DEFS = f"""{_FILES}, d(file, full_name, name, node_type, cls, first, last, skeleton, parent, contained) AS (VALUES
  {_values(_DEFINITIONS)}
), p AS (
  SELECT f.*, d.* EXCLUDE (file), strpos(content, first) - 1 AS start FROM f JOIN d USING (file)
), q AS (
  SELECT *, start + strpos(substr(content, start + 1), last) - 1 + length(last) AS stop, {_ID} AS id FROM p
)
"""
_LINE = "length({0}) - length(replace({0}, chr(10), '')) + 1"

ORACLE_SQL = {
    "package_chunks": _DEFS
    + f"""
SELECT q.id AS chunk_id, q.path AS file_path, q.full_name, q.name, CASE WHEN q.skeleton IS NULL THEN 'definition' ELSE 'definition_skeleton' END AS kind, q.node_type, q.cls AS defined_in_class,
       CASE WHEN q.path LIKE '%.py' THEN 'python' WHEN q.path LIKE '%.js' THEN 'javascript' WHEN q.path LIKE '%.ts' THEN 'typescript' ELSE 'go' END AS language,
       q.start::INTEGER AS start_byte, q.stop::INTEGER AS end_byte, ({_LINE.format("substr(q.content, 1, q.start)")})::INTEGER AS start_line, ({_LINE.format("substr(q.content, 1, q.stop)")})::INTEGER AS end_line,
       CASE WHEN q.parent = '' THEN substr(sha1(q.path || ':0:<file_skeleton:' || q.path || '>'), 1, 16) ELSE o.id END AS parent_chunk_id,
       coalesce(replace(q.skeleton, 'KEY', q.k), substr(q.content, q.start + 1, q.stop - q.start)) AS code, q.contained
FROM q LEFT JOIN q o ON o.path = q.path AND o.full_name = q.parent
""",
    "package_overviews": f"""{_FILES}, o(file, said) AS (VALUES
  {_values(_OVERVIEWS)}
), v AS (
  SELECT f.*, '# file: ' || path || chr(10) || replace(said, 'KEY', k) AS code FROM f JOIN o USING (file)
)
SELECT {_FILE_ID} AS chunk_id, path AS file_path, path AS full_name, file AS name, 1::INTEGER AS start_line, ({_LINE.format("content")})::INTEGER AS end_line, code, length(code) AS size_chars FROM v
""",
    "package_refs": f"""{_FILES}, r(file, owner, text, kind, status, target, target_file) AS (VALUES
  {_values(_REFERENCES)}
)
SELECT path AS file_path, owner AS chunk_name, replace(text, 'KEY', k) AS text, kind, status, target, 'r' || k || '/' || target_file AS target_path FROM f JOIN r USING (file)
""",
    "package_bindings": f"""{_FILES}, b(file, local_name, module_file, remote_name, kind, extra_segments) AS (VALUES
  {_values(_BINDINGS)}
)
SELECT path AS file_path, replace(local_name, 'KEY', k) AS local_name, 'r' || k || '/' || module_file AS resolved_path, replace(remote_name, 'KEY', k) AS remote_name, kind, extra_segments::INTEGER AS extra_segments FROM f JOIN b USING (file)
""",
    "package_imports": f"""{_FILES}, i(file, nth, first, last) AS (VALUES
  {_values(_IMPORTS)}
), s AS (
  SELECT f.*, nth, replace(last, 'KEY', k) AS last, strpos(content, replace(first, 'KEY', k)) - 1 AS start FROM f JOIN i USING (file)
), e AS (
  SELECT *, start + CASE WHEN nth = 7 THEN length('from .tools.deep import *') WHEN nth = 5 THEN length('from .tools import deep as d') ELSE strpos(substr(content, start + 1), last) - 1 + length(last) END AS stop FROM s
), a AS (
  SELECT path, string_agg(substr(content, start + 1, stop - start), chr(10) ORDER BY nth) AS import_text, string_agg(start || '-' || stop, ',' ORDER BY nth) AS ranges FROM e GROUP BY path
)
SELECT f.path AS file_path, coalesce(import_text, '') AS import_text, coalesce(ranges, '') AS ranges, CASE WHEN file = 'app.py' THEN 'r' || k || '/tools/deep.py' END AS wildcards
FROM f LEFT JOIN a USING (path) WHERE file NOT LIKE 'bad.%' AND file NOT IN ('empty.py', 'notes.txt')
""",
    "package_skips": _FILES
    + """
SELECT path AS file_path, CASE file WHEN 'empty.py' THEN 'empty' WHEN 'notes.txt' THEN 'UnsupportedFileExtensionError' ELSE 'MalformedSourceError' END AS reason
FROM f WHERE file LIKE 'bad.%' OR file IN ('empty.py', 'notes.txt')
""",
    "scanned_files": f"""
WITH t(name, text, reason, chunks, names) AS (VALUES
  {_values([(name, text, *_SCANNED) for name, text, _SCANNED in ((n, x, {
      "__init__.py": (None, 0, ""), "_inner.py": (None, 1, "KEY"), "lib/a.js": (None, 1, "KEY"), "lib/c.go": (None, 1, "KEY"), "lib/long.ts": ("oversized", 0, ""), "lib/bin.py": ("binary", 0, ""),
      "lib/none.py": ("empty", 0, ""), "broken.go": ("MalformedSourceError", 0, ""),
  }.get(n, (None, 0, ""))) for n, x in _TREE.items())])}
), f AS (
  SELECT name, 'r' || r_regionkey || '/' || name AS path, replace(text, 'KEY', w) AS content, reason, chunks, replace(names, 'KEY', w) AS names
  FROM (SELECT r_regionkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), '') AS w FROM region), t
)
SELECT path, strlen(content)::BIGINT AS length, CASE WHEN reason IN ('oversized', 'empty') THEN NULL ELSE sha1(content) END AS sha1, reason, chunks::BIGINT AS chunks, names, (SELECT sum(strlen(content)) FROM f)::BIGINT AS tree_bytes
FROM f WHERE name NOT IN ('lib/b.PY', 'node_modules/d.js', '.git/e.py')
""",
}
