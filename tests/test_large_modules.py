"""Modules that grow with the tables: time in proportion to their size, and a task for each."""

import gc
import time

import pytest
from pyspark.sql import functions as F
from support import SF

from lodestone import queries
from lodestone.operators import chunks as C
from lodestone.operators import parse as P
from lodestone.parsing import python_source
from lodestone.plans import generated as g
from lodestone.plans.repository import ingest
from lodestone.queries import QUERIES


def seconds_of_chunks(spark, n):
    """Of a file of n classes with a method each, parsed before."""
    text = "import os\n" + "".join(f"class S{i}(Base):\n    def m(self, a):\n        return '{'x' * 60}'\n\n\n" for i in range(n))
    files = spark.createDataFrame([("a.py", "python", bytearray(text.encode()))], "path string, language string, content binary")
    parsed = P.parse(files).persist()
    assert parsed.count() == 1
    rows = C.chunks(C.annotate(parsed))
    first = rows.agg(F.count("*"), F.sum(F.size("contained_symbols")), F.sum(F.length("code")))
    at = time.monotonic()
    assert tuple(first.collect()[0])[:2] == (n + 1, n)
    took = time.monotonic() - at
    named = {r["full_name"]: r for r in rows.where(F.col("full_name").isin("S0", f"S{n - 1}")).collect()}
    assert [named[f"S{i}"]["contained_symbols"] for i in (0, n - 1)] == [["S0.m"], [f"S{n - 1}.m"]]
    assert named[f"S{n - 1}"]["code"] in text
    parsed.unpersist()
    return took


def test_chunks_take_time_in_proportion_to_a_files_definitions(spark):
    seconds_of_chunks(spark, 100)  # code is made and compiled
    small, large = seconds_of_chunks(spark, 2_500), seconds_of_chunks(spark, 20_000)
    assert large < 12 * small  # eight times the file; 64 times the work, where each definition copies it


def test_each_module_has_a_task_of_its_own(spark):
    files, listing = g.nation_modules(spark, SF)
    by_task = files.groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in by_task] == [1] * 25
    assert {r["path"] for r in listing.collect()} == {r["path"] for r in files.select("path").collect()}


def test_trees_are_built_without_searching_them_for_cycles(monkeypatch):
    seen = []
    monkeypatch.setattr(P, "front_end", lambda language: lambda content: seen.append(gc.isenabled()) or python_source.parse(content))
    assert P.parse_one("python", b"def f(x):\n    return x\n")["parse_error"] is None
    assert P.parse_one("python", b"def f(:\n")["parse_error"] == "MalformedSourceError"
    assert seen == [False, False] and gc.isenabled()


def test_sources_without_a_hash_sign_are_not_searched_for_comments(monkeypatch):
    monkeypatch.setattr(python_source.tokenize, "generate_tokens", lambda readline: 1 / 0)
    assert [d.name for d in python_source.parse(b"def f(x):\n    return x\n").defs] == ["f"]


@pytest.mark.parametrize("name", ["chunk_kinds", "py_chunks", "status_counts", "file_skeletons", "report_totals", "resolved_refs", "sample_resolved", "sample_unresolved", "skeleton_texts", "symbol_index"])
def test_query_parses_each_module_in_a_task_of_its_own(spark, name):
    assert "shufflepartitionidpassthrough" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_totals_make_no_texts_and_no_ids_of_references(spark):
    plan = optimized(QUERIES["report_totals"](spark, SF)).split("InMemoryRelation")
    assert "decode(" not in plan[0] and plan[0].count("sha1(") <= 1


def test_modules_are_written_once_for_all_conditions_on_them(spark):
    files, _ = g.nation_modules(spark, SF)
    tested = files.where((F.octet_length("content") > 10) & (F.substring("content", 1, 6) == F.lit(b"import")))
    assert optimized(tested).count("encode(") == 1
    assert tested.count() == 25


def test_a_name_is_resolved_once_however_often_a_module_refers_to_it(spark):
    calls = "".join(f"def f{i}(x):\n    return g(x) + self.f{i}(x) + len(x) + selfish(x)\n" for i in range(50))
    text = f"def g(x):\n    return x\nclass A:\n    def m(self):\n        return self.n() + self.n()\n    def n(self):\n        pass\n{calls}g(1)\n"
    files = spark.createDataFrame([("a.py", len(text), bytearray(text.encode()), None)], "path string, length long, content binary, error string")
    r = ingest(files, files.select("path"), ".")
    names = {(x["text"], x["self_class"]): (x["n"], x["status"]) for x in r.counted_names().collect()}
    assert names["g", None] == (51, "local") and names["len", None] == (50, "builtin") and names["self.n", "A"] == (2, "local")
    assert names["self.f7", "f7"] == (1, "local") and names["selfish", "f7"] == (1, "unresolved")
    assert r.totals().first().asDict() == {"files": 1, "chunks": 53, "refs": 203, "local": 103, "external": 0, "builtin": 50, "unresolved": 50}
    every = r.refs.collect()
    assert len(every) == len({x["ord"] for x in every}) == 203
    assert all((x["status"] == "local") == (x["points_to"] is not None) == (x["text"] == "g" or x["text"].startswith("self.")) for x in every)


@pytest.mark.parametrize("source", ["global a, b\nmatch x:\n    case True: f()\n    case {'k': g(), **r}: pass\n", "def f(*, a, b=h()):\n    x: int = k(lambda y=m(): y)\n    {**n(), 1: 2}\n"])
def test_walk_skips_what_is_no_node(source):
    import ast

    source = source.replace("g()", "g.h")
    calls = {ast.unparse(x.func) for x in ast.walk(ast.parse(source)) if isinstance(x, ast.Call)}
    assert {r[1] for r in python_source.parse(source.encode()).refs} == calls


def test_walk_takes_little_more_time_than_the_interpreters_parser():
    import ast

    content = "".join(f"def f{i}(x):\n    return g(x + {i}, [x, 'a', None, x.y.z])\n\n\n" for i in range(10_000))
    least = lambda f, x: min(_seconds(f, x) for _ in range(3))
    assert least(python_source.parse, content.encode()) < 2.1 * least(ast.parse, content)


def _seconds(f, x):
    gc.collect()
    gc.disable()
    at = time.monotonic()
    f(x)
    took = time.monotonic() - at
    gc.enable()
    return took


def test_targets_meet_counted_names_and_not_each_reference(spark):
    plan = optimized(QUERIES["resolved_refs"](spark, SF)).split("InMemoryRelation")
    assert "decode(" not in plan[0]
    text = "def g(x):\n    return x\ndef h(x):\n    return g(g(x))\nclass A(g):\n    pass\ng(1)\ng.k(1)\n"
    files = spark.createDataFrame([("a.py", len(text), bytearray(text.encode()), None)], "path string, length long, content binary, error string")
    r = ingest(files, files.select("path"), ".", skeleton_threshold=10)
    assert {(x["text"], x["kind"], x["n"], x["status"]) for x in r.counted_names("kind").collect()} == {("g", "call", 3, "local"), ("g", "inheritance", 1, "local"), ("g.k", "call", 1, "local")}
    rows = queries._with_targets(r).collect()
    assert {(x["text"], x["kind"], x["n"], x["hits"], x["target_path"]) for x in rows} == {("g", "call", 3, 3, "a.py"), ("g", "inheritance", 1, 1, "a.py"), ("g.k", "call", 1, 1, "a.py")}


SOURCES = {
    "python": "import a\n# c\n@d(1)\nclass A(B):\n    x = f(1)\n    def m(self, y=g()):\n        if y:\n            import b\n            def n():\n                return h()\n        return [k(z) for z in y]\n\n\nwith o() as p:\n    async def q(): pass\nmatch r:\n    case 1:\n        def s(): pass\nt = lambda: u()\n",
    "javascript": "import a from 'b';\nfunction f(x) { return g(x); }\nclass A extends B { m() { return this.n(); } }\n",
    "typescript": "import a from 'b';\nfunction f(x: number): number { return g(x); }\n",
    "go": 'package p\n\nimport "fmt"\n\nfunc f(x int) int {\n\treturn g(x)\n}\n',
}


@pytest.mark.parametrize("language", sorted(SOURCES))
@pytest.mark.parametrize("wanted", ["root", "defs", "raw_imports", "raw_refs"])
def test_a_list_is_the_same_without_the_others(language, wanted):
    content = SOURCES[language].encode()
    full, part = P.parse_one(language, content), P.parse_one(language, content, (wanted,))
    lists = {"root", "defs", "raw_imports", "raw_refs"}
    assert all(full[x] for x in lists)
    assert part == {k: v if k == wanted or k not in lists else None for k, v in full.items()}


@pytest.mark.parametrize("name", ["file_skeletons", "skeleton_texts", "symbol_index"])
def test_query_over_one_table_keeps_no_parsed_files(spark, name):
    frame = QUERIES[name](spark, SF)
    assert "InMemoryRelation" not in optimized(frame)


def test_index_is_made_without_texts(spark):
    plan = optimized(QUERIES["symbol_index"](spark, SF)).split("MapInArrow")[0]
    assert "defs" in plan and not any(x in plan for x in ("decode(", "sha1(", "root", "raw_refs"))


def test_texts_of_skeletons_are_made_without_those_of_whole_definitions(spark):
    frame = QUERIES["skeleton_texts"](spark, SF)
    plan = optimized(frame).split("MapInArrow")[0]
    assert "root" not in plan and "sha1(" not in plan and "kind" not in plan.replace("kinds", "")
    rows = frame.collect()
    everything = g.nations(spark, SF).plain_chunks.where("kind = 'definition_skeleton'").select("full_name", "code").collect()
    assert rows and sorted(rows) == sorted(everything)


def test_overviews_need_neither_definitions_nor_their_texts(spark):
    plan = optimized(QUERIES["file_skeletons"](spark, SF)).split("MapInArrow")[0]
    assert "root" in plan and "decode(" not in plan and "defs" not in plan


@pytest.mark.parametrize("name", ["sample_resolved", "sample_unresolved"])
def test_samples_are_made_without_ids_of_references_chunks(spark, name):
    plan = optimized(QUERIES[name](spark, SF)).split("InMemoryRelation")
    assert plan[0].count("sha1(") <= 1 and "decode(" not in plan[0]
    status, n = {"sample_resolved": ("local", 10), "sample_unresolved": ("unresolved", 20)}[name]
    refs = [r for r in g.nations(spark, SF).refs.collect() if r["status"] == status]
    expected = sorted((r["file_path"], r["chunk_ord"], r["ord"], r["chunk_name"], r["text"]) for r in refs)[:n]
    assert [tuple(r) for r in QUERIES[name](spark, SF).collect()] == [(e[0], e[3], e[4]) for e in expected]
