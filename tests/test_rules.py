"""The array rules of chunking against a walk from the top, on random nested definitions."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.parsing.model import Definition, Source


def tree(rnd, start, end, depth):
    out, at = [], start
    while at + 4 < end and rnd.random() < 0.7:
        stop = rnd.randint(at + 3, end - 1)
        inner = tree(rnd, at + 1, stop, depth + 1) if depth < 4 else []
        out.append((at, stop, inner))
        at = stop + 1
    return out


def walk(nodes, budget, parent=None):
    for start, end, inner in nodes:
        whole = end - start <= budget or not inner
        yield start, "definition" if whole else "definition_skeleton", parent
        if not whole:
            yield from walk(inner, budget, start)


def flat(nodes):
    for start, end, inner in nodes:
        yield start, end
        yield from flat(inner)


def test_chunks_are_those_of_a_walk(spark):
    rnd, rows, expected = random.Random(5), [], {}
    content = b"x" * 400
    for k in range(60):
        nodes = tree(rnd, 0, 400, 0)
        source = Source(content, [Definition("t", f"d{s}", s, e, None, [], f"d{s}", True) for s, e in flat(nodes)])
        source.refs = [(0, f"r{i}", "call", a, a + 1) for i, a in enumerate(rnd.sample(range(399), 20))]
        rows.append({"path": f"f{k}", "language": "python", "content": content, **source.finish()})
        expected[f"f{k}"] = nodes
    from lodestone.operators.parse import _OUT

    parsed = spark.createDataFrame([tuple(r[f.name] for f in _OUT.fields) for r in rows], _OUT)
    annotated = C.annotate(parsed, budget=40, threshold=1000)
    got = {}
    for r in C.chunks(annotated).collect():
        got.setdefault(r["file_path"], []).append(r)
    owners = {(r["file_path"], r["text"]): r["chunk_ord"] for r in C.refs(annotated).collect()}
    for path, nodes in expected.items():
        mine = sorted(got.get(path, []), key=lambda r: r["ord"])
        ids = {r["chunk_id"]: r["start_byte"] for r in mine}
        assert [(r["start_byte"], r["kind"], ids.get(r["parent_chunk_id"])) for r in mine] == list(walk(nodes, 40))
        order = {s: i for i, (s, _) in enumerate(flat(nodes))}
        for r in next(x for x in rows if x["path"] == path)["raw_refs"]:
            holding = [c for c in mine if c["start_byte"] <= r["start"] and r["end"] <= c["end_byte"]]
            inner = max(holding, key=lambda c: c["start_byte"], default=None)
            assert owners.get((path, r["text"])) == (order[inner["start_byte"]] if inner else None)
    assert annotated.where(F.col("file_id").isNotNull()).isEmpty()
