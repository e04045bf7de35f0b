"""Source trees made of table rows, so that what ingesting them must give follows from the rows in SQL."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .repository import Repository, ingest

#: Tasks that modules are dealt to, as many as there are nations.
MODULES = 25
#: Bytes up to which a generated class is one chunk; about half of them are longer.
BUDGET = 350


def _class(key: Column, pad: Column) -> Column:
    """A class of a supplier, as long as its pad."""
    return F.concat(
        F.lit("class S"), key.cast("string"), F.lit("(Base):\n    def m(self, a):\n        pad = '"), F.repeat(F.lit("x"), pad),
        F.lit("'\n        self.n(a)\n        return nxt(a)\n\n    def n(self, a):\n        return os.path.join(a, helper(a), unknown_fn(a))\n\n\n"),
    )


def nation_modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files and listing: one Python module a nation, with a class for each supplier and a function for each customer."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pad = (F.floor(F.abs("s_acctbal")) % 400).cast("int")
    classes = (
        read("supplier")
        .select(F.col("s_nationkey").alias("k"), "s_suppkey", _class(F.col("s_suppkey"), pad).alias("code"))
        .groupBy("k")
        .agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "code"))).alias("classes"))
    )
    functions = read("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list("c_custkey")).alias("customers"))
    key = F.col("n_nationkey")
    head = F.concat(
        F.lit("import os\nfrom n"), ((key + 1) % 25).cast("string"), F.lit(" import helper as nxt\nfrom n"), ((key + 2) % 25).cast("string"),
        F.lit(" import *\n\n\ndef helper(x):\n    return len(x)\n\n\n"),
    )
    first = F.concat(F.lit("S"), F.element_at("classes", 1)["s_suppkey"].cast("string"))
    one = lambda c: F.concat(F.lit("def f_"), c.cast("string"), F.lit("(x):\n    return "), first, F.lit("(x).m(x)\n\n\n"))
    body = F.when(F.col("classes").isNotNull(), F.concat(F.array_join(F.transform("classes", lambda c: c["code"]), ""), F.coalesce(F.array_join(F.transform("customers", one), ""), F.lit(""))))
    rows = read("nation").join(classes, F.col("n_nationkey") == classes["k"], "left").join(functions, F.col("n_nationkey") == functions["k"], "left")
    path = F.concat(F.lit("n"), key.cast("string"), F.lit(".py")).alias("path")
    # a module grows with the tables, its parser takes one at a time: each goes to a task of its own, where it is written
    # once; conditions on a generator's column aren't moved in front of it, with the column made anew for each use
    rows = rows.repartitionById(MODULES, F.pmod(key, F.lit(MODULES)).cast("int"))
    files = rows.select(path, F.explode(F.array(F.encode(F.concat(head, F.coalesce(body, F.lit(""))), "UTF-8"))).alias("content"))
    files = files.select("path", F.octet_length("content").cast("long").alias("length"), "content", F.lit(None).cast("string").alias("error"))
    return files, read("nation").select(path)


def nations(spark: SparkSession, sf_dir: str, only: Collection[str] | None = None) -> Repository:
    files, listing = nation_modules(spark, sf_dir)
    return ingest(files, listing, ".", budget=BUDGET, only=only)


def part_files(spark: SparkSession, sf_dir: str) -> Repository:
    """One small file a part, in one of the four languages, with one function that calls another."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kinds = [
        (".py", F.concat(F.lit("def f"), key, F.lit("(x):\n    return g"), size, F.lit("(x)\n"))),
        (".js", F.concat(F.lit("const f"), key, F.lit(" = (x) => g"), size, F.lit("(x);\n"))),
        (".ts", F.concat(F.lit("export function f"), key, F.lit("(x: number): number {\n  return g"), size, F.lit("(x);\n}\n"))),
        (".go", F.concat(F.lit("package p\n\nfunc f"), key, F.lit("(x int) int {\n\treturn g"), size, F.lit("(x)\n}\n"))),
    ]
    extension, code = F.lit(None), F.lit(None)
    for i, (ext, text) in enumerate(kinds):
        mine = F.col("p_partkey") % 4 == i
        extension, code = F.when(mine, ext).otherwise(extension), F.when(mine, text).otherwise(code)
    files = part.select(F.concat(F.lit("p/f"), key, extension).alias("path"), F.encode(code, "UTF-8").alias("content"))
    files = files.select("path", F.octet_length("content").cast("long").alias("length"), "content", F.lit(None).cast("string").alias("error"))
    return ingest(files, files.select("path"), ".")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: some named like minified ones, some empty, some with a control byte."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    path = F.concat(F.lit("d/"), i.cast("string"), F.when(i % 50 == 7, ".min.js").otherwise(".py"))
    text = F.when(i % 41 == 3, "").when(i % 37 == 5, F.concat(F.lit("\u0001"), "text")).otherwise(F.col("text"))
    files = docs.select(i, path.alias("path"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))
    return files.withColumn("length", F.octet_length("content").cast("long")).withColumn("error", F.lit(None).cast("string"))
