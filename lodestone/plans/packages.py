"""Source trees of one package a supplier, in four languages, for queries about classes, imports and skeletons.

Texts are templates; ``KEY`` stands for the supplier's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repository import Repository, ingest

#: Bytes up to which a definition is one chunk, and from which on a file has an overview.
BUDGET, THRESHOLD = 160, 300

FILES = {
    "__init__.py": "VERSION = KEY\n",
    "base.py": "class Base:\n    def run(self):\n        return 1\n\n\ndef helper(x):\n    return x\n",
    "tools/__init__.py": "from .deep import dig\n",
    "tools/deep.py": "def dig(x):\n    return x\n\n\ndef bury(x):\n    return x\n",
    "app.py": '''import rKEY.tools.deep
import os as system
from .base import Base as Root, helper, helper as aid
from . import tools
from .tools import deep as d
from .tools.deep import dig
from .tools.deep import *
from .base import helper as dig
from ..rKEY.tools import dig as far

# entry
LIMIT = len("KEY")


@wrap(helper(1))
class App(Root):
    """Application."""

    # moves
    def go(self, x):
        self.run()
        self.go(x)
        dig(x)
        bury(x)
        d.bury(x)
        tools.dig(x)

    async def stop(self, x=aid(2)):
        rKEY.tools.deep.bury(x)
        system.exit(x)
        go(x)
        lost(x)
        far(x)


if LIMIT:
    def late(x):
        return App(x).go(x)
''',
    "web.js": """import { Base as B, other } from './base';
import def, * as ns from "lib";
import './side';

// a view
class View extends B {
  size = 1;
  draw(a) {
    this.paint(a);
    return def(a);
  }
  paint(a) {
    return ns.show(a) + parseInt(a);
  }
  grow = (a) => {
    draw(a);
    return other(a);
  };
}

const make = (x) => new View(x);
const key = 'KEY';
make(key);
""",
    "web.ts": """import type { Shape } from "./shape";
import Api from "api";

export interface Area {
  size(): number;
}

export class Box extends Api.Base implements Area {
  private side: number = KEY;
  constructor(side: number) {
    super(side);
    this.check(side);
  }
  size(): number {
    return Math.abs(this.side) + this.check<number>(1);
  }
  private check = (x: number): number => {
    return area(x);
  };
}

export function area(x: number): number {
  return new Box(x).size();
}
""",
    "main.go": """package main

import (
\t"fmt"
\ttext "strings/v2"
)

type Engine struct {
\tPart
\tname string
}

func (e *Engine) Start(n int) int {
\tfmt.Println(len(e.name), text.Trim("KEY"))
\treturn e.Stop(n) + Twice(n)
}

func Twice(n int) int {
\tf := func(k int) int { return k * KEY }
\treturn f(n) + append(n)
}
""",
    "notes.txt": "not a source\n",
    "bad.js": "let x = = KEY;\n",
    "bad.ts": "class {\n  m( { }\n}\n",
    "bad.go": "package p\nfunc f() {\n\tfoo bar\n}\n",
    "bad.py": "def f(:\n    pass\n",
    "empty.py": "",
}


def package_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files and listing: the same files for every supplier, below a folder of its own."""
    key = F.col("s_suppkey").cast("string")
    names = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in FILES.items()))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("k"), F.explode(names).alias("f"))
    files = rows.select(F.concat(F.lit("r"), "k", F.lit("/"), F.col("f.name")).alias("path"), F.encode(F.replace("f.text", F.lit("KEY"), F.col("k")), "UTF-8").alias("content"))
    files = files.select("path", F.octet_length("content").cast("long").alias("length"), "content", F.lit(None).cast("string").alias("error"))
    return files, files.select("path")


def packages(spark: SparkSession, sf_dir: str) -> Repository:
    files, listing = package_files(spark, sf_dir)
    return ingest(files, listing, ".", skeleton_threshold=THRESHOLD, budget=BUDGET)
