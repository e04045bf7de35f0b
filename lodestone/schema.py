"""Schemas and vocabularies of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

DEFINITION, DEFINITION_SKELETON, FILE_SKELETON = "definition", "definition_skeleton", "file_skeleton"
CALL, INHERITANCE = "call", "inheritance"
LOCAL, EXTERNAL, BUILTIN, UNRESOLVED = "local", "external", "builtin", "unresolved"
MODULE, NAMED = "module", "named"
EMPTY, OVERSIZED, BINARY, MINIFIED, UNKNOWN = "empty", "oversized", "binary", "minified", "unknown"

FILES = "path string, length long, content binary, error string"
LISTING = "path string, is_dir boolean, length long"

_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind] if isinstance(kind, str) else kind) for name, kind in fields.items()])


#: A line of a skeleton: the signature of a definition or a text as it is.
PART = _struct(text="string", sig="string")
#: A definition as a front end reports it.  ``id`` is its place in document order; ``parent`` is -1 at the top.
PARSED_DEFINITION = _struct(
    id="int", parent="int", ancestors="ints", nested="int", type="string", name="string", enclosing_class="string", namespace="strings",
    start="int", end="int", start_line="int", end_line="int", sig="string", has_body="boolean", body=T.ArrayType(PART),
)
PARSED_REF = _struct(**{"ord": "int", "text": "string", "kind": "string", "start": "int", "end": "int", "def": "int"})
PARSED_IMPORT = _struct(ord="int", stmt="int", start="int", end="int", form="string", module="string", relative="boolean", bound="string", alias="string", extra="int")
PARSED = T.StructType(
    [
        T.StructField("parse_error", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("defs", T.ArrayType(PARSED_DEFINITION)),
        T.StructField("raw_refs", T.ArrayType(PARSED_REF)),
        T.StructField("raw_imports", T.ArrayType(PARSED_IMPORT)),
        T.StructField("root", T.ArrayType(PART)),
    ]
)

CHUNK_COLUMNS = (
    "chunk_id full_name name file_path start_byte end_byte start_line end_line language code defined_in_class node_type kind "
    "size_chars parent_chunk_id references contained_symbols"
).split()
