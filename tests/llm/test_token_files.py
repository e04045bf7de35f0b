import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from support import SF
from tokenizers import Tokenizer

from lodestone.llm import token_files as t
from lodestone.llm._text import byte_chunks


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("most", [1, 300, 50_257, 2**32])
def test_blocks_round_trip(n, most):
    rng = np.random.default_rng(n + most)
    ids = rng.integers(0, most, n)
    ids[rng.random(n) < 0.05] = most - 1
    data, lengths = t.pack_blocks(ids)
    starts = np.cumsum(lengths) - lengths
    assert np.array_equal(t.unpack_blocks(data, starts), ids)
    if n == 1000:  # a block can be read alone
        assert np.array_equal(t.unpack_blocks(data, starts[3:4]), ids[384:512])


def test_query_gives_what_the_library_gives(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in t.op3_token_files(spark, SF).collect()}
    start = 0
    for (i, _), e in zip(docs, library().encode_batch([x for _, x in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab '\n\té1<|endoftx>"), st.just("a <|endoftext|> b")), max_size=6))
def test_ids_are_those_of_the_whole_text(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for _, _, data, offsets in byte_chunks(pa.array(texts, pa.string())):
        ids, counts = t.library_ids(data, offsets, path)
        expected = [library_once().encode(x, add_special_tokens=False).ids for x in texts]
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == expected


library_once = functools.cache(library)


def test_odd_documents(spark, odd_documents, no_documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = t.read_token_files(t.write_token_files(odd_documents, path)).collect()
    assert sorted(r["start"] for r in rows)[0] == 0 and len(rows) == 10
    order = sorted(rows, key=lambda r: r["start"])
    assert order[0]["doc_id"] is None and [r["doc_id"] for r in order[1:]] == [1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert [r["n_tokens"] for r in order[1:3]] == [1, 1]
    assert t.read_token_files(t.write_token_files(no_documents, path)).count() == 0
