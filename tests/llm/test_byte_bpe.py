import base64
import random

import public_tokenizers
import regex
import tiktoken
from support import SF

from lodestone.llm import byte_bpe as b
from lodestone.llm import pretokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_those_of_the_pattern():
    import numpy as np

    rnd, rule = random.Random(3), regex.compile(public_tokenizers.PATTERN)
    for _ in range(100):
        texts = ["".join(rnd.choice("  \n\t''''strevelmdxZ1.é漢 !,") for _ in range(rnd.randint(0, 40))) for _ in range(30)]
        coded = [t.encode() for t in texts]
        text, starts, ends, first, _, _, _ = pretokens.pieces(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
        for i, t in enumerate(texts):
            assert [text[starts[k] : ends[k]] for k in range(first[i], first[i + 1])] == rule.findall(t)


def test_both_ways_of_merging_agree():
    ranks, rnd = b.Ranks(PATH), random.Random(4)
    for _ in range(200):
        piece = bytes(rnd.choice(b"aethinrs ABC\xc3\xa9") for _ in range(rnd.randint(1, 60)))
        assert ranks._merge_short(piece) == ranks._merge_long(piece)


def test_query_gives_what_the_library_gives(spark):
    import hashlib

    encoding = library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in b.op10_byte_bpe(spark, SF).collect()}
    for i, text in docs.items():
        ids = encoding.encode_ordinary(text)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_documents(spark, odd_documents, no_documents):
    encoding = library()
    rows = b.decode(b.encode(odd_documents.withColumnRenamed("score", "token_ids"), PATH), PATH).collect()
    for r in rows:
        text = r["text"] or ""
        assert list(r["token_ids"]) == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert not r["token_ends"] or r["token_ends"][-1] == len(text.encode())
        assert [bytes(text.encode()[s:e]) for s, e in zip([0, *r["token_ends"]], r["token_ends"])] == [encoding.decode_single_token_bytes(i) for i in r["token_ids"]]
    assert len(rows) == 10
    assert b.decode(b.encode(no_documents, PATH), PATH).count() == 0
