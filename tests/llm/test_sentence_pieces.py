"""SentencePiece encoding, places and decoding against the library, with the given model and with others' normalisation."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from sievework.llm import sentence_pieces as sp

MODEL = P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " lead", "  two", "tail ", "a  b", "a \n b", "\n", "\tx", "▁", "a▁ b", "a ▁b ▁▁ c", "é" * 300, "é ﬁne ½ ①", "日本語 テスト", "\U0001f600 x \U0001f468‍\U0001f469", "\0 a \0b", "<s> </s> <unk> <0x41>",
    "ab. Cd.\nEf! gh? " * 300, "word " * 60_000, "x" * 5000, " a 　b", "Ａｂｃ　Ｄ", "a​b﻿c", "ㄱㅏ 각 한글", "x y\x85z", "؀ ﷺ ..." , "㍿ ﷺ  x",
]


def with_rules(path, name, **flags):
    """The model with the normalisation of one of the library's own rules."""
    rule = {n: v for n, v, *_ in sp.fields(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto())}[3] if name else b""
    compiled = {n: v for n, v, *_ in sp.fields(rule)}.get(2, b"") if rule else b""
    with open(path, "rb") as f:
        model = f.read()
    kept = b"".join(model[a:b] for n, _, a, b in sp.fields(model) if n != 3)

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    body = (b"\x12" + varint(len(compiled)) + compiled if compiled else b"") + b"".join(bytes([n << 3, int(v)]) for n, v in flags.values())
    return kept + b"\x1a" + varint(len(body)) + body


def check(path, texts):
    own, library = sp.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts:
        want = library.encode(t, return_type="offset_mapping", return_bytes=True)
        ids, begins, ends = own.pieces.placed(t)
        assert ids.tolist() == want["ids"], t[:60]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == want["offsets"], t[:60]


def made(seed, n):
    rng = random.Random(seed)
    letters = "ab  c▁é\n½ﬁ①Ａ　́ 각ㄱx.\U0001f600"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_given_model(monkeypatch):
    monkeypatch.setattr(sp, "RUN_CHARS", 40)
    check(MODEL, ODD + made(1, 400))


@pytest.mark.parametrize("name", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_other_normalisation(tmp_path, name, dummy, trim):
    path = tmp_path / "m.model"
    path.write_bytes(with_rules(MODEL, name, dummy=(3, dummy), trim=(4, trim)))
    assert bool(sp.Codec(str(path)).rules.map) == (name != "identity")
    check(str(path), [t for t in ODD if len(t) < 10_000] + made(2, 200))


def test_operators(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, 7), (1, "again", 7), (1, "again", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    encoded = sp.encode(docs, MODEL, keep=("doc_id", "text"))
    back = sp.decode(encoded, MODEL, keep=("doc_id", "text", "ids", "begins", "ends"))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = back.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids)
        assert r.begins[-1] == r.ends[-1] == len((r.text or "").encode())
        covered = "".join((r.text or "").encode()[a:b].decode() for a, b in zip(r.begins, r.ends, strict=True))
        assert covered == (r.text or "")
    assert sp.encode(docs.limit(0), MODEL).count() == 0


def test_query_equals_the_library(spark):
    import hashlib

    from sievework.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = QUERIES["op12_sentence_pieces"](spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decode_nulls_and_repeats(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = library.encode("one text and another")
    rows = [(1, ids), (2, None), (3, []), (4, [None]), (5, [ids[0], None, *ids[1:]]), (None, ids), (1, ids)]
    found = sp.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2), MODEL).collect()
    want = {1: "one text and another", 2: "", 3: "", 4: "", 5: "one text and another", None: "one text and another"}
    assert len(found) == len(rows) and all(r.decoded == want[r.doc_id] for r in found)
