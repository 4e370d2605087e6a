"""Token counts, byte-level BPE and packing against the libraries themselves."""

import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievework.llm import byte_bpe, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    None, "", " ", "a  b", "a \n b", "\n\nx", "x\n", " lead", "<|endoftext|> a <|endoftext|>. b<|startoftext|>", "é" * 300, "don't  we'll 12 345x​ 　z", "a\x1c \x1cb \x85 c",
    "日本語 テスト 漢字。", "\0 a \0", "a \0  x", "b \0  \0  y \0", "ab. Cd.\nEf! gh? " * 400, "İstanbul ß ẞ ǅ é", "word " * 70_000, "x" * 5000,
]
RANKS, JSON, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(1, "again", 7), (1, "again", 7), (None, "no key", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def test_counts_are_the_librarys(docs):
    own = Tokenizer.from_file(WORDS)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.count_tokens(docs, WORDS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0


def test_ids_are_the_librarys_and_decode_to_the_text(docs):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN, keep=("doc_id", "text"))
    back = byte_bpe.decode(encoded, RANKS, P.PATTERN, keep=("doc_id", "text", "ids"))
    for r in back.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()


def test_pieces_cover_each_document_and_fill_sequences(docs):
    own = Tokenizer.from_file(JSON)
    texts = {}
    for r in docs.filter("doc_id IS NOT NULL AND doc_id <> 1").collect():
        texts[r.doc_id] = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
    rows = packing.pack(docs, JSON, RANKS, P.PATTERN, capacity=256).collect()
    at = {}
    for r in sorted((r for r in rows if r.doc_id in texts), key=lambda r: (r.doc_id, r.start)):
        ids = texts[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {k: len(v) for k, v in texts.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 40))]).tolist()
        penalty = [0, *rng.integers(0, 30, 40).tolist()]
        best = [0] + [10**9] * 40
        for j in range(1, 41):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= 200:
                    pad = 0 if n >= 64 and n & (n - 1) == 0 else 200 - n
                    best[j] = min(best[j], best[i] + pad + penalty[j] + packing.WINDOW_COST)
        cuts = packing.best_cuts(pos, penalty, 200)
        cost = 0
        for i, j in zip(cuts, cuts[1:]):
            n = pos[j] - pos[i]
            cost += (0 if n >= 64 and n & (n - 1) == 0 else 200 - n) + penalty[j] + packing.WINDOW_COST
        assert cost == best[40]


def test_sentences_that_fit_a_window_stay_whole():
    packer = packing.Packer(packing.encoder(JSON, RANKS, P.PATTERN), 512, 0, 0)
    packer.add(1, " ".join(["word " * 300 + "end."] * 5))
    whole = packer.flush(last=True)
    assert len(whole) == 5 and [r[1] for r in whole] == sorted({n for _, n, *_ in whole}) and max(r[2] for r in whole) <= 512
    packer.add(2, "word " * 2000)
    cut = packer.flush(last=True)
    assert sum(r[2] for r in cut) == cut[0][4] and max(r[2] for r in cut) <= 512


def test_packing_reads_the_tokenizer_only_for_special_strings():
    own = packing.Encoder(JSON, RANKS, P.PATTERN)
    whole = Tokenizer.from_file(JSON)
    want = lambda t: whole.encode(t, add_special_tokens=False).ids
    assert own.ids("plain words, no special string").tolist() == want("plain words, no special string") and "whole" not in own.__dict__
    assert own.ids("a <|endoftext|> b").tolist() == want("a <|endoftext|> b") and "whole" in own.__dict__
    assert own.special == [t.content for t in whole.get_added_tokens_decoder().values()] and len(own.ends) == whole.get_vocab_size()
