"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from lectern.llm import bpe, token_output  # noqa: E402
from lectern.llm.pretokens import Pretokens  # noqa: E402

from .frames import none, odd, texts  # noqa: E402

WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pretokens_match_library(path):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = bpe.Encoder(path)
    r = random.Random(3)
    alphabets = ["ab", "abcdefghij etaoin", "don't we'll 're's'''t \n\t", "éàß日本ñ ÄÉΣσ", " \n\t  ab", "a1.'s 23\x1ce\x85İ ́", "<|endoftext|> x🙂"]
    cases = ["".join(r.choice(a) for _ in range(r.choice([0, 1, 2, 5, 40, 300]))) for a in alphabets for _ in range(60)] + ["<|endoftext|>", "a<|startoftext|>b", " ", "a  b ", "x\n\n y"]
    ids = own.encode(cases)
    for text, found in zip(cases, ids, strict=True):
        assert found == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pretokens_that_share_a_hash(path):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    pairs = [["".join("ab"[(bin(k).count("1") + s) % 2] for k in range(1 << n)) for s in (0, 1)] for n in (10, 11)]
    cases = [x for p in pairs for x in p] + [f"{p[0]} {p[1]} {p[0]}" for p in pairs] + ["plain words"]
    for order in (cases, cases[::-1]):
        own = bpe.Encoder(path)
        for _ in range(2):
            assert own.encode(order) == [library.encode(x, add_special_tokens=False).ids for x in order]
        assert [own.encode([x])[0] for x in order] == [library.encode(x, add_special_tokens=False).ids for x in order]


def test_every_long_pretoken_is_a_tree(monkeypatch):
    joins = []
    real = bpe.TreeBpe.join
    monkeypatch.setattr(bpe.TreeBpe, "join", lambda self, *a: joins.append(a) or real(self, *a))
    own, library = bpe.Encoder(WORD), Tokenizer.from_file(WORD)
    assert own.encode(["short extraordinarily"])[0] == library.encode("short extraordinarily", add_special_tokens=False).ids
    assert len(joins) == 1


def test_tree_concatenation_is_exact():
    tree, library = bpe.TreeBpe(WORD), Tokenizer.from_file(WORD)
    r = random.Random(4)
    for alphabet in ("ab", "theofandin", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(r.choice(alphabet) for _ in range(3000))
        whole = [t.value for t in library.model.tokenize(text)]
        for leaf in (7, 64, 1000):
            assert tree.tokens(text, leaf) == whole
    assert tree.tokens("") == []


def test_encode_and_digests(spark):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    out = bpe.encode(odd(spark), WORD)
    assert out.columns[-3:] == ["n_tokens", "ids", "decoded"] and "bucket" in out.columns
    expected = sorted((str(k), library.encode(t or "", add_special_tokens=False).ids) for k, t in texts())
    assert sorted((str(r.doc_id), r.ids) for r in out.collect()) == expected
    made = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd(spark), WORD).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert made == sorted((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False) if ids else "")) for k, ids in expected)
    assert bpe.encode(none(spark), WORD).count() == 0


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(BYTE)
    folder = str(tmp_path / "ids")
    token_output.write_token_ids(odd(spark), folder, BYTE, end_id=2)
    rows = sorted(token_output.read_token_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((k for k, _ in texts()), key=lambda k: (k is not None, k))
    start = 0
    text = {k: t for k, t in texts()}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2] and r.start == start and r.n_tokens == len(ids)
        start += len(ids)
    assert {r.doc_id: r.ids_crc32 for r in token_output.digests(spark, folder).collect()} == {r.doc_id: zlib.crc32(r.ids) for r in rows}
    assert [r.doc_id for r in token_output.read_token_ids(spark, folder, [17]).collect()] == [17]
    empty = str(tmp_path / "none")
    token_output.write_token_ids(none(spark), empty, BYTE, end_id=2)
    assert token_output.digests(spark, empty).count() == 0


def test_cache_overflow(monkeypatch):
    own = Pretokens(BYTE)
    monkeypatch.setattr("lectern.llm.pretokens.CACHED", 2)
    library = Tokenizer.from_file(BYTE)
    for text in ("a b c d e", "f g h i", "a b c"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "some words", "x", "y", 7)], "doc_id long, text string, `1` string, `2` string, n_tokens int")
    out = bpe.encode(rows, WORD)
    assert out.columns == ["doc_id", "text", "1", "2", "n_tokens", "ids", "decoded"]
    r = out.first()
    assert (r["1"], r["2"], "some" in r["decoded"]) == ("x", "y", True) and len(r["ids"]) == r["n_tokens"]


def test_token_steps_give_memory_back():
    """Every Python step of the token files returns its worker's memory when a task ends."""
    for run in (token_output._frames("", 2, None, None, "text"), token_output._pages("", 2), token_output._unpack(None, "", None)):
        assert hasattr(run, "__wrapped__")


def test_bpe_gives_memory_back_between_batches(monkeypatch):
    """A task's short-lived arrays do not stay with its worker, and what it remembers of pre-tokens is bounded lower than for the byte-level file."""
    bpe.encoder(WORD)
    given = []
    monkeypatch.setattr("lectern.llm.common.give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words"])], ["text"])
    assert len(list(bpe._mapper(WORD, "text", False)(iter([batch] * 3)))) == 3
    assert len(given) == 4
    own, other = bpe.Encoder(WORD).own, Pretokens(BYTE)
    assert 2 * len(own.slot_hash) == len(other.slot_hash)
    library = Tokenizer.from_file(WORD)
    own.bound = (2, None)
    for text in ("a b c d e", "f g h i", "a b c"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.rows <= 5
