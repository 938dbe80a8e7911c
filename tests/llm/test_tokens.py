import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from cohortspark.llm import token_count, token_files
from tests.conftest import SF_SMALL
from tests.llm.conftest import MORSE, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "\n", "\n\nfoo It's WE'LL don't", "foo\n", "foo \nbar", "  x", "a\tb\r\nc  d",
       "x▁y ▁", "<s> hi </s> <unk> <0x0A>", "x<|endoftext|>y <|startoftext|>",
       "日本語 テキスト\n\U0001F600 ok ＡＢＣ Ǆ İstanbul ΣΑΣ ΑΣ",
       "H̱ á ́b", "é" * 3000, "a\x00b c\x1cd\x85e", None,
       " ".join(MORSE * 2), MORSE[1], MORSE[0]]


@pytest.fixture(scope="module")
def docs(spark, checkpoints):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)],
                                "doc_id long, text string")
    return small.unionByName(odd)


def test_counts_are_the_librarys(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_count.count_tokens(docs, PIECES, 100).collect()}
    for r in docs.collect():
        n = len(model.encode(r.text or ""))
        assert tuple(got[r.doc_id])[1:] == (len((r.text or "").encode()), n, n > 100), r.text


def test_cache_and_table_limits_change_nothing(docs, monkeypatch):
    want = rows(token_count.count_tokens(docs, PIECES))
    monkeypatch.setattr(token_count, "TABLE_ENTRIES", 3)
    monkeypatch.setattr(token_count, "SUMMARY_ENTRIES", 5)
    monkeypatch.setattr(token_count, "CACHE_ENTRIES", 10)
    assert rows(token_count.count_tokens(docs, PIECES)) == want


def test_frequent_pre_tokens_are_counted_over_all_texts(spark, monkeypatch):
    texts = [f"the own{i}\nof own{i % 7} the {MORSE[i % 2]}" for i in range(6000)] + [None, "", "\n"]
    seen = Counter(w for t in texts for k, line in enumerate((t or "").split("\n"))
                   for w in ((b" " if k == 0 or j else b"") + x.encode()
                             for j, x in enumerate(line.split())))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert sorted(token_count.frequent_pre_tokens(df)) == sorted(seen)
    monkeypatch.setattr(token_count, "TABLE_ENTRIES", 20)
    assert sorted(token_count.frequent_pre_tokens(df)) == sorted(w for w, n in seen.items() if n > 1)
    monkeypatch.setattr(token_count, "TABLE_ENTRIES", 3)
    assert sorted(token_count.frequent_pre_tokens(df)) == [b" the", b"of"]
    monkeypatch.setattr(token_count, "TABLE_ENTRIES", 0)
    assert token_count.frequent_pre_tokens(df) == []
    assert token_count.frequent_pre_tokens(df.limit(0)) == []


def test_files_round_trip(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 5000)
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    token_files.write_token_files(docs, str(tmp_path / "set"), WORDS, 2)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "set")).collect(),
                 key=lambda r: r.doc_id)
    start = 0
    for r, doc in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [2]
        data = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.crc32, bytes(r.ids)) == (
            doc.doc_id, start, len(ids), zlib.crc32(data), data)
        start += len(ids)
    assert spark.read.parquet(str(tmp_path / "set/shards")).count() > 8
    some = got[len(got) // 2]
    assert token_files.read_document(spark, str(tmp_path / "set"), some.doc_id) == [
        np.frombuffer(some.ids, "<u4").tolist()]


def test_special_strings_in_any_case_are_the_librarys():
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "a<|EndOfText|>B. C", "<|endoftext|>'S",
             "X<|STARTOFTEXT|><|startoftext|>Y.", "<|EndOfTexT|>É É<|ENDOFTEXT|>", "<|END OFTEXT|>",
             "<|endof", "text|> <|ENDOFTEXT", "<|ENDOFTEXT|>\n<|endoftext|>", "THE <| END |>."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, cuts = token_files._encode(WORDS, data, offsets)
    for text, a, b in zip(texts, cuts, cuts[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_wrong_dictionary_is_noticed(spark, docs, tmp_path):
    for name in ("one", "two"):
        token_files.write_token_files(docs.filter("doc_id < 5" if name == "one" else "doc_id > 5"),
                                      str(tmp_path / name), WORDS, 2)
    spark.read.parquet(str(tmp_path / "two/dictionary")).write.parquet(
        str(tmp_path / "mixed/dictionary"))
    spark.read.parquet(str(tmp_path / "one/shards")).write.parquet(str(tmp_path / "mixed/shards"))
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(spark, str(tmp_path / "mixed")).collect()


def test_edges(spark, edge_docs, no_docs, tmp_path):
    n = edge_docs.count()
    assert token_count.count_tokens(edge_docs, PIECES).count() == n
    assert rows(token_count.count_tokens(no_docs, PIECES)) == []
    for df, name in ((edge_docs, "edge"), (no_docs, "none")):
        token_files.write_token_files(df, str(tmp_path / name), WORDS, 2)
    got = token_files.read_token_files(spark, str(tmp_path / "edge")).collect()
    assert len(got) == n
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None] * 3 + [-7, 1, 1, 2, 3, 4, 5, 6]
    assert [r.start for r in by_start] == np.cumsum(
        [0] + [r.n_tokens for r in by_start])[:-1].tolist()
    assert rows(token_files.read_token_files(spark, str(tmp_path / "none"))) == []
