import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from cohortspark.llm import piece_sampling
from cohortspark.llm.text import mix
from tests.conftest import SF_SMALL
from tests.llm.conftest import MORSE, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def sample(texts, keys):
    pieces = piece_sampling._pieces(PATH)
    texts = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ids, cuts = piece_sampling._sample(*piece_sampling._spaced(data, offsets),
                                       np.array(keys, np.uint64), pieces)
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])], \
        [t.decode() for t in piece_sampling.decode(ids, cuts, pieces)]


def test_decoding_is_lossless_and_the_librarys():
    texts = ["", "a", " ", "\n", "  x \n\n y  ", "the  cat", "日本語 テキスト\n\U0001F600 ok",
             "é" * 2000, "a\x00b", "<0x0A><s>", "x" * 3000, *MORSE, " ".join(MORSE)]
    ids, decoded = sample(texts, range(len(texts)))
    assert decoded == texts
    assert [MODEL.decode(i) for i in ids if i] == [t for t in texts if t]
    marks = ["x▁y ▁ ▁▁"]  # the library's space mark itself
    assert sample(marks, [1])[1] == marks


def test_draws_follow_the_lattice():
    """Frequencies against all segmentations of a word, weighed one by one."""
    weights = piece_sampling._pieces(PATH)[1]
    vocab = {MODEL.id_to_piece(i): i for i in range(MODEL.get_piece_size())}

    def cuts(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocab:
                yield from ((vocab[s[:k]], *rest) for rest in cuts(s[k:]))

    for word in ("reading", "other"):
        ways = list(cuts("▁" + word))
        p = np.exp([weights[list(w)].sum() for w in ways])
        p /= p.sum()
        n = 40_000
        ids, _ = sample([word] * n, mix(np.arange(n, dtype=np.uint64)))
        seen = Counter(map(tuple, ids))
        assert set(seen) <= set(ways) and len(seen) > 1
        assert max(abs(seen[w] / n - q) for w, q in zip(ways, p)) < 0.01


def test_thresholds_follow_from_the_segment_alone():
    """Bit for bit the same probabilities alone and among other texts."""
    pieces = piece_sampling._pieces(PATH)

    def lattice(words):
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        return piece_sampling._lattice(np.frombuffer(b"".join(words), np.uint8), offsets, pieces)

    others = [f" w{i}ord{i % 71}".encode() for i in range(3000)]
    for word in (" reading", " the", " internationalization", " 日本", "\n"):
        word = word.encode()
        firsts, lasts, *alone = lattice([word])
        for before in (1, 7, 2999):
            many = others[:before] + [word] + others[before:]
            node = sum(map(len, many[:before])) + before
            first, last, *among = lattice(many)
            for k in range(1, len(word) + 1):
                here, there = slice(firsts[k], lasts[k] + 1), slice(first[node + k], last[node + k] + 1)
                for x, y in zip(alone, among):
                    assert x[here].tobytes() == y[there].tobytes()


def test_lattices_in_blocks_are_those_of_one():
    pieces = piece_sampling._pieces(PATH)
    words = [w.encode() for w in (" reading", "\U0001FAE8", "\n", "x" * 40, *MORSE, " the", "\x00")]
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    firsts, lasts, *whole = piece_sampling._lattices(data, starts, sizes, pieces, 1 << 30)
    ends = np.cumsum(sizes + 1) - 1  # the nodes behind them begin segments and have no edges
    nodes = sorted(set(range(len(firsts))) - {0, *(ends[:-1] + 1).tolist()})
    for block in (1, 9, 100):
        first, last, *found = piece_sampling._lattices(data, starts, sizes, pieces, block)
        assert len(first) == len(firsts) and len(found[0]) == len(whole[0])
        for n in nodes:
            for x, y in zip(whole, found):
                assert x[firsts[n]:lasts[n] + 1].tobytes() == y[first[n]:last[n] + 1].tobytes()


def test_memory_for_many_different_words():
    pieces = piece_sampling._pieces(PATH)
    text = "".join(f" word{i * 7919 % 1_000_003}" for i in range(80_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    keys = np.array([1], np.uint64)
    piece_sampling._sample(data[:1000], np.array([0, 1000]), keys, pieces)  # what a worker keeps
    tracemalloc.start()
    try:
        ids, cuts = piece_sampling._sample(data, offsets, keys, pieces)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert piece_sampling.decode(ids, cuts, pieces) == [text[1:]]
    assert peak < 150 * len(text)


def test_draws_step_to_the_edge():
    p = np.array([1.0, 0.5, 0.3, 0.2, 0.7, 0.3])
    u = np.array([0.999, 0.0, 0.49, 0.5, 0.79, 0.81, 1.0, 0.69, 0.71])
    first = np.array([0, 1, 1, 1, 1, 1, 1, 4, 4])
    last = np.array([0, 3, 3, 3, 3, 3, 3, 5, 5])
    assert piece_sampling._draw(u, first, last, p).tolist() == [0, 1, 1, 2, 2, 3, 3, 4, 5]


def test_reproducible_in_any_partitioning(spark, checkpoints):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = rows(piece_sampling.sample_pieces(docs.coalesce(1), PATH, 7))
    assert one == rows(piece_sampling.sample_pieces(docs.repartition(7), PATH, 7))
    other = rows(piece_sampling.sample_pieces(docs, PATH, 8))
    assert one != other and all(r[3] for r in one + other)
    back = piece_sampling.decode_pieces(piece_sampling.sample_pieces(docs, PATH, 7), PATH)
    assert rows(back) == rows(docs.select("doc_id", "text"))


def test_edges(edge_docs, no_docs):
    got = piece_sampling.sample_pieces(edge_docs, PATH)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.lossless and r.n_tokens == len(r.ids)
    assert by_id[1][0] == by_id[1][1] and by_id[2][0].ids == by_id[3][0].ids == []
    assert by_id[5][0].ids != by_id[6][0].ids  # one text, two row keys
    assert rows(piece_sampling.sample_pieces(no_docs, PATH)) == []
