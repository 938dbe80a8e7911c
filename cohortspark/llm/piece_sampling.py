"""Sampled piece segmentations by forward filtering and backward sampling.

A text's pieces form a lattice between byte places.  The forward pass sums the
weights of all segmentations up to each place, the backward pass draws pieces
from the end of the text on, each in proportion to the weight behind it.  The
random numbers come from the row's key and the byte place alone, so a text is
cut the same way on every run and in every partition.

No piece holds a space behind another character nor a line feed, so the
lattice falls apart into segments (a word with the spaces before it); equal
segments share one forward pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import (find, gather, hash_table, mix, prefix_sums, span_hashes,
                                  sums_hashes, text_chunks, word_codes, worker_store)

RANK_SHIFT = 100.0       # a ranked piece has weight 1 / (rank + RANK_SHIFT)
BYTE_PENALTY = 10.0      # a byte piece costs so much more than the rarest piece
BLOCK_BYTES = 1 << 17    # different segments whose lattice is built at once, one at least
_PREFIX = np.int32(1 << 30)  # table value of a span that only begins pieces
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pieces(path: str):
    """(table of spans, log weights, byte ids, pieces' bytes and their places).

    Pieces are taken with a space for the library's space mark.  Scores of a
    BPE model are ranks, not log probabilities, and are turned into weights
    that fall with the rank.
    """
    store = worker_store("pieces")
    if path in store:
        return store[path]
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts, weights, byte_ids = [b""] * n, np.zeros(n), np.zeros(256, np.int32)
    normal = []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = piece.encode().replace(b"\xe2\x96\x81", b" ")
            weights[i] = model.get_score(i)
            normal.append(i)
    normal = np.array(normal)
    if weights[normal].min() < -1000:  # ranks
        weights[normal] = -np.log(np.arange(len(normal)) + RANK_SHIFT)
    weights[byte_ids] = weights[normal].min() - BYTE_PENALTY
    spans = {}
    for i in normal.tolist():
        for k in range(1, len(texts[i])):
            spans.setdefault(texts[i][:k], _PREFIX)
        spans[texts[i]] = np.int32(i)
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    ends = np.cumsum(sizes)
    table = hash_table(span_hashes(data, ends - sizes, ends),
                       np.fromiter(spans.values(), np.int32, len(spans)))
    sizes = np.fromiter(map(len, texts), np.int64, n)
    store[path] = (table, weights, byte_ids, np.frombuffer(b"".join(texts), np.uint8),
                   np.cumsum(sizes) - sizes, sizes)
    return store[path]


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Starts of the segments and their ends."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    space, feed = data == 32, data == 10
    cut[1:-1] |= space[1:] & ~space[:-1] | feed[1:] | feed[:-1]
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]


def _edges(data: np.ndarray, ends: np.ndarray, table, byte_ids):
    """Lattice edges of segments laid end to end: first byte, size, piece.

    ``ends`` is each byte's segment end.  A character without a piece of its
    own is spelt in bytes.
    """
    sums = prefix_sums(data)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.ones(len(leads), np.int64)
    sizes[data[leads] >= 0xC0] = 2
    sizes[data[leads] >= 0xE0] = 3
    sizes[data[leads] >= 0xF0] = 4
    own = np.zeros(len(leads), bool)
    got = [], [], []
    live, size = np.arange(len(leads)), 0
    while len(live):
        size += 1
        live = live[leads[live] + size <= ends[leads[live]]]
        at = leads[live]
        value = find(table, sums_hashes(sums, at, at + size))
        whole = (value > 0) & (value < _PREFIX)
        for to, x in zip(got, (at[whole], np.full(int(whole.sum()), size), value[whole])):
            to.append(x)
        own[live[whole & (sizes[live] == size)]] = True
        live = live[value > 0]
    bare = np.flatnonzero(~own)
    at = gather(np.arange(len(data)), leads[bare], sizes[bare])
    for to, x in zip(got, (at, np.ones(len(at), np.int64), byte_ids[data[at]])):
        to.append(x)
    return tuple(np.concatenate(x) for x in got)


def _lattice(data: np.ndarray, offsets: np.ndarray, pieces):
    """Forward filtering over segments laid end to end.

    Nodes are the byte places of each segment and its end.  Returns, by node,
    its first and last incoming edge, and by edge its probability, size and
    piece.  A node's edges stand with the longest first; everything about them
    follows from the node's own segment, whatever stands beside it.
    """
    table, weights, byte_ids = pieces[:3]
    sizes = np.diff(offsets)
    number = np.repeat(np.arange(len(sizes)), sizes)
    at, size, piece = _edges(data, np.repeat(offsets[1:], sizes), table, byte_ids)
    n_nodes, longest = len(data) + len(sizes), int(size.max(initial=0))
    depth = at - offsets[number[at]] + size  # of the target in its segment
    # by depth, node and falling size, which no two edges share
    order = np.argsort((depth * n_nodes + at + number[at] + size) * (longest + 1) + longest - size)
    at, size, piece, depth = at[order], size[order], piece[order], depth[order]
    source = at + number[at]
    target = source + size
    total = np.zeros(n_nodes)  # log weight up to each node
    log_p = np.empty(len(source))
    way = weights[piece]
    new = np.ones(len(source), bool)
    new[1:] = target[1:] != target[:-1]
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(source)))
    first, last = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    first[target[heads]], last[target[heads]] = heads, heads + counts - 1
    steps = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) \
        if len(depth) else np.zeros(1, np.int64)
    groups = np.searchsorted(heads, steps)
    for a, b, g, h in zip(steps[:-1], steps[1:], groups[:-1], groups[1:]):
        count = counts[g:h]
        ways = total[source[a:b]] + way[a:b]
        top = np.maximum.reduceat(ways, heads[g:h] - a)
        sums = top + np.log(np.add.reduceat(np.exp(ways - np.repeat(top, count)), heads[g:h] - a))
        total[target[heads[g:h]]] = sums
        log_p[a:b] = ways - np.repeat(sums, count)
    return first, last, np.exp(log_p), size.astype(np.int32), piece


def _lattices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces,
              block_bytes: int = BLOCK_BYTES):
    """``_lattice`` of the segments at ``starts``, built for blocks of about
    ``block_bytes`` one after the other: a lattice takes several times as much
    memory while it is built as afterwards."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    made, edges, i = [], 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block_bytes, "right")) - 1)
        first, last, *found = _lattice(gather(data, starts[i:j], sizes[i:j]),
                                       bounds[i:j + 1] - bounds[i], pieces)
        made.append((first + edges, last + edges, *found))
        edges += len(found[0])
        i = j
    return tuple(map(np.concatenate, zip(*made)))


def _draw(u: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The edge, from ``first`` to ``last``, that each random number falls on.

    Numbers step along their own node's few edges, so no other node's
    probabilities come into it.
    """
    edge, rest = first.copy(), u.copy()
    live = np.flatnonzero((rest >= p[edge]) & (edge < last))
    while len(live):
        rest[live] -= p[edge[live]]
        edge[live] += 1
        live = live[(rest[live] >= p[edge[live]]) & (edge[live] < last[live])]
    return edge


def _sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces):
    """Piece ids of all texts, and each text's first id."""
    starts, ends = _segments(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    back, lead = word_codes(data, starts, ends)
    sizes = (ends - starts)[lead]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first, last, p, size, piece = _lattices(data, starts[lead], sizes, pieces)
    doc = np.searchsorted(offsets, starts, "right") - 1
    place = ends - offsets[doc]                    # byte place in the text, from the end on
    node = (bounds[1:] + np.arange(len(lead)))[back]
    live = np.arange(len(starts))
    left = ends - starts
    drawn = []
    while len(live):
        # one number for each text and place
        u = (mix(keys[doc[live]] + place[live].astype(np.uint64) * _STEP)
             >> np.uint64(11)) * 2.0 ** -53
        edge = _draw(u, first[node[live]], last[node[live]], p)
        drawn.append((live, piece[edge]))
        node[live] -= size[edge]
        place[live] -= size[edge]
        left[live] -= size[edge]
        live = live[left[live] > 0]
    n = np.zeros(len(starts), np.int64)
    for at, _ in drawn:
        n[at] += 1
    before = np.concatenate([[0], np.cumsum(n)])
    ids = np.empty(before[-1], np.int32)
    for step, (at, got) in enumerate(drawn):
        ids[before[at + 1] - 1 - step] = got
    return ids, before[np.searchsorted(starts, offsets)]


def _spaced(data: np.ndarray, offsets: np.ndarray):
    """The texts with the space in front that the library puts there."""
    some = offsets[:-1][np.diff(offsets) > 0]
    more = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    return np.insert(data, some, 32), offsets + more


def _same(ids: np.ndarray, cuts: np.ndarray, spaced: np.ndarray, bounds: np.ndarray, pieces):
    """Whether each text's ids spell the text again."""
    raw, place, sizes = pieces[3:]
    spelt = gather(raw, place[ids], sizes[ids])
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[cuts]
    if np.array_equal(ends, bounds) and np.array_equal(spelt, spaced):
        return np.ones(len(cuts) - 1, bool)
    return np.array([spelt[a:b].tobytes() == spaced[c:d].tobytes()
                     for a, b, c, d in zip(ends, ends[1:], bounds, bounds[1:])], bool)


def decode(ids: np.ndarray, cuts: np.ndarray, pieces) -> list[bytes]:
    """Texts of the runs of ids between ``cuts``."""
    raw, place, sizes = pieces[3:]
    data = gather(raw, place[ids], sizes[ids]).tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[cuts].tolist()
    return [data[a + 1:b] for a, b in zip(ends, ends[1:])]  # without the space in front


def _encode(path: str, seed: int):
    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            row_keys = batch.column("doc_id").fill_null(-1).to_numpy(
                zero_copy_only=False).astype(np.uint64)
            row_keys = mix(row_keys + mix(np.array([seed], np.uint64)))
            for i, j, data, offsets in text_chunks(batch.column("text")):
                spaced, bounds = _spaced(data, offsets)
                ids, cuts = _sample(spaced, bounds, row_keys[i:j], pieces)
                same = _same(ids, cuts, spaced, bounds, pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(cuts), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()),
                                              pa.array(ids, pa.int32())),
                     pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "lossless"])
    return run


def sample_pieces(docs: DataFrame, model_path: str, seed: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): a sampled segmentation of every text.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  ``model_path`` is a sentencepiece model with byte pieces.  A text's
    segmentation depends on its doc_id, its bytes and ``seed`` alone.
    ``lossless`` says whether the decoded ids are the text again.

    A null or empty text has no ids; all null doc_ids share one key; repeated
    rows are each returned and cut alike; an empty table gives no rows.  Texts
    of any length are cut whole.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_encode(model_path, seed),
                        "doc_id long, n_tokens long, ids array<int>, lossless boolean"))


def _decode(path: str):
    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            lists = batch.column("ids").fill_null(pa.scalar([], batch.column("ids").type))
            ids = lists.flatten().to_numpy().astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array(decode(ids, cuts, pieces), pa.binary()).cast(pa.string())],
                names=["doc_id", "text"])
    return run


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from doc_id and ids; null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path),
                                                      "doc_id long, text string")
