"""Unigram segmentation over the pieces of a SentencePiece model, and decoding.

The pieces stand in a double-array trie over UTF-8 bytes.  Viterbi search takes the segmentation of greatest summed log
score; of equal ones, at each end the longest last piece.  A code point that is no piece itself may also be written as its
bytes, at a score below that of any piece.

A model of merge ranks has no probabilities, so the scores are learned from the corpus by expectation maximisation over
its best segmentations: starting from Zipf's law over the order of the pieces, all texts are segmented, the pieces are
counted, and the scores become the logarithms of their shares, ROUNDS times.  Tasks add up their own counts, so each round
sends one number for each piece and task.

The white-space marker U+2581 stands for a space; a space is put before the text.  In the trie the marker is the space
itself, so a U+2581 of the text has no piece, is written as bytes, and decoding gives back every text exactly.  No piece
holds a space after another character, so each run of spaces with the word behind it is segmented on its own, and equal
ones once for each stretch of text.  All positions of a stretch walk the trie together, and all its words are searched
together, as NumPy arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.llm.shared import Words, pieces, read

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer words are searched one by one.
LOCKSTEP = 60
ROUNDS = 2
_seen: dict[str, Words] = {}


class Pieces(NamedTuple):
    """A double-array trie (state t follows s on byte b if t = base[s] + b and check[t] = s), and the pieces themselves."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    longest: int
    unknown: float


def build_trie(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (-1: none) of a double-array trie of the words."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for word, v in words:
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][b]
        value[node] = v
    size = 2 * len(children) + 1024
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    place = {0: 0}
    lowest = 1
    queue = [0]
    for node in queue:
        if not children[node]:
            continue
        keys = sorted(children[node])
        while taken[lowest]:
            lowest += 1
        slot = lowest
        while True:
            b = slot - keys[0]
            if b > 0 and not any(taken[b + k] for k in keys):
                break
            slot = taken.find(0, slot + 1)
        base[place[node]] = b
        for k in keys:
            child = children[node][k]
            place[child] = b + k
            taken[b + k] = 1
            check[b + k], out[b + k] = place[node], value[child]
            queue.append(child)
    return base, check, out


def load(model: str, scores: str = "zipf") -> Pieces:
    """The pieces of a SentencePiece model file; scores: "zipf" or "model"."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    surface, normal, byte_ids = [b""] * n, [], np.full(256, -1, np.int64)
    for i in range(n):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            surface[i] = bytes([int(text[1:-1], 16)])
            byte_ids[surface[i][0]] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if MARKER in text.lstrip(MARKER):
                raise ValueError(f"piece {i} goes on after a space")
            surface[i] = text.replace(MARKER, " ").encode()
            normal.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    score = np.zeros(n)
    order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
    if scores == "zipf":
        score[order] = -np.log(np.arange(len(order)) + 2.7) - np.log(np.log(len(order) + 2.7))
    else:
        score[order] = [sp.get_score(i) for i in order]
    base, check, piece = build_trie([(surface[i], i) for i in normal])
    return Pieces(base, check, piece, score, byte_ids, surface, max(map(len, surface)), float(score[normal].min()) - UNKNOWN_PENALTY)


def piece_counts(docs: DataFrame, p: Pieces) -> np.ndarray:
    """How often each piece stands in the best segmentations of all texts."""
    sent, which = docs.sparkSession.sparkContext.broadcast(p), _name(p)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(sent.value.score), np.int64), _remembered(which)
        for _, data, offsets in pieces(batches, 0):
            total += np.bincount(encode(sent.value, data, offsets, seen)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    out = np.zeros(len(p.score), np.int64)
    # A number for each piece of the vocabulary.
    for b in docs.select("text").mapInArrow(task, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    sent.unpersist()
    return out


def rescored(p: Pieces, counts: np.ndarray) -> Pieces:
    """`p` with the logarithms of the pieces' shares in `counts`, half a count added to each; bytes don't count."""
    normal = np.flatnonzero(p.score < 0)
    n = counts[normal] + 0.5
    score = np.zeros(len(p.score))
    score[normal] = np.log(n) - np.log(n.sum())
    return p._replace(score=score, unknown=float(score[normal].min()) - UNKNOWN_PENALTY)


def fit(docs: DataFrame, model: str, rounds: int = ROUNDS) -> Pieces:
    """The pieces of a model file with scores learned from all texts of `docs`."""
    p = load(model)
    for _ in range(rounds):
        p = rescored(p, piece_counts(docs, p))
    return p


def _name(p: Pieces) -> str:
    return hashlib.blake2b(p.score.tobytes() + b"".join(p.surface)).hexdigest()


def _remembered(which: str) -> Words:
    """The words that this worker has segmented with these scores; those of other scores are forgotten."""
    if which not in _seen:
        _seen.clear()
    return _seen.setdefault(which, Words())


def _edges(p: Pieces, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id, score) of every piece that occurs in `data`; left: bytes to the end of the word at each byte."""
    at = np.arange(len(data))
    state = np.zeros(len(data), np.int64)
    starts, lengths, ids = [], [], []
    # Bytes of the code point that starts here; 0 inside one.
    width = np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))
    known = width == 0
    for n in range(1, p.longest + 1):
        fits = left[at] >= n
        at, state = at[fits], state[fits]
        after = p.base[state] + data[at + n - 1]
        fits = p.check[after] == state
        fits &= after > 0
        at, state = at[fits], after[fits]
        if not len(at):
            break
        got = p.piece[state]
        end = got >= 0
        starts.append(at[end])
        lengths.append(np.full(int(end.sum()), n, np.int64))
        ids.append(got[end].astype(np.int64))
        known[at[end][width[at[end]] == n]] = True
    for first in np.unique(width[~known]).tolist():
        of = np.flatnonzero(~known & (width == first))
        of = of[left[of] >= first]
        for j in range(first):
            starts.append(of + j)
            lengths.append(np.ones(len(of), np.int64))
            ids.append(p.byte_ids[data[of + j]])
    start, length, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, ids))
    cost = p.score[piece]
    fallback = piece == p.byte_ids[data[start]] if len(start) else np.empty(0, bool)
    whole = np.maximum.accumulate(np.where(width > 0, np.arange(len(data)), 0))
    cost[fallback] = p.unknown / width[whole[start[fallback]]]
    return start, length, piece, cost


def segment(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (bytes `data`, cut at `offsets`), and the number of ids before each word."""
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(len(sizes)), sizes)
    left = offsets[1:][word] - np.arange(len(data))
    start, length, piece, cost = _edges(p, data, left)
    # Node i + word is the gap before byte i; each word has one more node than bytes.
    node = start + word[start]
    end = node + length
    reach = end - offsets[word[start]] - word[start]
    order = np.lexsort((-length, end, np.minimum(reach, LOCKSTEP + 1)))
    node, end, piece, cost, reach, length = node[order], end[order], piece[order], cost[order], reach[order], length[order]
    nodes = len(data) + len(sizes)
    best, back = np.full(nodes, -np.inf), np.full(nodes, -1, np.int64)
    first = offsets[:-1] + np.arange(len(sizes))
    best[first] = 0.0
    cuts = np.searchsorted(reach, np.arange(1, LOCKSTEP + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        total, to = best[node[lo:hi]] + cost[lo:hi], end[lo:hi]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(total, heads)
        chosen = np.flatnonzero(total == np.repeat(top, np.diff(np.append(heads, len(to)))))
        chosen = chosen[np.concatenate([[True], to[chosen][1:] != to[chosen][:-1]])]
        best[to[chosen]], back[to[chosen]] = total[chosen], lo + chosen
    if cuts[-1] < len(node):
        score, frm, to, value = best, node[cuts[-1] :].tolist(), end[cuts[-1] :].tolist(), cost[cuts[-1] :].tolist()
        for i, (a, b, c) in enumerate(zip(frm, to, value, strict=True)):
            if score[a] + c > score[b]:
                score[b], back[b] = score[a] + c, int(cuts[-1]) + i
    found_word, found_id = [], []
    now, of = offsets[1:] + np.arange(len(sizes)), np.arange(len(sizes))
    while len(now):
        going = now > first[of]
        now, of = now[going], of[going]
        edge = back[now]
        found_word.append(of)
        found_id.append(piece[edge])
        now = node[edge]
    words, ids = np.concatenate(found_word), np.concatenate(found_id)
    # The last piece of each word was found first.
    order = np.argsort(words[::-1], kind="stable")
    return ids[::-1][order], np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(sizes)))])


def encode(p: Pieces, data: np.ndarray, offsets: np.ndarray, seen: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, and the number of ids before each text; an empty text has none."""
    seen = Words() if seen is None else seen
    # A space before each text that isn't empty.
    full = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(data, offsets[full], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = data == 32
    new = space & ~np.concatenate([[False], space[:-1]])
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))

    def search(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = (ends - starts)[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return segment(p, data[np.arange(upto[-1]) + np.repeat(starts[at] - upto[:-1], sizes)], upto)

    out, upto = seen.ids_of(data, starts, ends, search)
    return out, upto[np.searchsorted(starts, offsets)]


def decode(p: Pieces, ids: list[int]) -> str:
    """The text of `ids`; bytes that are no UTF-8 become U+FFFD, as ids from elsewhere may be cut anywhere."""
    return b"".join([p.surface[i] for i in ids]).decode(errors="replace")[1:]


def encode_documents(docs: DataFrame, model: str, scores: str = "corpus") -> DataFrame:
    """(doc_id, ids, decoded) of each row of `docs`: the ids of its whole text, and what they decode to.

    scores: "corpus" (learned from `docs`), "zipf" or "model".  Null texts count as empty: no ids.  Rows may repeat and ids
    may be null; other columns are not read.  The pieces are sent to the tasks; their size is that of the vocabulary.
    """
    chosen = fit(docs, model) if scores == "corpus" else load(model, scores)
    sent, which = docs.sparkSession.sparkContext.broadcast(chosen), _name(chosen)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = sent.value, _remembered(which)
        for rows, data, offsets in pieces(batches, 1):
            ids, upto = encode(p, data, offsets, seen)
            flat = ids.tolist()
            texts = [decode(p, flat[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """encode_documents() as doc_id, n_pieces, ids_crc32 (little-endian 32-bit) and the SHA-256 of the decoded text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, at = np.asarray(column.flatten()).astype("<u4"), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            texts = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64()), pa.array(texts)], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return encoded.mapInArrow(task, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents`."""
    return digests(encode_documents(read(spark, sf_dir, "documents"), _model()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: (doc_id, text, n_pieces, ids) with the text as decoded; null texts come back empty.

    Each row gives a row, also without a doc_id or with one that others have.
    """
    return encode_documents(docs, _model()).select("doc_id", F.col("decoded").alias("text"), F.size("ids").alias("n_pieces"), "ids")
