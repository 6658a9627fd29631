"""Packing: documents as token sequences of a fixed capacity with balanced attention cost.

Each task packs what it reads, one block of tokens after the other; nothing is shuffled. In a
block the pieces go out in descending length, each to the sequence of lowest estimated cost
(linear in its tokens, quadratic in the pieces, which attend to themselves only) that still has
room. Pieces that fit nowhere are cut to fill what is left, so a block has at most one sequence
that is not full; what it holds goes on to the next block, and at the end of a task it is cut
into sequences whose lengths are powers of two, which need no padding.

A null text is empty and becomes its end id alone. Rows are taken one by one, so repeated rows
and repeated or null ids are no special case; other columns of the input are left out, so no
name can clash. An empty table gives no pieces. A text of any length is read whole and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import text_blocks as tb
from .exchange import blocks_of

CAPACITY = 4096
BLOCK_SEQUENCES = 512
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Cost of a token, and of a pair of tokens in one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Pieces of words whose ids a worker remembers; then it starts anew.
REMEMBERED_PIECES = 1_000_000
#: Bytes of text encoded at a time. The arrays beside them take some hundred times as much; two workers share an executor.
BLOCK_BYTES = 500_000

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


class WordTokenizer:
    """Ids of whole texts, by way of the ids of their words.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of
    its words in order. Nor does it join letters with the marks behind them, and it lower-cases A-Z: so
    a word is cut into stem and marks. Each distinct piece is encoded once in a worker; the others are
    found by their 64-bit hashes, and the ids of a block of texts are gathered in one step.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool: list[np.ndarray] = []
        self.pooled = 0

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encode_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many stems of plain letters in one call: the last token of a stem tells where the next begins."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(stems) else self._encode(stems)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        plain = np.array([p.isalpha() for p in pieces], bool)
        order, made = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), []
        for places, encode in ((order[: plain.sum()], self._encode_stems), (order[plain.sum() :], self._encode)):
            for i in range(0, len(places), 2048):
                made.append(encode([pieces[k] for k in places[i : i + 2048].tolist()]))
        hashes, size = hashes[order], np.concatenate([m[1] for m in made])
        first = self.pooled + np.concatenate([[0], np.cumsum(size[:-1])])
        self.pool = [np.concatenate([*self.pool, *(m[0] for m in made)])]
        self.pooled += int(size.sum())
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.first, self.size = np.insert(self.first, at, first[order]), np.insert(self.size, at, size[order])

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        low, parts = tb.LOWER[buf], []
        for i, _, b, o in tb.chunks(buf, offsets):
            starts, ends, bounds = tb.word_spans(b, o, tb.PLAIN_WORD)
            part = low[offsets[i] : offsets[i] + len(b)]
            # Names of special tokens count as written: words with a < keep their capitals.
            angle = np.concatenate([[0], np.cumsum(b == 0x3C)])
            for k in np.flatnonzero(angle[ends] > angle[starts]):
                part[starts[k] : ends[k]] = b[starts[k] : ends[k]]
            stem = ends.copy()
            for _ in range(3):
                stem -= (stem > starts) & _MARKS[part[np.maximum(stem - 1, 0)]]
            last, before = part[np.maximum(stem - 1, 0)], part[np.maximum(stem - 2, 0)]
            letter = ((last >= 0x61) & (last <= 0x7A)) | ((stem - starts > 1) & (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
            cut = (stem > starts) & (stem < ends) & letter
            stem = np.where(cut, stem, ends)
            at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(cut)])[: len(starts)]
            s, e = np.empty(len(starts) + int(cut.sum()), np.int64), np.empty(len(starts) + int(cut.sum()), np.int64)
            s[at], e[at], s[at[cut] + 1], e[at[cut] + 1] = starts, stem, stem[cut], ends[cut]
            pieces_before = np.append(at, len(s))[bounds]
            parts.append((tb.span_hash(tb.byte_sums(part), s, e), s + offsets[i], e + offsets[i], np.diff(pieces_before)))
        hashes, s, e, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED_PIECES:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            whole = low.tobytes()
            self._learn(distinct[new], [whole[i:j].decode() for i, j in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size, begin = self.size[at][place], self.first[at][place]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[0][np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]


#: Marks that may stand behind a stem; no apostrophe, which the tokenizer joins with letters.
_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?|"])


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = tb.worker_state().setdefault("tokenizers", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces (document, start, length, sequence, offset) and the cost of each sequence.

    Descending documents go to the cheapest sequence with room. There are as many sequences as the
    tokens need; a document longer than any free room is cut where the cheapest sequence is full.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    free, cost, used = np.full(n, capacity, np.int64), np.zeros(n), np.zeros(n, np.int64)
    if n and total % capacity:
        free[-1] = total % capacity  # all but one come out full
    pieces = []

    def put(doc: int, start: int, length: int, k: int) -> None:
        pieces.append((doc, start, length, k, int(used[k])))
        used[k] += length
        free[k] -= length
        cost[k] += linear * length + quadratic * length * length

    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            room = np.where(free >= min(left, capacity), cost, np.inf)
            k = int(room.argmin())
            if room[k] == np.inf:
                k = int(free.argmax())
            length = min(left, int(free[k]))
            put(int(doc), start, length, k)
            start, left = start + length, left - length
    return pieces, cost


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, block_sequences: int) -> Iterator[pa.RecordBatch]:
    tokenizer, end = _tokenizer(path), np.array([end_id], "<u4").tobytes()
    task, made = TaskContext.get().partitionId() << 40, 0
    held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) not yet in a full sequence
    tokens = 0

    def emit(pending: list[tuple], last: bool):
        nonlocal held, made
        lengths = np.array([len(x[2]) // 4 for x in pending], np.int64)
        pieces, cost = assign(lengths, capacity)
        held, rows, total = [], [], int(lengths.sum())
        partial = total // capacity if total % capacity else None
        tail = []
        for doc, start, length, k, offset in pieces:
            doc_id, before, ids, doc_tokens = pending[doc]
            piece = (doc_id, before + start, ids[4 * start : 4 * (start + length)], doc_tokens)
            if k == partial:
                tail.append(piece)
            else:
                rows.append((piece[0], piece[1], length, piece[2], doc_tokens, task + made + k, offset, capacity, float(cost[k])))
        made += total // capacity
        if not last:
            held = tail
        else:  # powers of two
            rest, k = total % capacity, 0
            for bit in reversed(range(rest.bit_length())):
                size, offset, own = 1 << bit, 0, []
                if not rest & size:
                    continue
                while offset < size:
                    doc_id, before, ids, doc_tokens = tail[0]
                    length = min(size - offset, len(ids) // 4)
                    own.append((doc_id, before, length, ids[: 4 * length], doc_tokens, task + made, offset, size))
                    offset += length
                    tail[0] = (doc_id, before + length, ids[4 * length :], doc_tokens)
                    if not tail[0][2]:
                        tail.pop(0)
                price = sum(LINEAR * x[2] + QUADRATIC * x[2] * x[2] for x in own)
                rows += [(*x, price) for x in own]
                made += 1
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    id_type = None
    for batch, buf, offsets, _ in blocks_of(batches, BLOCK_BYTES):
        id_type = batch.schema.field(0).type
        ids, begin = tokenizer.ids(buf, offsets)
        whole, begin = ids.astype("<u4", copy=False).tobytes(), (4 * begin).tolist()
        for doc_id, i, j in zip(batch.column(0).to_pylist(), begin[:-1], begin[1:], strict=True):
            held.append((doc_id, 0, whole[i:j] + end, (j - i) // 4 + 1))
            tokens += (j - i) // 4 + 1
            if tokens >= block_sequences * capacity:
                if rows := emit(held, False):
                    yield batch_of(rows)
                tokens = sum(len(x[2]) // 4 for x in held)
    if held:
        yield batch_of(emit(held, True))
    tb.give_back()


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, block_sequences: int = BLOCK_SEQUENCES,
) -> DataFrame:
    """Pieces of documents with their ids (binary, little-endian 32-bit), sequence and place in it.

    Every id of every document, its end id included, lies in exactly one piece. `sequence_length`
    is the number of ids in the sequence: the capacity, or a power of two.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, capacity, end_id, block_sequences), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return pack(docs, default_tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
