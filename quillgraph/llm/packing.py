"""Best-fit packing of documents into token sequences, bulk-synchronous.

Every document becomes token ids and an end mark; one longer than a sequence is cut from its end, so that all its
pieces but the first are full. Pieces of over half a sequence each open one. Then rounds repeat until all are placed:

1. Pieces and the gaps of open sequences are range-sorted by size, largest first. Each task sweeps its range once: a
   piece goes to its successor, the smallest gap it fits into, whose rest is a gap again.
2. What a range could not place waits for gaps of larger ranges. A sweep over the ranges' summaries (a row for each
   range and state) deals runs of waiting pieces, by rank, to the smallest unchanged gaps before them: no gap is dealt
   twice, and a gap long enough for several pieces of a run gets as many. Tasks place each deal by the same sweep.
3. Pieces longer than any gap left open new sequences: as many as their sum needs at least, the longest first.

Sizes tie often, so ranges are cut by (size, id): a length that a third of all documents share spreads over tasks. A
round's rows are written to the shared folder, so a lost executor repeats one round's tasks. Ranges hold about ``ROWS``
rows; once all that is left fits one, that one also opens sequences, which ends the loop.

Defined results: null and empty texts are an end mark alone; a null doc_id and repeated rows are packed like others
(pieces are told apart by a number of their own); texts of any length are tokenized whole; the text ``<|endoftext|>``
becomes that token, as the tokenizer has it; columns other than doc_id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import shared_dir
from quillgraph.llm.fim import slices

#: Tokens of a sequence, the id that ends a document, and the public tokenizer.
SIZE, END, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
#: Rows of a range and most ranges of a round (larger tables get larger ranges).
ROWS, MOST_RANGES = 20_000, 20_000
#: Bytes of text in work at once, words that a Python worker remembers, words encoded by one call.
SLAB, MOST_WORDS, CALL = 8_000_000, 1_200_000, 2_000

#: Punctuation that may end a word, and letters before it: there a word is always cut.
MARKS, LETTERS = ",.;:!?", frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c not in "\u00aa\u00ba")

#: States of a row: placed in a sequence, piece waiting, gap as it was sorted, gap changed since.
PLACED, PIECE, FRESH, USED = 2, 1, 0, -1
SCHEMA = "rid long, doc_id long, piece int, start long, ids_crc32 long, ids binary, key int, seq long, offset long, part int, ord long, state int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = dict(zip(COLUMNS, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True))
#: A space before white space or the end: there the words of a text can't be told by its spaces alone.
ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)|<\|endoftext\|>"


class Encoder:
    """Token ids of texts; each word (a space and what follows up to the next) is encoded once while it is remembered.

    The tokenizer never joins across a space that text follows, so words give a text's ids. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        starts[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.starts = starts
        self.line_break = self.tokenizer.get_vocab()["Ċ"]
        self.marks = {" " + c: ids for c, ids in zip(MARKS, self.whole(list(MARKS)), strict=True)}  # no word begins with a space
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not met since ``known`` was full

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def atoms(self, word: str) -> list[str] | None:
        """Keys whose ids are a word's, one after another, where it has a line break or ends in punctuation; else None.

        The tokenizer cuts there in any case: a single line break between other characters is a token of its own, and
        so is a mark behind a letter.
        """
        lines = word.split("\n")
        if len(lines) > 1 and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return None
        keys = []
        for k, x in enumerate(lines):
            head = "\n" + x if k else x
            keys += [head[:-1], " " + x[-1]] if len(x) > 1 and x[-1] in MARKS and x[-2] in LETTERS else [head]
        return keys if len(keys) > 1 else None

    def learn(self, words: list[str]) -> None:
        """Encode words, many joined to one text each call. A key that begins with a line break stands for itself, others for a space and the word."""
        whole, cut = [], {}
        for w in words:
            keys = self.atoms(w) if not w.isalpha() else None
            if keys:
                cut[w] = keys
            else:
                whole.append(w)
        known, marks = self.known, self.marks
        parts = {k for keys in cut.values() for k in keys if k not in known and k not in marks}.difference(whole)
        for k in [k for k in parts if k in self.older]:
            known[k] = self.older[k]
            parts.remove(k)
        self.join([w for w in parts if w[0] == "\n"], "")
        self.join([*whole, *(w for w in parts if w[0] != "\n")], " ")
        for w, keys in cut.items():
            known[w] = b"".join([marks[k] if k in marks else known[k] for k in keys])

    def join(self, words: list[str], space: str) -> None:
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([space + space.join(some)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.starts[ids] if space else ids == self.line_break)
            if len(first) == len(some) and not first[0]:
                data, ends = ids.tobytes(), [*(first[1:] * 4).tolist(), len(ids) * 4]
                self.known.update(zip(some, [data[a:b] for a, b in zip((first * 4).tolist(), ends, strict=True)], strict=True))
            else:
                self.known.update(zip(some, self.whole([space + w for w in some]), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each followed by ``END``; number of ids of each)."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets, words = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
        first = offsets[:-1]
        rest = np.ones(len(words), bool)
        rest[first] = False
        coded = words.filter(pa.array(rest)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MOST_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in distinct:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        heads = words.take(pa.array(first)).to_pylist()
        if odd.any():
            for k in np.flatnonzero(odd):
                heads[k] = texts[int(k)].as_py()
        entries = [known[w] for w in distinct] + self.whole(heads) + [END.to_bytes(4, "little")]
        place = np.empty(len(words) + len(texts), np.int64)  # of each word's entry, with the end mark after each text
        shift = np.repeat(np.arange(len(texts)), np.diff(offsets))
        at = np.arange(len(words)) + shift
        place[at[first]] = len(distinct) + np.arange(len(texts))
        place[at[rest]] = coded.indices.to_numpy()
        ends = offsets[1:] + np.arange(len(texts))
        place[ends] = len(entries) - 1
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        table, begins = np.frombuffer(b"".join(entries), "<u4"), np.cumsum(sizes) - sizes
        sizes, begins = sizes[place], begins[place]
        total = np.cumsum(sizes)
        ids = table[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1])]
        return ids, np.diff(total[ends], prepend=0)


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that they share its words."""
    return Encoder(path)


def _table(columns: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in KINDS.items()], COLUMNS)


def _cut(docs: DataFrame, with_ids: bool, path: str) -> DataFrame:
    """Rows of the first state: pieces; those of over half a sequence are placed and leave a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = _encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1, SLAB):
                ids, sizes = encoder.encode(pc.fill_null(part.column(1), ""))
                counts = -(-sizes // SIZE)
                doc = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                short = sizes - (counts - 1) * SIZE  # of each document's first piece
                start = np.where(piece > 0, short[doc] + (piece - 1) * SIZE, 0)
                length = np.where(piece > 0, SIZE, short[doc])
                began = (np.cumsum(sizes) - sizes)[doc] + start
                data = memoryview(ids.tobytes())
                parts = [data[a : a + n] for a, n in zip((began * 4).tolist(), (length * 4).tolist(), strict=True)]
                rid = number + np.arange(len(doc))
                number += len(doc)
                opens = length > SIZE // 2
                rows = {
                    "rid": rid, "doc_id": part.column(0).take(pa.array(doc)), "piece": piece, "start": start, "ids_crc32": [zlib.crc32(x) for x in parts], "key": length,
                    "seq": pa.array(rid, mask=~opens), "offset": pa.array(np.zeros(len(doc), np.int64), mask=~opens), "state": np.where(opens, PLACED, PIECE),
                }
                yield _table(rows | ({"ids": [bytes(x) for x in parts]} if with_ids else {}), len(doc))
                left = opens & (length < SIZE)
                yield _table({"rid": rid[left], "key": SIZE - length[left], "state": np.full(left.sum(), USED)}, int(left.sum()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def swept(rows: pa.Table, part: int, alone: bool = False) -> pa.RecordBatch:
    """Best fit of a range's pieces into its gaps; ``rows`` are sorted, the largest first and gaps before pieces. ``alone``: pieces without a gap open sequences."""
    keys, states, rids = (rows.column(c).to_numpy() for c in ("key", "state", "rid"))
    left, state = keys.tolist(), np.where(states == PIECE, PIECE, FRESH).tolist()
    n = len(left)
    seq, offset = [None] * n, [None] * n
    gaps: list[list[int]] = [[] for _ in range(SIZE + 1)]  # rows of gaps by what is left of them
    filled = 0  # bit g: there is a gap of g
    for k, is_piece in enumerate(state):
        size = left[k]
        if not is_piece:
            gaps[size].append(k)
            filled |= 1 << size
            continue
        fits = filled >> size
        if fits:
            g = size + (fits & -fits).bit_length() - 1
            j = gaps[g].pop()
            if not gaps[g]:
                filled &= ~(1 << g)
            state[k], seq[k], offset[k] = PLACED, j, SIZE - g
            state[j] = USED if state[j] == FRESH else state[j]
            rest = g - size
        elif alone:
            state[k], seq[k], offset[k], j, rest = PLACED, k, 0, k, SIZE - size
        else:
            continue
        if state[j] != PLACED:
            left[j] = rest
        if rest:
            gaps[rest].append(j)
            filled |= 1 << rest
    state = np.array(state, np.int32)
    keep = np.array(left) > 0
    if alone:
        keep &= state == PLACED
    order = np.zeros(n, np.int64)  # rank among the range's waiting pieces, and among its unchanged gaps
    for kind in (PIECE, FRESH):
        order[state == kind] = np.arange((state == kind).sum())
    placed = state == PLACED
    # a row's sequence is the number of its gap, or its own where it opened one; an opener's gap has its row
    by_row = np.array([-1 if j is None else j for j in seq], np.int64)
    found = rids[np.where(placed, by_row, 0)] if n else rids
    out = rows.select(COLUMNS[:6]).append_column("key", pa.array(left, pa.int32())).append_column("seq", pa.array(found, pa.int64(), mask=~placed))
    out = out.append_column("offset", pa.array(offset, pa.int64())).append_column("part", pa.array(np.full(n, part, np.int32))).append_column("ord", pa.array(order)).append_column("state", pa.array(state))
    return out.filter(pa.array(keep)).combine_chunks()


def _batches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    return (b for b in rows.to_batches() if b.num_rows)


def _sweep(rows: DataFrame, ranges: int) -> DataFrame:
    order = [F.desc("key"), F.asc(F.col("state") == PIECE), F.asc("rid")]
    dealt = rows.coalesce(1) if ranges == 1 else rows.repartitionByRange(ranges, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]  # a range
        if held:
            yield from _batches(swept(pa.Table.from_batches(held), TaskContext.get().partitionId(), ranges == 1))

    return dealt.sortWithinPartitions(*order).select(*COLUMNS).mapInArrow(run, SCHEMA)


def _place_deal(rows: pa.Table) -> pa.Table:
    """A deal of pieces to gaps; deals of a negative number are pieces that open sequences."""
    if rows.column("deal")[0].as_py() < 0:
        n = rows.num_rows
        placed = {c: rows.column(c).combine_chunks() for c in COLUMNS[:7]} | {"seq": rows.column("rid").combine_chunks(), "offset": np.zeros(n, np.int64), "state": np.full(n, PLACED)}
        gap = {"rid": rows.column("rid").combine_chunks(), "key": SIZE - rows.column("key").to_numpy(), "state": np.full(n, USED)}
        return pa.Table.from_batches([_table(placed, n), _table(gap, n)])
    return swept(rows.append_column("piece_last", pc.equal(rows.column("state"), PIECE)).sort_by([("key", "descending"), ("piece_last", "ascending"), ("rid", "ascending")]), -1)


@dataclass
class Run:
    """Waiting pieces, or unchanged gaps, of one range, those not dealt yet: ranks ``at`` up to ``end``."""

    part: int
    at: int
    end: int
    least: int
    most: int
    total: int


def plan(summary: list) -> list[tuple[int, int, int, int, int]]:
    """Deals (part, state, first rank, end, number) from rows (part, state, n, least, most, total): the sweep over the ranges."""
    runs = {(r.part, r.state): Run(r.part, 0, r.n, r.least, r.most, r.total) for r in summary}
    longest = max((r.most for r in summary if r.state == USED), default=0)
    deals, waiting, open_gaps = [], [], []
    for part in sorted({r.part for r in summary}):
        pieces = runs.get((part, PIECE))
        while pieces and pieces.at < pieces.end and open_gaps:
            gaps, n = open_gaps[-1], pieces.end - pieces.at
            each = max(1, int(gaps.least / (pieces.total / pieces.end)))  # pieces of middle length in a gap
            taken = min(gaps.end - gaps.at, -(-n // each))
            last = min(pieces.end, pieces.at + taken * each)
            number = len(deals)
            deals += [(gaps.part, FRESH, gaps.end - taken, gaps.end, number), (part, PIECE, pieces.at, last, number)]
            longest = max(longest, gaps.most - pieces.least)
            gaps.end, pieces.at = gaps.end - taken, last
            if gaps.at == gaps.end:
                open_gaps.pop()
        if pieces and pieces.at < pieces.end:
            waiting.append(pieces)
        if (part, FRESH) in runs:
            open_gaps.append(runs[part, FRESH])
    stuck = [p for p in waiting if p.least > longest]  # no gap is or will be long enough
    new = -(-sum(math.ceil(p.total * (p.end - p.at) / p.end) for p in stuck) // SIZE)
    for p in stuck:
        taken = min(new, p.end - p.at)
        if taken:
            deals.append((p.part, PIECE, p.at, p.at + taken, -1 - p.part))
            new -= taken
    return deals


def placed_pieces(docs: DataFrame, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    numbers = itertools.count()

    def table(rows: DataFrame) -> DataFrame:
        where = f"{folder}/step={next(numbers)}"
        rows.write.partitionBy("state").parquet(where)
        return spark.read.schema(SCHEMA).parquet(where)

    rows = table(_cut(docs, with_ids, path)).where(F.col("state") != PLACED)
    while True:
        n = {r.is_piece: (r.n, r.least) for r in rows.groupBy((F.col("state") == PIECE).alias("is_piece")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).collect()}
        if True not in n:
            break
        rows = rows.where((F.col("state") == PIECE) | (F.col("key") >= n[True][1]))
        ranges = min(MOST_RANGES, math.ceil(sum(k for k, _ in n.values()) / ROWS))
        after = table(_sweep(rows, ranges))
        if ranges == 1:
            break
        left = after.where(F.col("state") != PLACED)
        deals = plan(left.groupBy("part", "state").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.sum("key").alias("total")).collect())
        rows = left
        if deals:
            listed = spark.createDataFrame(deals, "part int, state int, lo long, hi long, deal long")  # three for each range at most
            dealt = left.join(F.broadcast(listed), (left.part == listed.part) & (left.state == listed.state) & left.ord.between(listed.lo, listed.hi - 1), "left").select(*[left[c] for c in COLUMNS], "deal")
            done = table(dealt.where("deal is not null").groupBy("deal").applyInArrow(_place_deal, SCHEMA))
            rows = dealt.where("deal is null").drop("deal").unionByName(done.where(F.col("state") != PLACED))
    out = spark.read.schema(f"{SCHEMA}, step int").parquet(folder).where(F.col("state") == PLACED)
    return out.select("doc_id", "piece", "start", F.col("key").cast("long").alias("length"), "ids_crc32", "ids", F.col("seq").alias("sequence_id"), "offset")


def pack(docs: DataFrame) -> DataFrame:
    """``placed_pieces`` without the ids themselves."""
    return placed_pieces(docs).drop("ids")


def sequences(docs: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array of int, in order, at most ``SIZE``) and the doc_ids that they come from."""

    def ids(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        joined = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int32)
        return pa.table({"sequence_id": rows.column("sequence_id").slice(0, 1), "ids": pa.array([joined], pa.list_(pa.int32())), "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))})

    return placed_pieces(docs, with_ids=True).groupBy("sequence_id").applyInArrow(ids, "sequence_id long, ids array<int>, doc_ids array<long>")
