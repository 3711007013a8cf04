"""SentencePiece encoding and decoding with a forward recursion shared over a trie of words.

The vocabulary is a public SentencePiece model, read with the ``sentencepiece`` library, which also normalises the
text; encoding and decoding are done here. The normalised text is cut into marked words (leading spaces and what
follows) where no piece can cross. Distinct words of a batch are sorted, which is the depth-first order of their
trie, and each word continues from the forward states of the prefix it shares with the word before it.

State and transition: for a unigram model the state of a prefix is its best score and last piece, the Viterbi
recursion. The public model at hand is a BPE model, for which the best sum of scores is not the tokenizer's result;
there a piece may follow a prefix only if its merge order leaves the pair (last piece of the prefix, piece) as it is.
Exactly one piece qualifies at each position, so the same recursion gives the tokenizer's own ids. (The best sum of that model's scores
gives other pieces for 60 % of the distinct words of the test documents, 45 % of their occurrences.) Words that begin
with two or more spaces are merged directly, as space pieces share one rank.

Defined results: null text gives no pieces and decodes to an empty text; repeated rows and null doc_ids pass; whole
texts of any length are encoded; U+2581 reads as a space, as in the library; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import DOC_COLUMNS

#: The public model file; a parameter of every function that encodes.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words and pairs that a Python worker remembers, characters of text in work at once, longest remembered word, rows of a result batch.
MOST_WORDS, MOST_PAIRS, SLAB, LONG, SLICE = 600_000, 1_000_000, 3_000_000, 200, 2500


class Vocabulary:
    """Pieces, scores and byte pieces of a model; encodes words and decodes ids."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str = "bpe", byte_ids: dict[int, int] | None = None, unknown: int = 0, silent: Iterable[int] = ()):
        self.pieces, self.scores, self.kind, self.byte_ids, self.unknown = pieces, scores, kind, byte_ids or {}, unknown
        special = set(self.byte_ids.values()) | set(silent) | {unknown}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.longest = max(map(len, self.ids), default=1)
        crossing = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        joins = {c for p in self.ids if len(p) > 1 for c in p}
        inner = "".join(re.escape(c) for c in sorted(joins - {SPACE}))
        # a marked word; or one character that joins nothing, with no word around it
        self.split = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{inner}{SPACE}]" if inner else ".", re.S).findall
        back = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([back[i]]) if i in back else b"" if i in special and i != unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes[unknown] = " ⁇ ".encode()
        self.pairs: dict[int, bool] = {}
        ends: dict[str, set[int]] = {}  # lengths of the pieces that end in two, and in three, given characters
        for p in sorted(self.ids, key=len):
            if len(p) > 1:
                ends.setdefault(p[-2:], {1}).add(2 if len(p) == 2 else 1)
            if len(p) > 2:
                ends.setdefault(p[-3:], {*ends[p[-2:]]}).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    @classmethod
    def load(cls, model: bytes, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = range(sp.vocab_size())
        pieces = [sp.id_to_piece(i) for i in n]
        out = cls(pieces, [sp.get_score(i) for i in n], kind, {int(pieces[i][1:-1], 16): i for i in n if sp.is_byte(i)}, sp.unk_id(), [i for i in n if sp.is_control(i) or sp.is_unused(i)])
        out.normalize = sp.normalize
        return out

    def unknown_ids(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def merge(self, word: str) -> list[str]:
        """BPE by definition: join the best-ranked neighbours, leftmost first, until none joins."""
        sym: list[str | None] = list(word)
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(sym) and (p := sym[i] + sym[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[p]], i, j, p))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or right[i] != j or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, None
            right[i] = right[j]
            if right[i] < len(sym):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in sym if s is not None]

    def follows(self, before: int, piece: int) -> bool:
        """Whether ``piece`` stays as it is after ``before`` (-1: at the start of a word)."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        b = self.pieces[piece]
        a = [self.pieces[before]] if before >= 0 else []
        got = self.pairs[before * len(self.pieces) + piece] = self.merge("".join(a) + b) == [*a, b]
        return got

    def words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, in trie order; forward states of a shared prefix are kept."""
        return (self._bpe if self.kind == "bpe" else self._unigram)(sorted(words))

    def _bpe(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        ids, pairs, size, before = self.ids, self.pairs, len(self.pieces), ""
        lengths, single = self.lengths, (1,)
        last, spans = [-1], [0]  # last piece of each prefix and its length
        for w in words:
            if w.startswith(SPACE * 2):
                yield w, [i for p in self.merge(w) for i in ([ids[p]] if p in ids else self.unknown_ids(p))]
                continue
            if len(w) == 1:
                yield w, [ids[w]] if w in ids else self.unknown_ids(w)
                continue
            shared, most = 0, min(len(before), len(w))
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del last[shared + 1 :], spans[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                tried = lengths.get(w[end - 3 : end]) if end > 2 else None
                for n in tried or (lengths.get(w[end - 2 : end], single) if end > 1 else single):
                    if n <= end and (i := ids.get(w[end - n : end])) is not None:
                        prior = last[end - n]
                        good = pairs.get(prior * size + i)
                        if good or (good is None and self.follows(prior, i)):
                            last.append(i)
                            spans.append(n)
                            break
                else:  # a character outside the vocabulary joins nothing
                    last.append(-2)
                    spans.append(1)
            before, at, out = w, len(w), []
            while at:
                out.append(last[at])
                at -= spans[at]
            out.reverse()
            if -2 in out:
                parts, at = [], 0
                for i in out:
                    n = 1 if i == -2 else len(self.pieces[i])
                    parts += self.unknown_ids(w[at]) if i == -2 else [i]
                    at += n
                out = parts
            yield w, out

    def _unigram(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        ids, scores, before = self.ids, self.scores, ""
        floor = min(scores, default=0.0) - 10.0
        best, spans = [0.0], [0]  # best score of each prefix and the length of its last piece
        for w in words:
            shared, most = 0, min(len(before), len(w))
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del best[shared + 1 :], spans[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                found = [(best[end - n] + scores[ids[p]], n) for n in range(1, min(self.longest, end) + 1) if (p := w[end - n : end]) in ids]
                top = max(found, default=(best[end - 1] + floor, 1))
                best.append(top[0])
                spans.append(top[1])
            before, at, out = w, len(w), []
            while at:
                p = w[at - spans[at] : at]
                out.append([ids[p]] if p in ids else self.unknown_ids(p))
                at -= spans[at]
            yield w, [i for part in reversed(out) for i in part]

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes batches of texts; remembers a bounded number of words."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        self.v = Vocabulary.load(model, kind)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as int32 bytes, in order."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLAB):
                size += len(texts[to] or "")
                to += 1
            cut = [self.v.split(self.v.normalize(t)) if t else [] for t in texts[at:to]]
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            known = self.known
            new = {w for ws in cut for w in ws if w not in known}
            for w, ids in self.v.words(new):
                known[w] = array("i", ids).tobytes()
            for ws in cut:
                yield b"".join([known[w] for w in ws])
            for w in new:
                if len(w) > LONG:
                    del known[w]
            at = to


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, text, ids array<int>, decoded) of every row."""
    proto = open(model, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(proto, kind)
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                ids = list(enc.encode(part.column(1).to_pylist()))
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                decoded = pa.array([enc.v.decode(np.frombuffer(x, np.int32).tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, decoded], ["doc_id", "text", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 and whether decoding gives the text back, U+2581 read as a space."""
    e = encode(docs, model)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))).alias("roundtrip"))


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of documents with ``ids`` and ``n_pieces`` added, for a pipeline's last stage."""
    proto = open(model, "rb").read()
    rows = docs.select(*DOC_COLUMNS)
    at = DOC_COLUMNS.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(proto)
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                texts = part.column(at).to_pylist()
                ids = list(enc.encode(texts))
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                back = [enc.v.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
                same = pa.array([x == (t or "").replace(SPACE, " ") for x, t in zip(back, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(ends).astype(np.int64)), same], [*DOC_COLUMNS, "ids", "n_pieces", "roundtrip"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("roundtrip", T.BooleanType())])
    return rows.mapInArrow(run, schema)
