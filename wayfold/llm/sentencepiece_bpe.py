"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are laid end to end and indexed by a suffix array.  Every
piece of the vocabulary is looked up in it by binary search, which gives the range of its occurrences;
the occurrences are edges (start, length, piece), dealt into a table by start position, and the lattice is
relaxed over that table.  The model is a BPE model, so relaxing means its merge rule: in every segment the
best-scored edge over two neighbouring symbols joins them, the leftmost of equal ones, until no edge
is left.  (A best-path relaxation would give other ids than the model's own encoder.)  Characters no
piece holds become byte pieces.

Segments are runs of spaces with the word after them, and single line or tab characters; ``Vocabulary``
checks that no piece crosses such a border, and otherwise takes whole texts as segments.  Model files are
never trained or copied; the path is a parameter, the model's bytes go to the executors with the plan.

Null gives null; the empty text gives no ids; texts of any length are encoded whole, about ``INDEXED_CHARS`` characters of
distinct segments being indexed at a time (a longer segment, a run without any space, tab or line end, alone).  Decoding an
encoded text gives it back, with U+2581 as a space (the model's own mark for it).  Repeated rows have equal
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"
#: Characters of text taken at once, characters indexed at once (a table row of some 17 numbers each), and segments
#: and ids that a worker remembers between batches.
BATCH_CHARS = 500_000
INDEXED_CHARS = 120_000
REMEMBERED = 100_000
REMEMBERED_IDS = 500_000
_segment = re.compile(rf"{MARK}*[^{MARK}\n\t]+|{MARK}+|[\n\t]")
NONE = np.int32(-1)


def default_model() -> str:
    """Path of the installed public BPE model with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece BPE model (its serialized bytes)."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(n)]
        self.text = [sp.id_to_piece(k) for k in range(n)]
        self.normal = [k for k in range(n) if not special[k]]
        self.bytes = {int(self.text[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.unknown = sp.unk_id()
        score = np.array([sp.get_score(k) for k in range(n)])
        # Merge order as whole numbers: 0 is merged first; equal scores are equal.
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.longest = max((len(self.text[k]) for k in self.normal), default=1)
        many = [self.text[k] for k in self.normal if len(self.text[k]) > 1]
        self.splits = not any(MARK in p.lstrip(MARK) or set(p) & set("\n\t") for p in many)
        size = np.array([len(self.text[k]) for k in self.normal], np.int64)
        self.size = size
        self.ids = np.array(self.normal, np.int32)
        self.points = np.zeros((len(size), self.longest), np.uint32)
        for row, k in enumerate(self.normal):
            self.points[row, : size[row]] = [ord(c) + 1 for c in self.text[k]]
        self.out = [self.text[k].replace(MARK, " ").encode() for k in range(n)]
        for value, k in self.bytes.items():
            self.out[k] = bytes([value])
        for k in range(n):
            if sp.is_control(k):
                self.out[k] = b""

    def segments(self, text: str) -> list[str]:
        """The text in the model's normal form, cut where no piece crosses."""
        text = MARK + text.replace(" ", MARK)
        return _segment.findall(text) if self.splits else [text]

    def decode(self, ids) -> str:
        body = b"".join([self.out[k] for k in ids]).decode("utf-8", "replace")
        return body[1:] if body.startswith(" ") else body


def _keys(codes: np.ndarray, bits: int, longest: int) -> list[np.ndarray]:
    """For every row of codes (one row for each string), its codes packed into 64-bit keys, most significant first."""
    per = 64 // bits
    out = []
    for lo in range(0, longest, per):
        key = np.zeros(codes.shape[0], np.uint64)
        for k in range(lo, lo + per):
            key <<= np.uint64(bits)
            if k < codes.shape[1]:
                key |= codes[:, k].astype(np.uint64)
        out.append(key)
    return out


def _below(sorted_keys: list[np.ndarray], wanted: list[np.ndarray], strict: bool) -> np.ndarray:
    """For each wanted key tuple the number of suffixes below it (or not above it), by binary search."""
    n = len(sorted_keys[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        go = np.zeros(len(lo), bool)
        same = np.ones(len(lo), bool)
        for s, w in zip(sorted_keys, wanted, strict=True):
            v = s[at]
            go |= same & (v < w)
            same &= v == w
        if not strict:
            go |= same
        go &= lo < hi
        lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.where(lo < hi, mid, hi))
    return lo


def match(points: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The edges over a concatenated text (code points plus 1, 0 after each segment): table[start, length] = piece or -1."""
    alphabet = np.unique(points)
    alphabet = alphabet[alphabet > 0]
    n, longest = len(points), vocab.longest
    table = np.full((n, longest + 1), NONE, np.int32)
    if not len(alphabet):
        return table
    bits = 8 if len(alphabet) < 255 else 16 if len(alphabet) < 65535 else 32
    codes = np.where(points > 0, np.searchsorted(alphabet, points) + 1, 0)
    # Suffixes, cut at the longest piece: keys of the codes from every position on.
    padded = np.concatenate([codes, np.zeros(longest, codes.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, longest)[:n]
    keys = _keys(windows, bits, longest)
    # Order by the first key, then by the others where it ties.
    order = np.argsort(keys[0])
    if len(keys) > 1:
        head = keys[0][order]
        tie = np.zeros(n + 1, bool)
        tie[1:n] = head[1:] == head[:-1]
        spots = np.flatnonzero(tie[:-1] | tie[1:])
        own = order[spots]
        order[spots] = own[np.lexsort([k[own] for k in keys[::-1]])]
    keys = [k[order] for k in keys]
    # Pieces written in this alphabet.
    spot = np.minimum(np.searchsorted(alphabet, vocab.points), len(alphabet) - 1)
    held = ((alphabet[spot] == vocab.points) | (vocab.points == 0)).all(1)
    piece = np.where(vocab.points[held] > 0, spot[held] + 1, 0)
    size, ids = vocab.size[held], vocab.ids[held]
    top = np.uint64(2**bits - 1)
    rest = np.where(np.arange(longest)[None, :] >= size[:, None], int(top), piece)
    first = _below(keys, _keys(piece, bits, longest), True)
    last = _below(keys, _keys(rest, bits, longest), False)
    count = last - first
    ids, size, first, count = ids[count > 0], size[count > 0], first[count > 0], count[count > 0]
    places = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    table[order[places], np.repeat(size, count)] = np.repeat(ids, count)
    return table


def relax(points: np.ndarray, table: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's merges, in all segments at once.  Returns starts and lengths of the final symbols."""
    n, longest = len(points), table.shape[1] - 1
    size = (points > 0).astype(np.int64)
    ordered = np.append(rank, np.iinfo(np.int32).max).astype(np.int32)  # entry -1: no edge

    def cost(at):
        """Rank of the edge over the symbol at ``at`` and its right neighbour."""
        right = at + size[at]
        inside = right < n
        width = size[at] + np.where(inside, size[np.minimum(right, n - 1)], 0)
        real = inside & (width <= longest) & (width > size[at])
        return ordered[np.where(real, table[at, np.where(real, width, 0)], -1)]

    starts = np.flatnonzero(size)
    never = np.iinfo(np.int32).max
    price = np.full(n, never, np.int32)
    price[starts] = cost(starts)
    segment = np.cumsum(points == 0)[starts]
    alive, owner = starts, segment  # symbols of the segments that still merge, in order
    done = []
    while len(alive):
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(price[alive], edge)
        counts = np.diff(np.append(edge, len(alive)))
        wide = np.repeat(best, counts)
        open_ = wide < never
        done.append(alive[~open_])
        alive, owner, wide = alive[open_], owner[open_], wide[open_]
        if not len(alive):
            break
        hit = np.flatnonzero(price[alive] == wide)
        hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]  # the leftmost of each segment
        at, right = alive[hit], alive[hit + 1]
        size[at] += size[right]
        size[right] = 0
        price[right] = never
        stay = np.ones(len(alive), bool)
        stay[hit + 1] = False
        alive, owner = alive[stay], owner[stay]
        now = hit - np.arange(len(hit))  # their places after the removals
        price[at] = cost(at)
        before = np.maximum(now - 1, 0)
        ok = (now > 0) & (owner[before] == owner[now])
        left = alive[before[ok]]
        price[left] = cost(left)
    final = np.sort(np.concatenate(done)) if done else starts
    return final, size[final]


class Encoder:
    """Encodes batches of texts; remembers the ids of segments it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Match and relax the segments not met before."""
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        body = np.frombuffer("".join(fresh).encode("utf-32-le"), np.uint32)
        points = np.zeros(len(body) + len(fresh), np.uint32)  # code points plus 1; 0 ends a segment
        points[np.arange(len(body)) + np.repeat(np.arange(len(fresh)), sizes)] = body + np.uint32(1)
        table = match(points, self.vocab)
        at, size = relax(points, table, self.vocab.rank)
        ids = table[at, size]
        owner = np.cumsum(points == 0)[at]
        counts = np.ones(len(at), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            spelled = {}
            for k in unknown.tolist():
                c = chr(points[at[k]] - 1)
                if c not in spelled:
                    spelled[c] = [self.vocab.bytes.get(b, self.vocab.unknown) for b in c.encode()] if self.vocab.bytes else [self.vocab.unknown]
                counts[k] = len(spelled[c])
            wide = np.repeat(ids, counts)
            place = np.cumsum(counts) - counts
            for k in unknown.tolist():
                got = spelled[chr(points[at[k]] - 1)]
                wide[place[k] : place[k] + len(got)] = got
            ids = wide
        total = np.bincount(owner, counts, len(fresh)).astype(np.int64)
        base = len(self.pool)
        self.index.update(zip(fresh, range(len(self.begin), len(self.begin) + len(fresh)), strict=True))
        self.begin = np.concatenate([self.begin, base + np.cumsum(total) - total])
        self.count = np.concatenate([self.count, total])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.index) > REMEMBERED or len(self.pool) > REMEMBERED_IDS:
            self.forget()
        cut = [self.vocab.segments(t) if t else [] for t in texts]
        index = self.index
        fresh = set(chain.from_iterable(cut)).difference(index)
        part, size = [], 0
        for segment in fresh:  # a longer segment is indexed alone: segments stay whole
            if part and size + len(segment) > INDEXED_CHARS:
                self.learn(part)
                part, size = [], 0
            part.append(segment)
            size += len(segment) + 1
        if part:
            self.learn(part)
        segments = np.fromiter(map(len, cut), np.int64, len(cut))
        spots = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), np.int64, int(segments.sum()))
        count = self.count[spots]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.begin[spots] - (ends - count), count) + np.arange(int(count.sum()))]
        totals = np.append(0, ends)
        edge = np.append(0, np.cumsum(segments))
        return ids, totals[edge[1:]] - totals[edge[:-1]]


def _encoded(column, encoder: Encoder) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    lo, n = 0, len(column)
    while lo < n:
        texts, chars, hi = [], 0, lo
        while hi < n and (hi == lo or chars < BATCH_CHARS):
            texts.append(column[hi].as_py())
            chars += len(texts[-1] or "")
            hi += 1
        yield lo, hi, texts, *encoder.encode(texts)
        lo = hi


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text back) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model)
        encoder = Encoder(vocab)
        for batch in batches:
            for lo, hi, texts, ids, counts in _encoded(batch.column(1), encoder):
                null = np.array([t is None for t in texts])
                edge = np.append(0, np.cumsum(counts))
                same = [t is None or vocab.decode(ids[edge[k] : edge[k + 1]].tolist()) == t.replace(MARK, " ") for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32), pa.int32(), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(counts, pa.int64(), mask=null), pa.array(same, pa.bool_(), mask=null)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(rows.select("doc_id", F.col("ids")), run, f"doc_id {kind}, text string")


def read_model(path: str | None = None) -> bytes:
    """The serialized model, read on the driver; it goes out with the plan (about half a megabyte)."""
    with open(path or default_model(), "rb") as f:
        return f.read()
