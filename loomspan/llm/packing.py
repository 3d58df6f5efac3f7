"""Best-fit packing with large-item matching.

Texts become token ids with an end id; only those longer than a sequence are
cut.  The plan is made on the histogram of piece lengths, which has at most
`capacity` entries however many pieces there are:

* Pieces longer than a third of the capacity are large.  At most two of them
  share a sequence: the longest still unmatched goes with the longest large
  piece that fits beside it.
* Smaller pieces, longest first, go where they leave the smallest gap
  (best fit); if none has room, a new sequence opens.

Pieces of one length are interchangeable, so the plan says for each length
which ranks go to which run of sequences at which offset.  Ranks come from
counts of (length, slice) pairs, slices being even shares of the pieces by
hash; no length, however common, meets in one task.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import batches, cut, held, lean, tagged

CAPACITY = 2048
END_ID = 0
#: Pieces in a slice, about; a slice is numbered by one task.
SLICE_ROWS = 100_000
#: Words of a generation that a worker process remembers the ids of; those of one batch may come on top.
MEMORY = 500_000


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary's rules drop white space and never join across it, so a
    text's ids are those of its words in a row.  They also ignore case and
    part letters and digits from what follows, so ASCII marks at a word's end
    are a word of their own if the rules begin anew behind the character
    before them.  Its special marks are told in the text as it is, before case
    is ignored, and end what stands before them.

    Texts are parted as arrays of bytes and each different word of a batch is
    looked up once.  Words are remembered in two generations: when MEMORY
    words are known they become the older one, from which words in use are
    taken over.
    """

    _spaces = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
    _marks = np.isin(np.arange(256), list(string.punctuation.encode()))
    _word_end = "</w>"
    #: A capital that an accent may follow: the rules join the two before they ignore case, and w has a joint form with a ring, but W has none.
    _before_more = re.compile(rb"([A-Z](?=[\x80-\xff]))")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True  # marks are told here; what only lower-casing makes one is not
        special = {t.content.encode(): i for i, t in self.coder.get_added_tokens_decoder().items()}
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.stand_in = {k: b" \xff%d " % i for k, i in special.items()}  # no UTF-8 has this byte
        self.first_bytes = {k[:2] for k in special}
        self.fixed = {b"\xff%d" % i: np.array([i], "<u4").tobytes() for i in special.values()}
        self.known: dict[bytes, bytes] = dict(self.fixed)
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.coder.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(self._word_end)]] = True
        self.parted = np.full(1 << 16, -1, np.int8)  # by the bytes of a character, two at most: 1 if a mark behind it begins anew, -1 if not known yet
        self.parted[0] = 0

    def _plain(self, text: bytes) -> bytes:
        if any(b in text for b in self.first_bytes):
            text = self.special.sub(lambda m: self.stand_in[m[0]], text)
        if b"\xcc" in text or b"\xcd" in text:  # accents of their own, U+0300 to U+037F
            return b"".join(t if k % 2 else t.lower() for k, t in enumerate(self._before_more.split(text)))
        return text.lower()

    def _is_parted(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a mark begins anew behind the character that ends in these two bytes; no for those of three bytes and more."""
        two = (before >= 0xC2) & (before < 0xE0) & (last >= 0x80) & (last < 0xC0)
        keys = np.where(last < 0x80, last, np.where(two, before.astype(np.int32) << 8 | last, 0))
        for k in np.unique(keys[self.parted[keys] < 0]).tolist():
            c = (bytes([k]) if k < 0x80 else k.to_bytes(2)).decode()
            both, one, mark = (self.coder.encode(x, add_special_tokens=False).ids for x in (c + ".", c, "."))
            self.parted[k] = both == one + mark  # in one piece they have one end, not two
        return self.parted[keys] == 1

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of bytes that begin and end with white space: where words begin, the different words, and which of them each one is."""
        spaces, marks = self._spaces[data], self._marks[data]
        begins = ~spaces
        begins[1:] &= spaces[:-1]
        first, last = np.flatnonzero(marks[1:] & ~marks[:-1]) + 1, np.flatnonzero(marks[:-1] & ~marks[1:])
        first = first[spaces[last + 1] & ~spaces[first - 1]]
        begins[first[self._is_parted(data[first - 2], data[first - 1])]] = True
        dense = data[~spaces]
        ends = np.append(np.flatnonzero(begins[~spaces]), len(dense)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(dense)]).dictionary_encode()
        _, ends, dense = column.dictionary.buffers()
        ends, dense = np.frombuffer(ends, np.int64, len(column.dictionary) + 1).tolist(), dense.to_pybytes() if dense else b""
        return np.flatnonzero(begins), [dense[a:b] for a, b in itertools.pairwise(ends)], column.indices.to_numpy()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words, which are encoded as one text: each has one end at least, so if there are as many as words, those part them; else by halves."""
        ids = np.array(self.coder.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        data = ids.tobytes()
        if len(words) < 2:
            return [data] * len(words)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            half = len(words) // 2
            return self._encode(words[:half]) + self._encode(words[half:])
        return [data[a:b] for a, b in itertools.pairwise([0, *(4 * ends).tolist()])]

    def _learn(self, new: list[bytes]) -> None:
        known, older = self.known, self.older
        known.update((w, older[w]) for w in new if w in older)
        texts = {w: w.decode("utf-8", "replace") for w in new if w not in older}
        letters = {w: t for w, t in texts.items() if t.lower().isalpha()}
        others = {w: t for w, t in texts.items() if w not in letters}
        known.update(zip(letters, self._encode(list(letters.values())), strict=True))
        out = self.coder.encode_batch_fast(list(others.values()), add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, out, strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, dict(self.fixed)
        texts = [self._plain(t) for t in texts]
        begins, words, codes = self._words(np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8))
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        ids = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        size = sizes[codes]
        ends = np.append(0, np.cumsum(size))
        out = every[np.repeat(firsts[codes] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[np.searchsorted(begins, np.cumsum([1, *(len(t) + 1 for t in texts)]))].tolist()
        return [out[a:b].tobytes() for a, b in itertools.pairwise(at)]


@held
def word_tokens(path: str) -> WordTokens:
    """One for a worker process, whatever packing tasks it gets."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_tag, piece, start, length, ids_crc32: whole texts, cut only if longer than the capacity.

    Null text is empty and has the end id alone.  row_tag tells rows of equal
    doc_id apart; a text of any length is tokenised whole.  Other columns
    aren't read and may have any name.  An empty table gives an empty result.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = word_tokens(tokenizer)
        for column in series:
            out = []
            for ids in (ids for _, texts in batches([column.to_frame("text")]) for ids in tokens(texts)):
                ids += end
                parts = [ids[at : at + 4 * capacity] for at in range(0, len(ids), 4 * capacity)]
                out.append([{"piece": n, "start": n * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for n, p in enumerate(parts)])
            yield pd.Series(out)

    cut_up = F.pandas_udf(lean(run, word_tokens), "array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    rows = tagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return rows.select("doc_id", "row_tag", F.explode(cut_up("text")).alias("_p")).select("doc_id", "row_tag", "_p.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) for all pieces, from how many there are of each length."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: runs (first sequence, how many)
    opened = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    alive = list(large)
    while alive:
        a = alive[-1]
        if not left[a]:
            alive.pop()
            continue
        i = bisect.bisect_right(alive, capacity - a) - 1
        while i >= 0 and not left[alive[i]]:
            del alive[i]
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, opened, 0)
            gaps[capacity - a].append((opened, n))
        else:
            b = alive[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # one is left, and only its like would fit: look below it
                j = i - 1
                while j >= 0 and not left[alive[j]]:
                    j -= 1
                if j < 0:
                    put(a, 1, opened, 0)
                    gaps[capacity - a].append((opened, 1))
                    opened += 1
                    continue
                b, n = alive[j], 1
            put(a, n, opened, 0)
            put(b, n, opened, a)
            gaps[capacity - a - b].append((opened, n))
        opened += n
    rooms = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                n, rest = divmod(left[length], each)
                for first, many, items in ((opened, n, each), (opened + n, 1 if rest else 0, rest)):
                    if many:
                        for k in range(items):
                            put(length, many, first, k * length)
                        room = capacity - items * length
                        if room not in gaps or not gaps[room]:
                            bisect.insort(rooms, room)
                        gaps[room].append((first, many))
                opened += n + bool(rest)
                break
            room = rooms[i]
            first, many = gaps[room].pop()
            n = min(many, left[length])
            if n < many:
                gaps[room].append((first + n, many - n))
            if not gaps[room]:
                del rooms[i]
            put(length, n, first, capacity - room)
            if not gaps[room - length]:
                bisect.insort(rooms, room - length)
            gaps[room - length].append((first, n))
    return out


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with row_tag, piece and length, 1 to capacity) with sequence_id long and offset long added.

    Offsets in a sequence go from 0 without gaps.  Which of the pieces of one
    length gets which place is decided by hash, alike in every run over the
    same rows.  An empty table gives an empty result.
    """
    parts = cut(parts)
    spark = parts.sparkSession
    n_slices = max(1, -(-parts.count() // SLICE_ROWS))
    sliced = parts.withColumn("_slice", F.pmod(F.xxhash64("row_tag", "piece"), F.lit(n_slices)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    totals = sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most `capacity` rows
    steps = plan({r["length"]: r["n"] for r in totals}, capacity)
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_slice").orderBy("row_tag", "piece")
    ranked = sliced.withColumn("_i", F.row_number().over(within) - 1).join(bases, ["length", "_slice"]).withColumn("_rank", F.col("_i") + F.col("_base"))
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, _, first, offset in steps:
        by_length[length].append((rank, first, offset))
    sent = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in by_length.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        at, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for n in np.unique(lengths):
            mine, rows = np.flatnonzero(lengths == n), sent.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], ranks[mine], "right") - 1]
            at[mine], offset[mine] = row[:, 1] + ranks[mine] - row[:, 0], row[:, 2]
        return pd.DataFrame({"sequence_id": at, "offset": offset})

    return ranked.withColumn("_at", place("length", "_rank")).select(*parts.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, row_tag, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated rows each for themselves, a null or
    empty text as its end id.  Pieces of one length are interchangeable, and
    which goes where is decided by hash.  An empty table gives an empty
    result.  Other columns of docs aren't read and may have any name.
    """
    return packed(pieces(docs, tokenizer, capacity, doc_id, text), capacity)
