"""Repeated byte strings by suffix arrays.

Windows of `width` bytes are routed to shards by their seed (see repeats.py),
so equal windows meet.  Each shard builds a suffix array of its blocks by
Larsson-Sadakane refinement and Kasai's common prefixes; neighbours that
share `width` bytes and more are repeated, as is what a block with copies has.

A seed with very many different blocks is dealt out over several shards.
Each of those hands on the hash of each of its different windows, in order,
and the shards' lists are merged by binary search, a range of hashes at a
time.  So no task holds more than a shard or a range, however hot a seed is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .frames import batches, cut, discard, keep, signed, tagged
from .suffix import Strings, common_prefixes, repeated, search, suffix_array
from .texthash import U, mix, prefix_sums, windows

WIDTH = 200
SEED = 40
#: Bytes of a shard; blocks of a seed beyond which it is dealt out over several.
SHARD_BYTES = 3 << 20
HOT_BLOCKS = 8000
_NUMBERS = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _make(width: int, seed: int):
    def make(texts: list[bytes]) -> dict[str, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        return repeats.find_runs(np.frombuffer(b"".join(texts), np.uint8), offsets, width, seed, _NUMBERS)

    return make


def _batches(frames, text: str = "text"):
    return batches(frames, text, 1 << 20)


def _contents(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """seed, block, rivals, copies, content of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, texts in _batches([frame]):
                out = [(b["seed"], b["block"], b["rivals"], b["copies"], t[b["start"] : b["start"] + b["n"] + width - 1]) for of, t in zip(part["of"], texts, strict=True) for b in of]
                yield pd.DataFrame(out, columns=["seed", "block", "rivals", "copies", "content"])

    return repeats.with_text(rows, docs).mapInPandas(run, "seed long, block long, rivals long, copies long, content binary")


def shard(seeds: np.ndarray, blocks: np.ndarray, salts: np.ndarray, shards: np.ndarray, copies: np.ndarray, contents: list[bytes], width: int) -> pd.DataFrame:
    """The repeated windows of one shard, and of seeds in several shards the hashes of its different windows."""
    s = Strings.of(contents)
    order = suffix_array(s)
    flags, first = repeated(s, order, common_prefixes(s, order), width, copies)
    given: dict[int, list] = {}
    if (shards > 1).any():
        first = np.sort(first[shards[s.owner[first]] > 1])
        hashes = signed(windows(prefix_sums(_NUMBERS[s.data]), first, first + width))
        bounds = np.searchsorted(first, s.offsets)
        for i in np.flatnonzero(np.diff(bounds)):
            mine = slice(bounds[i], bounds[i + 1])
            given[int(i)] = [{"h": int(h), "at": int(p - s.offsets[i])} for h, p in zip(hashes[mine], first[mine], strict=True)]
    out = []
    for i in range(len(contents)):
        found = flags[s.offsets[i] : s.offsets[i + 1] - width + 1]
        if i in given or found.any():
            out.append((seeds[i], blocks[i], salts[i], shards[i], repeats.ranges(found), given.get(i)))
    return pd.DataFrame(out, columns=["seed", "block", "salt", "shards", "ranges", "given"])


def _in_shards(contents: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """contents, dealt out by seed and salt and sorted, goes shard by shard; a shard ends between two groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for frame in frames:
            for row in zip(frame["seed"], frame["block"], frame["salt"], frame["shards"], frame["copies"], map(bytes, frame["content"]), strict=True):
                if size >= shard_bytes and (row[0], row[2]) != (held[-1][0], held[-1][2]):
                    yield _shard_of(held, width)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield _shard_of(held, width)

    return contents.mapInPandas(run, "seed long, block long, salt int, shards int, ranges array<struct<first:int,last:int>>, given array<struct<h:long,at:int>>")


def _shard_of(held: list[tuple], width: int) -> pd.DataFrame:
    seeds, blocks, salts, shards, copies, contents = zip(*held, strict=True)
    return shard(np.array(seeds, np.int64), np.array(blocks, np.int64), np.array(salts, np.int32), np.array(shards, np.int32), np.array(copies, np.int64), list(contents), width)


def _merge(shards: DataFrame) -> DataFrame:
    """seed, block, ranges: windows of seeds in several shards that another shard has too."""
    rows = shards.where("given is not null").select("seed", "block", "salt", "shards", F.explode("given").alias("g")).select("seed", "block", "salt", "g.*", F.pmod(F.shiftright("g.h", 20), F.col("shards")).alias("part"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        everything = np.sort(frame["h"].to_numpy())
        found = []
        for _, one in frame.groupby("salt"):
            found.append(one[search(everything, one["h"].to_numpy()) > 1])
        out = pd.concat(found)
        return pd.DataFrame({"seed": out["seed"], "block": out["block"], "at": out["at"]})

    hits = rows.groupBy("seed", "part").applyInPandas(merge, "seed long, block long, at int")
    return hits.select("seed", "block", F.array(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("ranges"))


def byte_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, hot_blocks: int = HOT_BLOCKS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (what goes, in bytes, as sorted start and stop pairs that don't touch).

    Each byte that a window of `width` bytes covers goes if the window's
    bytes also start anywhere else, in the same text too.  Windows are judged
    on the input.  Null and empty texts have no bytes, and their digest is
    that of nothing.  Repeated rows are texts of their own, so they repeat
    each other; all copies of a window go, so ties are no matter.  A text of
    any length is judged whole.  Other columns aren't read and may have any
    name; an empty table gives an empty result.
    """
    rows = tagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    texts = rows.select("row_tag", "text")
    runs = repeats.surviving_runs(texts, _make(width, seed), _batches, write=True)
    every = repeats.blocks(runs)
    contents = _contents(every.where("rivals > 1 or copies > 1"), texts, width).withColumn("shards", F.ceil(F.col("rivals") / hot_blocks).cast("int")).withColumn("salt", F.pmod(F.shiftright("block", 16), F.col("shards")).cast("int"))
    dealt = contents.select("seed", "block", "salt", "shards", "copies", "content").repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    shards = keep(_in_shards(dealt, width, shard_bytes))
    discard(every)
    found = cut(shards.where(F.size("ranges") > 0).select("seed", "block", "ranges").unionByName(_merge(shards)))
    discard(shards)
    marked = rows.join(repeats.spans(runs, found, width), "row_tag", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>")
    def finish(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for x, given in zip(t, s, strict=True):
            data = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b""
            gone = repeats.merged(given, len(data)) if given is not None else []
            digest, at = hashlib.sha256(), 0
            for a, b in [*gone, (len(data), len(data))]:
                digest.update(data[at:a])
                at = b
            out.append((len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "stop": b} for a, b in gone]))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return marked.withColumn("_r", finish("text", "spans")).select("doc_id", "_r.*")
