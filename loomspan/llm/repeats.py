"""What the two repeated-substring operators share.

A window is `width` consecutive values (bytes or words) of one text.  It is
repeated if an equal one starts anywhere else.  Each window has a seed: of
the hashes of its inner runs of `seed` values the smallest, the leftmost of
equal ones.  Equal windows have equal seeds, so they can only be found among
windows of one seed.  Neighbouring windows mostly share the seed's place;
such a run of windows is one row, and the values it covers are its block.

* runs of a seed that occurs once can't hold a repeated window and go;
* equal blocks are carried on as one, with the number of its copies;
* what is left, blocks that share a seed with any other or with a copy, goes
  to the operator's own method, which says which windows are repeated: those
  met at two places and more, a block's copies counted.

Counts add up before they shuffle, and the joins are equi-joins that Spark
may split where a seed is in very many texts.  Texts travel twice: to their
blocks and to their spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, keep, lean, signed
from .texthash import U, prefix_sums, windows

_PLACE = U((1 << 24) - 1)
#: Windows looked at together; a longer text is looked at in parts that overlap by a window.
PART = 1 << 20


def find_runs(values: np.ndarray, offsets: np.ndarray, width: int, seed: int, numbers: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of windows of texts lying one after another: text i has values[offsets[i]:offsets[i + 1]].

    numbers: stands in for each value, if values are bytes.
    """
    found: list[dict[str, np.ndarray]] = []
    for at in range(0, max(len(values), 1), PART):
        part = values[at : at + PART + width - 1]
        if len(part) >= width:
            part = part if numbers is None else numbers[part]
            found.append(_part_runs(part, np.clip(offsets - at, 0, len(part)), at, width, seed))
    out = {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in ("seed", "block", "start", "n", "place")}
    out["text"] = np.searchsorted(offsets, out["start"], "right") - 1
    out["start"] = out["start"] - offsets[out["text"]] if len(offsets) else out["start"]
    return out


def _part_runs(values: np.ndarray, offsets: np.ndarray, at: int, width: int, seed: int) -> dict[str, np.ndarray]:
    sums = prefix_sums(values)
    i = np.arange(len(values) - seed + 1)
    hashes = windows(sums, i, i + seed)
    low = (hashes & ~_PLACE) | i.astype(np.uint64)
    size, want = 1, width - seed + 1
    while 2 * size <= want:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if want > size:
        low = np.minimum(low[: len(low) - (want - size)], low[want - size :])
    inside = np.ones(len(low), bool)
    for edge in np.unique(offsets):
        inside[max(0, edge - width + 1) : edge] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("seed", "block", "start", "n", "place")}
    place = (low[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(place) != 0)]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    begin, end = starts[first], starts[last]
    return {"seed": signed(hashes[place[first]]), "block": signed(windows(sums, begin, end + width)), "start": begin + at, "n": end - begin + 1, "place": place[first] - begin}


def surviving_runs(docs: DataFrame, make: Callable[[list[bytes]], dict[str, np.ndarray]], batched: Callable, write: bool = False) -> DataFrame:
    """row_tag, seed, block, start, n, place (of the seed, from the start): the runs of windows whose seed occurs twice and more.  docs has row_tag and text.

    write: keep all runs until then instead of making them twice; more disk, less time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, texts in batched(frames):
            r = make(texts)
            yield pd.DataFrame({"row_tag": rows["row_tag"].to_numpy()[r["text"]], "seed": r["seed"], "block": r["block"], "start": r["start"].astype(np.int32), "n": r["n"].astype(np.int32), "place": r["place"].astype(np.int32)})

    runs = docs.mapInPandas(lean(run), "row_tag long, seed long, block long, start int, n int, place int")
    runs = keep(runs) if write else runs
    twice = keep(runs.groupBy("seed").agg(F.count("*").alias("_c")).where("_c > 1").select("seed"))  # written, so that the join stands alone and Spark may split a hot seed
    out = keep(runs.join(twice, "seed"))
    discard(twice, *[runs] * write)
    return out


def blocks(runs: DataFrame) -> DataFrame:
    """seed, block, n, place, copies, row_tag, start (of one copy), rivals (how many different blocks the seed has)."""
    once = keep(runs.groupBy("seed", "block").agg(F.count("*").alias("copies"), F.min(F.struct("row_tag", "start")).alias("_first"), F.min("n").alias("n"), F.min("place").alias("place")))
    rivals = keep(once.groupBy("seed").agg(F.count("*").alias("rivals")))
    out = keep(once.join(rivals, "seed").select("seed", "block", "n", "place", "copies", "_first.row_tag", "_first.start", "rivals"))
    discard(once, rivals)
    return out


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """text, of: the blocks of each text that has any (array of seed, block, start, n, place, rivals, copies)."""
    per_text = rows.groupBy("row_tag").agg(F.collect_list(F.struct("seed", "block", "start", "n", "place", "rivals", "copies")).alias("of"))
    return docs.join(per_text, "row_tag").select("text", "of")


def spans(runs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """row_tag, spans: for each text with repeated windows what they cover, as (start, stop) pairs, in no order.

    found: seed, block, ranges (array of first and last repeated window).
    """
    hits = runs.select("row_tag", "seed", "block", "start").join(found, ["seed", "block"])
    covered = F.transform("ranges", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] + width).alias("stop")))
    return hits.select("row_tag", covered.alias("_s")).groupBy("row_tag").agg(F.flatten(F.collect_list("_s")).alias("spans"))


def ranges(flags: np.ndarray) -> list[dict[str, int]]:
    """First and last of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def merged(given, n: int) -> list[tuple[int, int]]:
    """The union of spans in 0..n as sorted runs that don't touch."""
    out: list[list[int]] = []
    for s in sorted((s["start"], min(s["stop"], n)) for s in given):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]
