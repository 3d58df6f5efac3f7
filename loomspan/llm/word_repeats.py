"""Repeated word windows by level-wise doubling.

A window of 35 words can only be repeated if what it contains is.  So level 1
looks at one inner run of 8 words for each window (its seed, see repeats.py),
level 2 at one of 16 words, level 3 at one of 32, and the last at all 35.
Windows whose inner run occurs once at a level go; only the others are
extended to the next, until none is left or the full length is reached.

At length l the inner run of a window starts at the first word whose distance
from the seed is a multiple of 36 - l: equal windows have equal inner runs,
and up to 36 - l neighbouring windows share one, so a level counts few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .frames import batches, cut, discard, keep, lean, signed, tagged
from .texthash import prefix_sums, windows, word_hashes

WIDTH = 35
SEED = 8


def lengths(width: int, seed: int) -> list[int]:
    """Doubling from the seed's length to the window's."""
    out = []
    while seed < width:
        seed = min(2 * seed, width)
        out.append(seed)
    return out


def _make(width: int, seed: int):
    def make(texts: list[bytes]) -> dict[str, np.ndarray]:
        words, offsets = word_hashes(texts)
        return repeats.find_runs(words, offsets, width, seed)

    return make


def _levels(rows: DataFrame, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """seed, block, n, place, copies, and for each length l an array h<l> of the hashes of the inner runs that its windows have."""
    steps = lengths(width, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, texts in batches([frame]):
                words, offsets = word_hashes(texts)
                sums = prefix_sums(words)
                out = []
                for base, of in zip(offsets, part["of"], strict=False):
                    for b in of:
                        row = [b["seed"], b["block"], b["n"], b["place"], b["copies"]]
                        for length in steps:
                            gap = width - length + 1
                            at = base + b["start"] + np.arange(b["place"] % gap, b["n"] - 1 + gap, gap)
                            row.append(signed(windows(sums, at, at + length)))
                        out.append(row)
                yield pd.DataFrame(out, columns=["seed", "block", "n", "place", "copies", *(f"h{x}" for x in steps)])

    return repeats.with_text(rows, docs).mapInPandas(lean(run), "seed long, block long, n int, place int, copies long, " + ", ".join(f"h{x} array<long>" for x in steps))


def _refine(levels: DataFrame, width: int, seed: int) -> DataFrame:
    """seed, block, ranges: the repeated windows of blocks of one seed, a block with copies being there more than once."""
    now, before = levels.withColumn("alive", F.sequence(F.lit(0), F.col("n") - 1)), []
    for length in lengths(width, seed):
        gap = width - length + 1
        number = lambda s: F.floor((s + F.pmod(F.col("place") - s, F.lit(gap)) - F.pmod("place", F.lit(gap))) / gap).cast("int")  # noqa: B023, E731
        now = keep(now.withColumn("runs", F.array_distinct(F.transform("alive", number))))
        discard(*before)
        before = [now]
        each = now.select("seed", "block", "copies", F.explode("runs").alias("run"), f"h{length}").select("seed", "block", "copies", "run", F.col(f"h{length}")[F.col("run")].alias("h"))
        twice = each.groupBy("seed", "h").agg(F.sum("copies").alias("_c")).where("_c > 1").select("seed", "h")
        good = each.where("copies = 1").join(twice, ["seed", "h"], "left_semi").groupBy("seed", "block").agg(F.collect_set("run").alias("good"))
        met = F.filter("alive", lambda s: F.array_contains("good", number(s)))
        now = now.drop("runs", f"h{length}").join(good, ["seed", "block"], "left").where("copies > 1 or good is not null").withColumn("alive", F.when(F.col("copies") > 1, F.col("alive")).otherwise(met)).drop("good")
    edge = lambda step: F.filter("alive", lambda s: ~F.array_contains("alive", s + step))
    ends = now.where(F.size("alive") > 0).select("seed", "block", edge(-1).alias("first"), edge(1).alias("last"))
    out = cut(ends.select("seed", "block", F.arrays_zip("first", "last").alias("ranges")))
    discard(*before)
    return out


def _finish(text: str | None, spans) -> tuple[int, int, str]:
    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    gone = repeats.merged(spans, len(words)) if spans is not None else []
    digest, at, first = hashlib.sha256(), 0, True
    for a, b in [*gone, (len(words), len(words))]:
        if a > at:
            digest.update(b"" if first else b" ")
            digest.update(b" ".join(words[at:a]))
            first = False
        at = b
    return len(words), sum(b - a for a, b in gone), digest.hexdigest()


def word_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (what goes, in words, as sorted start and stop pairs).

    Each word that a window of `width` words covers goes if the window's
    words also start anywhere else, in the same text too.  Windows are judged
    on the input.  Null and empty texts have no words, and their digest is
    that of nothing.  Repeated rows are texts of their own, so they repeat
    each other; all copies of a window go, so ties are no matter.  A text of
    any length is judged whole.  Other columns aren't read and may have any
    name; an empty table gives an empty result.
    """
    rows = tagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    texts = rows.select("row_tag", "text")
    runs = repeats.surviving_runs(texts, _make(width, seed), batches)
    every = repeats.blocks(runs)
    levels = _levels(every.where("rivals > 1 or copies > 1"), texts, width, seed)
    found = _refine(levels, width, seed)
    discard(every)
    marked = rows.join(repeats.spans(runs, found, width), "row_tag", "left")

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>")
    @lean
    def finish(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(t, s, strict=True):
            n, gone, digest = _finish(x, y)
            out.append((n, gone, digest, [{"start": a, "stop": b} for a, b in repeats.merged(y, n)] if y is not None else []))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "spans"])

    return marked.withColumn("_r", finish("text", "spans")).select("doc_id", "_r.*")
