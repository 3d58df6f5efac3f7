"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of a bounded
sample of its labelled texts.  A text is compressed with every dictionary,
after lower-casing and with digits and punctuation left out; the language
whose dictionary gives the fewest bytes wins.  Where the best and the second
differ by less than a margin, the answer is rejected.

Long texts are compressed whole, in blocks whose sizes add up.  The model is
at most DICT_BYTES a language, whatever the size of the corpus; beyond
MODEL_BYTES fitting fails rather than leave languages out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import lean, unused

#: Bytes of sample text in a language's dictionary, and the texts it is gathered from.
DICT_BYTES = 32 << 10
SAMPLE_ROWS = 400
SAMPLE_CHARS = 1500
#: Languages whose sample texts are gathered in one reading.
FITTED_AT_ONCE = 100
#: Bytes of all dictionaries, which are sent to every task.
MODEL_BYTES = 64 << 20
#: Text that is compressed at a time: beyond it a block finds itself in its own past more than in the dictionary.
BLOCK = 8 << 10
LEVELS = (6, 12)
#: Texts whose margin at the first level is below this are compressed again at the second, slower one, which then decides.
CLOSE = 0.08
#: Fewer bytes saved than this share of the second-best size: rejected.
MARGIN = 0.01
UNDETERMINED = "und"

_letter = regex.compile(r"\p{L}")
#: Bytes of ASCII that aren't letters become spaces.
_spaces = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    samples: tuple[bytes, ...]


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_spaces).split())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> Model:
    """Dictionaries from the labelled rows with a non-null language and a text.

    Of each language SAMPLE_ROWS rows at most are read, those with the
    smallest hash of `order` and the text, each different one once, and of
    each SAMPLE_CHARS characters: the bounded sample of labelled rows the
    classifier is fitted on.  So no more comes to the driver, and every
    language is learned, whatever `order` repeats or leaves null.  If the
    dictionaries may take more than MODEL_BYTES, a ValueError is raised.
    Repeated rows count once; without rows nothing is learned.
    """
    place = F.pmod(F.xxhash64(F.lit(0) if order is None else order, F.col(text)), F.lit(1 << 60))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.substring(text, 1, SAMPLE_CHARS).alias("t"), place.alias("p"))
    most = MODEL_BYTES // DICT_BYTES
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("p").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; a model that is sent to every task takes {MODEL_BYTES} bytes")
    names, found = sorted(counts), {}
    for begin in range(0, len(names), FITTED_AT_ONCE):
        taken = _sampled(rows, {k: counts[k] for k in names[begin : begin + FITTED_AT_ONCE]}).toPandas().sort_values(["l", "p"])
        for k, part in taken.groupby("l", sort=True):
            if sample := b" ".join(dict.fromkeys(map(plain, part["t"])))[:DICT_BYTES]:
                found[k] = sample
    return Model(tuple(found), tuple(found.values()))


def _sampled(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """l, t, p: of each language in counts, which has about how many different rows there are of each, SAMPLE_ROWS rows at most.

    Twice as many as wanted pass the threshold on the hash, which is far more
    than chance takes away; repeated ones become one before the rest go.
    """
    below = F.lit(0)
    for k, n in counts.items():
        below = F.when(F.col("l") == k, F.lit(int(min(1.0, 2 * SAMPLE_ROWS / max(n, 1)) * (1 << 60)))).otherwise(below)
    several = rows.where(F.col("p") < below).groupBy("l", "p").agg(F.min("t").alias("t"))
    return several.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("p"))).where(F.col("i") <= SAMPLE_ROWS).drop("i")


def coders(model: Model) -> list[list[zstandard.ZstdCompressor]]:
    """For each level a compressor of each language."""
    out = []
    for level in LEVELS:
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=DICT_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        out.append([])
        for s in model.samples:
            d = zstandard.ZstdCompressionDict(s, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out[-1].append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def classify(text: str | None, languages: tuple[str, ...], levels: list[list[zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    if not text or not languages or not _letter.search(text):
        return UNDETERMINED, 0.0, True
    if len(languages) == 1:
        return languages[0], 1.0, False
    whole = plain(text)
    blocks = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
    for each in levels:
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in each]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = (second - sizes[best]) / second
        if score >= CLOSE:
            break
    return languages[best], score, score < MARGIN


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred string, lang_score double (0 to 1) and lang_rejected boolean added.

    Only the text decides.  A null text and one without a letter get "und",
    score 0 and are rejected; so does any text if nothing was learned.  If
    sizes tie, the language first by name is named and the answer is rejected
    for its margin of 0.  A text of any length is judged whole, repeated
    rows each for themselves, and an empty table gives an empty result.
    Columns of these three names are replaced, others kept.
    """
    keep = docs.drop("lang_pred", "lang_score", "lang_rejected")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, levels = sent.value.languages, coders(sent.value)
        for s in frames:
            yield pd.DataFrame([classify(t if isinstance(t, str) else None, languages, levels) for t in s], columns=["lang", "score", "rejected"])

    judge = F.pandas_udf(lean(run), "lang string, score double, rejected boolean")
    told = unused(keep, "judged")
    out = keep.withColumn(told, judge(F.col(text)))
    return out.withColumns({"lang_pred": F.col(told)["lang"], "lang_score": F.col(told)["score"], "lang_rejected": F.col(told)["rejected"]}).drop(told)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


