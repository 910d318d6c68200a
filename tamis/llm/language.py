"""Language identification by compression against raw-content dictionaries.

Training takes a bounded, reproducible sample of the labelled texts of each language
and joins it to a raw-content zstandard dictionary.  Prediction compresses each block of a
text (4 KiB, the last one what is left) with every language's dictionary, at one level for texts of
any length; the language with the fewest bytes over the whole text wins.  Before that, training and tested texts alike are lower-cased and their runs of
other characters than letters become one space, so capitals, digits and markup weigh
nothing.  The score is the winner's softmax weight over those byte counts, so it is
near 1 / languages when they tie, and narrow margins are marked as rejected.

``und`` with score 0 stands for a null text and a text without a letter (Unicode category L);
so for empty texts.  With no labelled rows at all, or an empty training
table, every text is ``und``.  Ties go to the language with the most training text, then to the name that sorts first.  Repeated
rows get equal answers.  Very long texts are taken whole, block by block.  A row without an id is not held out.  Only the named
columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.batches import slices
from tamis.shared import col

UNDECIDED = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The lower-cased letters of a text, with one space for all that stands between them."""
    return _OTHER.sub(" ", text.lower()).encode()


def learn(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    dictionary_bytes: int = 96 << 10,
    most_from_a_text: int = 4096,
) -> dict[str, bytes]:
    """A raw-content dictionary for each value of ``lang_col``, those with the most text first.

    The sample's bound is ``dictionary_bytes`` a language (documented sample: distinct texts
    in the order of a hash, at most ``most_from_a_text`` characters of each).  The cut in
    the hash's range is set from each language's total, and distinct texts are counted
    once, so the driver receives about three times the bound, however large the table.
    """
    source = labelled.select(col(lang_col).alias("lang"), col(text_col).alias("text")).where("lang IS NOT NULL AND text <> ''")
    part = F.least(F.length("text"), F.lit(most_from_a_text))
    hashed = source.select("lang", F.xxhash64("text").alias("h"), part.alias("n"), F.substring("text", 1, most_from_a_text).alias("text"))
    place = F.pmod("h", F.lit(1 << 30))
    # the amount of distinct text is estimated from a 1/64 share of the hash's range, unless that is little
    totals = {
        r["lang"]: (r["thin"] * 64 if r["thin"] > 4 * dictionary_bytes else r["everything"])
        for r in hashed.groupBy("lang")
        .agg(F.sum("n").alias("everything"), F.sum(F.when(place < (1 << 24), F.col("n")).otherwise(0)).alias("thin"))
        .collect()
    }
    found: dict[str, bytes] = {}
    waiting = {lang: min(1.0, 3 * dictionary_bytes / max(1, n)) for lang, n in totals.items()}
    while waiting:
        cut = F.create_map(*[x for lang, share in waiting.items() for x in (F.lit(lang), F.lit(int(share * (1 << 30)) + 1))])
        rows = (
            hashed.where(place < F.get(F.array(cut[F.col("lang")]), F.lit(0)))
            .groupBy("lang", "h")
            .agg(F.min("text").alias("text"))
            .collect()
        )
        by_lang: dict[str, list] = {}
        for r in rows:
            by_lang.setdefault(r["lang"], []).append((r["h"], r["text"]))
        for lang, share in list(waiting.items()):
            texts = [letters(t) for _, t in sorted(by_lang.get(lang, []))]
            if sum(map(len, texts)) >= dictionary_bytes or share >= 1:
                found[lang] = b"\n".join(texts)[:dictionary_bytes]
                del waiting[lang]
            else:  # many copies: the distinct texts are fewer than the total promised
                waiting[lang] = min(1.0, share * 8)
    return {lang: found[lang] for lang in sorted(found, key=lambda x: (-totals[x], x))}


class Classifier:
    """Compressors of all languages, prepared once."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 4096, level: int = 12) -> None:
        self.languages, self.block = list(dictionaries), block
        self.packers = [self._packer(dictionaries[lang], level) for lang in self.languages]

    @staticmethod
    def _packer(content: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a whole text, for each language."""
        raw = letters(text)
        blocks = [raw[at : at + self.block] for at in range(0, len(raw), self.block)]
        return [sum(len(packer.compress(b)) for b in blocks) for packer in self.packers]

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """The language, the score, and whether the margin is too narrow to trust."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDECIDED, 0.0, True
        sizes = self.sizes(text)
        least = min(sizes)
        # a byte of difference is strong evidence; its weight falls with the noise of long texts
        unit = 1.0 + math.sqrt(least) / 4
        score = 1.0 / sum(math.exp((least - s) / unit) for s in sizes)
        rest = sorted(sizes)[1:2]
        margin = (rest[0] - least) / least if rest else 1.0
        return self.languages[sizes.index(least)], score, margin < narrow


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    narrow: float = 0.01,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """For each row of ``docs``: the id, ``carry`` columns, ``lang_pred``, ``score`` and ``rejected``.

    ``rejected`` marks a margin between the best two languages under ``narrow`` of the best
    one's bytes; ``lang_pred`` names the best one all the same.
    """
    if sum(map(len, dictionaries.values())) > 128 << 20:
        raise ValueError("dictionaries of over 128 MB are too large to send")
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    source = docs.select(col(id_col).alias("doc_id"), *[col(c) for c in carry], col(text_col).alias("text__"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(sent.value)
        for part in slices(batches):
            found = [classifier.predict(t, narrow) for t in part.column(part.num_columns - 1).to_pylist()]
            arrays = [part.column(i) for i in range(part.num_columns - 1)]
            arrays += [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def held_out(id_column: Column) -> Column:
    """Rows that training never sees: CRC-32 of the id's digits is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
