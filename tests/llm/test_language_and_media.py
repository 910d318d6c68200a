"""Language ID and media tiles against independent recomputations."""

from __future__ import annotations

import hashlib
import io
import math
import random
import struct
import unicodedata

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tamis.llm import language, media

# -- language -------------------------------------------------------------------


def _plain(text):
    """Lower-cased letters with one space between runs of them, without regular expressions."""
    out = []
    for c in text.lower():
        kept = c.isalnum() and not c.isdecimal()
        if kept or (out[-1:] != [" "]):
            out.append(c if kept else " ")
    return "".join(out).encode()


def _sizes(dictionaries, text):
    raw, out = _plain(text), []
    for content in dictionaries.values():
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(level=12)
        packer = zstandard.ZstdCompressor(level=12, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(sum(len(packer.compress(raw[at : at + 4096])) for at in range(0, len(raw), 4096)))
    return out


def test_language_by_brute_force(spark, sf_dir, edge_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    names = list(dictionaries)
    both = docs.select("doc_id", "text").unionByName(edge_docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    for row in language.identify(both, dictionaries, carry=("text",)).collect():
        text = row.text
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        sizes = _sizes(dictionaries, text)
        least = min(sizes)
        assert row.lang_pred == names[sizes.index(least)]
        unit = 1 + math.sqrt(least) / 4
        assert row.score == pytest.approx(1 / sum(math.exp((least - s) / unit) for s in sizes))
        assert row.rejected == ((sorted(sizes)[1] - least) / least < 0.01)


def test_language_of_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> '' AND lang IS NOT NULL")
    dictionaries = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    held = docs.where(language.held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # whole texts, and all pieces of some lengths, of the documents that training never saw
    frames = [held]
    for n in (150, 400, 600, 2000):
        at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - n, F.lit(1)), F.lit(4 * n)))
        frames.append(held.where(F.length("text") >= n).select("doc_id", "lang", at.alias("at"), "text").select("doc_id", "lang", F.expr(f"substr(text, at, {n})").alias("text")))
    for frame in frames:
        rows = language.identify(frame, dictionaries, carry=("lang",)).where("lang_pred <> 'und'").collect()
        assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_of_very_long_texts_and_no_ids(spark):
    docs = spark.createDataFrame([(1, "en", "the quick brown fox and the lazy dog " * 40), (2, "fr", "le renard brun et le chien paresseux " * 40)], "doc_id long, lang string, text string")
    dictionaries = language.learn(docs)
    rows = [(None, "the lazy dog and the fox"), (3, "le chien et le renard " * 100_000), (3, "le chien et le renard " * 100_000)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), dictionaries).select("*", language.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in found) == [(0, "en"), (3, "fr"), (3, "fr")]
    assert all(r.held_out is False for r in found if r.doc_id is None) and all(r.held_out is not None for r in found)


# -- media ------------------------------------------------------------------------


def _means(image, rows, columns):
    """Exact area means by repeating every sample, so that each area is a whole number of them."""
    fine = np.repeat(np.repeat(image.astype(np.int64), rows, axis=0), columns, axis=1)
    return fine.reshape(rows, image.shape[0], columns, image.shape[1]).sum(axis=(1, 3)), image.shape[0] * image.shape[1]


def _feature(payload, side):
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    sums, _ = _means(image, 8, 9)
    bits = "".join("01"[int(row[k + 1]) > int(row[k])] for row in sums for k in range(8))
    sums, area = _means(image, side, side)
    out = bytearray()
    for s in sums.ravel().tolist():
        whole, rest = divmod(2 * s, 2 * area)  # to the nearest, halves to even
        out.append(whole + (rest > area or (rest == area and whole % 2)))
    header = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({side}, {side}, 1), }}" + " " * (21 - len(str(side)))  # room for the first axis to grow
    header = header.ljust(-(10 + len(header) + 1) % 64 + len(header)) + "\n"
    npy = b"\x93NUMPY\x01\x00" + struct.pack("<H", len(header)) + header.encode() + bytes(out)
    return f"{int(bits, 2):016x}:{hashlib.sha256(npy).hexdigest()[:16]}"


def test_media_features_by_brute_force(known_docs, spark):
    long_ = spark.createDataFrame([(10**6, "né et " * 30_000), (10**6 + 1, "x" * 65), (10**6 + 2, None), (10**6 + 2, None)], "doc_id long, text string")
    docs = known_docs.select("doc_id", "text").unionByName(long_)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.media_digests(docs).collect():
        raw = texts[r.doc_id]
        if len(raw) < 10_000 or r.doc_id >= 10**6:
            assert r.feature == _feature(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)), 32)


def test_media_scales_by_the_maximum():
    flat = {15: b"P2\n2 1\n15\n15 0", 1: b"P2\n2 1\n1\n1 0", 1000: b"P5\n2 1\n1000\n" + struct.pack(">2H", 1000, 0), 65535: b"P5\n2 1\n65535\n" + struct.pack(">2H", 65535, 30000)}
    for most, data in flat.items():
        image, found = media.samples_of(data)
        assert found == most
        low = 0 if most < 65535 else round(30000 * 255 / 65535)
        assert np.load(io.BytesIO(media.tile(image, 2, most)))[:, :, 0].tolist() == [[255, low]] * 2


def _bmp(width, height, depth, body, colours=0, offset=54):
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(body), 0, offset, 40, width, height, 1, depth, 0, 0, 0, 0, colours, 0) + body


HOSTILE = (
    b"P2\n1 1\n255\n300", b"P2\n1 1\n255\n-3", b"P2\n1 1\n255\nx", b"P5\n99999999999 99999999999\n255\n", b"P4\n99999999999 99999999999\n", b"P1\n99999999999 9\n", b"P1\n2 1\n0 7",
    b"P3\n99999999 99999999\n255\n1", b"P6\n1 1\n65535\n123", b"P5\n1 1\n7\n\xff", b"P5\n1 1\n100000\n12", b"P5\n-1 -1\n255\n1", b"P5\n" + b"9" * 5000 + b" 1\n255\n", b"P5", b"P5\n1", b"P9\n1 1\n255\n1",
    b"BM", b"BM" + b"\xff" * 60, _bmp(2**31 - 1, 2**31 - 1, 32, b""), _bmp(1, -(2**31), 24, b"1234"), _bmp(1, 1, 8, b"\0" * 8, colours=2**32 - 1), _bmp(1, 1, 8, b"\0" * 4 + b"\5\0\0\0", colours=1, offset=58),
    _bmp(1, 1, 24, b"1234", offset=2**32 - 1), _bmp(0, 1, 24, b"1234"), _bmp(1, 0, 24, b"1234"), b"", b"\0" * 100, b"P1\n# no end",
)


def test_media_never_fails(spark):
    rng = random.Random(6)
    grey = bytes(range(12))
    whole = [b"P5 # n\n4 3\n255\n" + grey, b"P2\n4 3\n15\n" + b" ".join(b"%d" % x for x in grey), b"P6\n2 2\n255\n" + grey, b"P4\n9 2\n1234", b"P1\n2 2\n0 1 1 0", _bmp(2, 2, 24, b"\0" * 16), _bmp(2, -2, 8, b"\1\2\3\0" * 4 + b"\0\1\0\0" * 2, colours=4, offset=70)]
    cases = list(HOSTILE) + [w[:n] for w in whole for n in range(len(w))]
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(len(data))] = rng.choice(b"0919 #-\n\0\xff\x7f")
        cases.append(bytes(data))
    for data in cases:
        try:
            image, most = media.samples_of(data)
        except (ValueError, struct.error):
            continue
        assert image.size and image.max() <= most and len(media.tile(image, 4, most)) == 128 + 16 * image.shape[2]
    rows = [(i, bytearray(x)) for i, x in enumerate([*HOSTILE, *whole])]
    found = {r.doc_id: r for r in media.tiles(spark.createDataFrame(rows, "doc_id long, media binary"), side=2).collect()}
    assert all(found[i].tile is None and found[i].dhash is None and found[i].rows is None for i in range(len(HOSTILE)))
    assert all(found[len(HOSTILE) + i].tile is not None for i in range(len(whole)))
