"""Quality rules, licenses, secrets, media, language, BPE and token counts."""

from __future__ import annotations

import base64
import hashlib
import io
import pathlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from tamis.llm import bpe, language, licenses, media, quality, registry, secret_scan, token_count
from tamis.llm.known_licenses import EVERY, KNOWN, LONG

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def edge_duck(edge_docs):
    con = duckdb.connect()
    documents = edge_docs.select("doc_id", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    return con


# -- quality rules --------------------------------------------------------------


def test_quality_is_its_sql(edge_docs, edge_duck, same_as_sql):
    same_as_sql(quality.quality(edge_docs), edge_duck, quality.oracle())


def test_quality_counts_by_brute_force(edge_docs):
    for row in edge_docs.join(quality.quality(edge_docs).withColumnRenamed("doc_id", "i").drop("kept"), F.col("doc_id") == F.col("i")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 4000 else None
        lines = [x for x in (row.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row.n_words == len(words)
        assert row.word_chars == sum(map(len, words))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", row.text or ""))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert covered is None or row.n_repeat_words == len(covered)
        assert row.base_failed == (len(words) < 50 or 100 * row.n_repeat_words > 50 * len(words))


def test_quality_stays_native(edge_docs):
    plan = quality.quality(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_quality_filter_keeps_columns(edge_docs, no_docs):
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    verdicts = {r.doc_id: r.kept for r in quality.quality(edge_docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    assert quality.quality(no_docs).count() == 0


# -- licenses -------------------------------------------------------------------


def test_licenses_are_their_sql(edge_docs, edge_duck, same_as_sql):
    same_as_sql(licenses.license_scan(edge_docs), edge_duck, licenses.oracle())


def test_licenses_in_other_clothes(spark):
    def changed(text: str) -> str:
        text = text.upper().replace("LICENSE", "LICENCE").replace('"', "''").replace("<YEAR>", "(C) 2021, 2022")
        return "  " + text.replace(". ", " .\n") + "\nAll rights reserved.\n"

    rows = [(i, changed(t)) for i, (_, t) in enumerate(KNOWN)]
    rows += [(100 + i, t + " and more") for i, (_, t) in enumerate(KNOWN)] + [(200, None), (201, ""), (202, "...")]
    found = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(KNOWN))] == [n for n, _ in KNOWN]
    assert all(v is None for i, v in found.items() if i >= 100)


def _names(spark, texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.license_id for r in sorted(rows)]


def test_licenses_whole_long_texts(spark):
    folder = pathlib.Path(licenses.__file__).parent / "license_texts"
    texts = [(folder / f"{file}.txt").read_text() for _, file in LONG]
    assert _names(spark, texts) == [name for name, _ in LONG]
    assert _names(spark, [t + " and more" for t in texts]) == [None] * len(LONG)
    apache, gpl = texts[0], texts[7]
    assert _names(spark, [apache.split("   APPENDIX")[0], "# " + apache.replace("\n", "\n# "), apache.replace("[yyyy] [name of copyright owner]", "2020 Foo")]) == ["Apache-2.0"] * 3
    former = gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
    assert former != gpl and _names(spark, [former, gpl.split("            How to Apply")[0]]) == ["GPL-2.0"] * 2


def test_licenses_under_other_titles_and_bullets(spark):
    texts = dict(KNOWN)
    mit, bsd = texts["MIT"].split("\n", 1)[1], texts["BSD-3-Clause"]
    starred = re.sub(r"(?m)^\d\. ", "* ", bsd)
    assert starred != bsd
    found = _names(
        spark,
        [
            mit, "The MIT License (MIT)\n" + mit, "BSD 3-Clause License\n\n" + bsd, starred, "BSD 3-Clause License\n\n" + starred, bsd.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ", 1),
            "BSD 2-Clause License\n" + re.sub(r"(?m)^\d\. ", "- ", texts["BSD-2-Clause"]), "zlib License\n\n" + texts["Zlib"], texts["ISC"].split("\n", 1)[1],
        ],
    )
    assert found[:6] == ["MIT", "MIT"] + ["BSD-3-Clause"] * 4 and found[6:] == ["BSD-2-Clause", "Zlib", "ISC"]


NOTICES = (
    "Copyright Joyent, Inc. and other Node contributors", "Copyright The Foo Authors", "Copyright the Foo Authors. All rights reserved.", "Copyright: 2020 Foo",
    "copyright : Foo Ltd.", "copyright joyent, inc.", "copyright the foo authors", "COPYRIGHT THE FOO AUTHORS", "(c) Joyent, Inc.", "(C) joyent", "Copyright (c) Foo", "// Copyright Brian May",
    "# Copyright: Foo and others", "  * Copyright Émile Żak <e@example.be>", "Copyright (c) The Regents of the University of California.", "© Foo", "% Copyright Foo", "Copyright 漢字",
    "<!-- Copyright The Foo Authors -->", "Copyright (c) 2020 Foo", "(c) 2020 Foo", "Copyright by Foo", "Copyright © Foo", "Copyright: (c) 2020 Foo", "(c) Copyright Foo 2020",
)
PROSE = (
    "copyright holders be liable", "COPYRIGHT HOLDERS OR CONTRIBUTORS BE LIABLE", "copyright notice that is included in or attached to the work", "Copyright Holder, and derivatives",
    "copyright license to reproduce, prepare Derivative Works of,", "copyright on the Program, and are irrevocable provided the stated", "copyright law: that is to say, a work",
    "copyright the software, and", "Copyright and Related Rights. A Work made available", "(c) You must retain, in the Source form of any Derivative Works", "(c) Neither the name of the copyright",
    "(c) the licenses granted in this Section 2.1(a) and (b) are", "(c) under Patent Claims infringed by Covered Software in the absence of", "Copyrights for the package.",
    "copyrighted by the Free Software Foundation, write to the Free", "Copyright Foo. This software is free.", "Copyright treaty adopted in 1996", "COPYRIGHT LAW",
)


def test_licenses_drop_notices_and_keep_prose(spark):
    rows = [(t, f"one\n{t}\ntwo") for t in NOTICES + PROSE] + [(t, t) for t in NOTICES + PROSE]
    forms = [tuple(r) for r in spark.createDataFrame(rows, "line string, text string").select("line", licenses.canonical(F.col("text")).alias("form")).collect()]
    assert [r for r in forms if r[0] in NOTICES and r[1] not in ("one two", "")] == []
    assert [r for r in forms if r[0] in PROSE and len(r[1].split()) < len(re.findall(r"\w+", r[0]))] == []


def test_licenses_under_any_notice(spark):
    mit = dict(KNOWN)["MIT"]
    assert _names(spark, [mit.replace("Copyright (c) <year> <copyright holders>", n) for n in NOTICES]) == ["MIT"] * len(NOTICES)


def test_licenses_share_no_form(spark):
    forms = spark.createDataFrame(list(EVERY), "name string, text string").select("name", licenses.canonical(F.col("text")).alias("form"))
    assert forms.groupBy("form").agg(F.count_distinct("name").alias("n")).where("n > 1").count() == 0


# -- secrets ----------------------------------------------------------------------


def test_secrets_base_by_brute_force(edge_docs, spark, sf_dir):
    docs = edge_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    for row in secret_scan.secret_scan(docs).collect():
        spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.compile(p, re.A).finditer(texts[row.doc_id]) if ok(m)]
        shown = ",".join(f"{kinds[k][0]}:{lo}:{hi}" for lo, k, hi in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, shown.split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ('k = "s3cr3tV4lue99"\nother = 5\nconfig.password = k', ["s3cr3tV4lue99"]),
        ('cfg["api_key"] = "AbC12345xyz" + "moreStuff99"', ["AbC12345xyz", "moreStuff99"]),
        ("export DB_PASS='abc123XYZ!!'", ["abc123XYZ!!"]),
        ('{"client_secret": "Zx81kkQ02mmn"}', ["Zx81kkQ02mmn"]),
        ("authToken => 'Qm9uam91cjEyMw'", ["Qm9uam91cjEyMw"]),
        ('a = "Xy12Zq88pp"\nb = a + "Tt55Rr44"\nsecretKey := b', ["Xy12Zq88pp", "Tt55Rr44"]),
        ('password = "your_password_here"', []),
        ("title: a long and quiet text", []),
        ("the token: we walked home", []),
        ('colour = "A1b2C3d4E5"', []),
    ],
)
def test_secrets_by_assignment(text, secret):
    assert [text[lo:hi] for lo, hi in sorted(secret_scan.lexed_spans(text))] == secret


@pytest.mark.parametrize(
    "text",
    [
        'db = connect(password="p@ss!w0rd#9")',
        'db = connect(host, port=5, password="p@ss!w0rd#9")',
        'x={pwd:"p@ss!w0rd#9"}',
        'c = Client(passphrase="p@ss!w0rd#9")',
        'token = make_client_of(passphrase="p@ss!w0rd#9")',
        'b = "x"\na = b + connect(password="p@ss!w0rd#9")',
        'a = password = "p@ss!w0rd#9"',
        'password = a = b = "p@ss!w0rd#9"',
        'password: str = "p@ss!w0rd#9"',
        'password: Optional[str] = "p@ss!w0rd#9"',
        'password: dict[str, list[str]] = ["p@ss!w0rd#9"]',
        'const apiSecret: string = "p@ss!w0rd#9"',
        'const apiSecret: string | null = "p@ss!w0rd#9"',
        'apiSecret?: string = "p@ss!w0rd#9"',
        'val password: String = "p@ss!w0rd#9"',
        'val password: String? = "p@ss!w0rd#9"',
        'let secret: &str = "p@ss!w0rd#9"',
        'const SECRET: &\'static str = "p@ss!w0rd#9"',
        'password: std::string = "p@ss!w0rd#9"',
        'd: str = "p@ss!w0rd#9"\npassword: Optional[str] = d',
        'host: some, password = "p@ss!w0rd#9"',
        'token = ("p@ss!w0rd#9")',
        'token = [\n    "p@ss!w0rd#9",\n]',
        'password = {"p@ss!w0rd#9"}',
        'password = (prefix or "p@ss!w0rd#9")',
        'password = prefix + "p@ss!w0rd#9"',
        'cfg = {"a": [1, 2], "password": ["p@ss!w0rd#9"]}',
        'password = """p@ss!w0rd#9"""',
        "password = r\'\'\'\np@ss!w0rd#9\n\'\'\'",
    ],
)
def test_secrets_in_nested_and_declared_targets(text):
    assert [text[lo:hi] for lo, hi in secret_scan.lexed_spans(text)] == ["p@ss!w0rd#9"]
    assert "w0rd" not in secret_scan.masked(text)


def test_secrets_in_bracketed_parts():
    text = 'token = ("p@ss!w0rd#9" +\n  "Xy12Zq88pp")\nkeys = ["a"]\nsecrets = ["Tt55Rr44Ww", k("no9Argument")]'
    assert [text[lo:hi] for lo, hi in sorted(secret_scan.lexed_spans(text))] == ["p@ss!w0rd#9", "Xy12Zq88pp", "Tt55Rr44Ww"]


def test_secrets_in_bare_values():
    for text, secret in (
        ("url=https://h/?user=bob&password=@bc123XYZ!!", "@bc123XYZ!!"),
        ("c = Client(password=@bc123XYZ!!)", "@bc123XYZ!!"),
        ("password=(abc)123XYZ!!", "(abc)123XYZ!!"),
        ("password=@bc(123XYZ!!", "@bc(123XYZ!!"),
        ("token: QWxhZGRpbjpvcGVu=", "QWxhZGRpbjpvcGVu"),
        ("token: QWxhZGRpbjpvcGVu=c2VzYW1l", "QWxhZGRpbjpvcGVu"),
    ):
        assert secret in [text[lo:hi] for lo, hi in secret_scan.lexed_spans(text)], text


def test_secrets_in_nested_targets_in_linear_time():
    began = time.time()
    for text in (
        "p=@" * 130_000, "password=" * 45_000, "p=f(" * 100_000, "a:b[" * 100_000, "a: b " * 80_000, "a=(b " * 80_000, "password=@(" * 40_000,
        'a="""' * 80_000, 'a=["b"' * 60_000, "a=" + "(" * 400_000, "a=" * 200_000 + '"x"', "a=(" + "b, " * 130_000, "a: " + "b c " * 100_000, "a=b+" * 100_000,
    ):
        secret_scan.scan(text)
    assert time.time() - began < 30


def test_secrets_masked(edge_docs, no_docs):
    masked = secret_scan.mask_secrets(edge_docs)
    assert masked.schema == edge_docs.schema and masked.count() == edge_docs.count()
    assert not masked.where("text LIKE '%hunter2%'").count()
    assert secret_scan.mask_secrets(no_docs).count() == 0 and secret_scan.secret_scan(no_docs).count() == 0
    assert secret_scan.masked(None) is None and secret_scan.masked("") == ""


def test_secrets_scan_in_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "a." * 200_000, "a=" * 200_000, '="' * 200_000, "a = a + " * 50_000, "token " * 60_000, "[\"a" * 100_000, "a -" * 100_000):
        secret_scan.scan(text)
    assert time.time() - began < 30


# -- media ------------------------------------------------------------------------


def test_media_of_texts(known_docs, no_docs):
    texts = {r.doc_id: (r.text or "").encode() for r in known_docs.collect()}
    for r in media.media_digests(known_docs).collect():
        raw = texts[r.doc_id]
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert media.media_digests(no_docs).count() == 0


def test_media_area_resize_by_brute_force():
    rng = np.random.default_rng(1)
    for shape, rows, columns in (((5, 7, 1), 3, 4), ((16, 18, 3), 8, 9), ((1, 1, 1), 8, 9), ((2, 64, 1), 8, 9)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        fine = np.repeat(np.repeat(image.astype(float), rows, axis=0), columns, axis=1)
        exact = fine.reshape(rows, shape[0], columns, shape[1], shape[2]).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, rows, columns), exact)


def test_media_formats(spark):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    rgb = np.dstack([grey, grey[::-1], 255 - grey])
    pgm = b"P5 # note\n4 3\n255\n" + grey.tobytes()
    plain = b"P2\n4 3\n255\n" + " ".join(map(str, grey.ravel())).encode()
    ppm = b"P6\n4 3\n255\n" + rgb.tobytes()
    wide = b"P5\n4 3\n65535\n" + (grey.astype(">u2") * 257).tobytes()
    bits = b"P4\n4 3\n" + np.packbits(np.pad(grey < 100, ((0, 0), (0, 4))), axis=1).tobytes()
    stride = b"".join(row.tobytes() for row in rgb[::-1, :, ::-1])
    bmp = b"BM" + (54 + 36).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + stride
    assert (media.decode(pgm)[:, :, 0] == grey).all() and (media.decode(plain)[:, :, 0] == grey).all()
    assert (media.decode(ppm) == rgb).all() and (media.decode(bmp) == rgb).all()
    assert (media.decode(wide)[:, :, 0] == grey.astype(int) * 257).all()
    assert ((media.decode(bits)[:, :, 0] == 0) == (grey < 100)).all()
    rows = [(1, bytearray(pgm)), (2, bytearray(b"P5\n4 3\n255\nshort")), (3, None), (4, bytearray(bmp)), (5, bytearray(b"BM"))]
    found = {r.doc_id: r for r in media.tiles(spark.createDataFrame(rows, "doc_id long, media binary"), side=2).collect()}
    assert np.load(io.BytesIO(found[1].tile)).shape == (2, 2, 1) and len(found[1].dhash) == 16
    assert found[4].channels == 3 and all(found[i].tile is None and found[i].dhash is None for i in (2, 3, 5))


# -- language -----------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    rows = language.identify(docs.where(language.held_out(F.col("doc_id"))), dictionaries, carry=("lang",)).where("length(lang_pred) = 2").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    sure = [r for r in rows if not r.rejected]
    assert sum(r.lang == r.lang_pred for r in sure) >= 0.97 * len(sure) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edge_docs, no_docs):
    assert language.learn(no_docs) == {}
    dictionaries = language.learn(edge_docs)
    assert set(dictionaries) == {"en", "fr"}
    found = {r.doc_id: r for r in language.identify(edge_docs, dictionaries).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 15, 16)) and found[5].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in language.identify(edge_docs, {}).collect()} == {"und"}
    classifier = language.Classifier(dictionaries)
    assert all(classifier.predict(t, 0.01) == ("und", 0.0, True) for t in ("½ ² 12_3", "!?", "\u0301"))
    assert classifier.predict("é", 0.01)[0] in ("en", "fr")
    assert language.identify(no_docs, dictionaries).count() == 0


def test_language_sample_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    (content,) = language.learn(docs, dictionary_bytes=4096).values()
    assert len(content) == 4096


# -- byte-level BPE -----------------------------------------------------------------


def _tiktoken():
    blob = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return blob, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(known_docs, no_docs):
    _, exact = _tiktoken()
    texts = {r.doc_id: r.text or "" for r in known_docs.collect()}
    encoded = bpe.encode(known_docs, RANKS, public_tokenizers.PATTERN, digests=True)
    for r in encoded.collect():
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect():
        assert r.text == texts[r.doc_id]
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_texts():
    blob, exact = _tiktoken()
    encoder = bpe.encoder_of(blob, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab cé\n\t漢😀1'sre ") for _ in range(rng.randrange(400))) for _ in range(200)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "é" * 129, "x" * 128, "x" * 129]
    assert encoder.encode(texts) == [exact.encode_ordinary(t) for t in texts]


# -- token counts -------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return token_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_are_the_library(pieces, known_docs, no_docs):
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    exact.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = {r.doc_id: r.text or "" for r in known_docs.collect()}
    for r in token_count.token_counts(known_docs, pieces).collect():
        assert r.n_tokens == len(exact.encode(texts[r.doc_id], add_special_tokens=False).ids)
    counter = token_count.counter_of(pieces)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aab  cé\n\t漢😀1the▁") for _ in range(rng.randrange(300)))
        assert counter.count(text)[0] == len(exact.encode(text, add_special_tokens=False).ids)
    assert token_count.token_counts(no_docs, pieces).count() == 0 and counter.count(None) == (0, 0.0)


def test_token_counts_by_brute_force():
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.5), ("ba", -2.0)]
    counter = token_count.Counter(pieces)
    scores, low = dict(pieces), -13.0
    for n in range(7):
        for text in {"".join(random.Random(n * 50 + k).choices("abc", k=n)) for k in range(40)}:
            marked = "▁" + text if text else ""
            best = [(0.0, 0, False)] + [(float("-inf"), 0, False)] * len(marked)
            for end in range(1, len(marked) + 1):
                for start in range(end):  # the first of equal scores stays
                    part = marked[start:end]
                    if part in scores and best[start][0] + scores[part] > best[end][0]:
                        best[end] = (best[start][0] + scores[part], best[start][1] + 1, False)
                if marked[end - 1] not in scores and best[end - 1][0] + low > best[end][0]:
                    best[end] = (best[end - 1][0] + low, best[end - 1][1] + (not best[end - 1][2]), True)
            assert counter.count(text) == (best[-1][1], best[-1][0])


def test_registered_queries(spark, sf_dir):
    for name in ("op1_language_id", "op4_license_scan", "op6_media_tiles", "op7_secret_scan", "op9_byte_bpe", "op10_token_counts"):
        assert registry.QUERIES[name](spark, sf_dir).count() == 200
