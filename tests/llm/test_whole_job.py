"""The text-corpus operators do the whole job: nothing of a query, item or value is left out."""

import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidewell.llm import bm25_wand, pii_feistel
from tidewell.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def test_bm25_searches_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    tf, length = {}, {}
    for slice_ in bm25_wand._tokens(pa.array(list(texts.values()))):
        for i in range(slice_.docs):
            doc = list(texts)[slice_.first + i]
            terms = slice_.hashes[slice_.offsets[i] : slice_.offsets[i + 1]].tolist()
            tf[doc], length[doc] = Counter(terms), len(terms)
    df = Counter(t for c in tf.values() for t in c)
    mean = sum(length.values()) / len(length)
    idf = {t: math.log(1 + (len(tf) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    got = defaultdict(list)
    for r in Q.op1_bm25_wand(spark, DIR).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q in [i for i in tf if i % 50 == 0]:
        scores = {d: sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[d] / mean)) for t in tf[q] if t in c) for d, c in tf.items()}
        best = sorted((-round(s, 9), d) for d, s in scores.items() if s > 0)[:10]
        assert [d for _, d in best] == [d for d, _ in got[q]]
        assert [-s for s, _ in best] == pytest.approx([s for _, s in got[q]], abs=2e-6)


def test_bm25_finds_a_word_of_one_document(spark):
    docs = spark.createDataFrame([(i, f"common only{i}") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "only7 unknown"), (2, " ".join(f"only{i}" for i in range(20, 30)) + " " + " ".join(f"unknown{i}" for i in range(40)))], "query_id long, text string")
    got = {(r.query_id, r.doc_id) for r in bm25_wand.search(docs, asked).collect()}
    assert got == {(1, 7), *((2, i) for i in range(20, 30))}
    queries = spark.createDataFrame([(1, " ".join(f"only{i}" for i in range(30)))], "query_id long, text string")
    assert [r.doc_id for r in bm25_wand.search(docs, queries, k=3).orderBy("rank").collect()] == [0, 1, 2]


def _with_check(country, body):
    return f"{country}{98 - pii_feistel._mod97(body + country + '00'):02d}{body}"


def test_ibans_of_every_country_and_beside_other_words():
    cipher = pii_feistel.Cipher(b"k")
    assert len(pii_feistel.IBAN_LENGTHS) == 89
    for country, length in pii_feistel.IBAN_LENGTHS.items():
        value = _with_check(country, ("7" * 40)[: length - 4])
        out, counts = pii_feistel.pseudonymise(f"to {value} now", cipher)
        assert counts == {"iban": 1} and value not in out and len(out) == len(value) + 7
    for value in ("CZ6508000000192000145399", "GR1601101250000000012300695", "HU42117730161111101800000000", "RO49AAAA1B31007593840000", "SA0380000000608010167519", "TR330006100519786457841326"):
        assert pii_feistel.pseudonymise(value, cipher)[1] == {"iban": 1}
    for text in ("DE89370400440532013000 5 items", "DE89 3704 0044 0532 0130 00 5 ITEMS", "AB12 DE89370400440532013000 X"):
        out, counts = pii_feistel.pseudonymise(text, cipher)
        assert counts == {"iban": 1} and "0532" not in out.replace(" ", "") and out[-2:] == text[-2:]
    out, counts = pii_feistel.pseudonymise("DE89370400440532013000 555-123-4567", cipher)
    assert counts == {"iban": 1, "phone": 1} and "123-4567" not in out
    out, counts = pii_feistel.pseudonymise("AB12 CDEF GHIJ 555-123-4567", cipher)
    assert counts == {"phone": 1} and "123-4567" not in out
    assert pii_feistel.pseudonymise("DE893704004405320130005 items", cipher)[1] == {}


def test_phone_of_single_digits_is_found_alone():
    out, counts = pii_feistel.pseudonymise("+1 2 3 4 5 6 7", pii_feistel.Cipher(b"k"))
    assert counts == {"phone": 1} and out != "+1 2 3 4 5 6 7"
