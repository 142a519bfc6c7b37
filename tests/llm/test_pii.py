"""Surrogates: nothing real is left, and kind, format, coreference and distinctness hold."""

import re

from pyspark.sql import functions as F

from propspark.llm import pii, queries

SF = "/root/testdata/sf0.001"


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, surface string").repartition(3)
    return pii.replace_entities(df, key).orderBy("doc_id").collect()


def luhn(digits):
    return sum(sum(divmod(int(d) * (i % 2 + 1), 10)) for i, d in enumerate(reversed(digits))) % 10


def test_kinds_and_formats(spark):
    texts = [
        "Write to John.Doe+x@Mail7.Example.com or john.doe+x@mail7.example.com, call +1 (736) 555-2678 or (736) 555-2678.",
        "IP 97.51.17.173. Card 4111 1111 1111 1111 and 4111111111111111; ssn 123-45-6789; IBAN DE89 3704 0044 0532 0130 00 x",
        'token = "a8bbeeb08a385de42c3ee7cd437fc51b3b4445e9" here', None, "", "clean text, 12 of 1999.", "\n\n",
    ]
    got = replaced(spark, texts)
    assert [r.n_entities for r in got] == [4, 5, 1, 0, 0, 0, 0]
    assert [r.text for r in got[3:]] == texts[3:] and got[0].surface == "x"
    m = re.fullmatch(r"Write to ([A-Z][a-z]{3}\.[A-Z][a-z]{2}\+[a-z]@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com) or (\S+), "
                     r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})\.", got[0].text)
    assert m and m[1].lower() == m[2] != "john.doe+x@mail7.example.com" and m[3] == m[4] != "(736) 555-2678"
    m = re.fullmatch(r"IP ((?:\d{1,3}\.){4}) ?Card (4(?:\d{3} ?)\d{4} \d{4} \d{4}) and (4\d{15}); ssn (\d{3}-\d{2}-\d{4}); "
                     r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) x", got[1].text)
    assert m and all(int(x) < 256 for x in m[1].split(".")[:4])
    assert m[2].replace(" ", "") == m[3] != "4" + "1" * 15 and luhn(m[3]) == 0 and m[4] != "123-45-6789"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" here', got[2].text) and got[2].text != texts[2]
    assert [r.text for r in replaced(spark, texts)] == [r.text for r in got]
    assert replaced(spark, texts, "another")[0].text != got[0].text


def test_names_keep_gender_script_and_reference(spark):
    got = replaced(spark, ["Mr. John Smith met Anna Smith.", "Mrs. Smith and Dr. Мария Иванова", "Frau SMITH is no name here",
                           "Herr Νίκος Παππάς"])
    a = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+)\.", got[0].text)
    b = re.fullmatch(r"Mrs\. (\w+) and Dr\. ([А-Я][а-я]+) ([А-Я][а-я]+)", got[1].text)
    c = re.fullmatch(r"Herr (\w+) (\w+)", got[3].text)
    assert a[2] == a[4] == b[1] != "Smith" and a[1] != "John"
    assert a[3].endswith("a") and not a[1].endswith("a") and b[2].endswith("а")
    assert all(0x370 <= ord(x) < 0x400 for x in c[1] + c[2]) and got[2].n_entities == 0


def test_distinct_and_not_real(spark):
    """Small formats force collisions: all one-letter addresses are real, so their surrogates must grow."""
    real = [f"{x}@a.de" for x in "abcdefghijklmnopqrstuvwxyz"] + [f"{x}{y}@a.de" for x in "abcdef" for y in "abcdef"]
    texts = [f"{m} and again {m.upper()}" for m in real]
    got = replaced(spark, texts)
    new = []
    for t, r in zip(real, got):
        a, b = r.text.split(" and again ")
        assert b == a.upper() or len(a) != len(t) and a == b.lower()
        new.append(a.lower())
    assert len(set(new)) == len(real) and not set(new) & set(real)


def test_hot_and_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("mail a.b@c.org twice a.b@c.org").alias("text"))
    got = pii.replace_entities(df, "k").select("text", "n_entities").distinct().collect()
    assert len(got) == 1 and got[0].n_entities == 2
    assert pii.replace_entities(df.limit(0), "k").count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op1_pii_surrogates"](spark, SF).collect()}
    assert set(got) == set(docs)
    planted = r"[a-z.0-9éèêçñóíäöüß]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b"
    seen = {}
    for i, text in docs.items():
        old, new = re.findall(planted, text), got[i].text
        assert not old or got[i].n_entities >= len(old)
        for x in old:
            assert x not in new
        if not got[i].n_entities:
            assert new == text
        else:
            assert re.sub(r"[\w+@.-]*\d[\w+@.-]*", "", new).split()[:3] == re.sub(r"[\w+@.-]*\d[\w+@.-]*", "", text).split()[:3]
            for kind, x, y in zip(["card"] * 9, re.findall(r"\b\d{16}\b", text), re.findall(r"\b\d{16}\b", new)):
                assert seen.setdefault((kind, x), y) == y
    assert len(set(seen.values())) == len(seen)
