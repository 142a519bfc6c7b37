"""Quality counts against plain Python; the verdict's rules case by case."""

import random
import re

from propspark.llm import quality, queries
from tests.llm import brute  # noqa: F401

SF = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\r\x0b\x0c\n", "a", "a b c d e", "a b c d e f", "x " * 5000, "é ü 🙂  # <|>\n\n#"]
    for _ in range(80):
        texts.append("".join(rng.choice(["a ", "b ", "c\n", "d\t", "#", "| ", "\n", "e. "]) for _ in range(rng.randint(0, 60))))
    df = spark.createDataFrame(list(enumerate(texts)), "n_chars int, text string")
    got = quality.measure(df).orderBy("n_chars").collect()
    for t, r in zip(texts, got):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), t


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_line_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_rules(spark):
    prose = "This line has quite a few words, and it ends well."
    cases = [
        (prose, True, prose),
        (f"{prose}\nHome | News | About | Contact\n{prose.upper()}", True, f"{prose}\n{prose.upper()}"),
        (f"{prose}\n\nAll rights reserved.", True, f"{prose}\n"),
        ("So### many$$$ of%%% the&&& words*** here### end$$$ in%%% such&&& runs*** again###.", False, ""),
        ("Home | News | About | Contact | Terms | Legal | Jobs\n" + "Sentence without any marks is cut off here now", False, ""),
        (None, False, None),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, (t, _, _) in enumerate(cases)], "doc_id int, text string, n_chars bigint")
    got = {r.doc_id: r for r in quality.measure(df).collect()}
    for i, (_, kept, cleaned) in enumerate(cases):
        assert (got[i].kept, got[i].clean_text) == (kept, cleaned)
    out = {r.doc_id: r for r in quality.clean(df).collect()}
    assert set(out) == {0, 1, 2} and out[0].n_chars == 1 and out[1].n_chars == len(out[1].text)
    assert quality.measure(df.limit(0)).count() == 0


def test_clean_lines_stay(spark):
    """One-line documents: prose with a phrase's word in it, and lines with the marks of other scripts, are clean."""
    stay = [
        "She put the last cookie on a plate, carried it to the garden and read until the sun went down.",
        "The parcel was so heavy that the copyright lawyer, who had waited since noon, asked two friends for help.",
        "There was a sign in front of the house, and nobody read it.",
        "The museum, which few visitors ever subscribe to, keeps letters of sailors written in javascript and ink for the curious.",
        "यह एक साधारण और साफ़ वाक्य है जो दंड पर समाप्त होता है।",
        "یہ ایک سادہ اور صاف جملہ ہے جو اردو کے نشان پر ختم ہوتا ہے۔",
        "ይህ ቀላል እና ንጹህ ዓረፍተ ነገር ነው ብሎ ሁሉም ሰው ያምናል።",
    ]
    go = [
        "Sign in", "Please log in to continue.", "We use cookies, see our privacy policy.", "Copyright 2020 Example, Inc.",
        "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Click here to subscribe!",
    ]
    df = spark.createDataFrame(list(enumerate(stay + go)), "doc_id int, text string")
    got = {r.doc_id: (r.n_bad_lines, r.kept) for r in quality.measure(df).collect()}
    assert [got[i] for i in range(len(stay))] == [(0, True)] * len(stay)
    assert [got[i][0] for i in range(len(stay), len(got))] == [1] * len(go)


def test_sql_says_the_same_on_odd_lines(spark):
    """Scripts without sentence marks, their own marks, phrases beside each other, after articles, inside words, in long lines."""
    import duckdb

    prose = "The keeper of the small lighthouse wrote down every ship, and nobody ever read what it said."
    lines = [
        "\u0e19\u0e35\u0e48 \u0e04\u0e37\u0e2d \u0e1b\u0e23\u0e30\u0e42\u0e22\u0e04 \u0e22\u0e32\u0e27 \u0e21\u0e32\u0e01", "\u092f\u0939 \u090f\u0915 \u0938\u0930\u0932 \u0935\u093e\u0915\u094d\u092f \u0939\u0948\u0964",
        "cookies javascript", "cookies, javascript; copyright", "Cookie-Cookie cookies", "a sign in", "A SIGN IN the hall", "visa log in", "please Sign in", "sign  in",
        "sign inside", "catalog in", "copyrighted", "xcookie", "cookie9", "\u00e9cookie", "terms of use and terms of service", "terms of  use", "LICENSED UNDER", "licenced under x",
        prose + " cookie", prose + " all rights reserved click here subscribe", "no log in, no sign in", "click here now please, sir or madam, thank you very much indeed",
        "Home | News", "Home | News | About | Contact", "a :: b :: c :: d", "wow!! what?? this|| is<< so>> odd##", "", "   ", "one two three four five", "five words with one mark.",
    ]
    rng = random.Random(4)
    texts = [None, "", *lines, *("\n".join(rng.choice(lines + [prose]) for _ in range(rng.randint(1, 9))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    columns = ["doc_id", *quality.COUNTS, "n_lines", "n_bad_lines", "line_chars", "lost_chars", "base_failed", "kept"]
    got = [tuple(r) for r in quality.measure(df).select(*columns).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({quality.MEASURE_SQL}) ORDER BY doc_id").fetchall()
    assert got == want


def test_rules_stand_once_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    plan = quality.clean(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("all rights") == 1 and plan.count("2CF9") == 1
