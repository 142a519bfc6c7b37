"""Line runs against a direct search for windows that occur earlier."""

import random
import re

from propspark.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def brute(docs, lines=3, words=50):
    """Text left and lines removed for each (key, text) in order."""
    seen, out = set(), []
    for _, text in docs:
        split = (text or "").split("\n")
        full = [i for i, x in enumerate(split) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for i in range(len(full)):
            for n in (1, lines):
                if i + n > len(full) or n == 1 and len(re.findall(r"[^\x20\x09-\x0D]+", split[full[i]])) < words:
                    continue
                gram = tuple(split[j] for j in full[i:i + n])
                if gram in seen:
                    gone.update(full[i:i + n])
                seen.add(gram)
        out.append(("\n".join(x for i, x in enumerate(split) if i not in gone) if gone else text, len(gone)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    lines = ["a b", "c", "d e f", "", " ", "g", "long " * 50 + "x", "word " * 12 + "y"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(60)]
    docs += [(100, "u\nv\nw\nz"), (101, "q\nu\n\nv\nw\nr\nu\nv"), (102, "v\nw\nz"), (103, None), (104, ""), (105, "c\n" * 2000)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id bigint, text string, th string, start int")
    for n, w in ((3, 50), (2, 12)):
        got = line_dedup.drop_repeated_lines(df, lines=n, words=w).orderBy("doc_id").collect()
        assert [(r.clean_text, r.n_removed_lines) for r in got] == brute(docs, n, w)


def test_equal_rows_and_nulls(spark):
    text = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(None, text), (None, text), (2, text), (2, text), (3, "one\ntwo\nx")], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.n_removed_lines) for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == [(0, 0), (0, 0), (2, 4), (2, 4), (3, 0)]
    assert sorted(r.doc_id or 0 for r in line_dedup.clean(df).collect()) == [0, 0, 3]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_runs_are_extended(spark):
    body = "\n".join(f"line {i}" for i in range(9))
    df = spark.createDataFrame([(1, f"start\n{body}\nend"), (2, f"other\nbegin\n{body}\nstop")], "doc_id int, text string")
    runs = line_dedup.repeated_runs(df).collect()
    assert [(r.doc, r.start, r.n, r.from_key, r.from_start) for r in runs] == [(2, 2, 9, 1, 1)]


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(queries.QUERIES["op6_line_winnowing"](spark, SF).collect())
    assert [(r.n_removed_lines, r.kept_bytes) for r in got] == [(n, len(t.encode())) for t, n in brute(docs)]
    assert sum(r.n_removed_lines for r in got) > 0


def test_fewer_lines_that_reach_the_words_together(spark):
    a, b, c, d = ("a " * 41, "b " * 43, "c " * 20, "d " * 20)
    df = spark.createDataFrame([(1, f"x\n{a}\n{b}\ny\n{c}\n{d}"), (2, f"z\n{a}\n\n{b}\nq"), (3, f"{b}\n{a}"), (4, f"{c}\n{d}\nr"),
                                (5, f"{a}\n{b}")], "doc_id int, text string")
    got = line_dedup.drop_repeated_lines(df).orderBy("doc_id").collect()
    assert [r.n_removed_lines for r in got] == [0, 2, 0, 0, 2] and got[1].clean_text == "z\n\nq"
    assert [tuple(x) for x in got[1].runs] == [(1, 2, 1, 1)]
    rng = random.Random(8)
    pool = ["a", "b b", "c " * 4, "d " * 5, "e " * 7]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    for n, w in ((3, 9), (4, 9), (5, 12)):
        got = line_dedup.drop_repeated_lines(df, lines=n, words=w).orderBy("doc_id").collect()
        assert [r.n_removed_lines for r in got] == together(docs, n, w)


def together(docs, lines, words):
    """Lines removed from each text when windows of fewer lines count that reach ``words`` words only together."""
    seen, out = set(), []
    for _, text in docs:
        full, gone = [x for x in text.split("\n") if x.strip()], set()
        size = [len(x.split()) for x in full]
        for i in range(len(full)):
            for n in range(1, lines + 1):
                own = size[i:i + n]
                if len(own) < n or n < lines and (sum(own) < words or n > 1 and max(own) >= words):
                    continue
                if tuple(full[i:i + n]) in seen:
                    gone.update(range(i, i + n))
                seen.add(tuple(full[i:i + n]))
        out.append(len(gone))
    return out
