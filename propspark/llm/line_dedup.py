"""Removal of runs of lines that occur earlier, found by winnowed line hashes (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.llm.quality import let
from propspark.llm.text import content
from propspark.session import materialize

LINES, WORDS = 3, 50


def _windows(full: Column, lines: int, words: int) -> Column:
    """Windows of ``lines`` lines, each under its least line hash, lines of ``words`` words as windows alone, and
    windows of fewer lines that reach ``words`` words together, none of them alone.

    A window has its first line's number, its length, the fingerprint (hash and number of the line) and a 128-bit key.
    """

    def window(at: Column, lines: int = lines) -> Column:
        rows = [F.get(full, at + j) for j in range(lines)]
        least = F.array_min(F.array(*[F.struct(r["h1"].alias("h"), (at + j).alias("at")) for j, r in enumerate(rows)]))
        return F.struct(
            at.alias("at"), F.lit(lines).alias("n"), least["h"].alias("f"), least["at"].alias("f_at"),
            F.xxhash64(F.lit(lines), *[r["h1"] for r in rows]).alias("k1"),
            F.xxhash64(F.lit(-lines), *[r["h2"] for r in rows]).alias("k2"))

    def alone(row: Column, at: Column) -> Column:
        return F.when(row["words"] >= words, F.struct(
            at.alias("at"), F.lit(1).alias("n"), row["h1"].alias("f"), at.alias("f_at"),
            row["h1"].alias("k1"), row["h2"].alias("k2")))

    def together(lines: int) -> Column:
        def of(row: Column, at: Column) -> Column:
            each = [row["words"], *[F.get(full, at + j)["words"] for j in range(1, lines)]]
            # beyond the last line the sum is null
            return F.when((sum(each[1:], each[0]) >= words) & (F.greatest(*each) < words), window(at, lines))

        return F.transform(full, of)

    every = F.when(F.size(full) >= lines, F.transform(F.sequence(F.lit(0), F.size(full) - lines), lambda at: window(at)))
    single = F.filter(F.concat(
        F.transform(full, alone), *[together(n) for n in range(2, lines)]), lambda x: x.isNotNull())
    return let(single, lambda some: F.when(every.isNull(), some).otherwise(F.concat(every, some)))


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES, words: int = WORDS) -> DataFrame:
    """Maximal runs of lines that occur earlier: key, text hash, ``start`` and ``n`` (counted in lines with a word)
    and the earlier place (``from_key``, ``from_start``).

    Line hashes are winnowed: of any ``lines`` consecutive lines the least hash is a fingerprint, so a repeated run of
    that length shares one; a line of ``words`` words is one by itself, and of fewer lines that
    have ``words`` words only together the least is one too. Only windows whose fingerprint
    occurs twice are looked at further. They meet their first equal window in (key, text hash, line) order, by
    the hash of all their lines, and matches that continue each other on the same pair of places are extended
    both ways into one run. Each window has one partner, however often it occurs, so nothing grows with the square of a
    frequent line's count.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc"), content(F.col(f"`{text}`")).alias("t"))
    each = F.transform(F.split("t", "\n"), lambda x: F.struct(
        F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"),
        F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    found = rows.select("doc", F.xxhash64("t").alias("th"), F.explode(
        let(F.filter(each, lambda x: x["words"] > 0), lambda full: _windows(full, lines, words))).alias("w"))
    found = materialize(found.select("doc", "th", "w.*"), "windows")

    place = F.xxhash64("doc", "th", "f_at")
    common = found.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("f")
    found = materialize(found.join(common, "f", "left_semi").drop("f", "f_at"), "candidates")

    here = F.struct("doc", "th", "at")
    first = found.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    matched = found.join(first.filter("first <> last"), ["k1", "k2"]).filter(F.col("first") != here)
    shift = F.col("at") - F.col("first.at")
    track = ["doc", "th", "from_key", "from_th", "shift"]
    matched = matched.select("doc", "th", "at", "n", F.col("first.doc").alias("from_key"), F.col("first.th").alias("from_th"),
                             shift.alias("shift")).distinct()
    # on one track, a match that begins inside or right after what is covered so far goes on with the run
    order = Window.partitionBy(*track).orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = matched.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1))
    begun = begun.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = begun.groupBy(*track, "run").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"))
    return runs.select("doc", "th", "start", (F.col("end") - F.col("start")).alias("n"), "from_key",
                       (F.col("start") - F.col("shift")).alias("from_start"))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES, words: int = WORDS) -> DataFrame:
    """Add ``n_lines``, ``n_removed_lines``, ``runs`` and ``clean_text`` (without the later repeated runs) to every row.

    Deleted is each line that lies in a window of ``lines`` lines (of any words), is a line of ``words`` words, or lies in
    a window of fewer lines that reach ``words`` words together while none does alone, which occurs earlier
    in the order of (key, text hash, line); null keys come first. Lines without a word are passed over and stay.
    Lines are compared whole, by 128 bits of hash. Rows equal in key and text are one document and
    get equal results. Null text has no lines; an empty table gives an empty result. A text is one row of lines, of
    any number; time for a text grows with its lines times its runs. Columns of ``df`` may have any names but the new ones.
    """
    clash = {"n_lines", "n_removed_lines", "runs", "clean_text"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    runs = repeated_runs(df, key, text, lines, words)
    runs = runs.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "n", "from_key", "from_start"))).alias("runs"))
    raw = content(F.col(f"`{text}`"))
    keyed = df.withColumns({"__line_key": F.col(f"`{key}`"), "__line_hash": F.xxhash64(raw)})
    joined = keyed.join(runs, F.col("__line_key").eqNullSafe(runs["doc"]) & (F.col("__line_hash") == runs["th"]), "left")

    # runs that touch are joined; lines outside all of them stay
    full = F.transform(F.split(raw, "\n"), lambda x: F.struct(x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("full")))
    merged = F.aggregate(
        "runs", F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (r["start"] <= F.element_at(acc, -1)["b"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["a"].alias("a"),
                F.greatest(F.element_at(acc, -1)["b"], r["start"] + r["n"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(r["start"].alias("a"), (r["start"] + r["n"]).alias("b"))))))
    joined = joined.withColumns({"__lines": full, "__cuts": merged})
    places = F.filter(F.transform("__lines", lambda x, i: F.when(x["full"], i)), lambda x: x.isNotNull())
    joined = joined.withColumn("__places", places)
    # cuts in numbers of all lines: blank lines inside a cut stay
    cuts = F.transform("__cuts", lambda c: F.struct(
        F.get("__places", c["a"]).alias("a"), F.get("__places", c["b"] - 1).alias("b")))
    joined = joined.withColumn("__cuts", cuts)
    kept = F.filter("__lines", lambda x, i: ~x["full"] | ~F.exists("__cuts", lambda c: (i >= c["a"]) & (i <= c["b"])))
    out = joined.withColumns({
        "n_lines": F.size("__places").cast("bigint"),
        "runs": F.coalesce("runs", F.array().cast(joined.schema["runs"].dataType)),
        "clean_text": F.when(F.col("__cuts").isNull(), F.col(f"`{text}`")).otherwise(
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n")),
        "n_removed_lines": F.when(F.col("__cuts").isNull(), 0).otherwise(
            F.size("__lines") - F.size(kept)).cast("bigint"),
    })
    # a filter on these columns must not be moved below them: all would be computed twice
    return out.select(*[keyed[f"`{c}`"] for c in df.columns], F.inline(F.array(F.struct("n_lines", "n_removed_lines", "runs", "clean_text"))))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES, words: int = WORDS) -> DataFrame:
    """``df`` with the later repeated runs cut from its texts; a document that lost every line goes.

    The columns stay as they are (``n_chars`` is counted anew where lines were cut).
    """
    cut = drop_repeated_lines(df, key, text, lines, words)
    cut = cut.filter((F.col("n_removed_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines")))
    out = cut.withColumn(text, F.col("clean_text"))
    if "n_chars" in df.columns and df.schema["n_chars"].dataType.simpleString() in ("int", "bigint"):
        kind = df.schema["n_chars"].dataType.simpleString()
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
