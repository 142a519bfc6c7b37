"""Line-first quality rules (built-in functions only)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.text import BLANK, content

#: Line rules as patterns.
FLOOD = r"[#*$%&!?|<>]{2,}([\x20\x09-\x0D]|$)"
SEPARATOR = r"[\x20\x09-\x0D]([|»›•·/>]|::)[\x20\x09-\x0D]"
#: Unicode's Terminal_Punctuation of all scripts, and the ellipsis.
SENTENCE = (
    r"["
    r"\x{21}\x{2C}\x{2E}\x{3A}\x{3B}\x{3F}\x{37E}\x{387}\x{589}\x{5C3}\x{60C}\x{61B}\x{61D}-\x{61F}\x{6D4}"
    r"\x{700}-\x{70A}\x{70C}\x{7F8}\x{7F9}\x{830}-\x{835}\x{837}-\x{83E}\x{85E}\x{964}\x{965}\x{E5A}\x{E5B}"
    r"\x{F08}\x{F0D}-\x{F12}\x{104A}\x{104B}\x{1361}-\x{1368}\x{166E}\x{16EB}-\x{16ED}\x{1735}\x{1736}"
    r"\x{17D4}-\x{17D6}\x{17DA}\x{1802}-\x{1805}\x{1808}\x{1809}\x{1944}\x{1945}\x{1AA8}-\x{1AAB}"
    r"\x{1B4E}\x{1B4F}\x{1B5A}\x{1B5B}\x{1B5D}-\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}-\x{1C3F}\x{1C7E}\x{1C7F}"
    r"\x{2024}\x{2026}\x{203C}\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}\x{2E2E}\x{2E3C}\x{2E41}\x{2E4C}"
    r"\x{2E4E}\x{2E4F}\x{2E53}\x{2E54}\x{2E60}\x{2E61}\x{3001}\x{3002}\x{A4FE}\x{A4FF}\x{A60D}-\x{A60F}"
    r"\x{A6F3}-\x{A6F7}\x{A876}\x{A877}\x{A8CE}\x{A8CF}\x{A92F}\x{A9C7}-\x{A9C9}\x{AA5D}-\x{AA5F}\x{AADF}"
    r"\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}\x{FE50}-\x{FE52}\x{FE54}-\x{FE57}\x{FF01}\x{FF0C}"
    r"\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}\x{FF64}\x{1039F}\x{103D0}\x{10857}\x{1091F}\x{10A56}\x{10A57}"
    r"\x{10AF0}-\x{10AF5}\x{10B3A}-\x{10B3F}\x{10B99}-\x{10B9C}\x{10F55}-\x{10F59}\x{10F86}-\x{10F89}"
    r"\x{11047}-\x{1104D}\x{110BE}-\x{110C1}\x{11141}-\x{11143}\x{111C5}\x{111C6}\x{111CD}\x{111DE}\x{111DF}"
    r"\x{11238}-\x{1123C}\x{112A9}\x{113D4}\x{113D5}\x{1144B}-\x{1144D}\x{1145A}\x{1145B}\x{115C2}-\x{115C5}"
    r"\x{115C9}-\x{115D7}\x{11641}\x{11642}\x{1173C}-\x{1173E}\x{11944}\x{11946}\x{11A42}\x{11A43}"
    r"\x{11A9B}\x{11A9C}\x{11AA1}\x{11AA2}\x{11C41}-\x{11C43}\x{11C71}\x{11EF7}\x{11EF8}\x{11F43}\x{11F44}"
    r"\x{12470}-\x{12474}\x{16A6E}\x{16A6F}\x{16AF5}\x{16B37}-\x{16B39}\x{16B44}\x{16D6E}\x{16D6F}"
    r"\x{16E97}\x{16E98}\x{1BC9F}\x{1DA87}-\x{1DA8A}"
    r"]")
BOILERPLATE = (r"(?i)(?<![\p{L}\p{N}])(?:all rights reserved|licen[cs]ed under|released under|terms of (?:use|service)|privacy policy|"
               r"cookies?|javascript|click here|subscribe|(?<!(?:a|the|this|that|each|every|one|no) )(?:sign|log) in|copyright)"
               r"(?![\p{L}\p{N}])")
#: A line is boilerplate if its phrases are one of this many words of it, or more.
SHARE = 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of ``window`` words that the text has twice or more, the first one included."""

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
            F.lit(0), lambda acc, x: acc + x)

    def repeated(pairs: Column) -> Column:
        same = F.transform(pairs, lambda e, i: F.when(
            (F.get(pairs, i - 1)["h"] == e["h"]) | (F.get(pairs, i + 1)["h"] == e["h"]), e["at"]))
        return let(F.array_sort(F.filter(same, lambda x: x.isNotNull())), covered)

    def detailed(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, repeated)).otherwise(0)

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - window), lambda i: F.xxhash64(
            *[F.get(each, i + j) for j in range(window)]))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) > window, let(hashes, detailed)).otherwise(0)


#: Pieces of which every phrase has one, in lower case; a line without them has no phrase.
HINTS = ("rights reserved", "licen", "released under", "terms of ", "privacy policy", "cookie", "javascript", "click here", "subscribe",
         "sign in", "log in", "copyright")


def may_have_phrase(line: Column) -> Column:
    """False if no phrase of ``BOILERPLATE`` can be in a line; plain searches, no pattern."""
    return let(F.lower(line), lambda low: functools.reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in HINTS]))


def line_fails(line: Column, min_words: int = 5, max_flood: int = 30) -> Column:
    """Why a line with a word goes: ``punctuation``, ``navigation`` or ``boilerplate``; null if it stays.

    * punctuation: more than ``max_flood`` per cent of its words end in a run of symbols, or it has
      ``min_words`` words and no sentence punctuation at all;
    * navigation: three separators between items, or one and as many items as words;
    * boilerplate: phrases of licences, site menus and consent banners are a sixth of its words.

    Words are counted only for lines that a rule can fail, phrases searched only where a piece of one stands, and the large
    class of sentence marks is looked up only where the common ones are absent.
    """
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marked = line.rlike("[.,!?;:]") | line.rlike(SENTENCE)

    def covered(found: Column) -> Column:
        return (F.size(found) > 0) & (F.size(F.split(F.array_join(found, " "), " ")) * SHARE >= words)

    searched = let(F.regexp_extract_all(line, F.lit(BOILERPLATE), 0), covered)
    return (
        F.when(F.regexp_count(line, F.lit(SEPARATOR)) >= 3, "navigation")
        .when(let(F.regexp_count(line, F.lit(FLOOD)), lambda n: (n > 0) & (n * 100 > words * max_flood)), "punctuation")
        .when(~marked & (words >= min_words), "punctuation")
        .when(may_have_phrase(line) & searched, "boilerplate"))


def measure(df: DataFrame, text: str = "text", max_lost: int = 50) -> DataFrame:
    """Add the counts of a text, ``n_lines`` (with a word), ``n_bad_lines``, ``line_chars`` and ``lost_chars`` (code
    points of all lines with a word and of those that fail a rule), ``base_failed``, ``kept`` and ``clean_text``.

    Lines are judged first and those that fail go (blank lines stay as they are); a document that loses more than
    ``max_lost`` per cent of its line characters is rejected, as is one of under ten words or with more than a fifth of
    its words in repeated five-word windows. Windows of one text are compared by 64-bit hashes. Null counts as empty:
    no words, hence rejected. Every row is judged alone and whole, so repeated rows get equal results; an empty
    table gives an empty one. Columns of these
    names in ``df`` are an error.
    """
    added = [*COUNTS, "n_lines", "n_bad_lines", "line_chars", "lost_chars", "base_failed", "kept", "clean_text"]
    clash = set(added) & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    names = list(df.columns)
    raw = content(F.col(f"`{text}`"))
    parts = df.withColumns({
        "__words": F.filter(F.split(raw, BLANK + "+"), lambda w: w != ""),
        "__lines": F.transform(F.split(raw, "\n"), lambda x: F.struct(
            x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("full")))})
    parts = parts.withColumn("__lines", F.transform("__lines", lambda x: F.struct(
        x["line"].alias("line"), x["full"].alias("full"), F.when(x["full"], line_fails(x["line"])).alias("why"))))
    full = F.transform(F.filter("__lines", lambda x: x["full"]), lambda x: x["line"])
    bad = F.filter("__lines", lambda x: x["why"].isNotNull())

    def chars(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["line"]))

    counted = parts.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(raw, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("__words")).cast("bigint"),
        "n_lines": F.size(F.filter("__lines", lambda x: x["full"])).cast("bigint"),
        "n_bad_lines": F.size(bad).cast("bigint"),
        "line_chars": chars(F.filter("__lines", lambda x: x["full"])),
        "lost_chars": chars(bad),
        "clean_text": F.when(F.size(bad) > 0, F.array_join(F.transform(
            F.filter("__lines", lambda x: x["why"].isNull()), lambda x: x["line"]), "\n")).otherwise(F.col(f"`{text}`")),
    })
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kept = ~failed & (F.col("lost_chars") * 100 <= F.col("line_chars") * max_lost)
    judged = counted.withColumns({"base_failed": failed, "kept": kept})
    # a filter on these columns must not be moved below them: all would be computed twice
    return judged.select(*[F.col(f"`{c}`") for c in names], F.inline(F.array(F.struct(*added))))


def clean(df: DataFrame, text: str = "text", max_lost: int = 50) -> DataFrame:
    """The documents kept, without the lines that failed, and with the columns of ``df`` (``n_chars`` counted anew)."""
    kept = measure(df, text, max_lost).filter("kept")
    out = kept.withColumn("__changed", F.col("n_bad_lines") > 0).withColumn(text, F.col("clean_text"))
    if "n_chars" in df.columns and df.schema["n_chars"].dataType.simpleString() in ("int", "bigint"):
        kind = df.schema["n_chars"].dataType.simpleString()
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


#: The same measures as SQL, rules written out again. Its patterns know no look-behind: every character between words is doubled,
#: so that a phrase can take one on either side, and phrases after an article or the like are spoilt first.
MEASURE_SQL = r"""
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  l.n_lines, l.n_bad_lines, l.line_chars, l.lost_chars,
  d.n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * d.n_words AS base_failed,
  NOT (d.n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * d.n_words) AND 100 * l.lost_chars <= 50 * l.line_chars AS kept
FROM (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS full_lines
    FROM documents)
) d
JOIN (
  SELECT doc_id, count(*) FILTER (has_word)::BIGINT AS n_lines, count(*) FILTER (bad)::BIGINT AS n_bad_lines,
    coalesce(sum(len(line)) FILTER (has_word), 0)::BIGINT AS line_chars, coalesce(sum(len(line)) FILTER (bad), 0)::BIGINT AS lost_chars
  FROM (SELECT doc_id, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word,
      len(regexp_extract_all(line, '[\x20\x09-\x0D]([|»›•·/>]|::)[\x20\x09-\x0D]')) >= 3
      OR len(regexp_extract_all(line, '[#*$%&!?|<>]{2,}([\x20\x09-\x0D]|$)')) * 100 > len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) * 30
      OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5 AND NOT regexp_matches(line, '@marks'))
      OR coalesce(list_sum([len(x) - len(replace(x, '  ', ' ')) + 1 FOR x IN phrases]), 0) * 6 >= len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
        AND len(phrases) > 0 AS bad
    FROM (SELECT doc_id, line, regexp_extract_all(
        regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^\p{L}\p{N}])', '\1\1', 'g'),
          '(a|the|this|that|each|every|one|no)  (sign|log)  in', '\1  \2  xin', 'g'),
        '(^|[^\p{L}\p{N}])(all  rights  reserved|licen[cs]ed  under|released  under|terms  of  (?:use|service)|privacy  policy|cookies?|javascript|click  here|subscribe|(?:sign|log)  in|copyright)([^\p{L}\p{N}]|$)', 2) AS phrases
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)))
  GROUP BY doc_id
) l ON l.doc_id = d.doc_id
LEFT JOIN (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (
        SELECT doc_id, i, w[i:i + 4] AS gram FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))))
    WHERE c > 1)
  GROUP BY doc_id
) r ON r.doc_id = d.doc_id
""".replace("@marks", SENTENCE)
