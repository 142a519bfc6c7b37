"""Personal data replaced by keyed surrogates of the same kind (built-in functions only).

Entities are found by pattern, cut into units (an e-mail address has an address and a domain, a name its given and
family name) and each distinct unit of the corpus gets one surrogate: a keyed hash steers the choice, so equal units
agree everywhere and the key decides. Surrogates that meet another surrogate or a real unit are drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.quality import let
from propspark.llm.text import content, digest
from propspark.session import materialize

# Titles and given names that tell a gender.
MALE_TITLES = "Mr Herr Sr Señor Don Monsieur".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Sra Señora Doña Madame Mme".split()
TITLES = MALE_TITLES + FEMALE_TITLES + ["Dr", "Prof"]
MALE_NAMES = ("John James Robert Michael David William Thomas Peter Paul Hans Karl Jean Pierre José Juan Carlos Luis "
              "Иван Пётр Дмитрий Γιώργος Νίκος").split()
FEMALE_NAMES = ("Mary Anna Maria Elizabeth Sarah Emma Laura Julia Marie Claire Sophie Carmen Ana Lucía Petra Monika "
                "Мария Анна Ольга Ελένη Σοφία").split()

_ALONE = r"(?<![\p{L}\p{N}])"
_CAPITAL = r"(?=\p{Lu})" + _ALONE
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_NAME = r"\p{Lu}\p{Ll}+"
_TITLE = r"(?:" + "|".join(TITLES) + r")\.? "
PATTERNS = {
    "secret": (r"(?<=[=:] {0,1}[\"'])[A-Za-z0-9_+/=-]{16,}(?=[\"'])|(?<![A-Za-z0-9])(?=[a-f]{0,31}[0-9])[0-9a-f]{32,}(?![A-Za-z0-9])|"
               + _ALONE + r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|" + _ALONE + r"(?:sk-|ghp_)[A-Za-z0-9]{20,}"),
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": _ALONE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": (r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|"
              + _ALONE + r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|"
              r"(?<![\p{L}\p{N}.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "ssn": r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![\p{L}0-9.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9]|\.[0-9])",
    "card": _ALONE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "person": (_CAPITAL + _TITLE + _NAME + r"(?:[ -]" + _NAME + r")?|" + _CAPITAL + r"(?:" + "|".join(MALE_NAMES + FEMALE_NAMES)
               + r") " + _NAME),
}
ENTITY = "|".join(PATTERNS.values())
#: Every entity but a name holds one of these; other texts are searched for names only, which is much cheaper.
MARKS = r"[0-9@\"']|AKIA|ASIA|sk-|ghp_"

_SYLLABLES = [c + v for c in "bdfgklmnprstv" for v in "aeiou"]
_FAMILY_ENDS = ["son", "mann", "er", "ez", "ard", "in", "ov", "is"]
# Letters of other scripts for the letters of the syllables and endings.
_LATIN = "abdefgijklmnoprstuvz"
_CYRILLIC = "абдефгийклмнопрстувз"
_GREEK = "αβδεφγιηκλμνοπρστυωζ"
_MARKED = "àâäçèéêëîïñòóôöùûüßœ"
_CYRILLIC_ALL = "абвгдежзийклмнопрстуфхцчшщыэюя"
_GREEK_ALL = "αβγδεζηθικλμνξοπρστυφχψω"


def _units(surface: Column) -> Column:
    """The units of an entity: kind, canonical form (what makes two mentions the same) and the text to replace."""

    def unit(kind, canon, text) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), canon.alias("canon"), text.alias("part"))

    def is_a(kind: str) -> Column:
        return surface.rlike(f"^(?:{PATTERNS[kind]})$")

    plain = F.lower(F.regexp_replace(surface, r"[^\p{L}\p{N}]", ""))
    digits = F.regexp_replace(surface, "[^0-9]", "")
    # a phone number is told by its last ten digits, whatever stands before them
    phone = F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits)
    domain = F.substring_index(surface, "@", -1)
    title = F.regexp_extract(surface, "^(" + "|".join(TITLES) + r")\.? ", 1)
    names = F.split(F.regexp_replace(surface, "^" + _TITLE, ""), " ")
    given, family = names[0], F.element_at(names, -1)
    gender = (
        F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f")
        .when(given.isin(MALE_NAMES), "m").when(given.isin(FEMALE_NAMES), "f").otherwise("n"))
    return (
        F.when(surface.contains("@"), F.array(unit("mail", F.lower(surface), F.substring_index(surface, "@", 1)),
                                              unit("domain", F.lower(domain), domain)))
        .when(is_a("ip"), F.array(unit("ip", surface, surface)))
        .when(is_a("phone"), F.array(unit("phone", phone, surface)))
        .when(is_a("ssn"), F.array(unit("ssn", digits, surface)))
        .when(is_a("card"), F.array(unit("card", digits, surface)))
        .when(is_a("iban"), F.array(unit("iban", plain, surface)))
        .when(is_a("person"), F.when(F.size(names) > 1, F.array(
            unit(F.concat(F.lit("given_"), gender), F.lower(given), given), unit("family", F.lower(family), family)))
            .otherwise(F.array(unit("family", F.lower(family), family))))
        .otherwise(F.array(unit("secret", surface, surface))))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _choose(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(b, F.lit(len(letters))) + 1, F.lit(1))


def _like(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter or digit replaced by one of the same class and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        low = F.lower(c)
        letter = (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(hexadecimal, _choose("abcdef", b))
            .when(low.rlike("[a-z]"), _choose("abcdefghijklmnopqrstuvwxyz", b))
            .when(low.rlike(r"\p{IsCyrillic}"), _choose(_CYRILLIC_ALL, b))
            .when(low.rlike(r"\p{IsGreek}"), _choose(_GREEK_ALL, b))
            .when(low.rlike(r"\p{IsLatin}"), _choose(_MARKED, b)).otherwise(c))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check over all digits (valid: a multiple of ten)."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
            d.cast("int") * (F.pmod(i, F.lit(2)) + 1), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0), lambda acc, x: acc + x)


def _script(text: Column, latin: Column) -> Column:
    """Latin letters in the script of ``text``."""
    return (F.when(text.rlike(r"\p{IsCyrillic}"), F.translate(latin, _LATIN, _CYRILLIC))
            .when(text.rlike(r"\p{IsGreek}"), F.translate(latin, _LATIN, _GREEK)).otherwise(latin))


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """A candidate in the canonical form of its kind."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])

    def draw(s: Column) -> Column:
        syllables = F.array(*[F.lit(x) for x in _SYLLABLES])

        def syllable(i: int) -> Column:
            return F.get(syllables, F.pmod(_byte(s, F.lit(2 * i)) * 256 + _byte(s, F.lit(2 * i + 1)), F.lit(len(_SYLLABLES))))

        # later attempts are longer, so a kind cannot run out of surrogates
        more = F.when(attempt >= 4, F.concat(syllable(3), syllable(4))).otherwise("")
        stem = F.concat(syllable(0), syllable(1), more)
        ends = F.array(*[F.lit(x) for x in _FAMILY_ENDS])
        family = F.concat(stem, syllable(5), F.get(ends, F.pmod(_byte(s, F.lit(20)), F.lit(len(_FAMILY_ENDS)))))
        given = F.concat(stem, F.when(kind == "given_f", _choose("nlrm", _byte(s, F.lit(21)))).otherwise(""),
                         F.when(kind == "given_f", "a").when(kind == "given_m", _choose("nrsl", _byte(s, F.lit(22)))).otherwise("e"))
        local = F.when(kind == "mail", F.substring_index(canon, "@", 1)).otherwise(canon)
        hexadecimal = (kind == "secret") & canon.rlike("^[0-9a-f]+$")
        like = _like(local, s, hexadecimal)
        longer = F.when(attempt >= 8, F.concat(like, F.substring(F.conv(F.substring(s, 200, 12), 16, 10), 1, 6))).otherwise(like)
        dot = F.length(F.substring_index(canon, ".", -1))
        first = F.substring(canon, 1, 1)
        tail = F.substring(like, F.lit(2), F.length(like))
        number = F.concat(F.when((first != "0") & like.startswith("0"), first).otherwise(F.substring(like, 1, 1)), tail)
        body = F.concat(first, F.substring(like, F.lit(2), F.length(like) - 2))
        check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        card = F.when(F.pmod(_luhn(canon), F.lit(10)) == 0, F.concat(body, check)).otherwise(
            F.concat(first, tail))
        return (
            F.when(kind == "ip", F.concat_ws(".", F.pmod(_byte(s, F.lit(0)), F.lit(223)) + 1, _byte(s, F.lit(1)), _byte(s, F.lit(2)),
                                             F.pmod(_byte(s, F.lit(3)), F.lit(254)) + 1))
            .when(kind.startswith("given"), _script(canon, given)).when(kind == "family", _script(canon, family))
            .when(kind == "domain", F.concat(F.substring(longer, F.lit(1), F.length(longer) - dot - 1), F.lit("."),
                                             F.substring_index(canon, ".", -1)))
            .when(kind == "card", card).when(kind.isin("phone", "ssn"), number)
            .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.substring(like, F.lit(3), F.length(like))))
            .otherwise(longer))

    return let(stream, draw)


def assign(units: DataFrame, key: str, name: str = "surrogates") -> DataFrame:
    """One surrogate for each distinct (kind, canon): no two of a kind are equal and none is a real unit of its kind.

    In each round the open units draw a candidate; the least canonical form wins a contested one, and units whose
    candidate is taken or real draw again. The result depends on the units and the key only.
    """
    real = materialize(units.select("kind", "canon").filter(F.col("canon").isNotNull()).distinct(), "units")

    def shown(kind: Column, canon: Column) -> Column:
        # what a unit shows in the text: of an address the part before the domain
        return F.when(kind == "mail", F.substring_index(canon, "@", 1)).otherwise(canon)

    taken = real.select("kind", shown(F.col("kind"), F.col("canon")).alias("surrogate")).distinct()
    open_, done, attempt = real, [], 0
    while open_ is not None:
        drawn = open_.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        winners = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(
            taken, ["kind", "surrogate"], "left_anti")
        won = materialize(winners.select("kind", "canon", "surrogate"), name)
        done.append(won)
        taken = taken.unionByName(won.select("kind", "surrogate"))
        rest = materialize(open_.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        open_ = rest if rest.take(1) else None
        attempt += 1
    return reduce(DataFrame.unionByName, done)


def _dressed(part: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the format of the mention: separators, case and leading digits as there."""
    letters = F.split(part, "")
    total = F.length(F.regexp_replace(part, r"[^\p{L}\p{N}]", ""))
    plain = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    kept = total - F.length(plain)  # digits before the last ten of a phone number stay

    def walk(acc: Column, c: Column) -> Column:
        at = acc["n"] - kept
        new = F.when(at < 0, c).otherwise(F.substring(plain, at + 1, F.lit(1)))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(acc["s"], cased).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n")))

    in_place = F.aggregate(letters, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), walk, lambda acc: acc["s"])
    title = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    cased = F.when((F.upper(part) == part) & part.rlike(r"\p{Lu}"), F.upper(surrogate)).otherwise(title)
    same_length = F.length(plain) <= total
    return (F.when(kind == "ip", surrogate).when(kind.startswith("given") | (kind == "family"), cased)
            .when(same_length, in_place).otherwise(surrogate))


def replacements(surfaces: DataFrame, key: str) -> DataFrame:
    """For each distinct ``surface`` its ``replacement`` and ``kind``."""
    distinct = materialize(surfaces.select("surface").distinct(), "surfaces")
    units = materialize(distinct.select("surface", F.posexplode(_units(F.col("surface"))).alias("no", "u")).select("surface", "no", "u.*"), "parts")
    assigned = assign(units, key)
    dressed = units.join(assigned, ["kind", "canon"]).select(
        "surface", "no", "kind", "part", _dressed(F.col("part"), F.col("surrogate"), F.col("kind")).alias("new"))
    whole = dressed.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("no", "part", "new", "kind"))).alias("u"))
    # the parts stand at the end of the mention, one character between them; what is before them (a title) stays
    first, last = F.col("u")[0], F.element_at("u", -1)
    surface = F.col("surface")
    tail_at = F.length(surface) - F.length(last["part"])
    two = F.concat(
        F.substring(surface, F.lit(1), tail_at - F.length(first["part"]) - 1), first["new"],
        F.substring(surface, tail_at, F.lit(1)), last["new"])
    one = F.concat(F.substring(surface, F.lit(1), tail_at), last["new"])
    return whole.select("surface", F.when(F.size("u") > 1, two).otherwise(one).alias("replacement"), 
                        F.when(first["kind"].rlike("given|family"), "person").otherwise(first["kind"]).alias("kind"))


def replace_entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its personal data replaced, and ``n_entities`` and ``kinds`` (of the entities, in order).

    E-mail addresses, phone numbers, IP addresses, payment cards, social security and account numbers, secrets and
    names after a title or a known given name are replaced. The same unit gets the same surrogate in all documents, also
    when it is written differently (case, separators, a country prefix); different units get different ones. Cards that
    pass Luhn's check still do, country prefixes and issuer digits stay, names keep gender and script. Texts without an
    entity stay as they are, null stays null. Repeated rows get equal results, an empty table gives an empty one. A text of any
    length is searched whole. Columns of ``df`` may have any other names.
    """
    clash = {"n_entities", "kinds"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    names = list(df.columns)
    marked = F.col("__pii_text").rlike(MARKS)
    found = F.when(marked, F.regexp_extract_all(F.col("__pii_text"), F.lit(ENTITY), 0)).otherwise(
        F.regexp_extract_all(F.col("__pii_text"), F.lit(PATTERNS["person"]), 0))
    keyed = df.withColumn("__pii_text", content(F.col(f"`{text}`"))).withColumn("__pii_found", found)
    some = keyed.filter(F.size("__pii_found") > 0).withColumn("__pii_key", digest(F.col("__pii_text")))
    places = some.select(F.col("__pii_key.hi").alias("hi"), F.col("__pii_key.lo").alias("lo"),
                         F.posexplode("__pii_found").alias("no", "surface")).distinct()
    places = materialize(places, "places")
    new = materialize(replacements(places, key), "replacements")
    per_text = places.join(new, "surface").groupBy("hi", "lo").agg(
        F.array_sort(F.collect_list(F.struct("no", "replacement", "kind"))).alias("__pii_new"))
    joined = some.join(per_text, (F.col("__pii_key.hi") == per_text.hi) & (F.col("__pii_key.lo") == per_text.lo))
    between = F.when(marked, F.split("__pii_text", ENTITY, -1)).otherwise(F.split("__pii_text", PATTERNS["person"], -1))
    put = F.concat(F.transform("__pii_new", lambda x: x["replacement"]), F.array(F.lit("")))
    changed = F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, b))), "")
    columns = [F.col(f"`{c}`") for c in names if c != text]
    with_new = joined.select(*columns, changed.alias(text), F.size("__pii_new").cast("bigint").alias("n_entities"),
                             F.transform("__pii_new", lambda x: x["kind"]).alias("kinds"))
    without = keyed.filter(F.size("__pii_found") == 0).select(
        *columns, F.col(f"`{text}`"), F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return with_new.unionByName(without).select(*[F.col(f"`{c}`") for c in names], "n_entities", "kinds")
