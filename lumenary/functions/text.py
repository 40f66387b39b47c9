"""Text columns: keys, classes, numbers in words, terms, chunks, extraction checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that carry no content in a question.
STOPWORDS = (
    "what", "why", "how", "explain", "define", "describe", "tell", "give", "with", "from", "about", "than", "more", "less", "into", "this", "that", "these", "those",
    "your", "please", "simple", "simply", "the", "and", "are", "was", "were", "for", "does", "can", "chapter", "class", "subject", "only", "notes", "study", "material",
)
# Names of topics that stand for another.
TOPIC_ALIASES = {"basic_concepts_of_chemistry": "matter_definition", "basic_concept_of_chemistry": "matter_definition", "matter": "matter_definition", "hydrocarbon": "alkanes", "hydrocarbons": "alkanes", "aromatic_hydrocarbons": "aromatics"}
# Kinds of exams, and other names of them.
EXAM_TYPES = ("class_test", "unit_test", "school_exam", "pre_board", "board_exam", "chapter_wise", "subject_wise", "other")
EXAM_ALIASES = {
    "class": "class_test", "classtest": "class_test", "ct": "class_test", "unit": "unit_test", "ut": "unit_test", "school": "school_exam", "term": "school_exam", "final": "school_exam",
    "preboard": "pre_board", "pre_board_exam": "pre_board", "board": "board_exam", "boards": "board_exam", "chapter": "chapter_wise", "chapterwise": "chapter_wise", "subject": "subject_wise", "subjectwise": "subject_wise",
}
# Levels of difficulty in words.
DIFFICULTY = {
    "very easy": 1, "trivial": 1, "easy": 2, "low": 2, "basic": 2, "beginner": 2, "simple": 2, "medium": 3, "moderate": 3, "intermediate": 3, "average": 3, "normal": 3,
    "hard": 4, "high": 4, "difficult": 4, "challenging": 4, "advanced": 4, "very hard": 5, "very difficult": 5, "expert": 5,
}
# Roman class numbers.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}


def normal_key(c: Column) -> Column:
    """Lower-case letters and digits, one underscore for anything else, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def looked_up(c: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else None
    return F.coalesce(F.element_at(pairs, c), default) if table else default


def normal_topic(c: Column) -> Column:
    key = normal_key(F.coalesce(c, F.lit("unknown")))
    return looked_up(key, TOPIC_ALIASES, key)


def exam_type(c: Column) -> Column:
    """A known kind as it is, another name's kind, other for nothing, else the key."""
    key = normal_key(F.coalesce(c, F.lit("")))
    return F.when(key.isin(*EXAM_TYPES), key).otherwise(looked_up(key, EXAM_ALIASES, F.when(key == "", "other").otherwise(key)))


def class_level(c: Column) -> Column:
    """class_11, Grade XI or 11th to 11."""
    bare = F.regexp_replace(F.regexp_replace(normal_key(F.coalesce(c, F.lit(""))), "^class_", ""), "^grade_", "")
    return looked_up(bare, ROMAN | {"11th": "11"}, bare)


def titled(c: Column) -> Column:
    """Words of a key, spaced and capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[_\\-]+", " "), r"\s+", " ")))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clipped(c: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text as dots."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.length(c) / 4).cast("int"))


def terms(c: Column) -> Column:
    """Distinct content words of three characters or more, sorted."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))))


def occurrences(text: Column, term: Column) -> Column:
    """How often term is in text, none overlapping."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def message_tokens(c: Column, images: Column) -> Column:
    """A quarter of the characters, rounded up, and 800 for each image."""
    return (F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4) + 800 * F.coalesce(images, F.lit(0))).cast("int")


def page_numbers(items: Column) -> Column:
    """The first whole number of each item of an array of texts, positive ones, distinct and sorted."""
    found = F.transform(items, lambda x: F.try_to_number(F.nullif(F.regexp_extract(x, r"\d{1,9}", 0), F.lit("")), F.lit("999999999")).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x > 0))))


def difficulty(c: Column) -> Column:
    """A word or a number to 1..5; 1 where neither is there."""
    text = F.lower(F.trim(c))
    pairs = F.create_map(*(F.lit(x) for kv in DIFFICULTY.items() for x in kv))
    number = F.nullif(F.substring(F.regexp_extract(text, r"\d+", 0), 1, 9), F.lit("")).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.element_at(pairs, text), number, F.lit(1))))


def next_version(c: Column) -> Column:
    """v3 to v4; anything else to v2."""
    n = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^v(\d{1,9})$", 1)
    return F.when(n != "", F.concat(F.lit("v"), (F.nullif(n, F.lit("")).cast("int") + 1).cast("string"))).otherwise("v2")


def next_run(now: Column, zone: str, hour: int, minute: int) -> Column:
    """The next time after now (UTC) that clocks of the zone show hour:minute, in UTC."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.to_utc_timestamp(F.when(today > local, today).otherwise(today + F.expr("INTERVAL 1 DAY")), zone)


def marks(c: Column) -> Column:
    """The first number of a text if it is over 0 and up to 100, else null."""
    x = F.nullif(F.regexp_extract(F.lower(c.cast("string")), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    return F.when((x > 0) & (x <= 100), x)


def subscripts(c: Column) -> Column:
    return F.translate(c, "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹", "01234567890123456789")


def word_chunks(c: Column, size: int = 900) -> Column:
    """Word-bounded pieces of at most size characters (a longer word is a piece by itself)."""
    def put(acc: Column, w: Column) -> Column:
        room = F.length(acc["now"]) + 1 + F.length(w) <= size
        return F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), w.alias("now"))).when(room, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(" "), w).alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), w.alias("now")))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.aggregate(words, zero, put, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def paragraph_chunks(c: Column, most: int = 1400, least: int = 220) -> Column:
    """Paragraphs and sentences filled into chunks of about most characters.

    A chunk closes when the next part would take the sum of its parts over most. One under
    least is joined to the chunk before, after an empty line.
    """
    parts = F.filter(F.transform(F.split(F.trim(c), r"\n\s*\n|(?<=\.)\s+(?=[A-Z0-9])"), lambda p: F.trim(p)), lambda p: p != "")

    def flush(acc: Column) -> Column:
        text, done = F.array_join(acc["now"], " "), acc["done"]
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.greatest(F.size(done), F.lit(1))), F.lit("\n\n"), text)))
        return F.when(text == "", done).when((F.length(text) < least) & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(text)))

    def put(acc: Column, p: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["n"] + F.length(p) > most)
        return F.when(full, F.struct(flush(acc).alias("done"), F.array(p).alias("now"), F.length(p).alias("n"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(p)).alias("now"), (acc["n"] + F.length(p)).alias("n")))

    none = F.array().cast("array<string>")
    return F.aggregate(parts, F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("n")), put, flush)


def section_title(c: Column) -> Column:
    """The first line, at most 90 characters and nine words, that doesn't end in a full stop."""
    line = F.trim(F.substring(F.split(F.trim(c), "\n")[0], 1, 90))
    return F.when((F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) <= 9) & ~line.endswith("."), line).otherwise("")


# Common words of prose; a text in capitals that has next to none of them is written in a font's cipher.
PROSE = (
    "a", "able", "about", "after", "also", "an", "and", "are", "as", "at", "be", "been", "between", "by", "can", "carbon", "chemical", "chemistry",
    "compound", "compounds", "for", "from", "has", "have", "in", "into", "is", "it", "learn", "may", "of", "on", "or", "organic", "other",
    "reaction", "reactions", "structure", "structures", "that", "the", "their", "these", "this", "to", "understand", "unit", "was", "which",
    "will", "with", "write", "you",
)
# The least words, share of capitals and number of odd signs of such a text, its most common words; shares that need a look.
CIPHER_WORDS, CIPHER_CAPITALS, CIPHER_SIGNS, CIPHER_COMMON, CONTROLS, SLASHES = 40, 0.82, 5, 0.025, 0.03, 0.025


def extraction_sanity(c: Column) -> Column:
    """Signs of a broken extraction: shares of control signs and backslashes, prose that reads like a cipher, unread glyphs, verdicts.

    corrupt: a cipher or unread glyphs. needs_review: unread glyphs, or many control signs or
    backslashes, which formulas may have.
    """
    solid = F.greatest(F.lit(1), F.length(F.regexp_replace(c, r"\s", "")))
    n = lambda pattern: F.regexp_count(c, F.lit(pattern))
    controls, slashes = n(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), n(r"\\")
    words = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    common = F.size(F.filter(words, lambda w: F.lower(w).isin(*PROSE)))
    capitals = n(r"\p{Lu}") / F.greatest(F.lit(1), n(r"\p{L}"))
    cipher = (F.size(words) >= CIPHER_WORDS) & (capitals >= CIPHER_CAPITALS) & (common / F.greatest(F.lit(1), F.size(words)) < CIPHER_COMMON) & ((controls >= CIPHER_SIGNS) | (slashes >= CIPHER_SIGNS))
    aliases, cids, private = n(r"/unif[0-9A-Fa-f]+"), n(r"(?i)\(cid:\d+\)"), n(r"[\x{E000}-\x{F8FF}]")
    glyphs = aliases + cids + private
    return F.struct(
        F.round(controls / solid, 5).alias("control_ratio"), F.round(slashes / solid, 5).alias("backslash_ratio"), cipher.alias("cipher_like"), aliases.alias("aliases"), cids.alias("cids"), private.alias("private_use"),
        (cipher | (glyphs > 0)).alias("corrupt"), ((controls / solid >= CONTROLS) | (slashes / solid >= SLASHES) | (glyphs > 0)).alias("needs_review"),
    )


def extraction_quality(c: Column) -> Column:
    """Length over 900 characters, at most 1, and 0.15 of that for a corrupt text."""
    return F.round(F.least(F.lit(1.0), F.length(c) / 900) * F.when(extraction_sanity(c)["corrupt"], 0.15).otherwise(1.0), 3)


def repaired(c: Column) -> Column:
    """Plain quotes, dashes and spaces in place of their typographic forms; spaces squeezed in lines."""
    return F.trim(F.regexp_replace(F.translate(c, "‘’“”–— ", "''\"\"-- "), "[ \t]+", " "))


# How lines begin that are no titles.
NO_TITLE = ("chapter", "unit", "page", "ncert", "the ", "it ", "a ", "an ", "in ", "this ", "these ", "those ", "when ", "as ", "after ", "every", "chemical", "chemistry deals", "scientists")


def inferred_title(c: Column) -> Column:
    """The line after UNIT n among the first 20, else the first of 12 that reads like a title; empty if none does."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""), 1, 20)
    letters = lambda x: F.regexp_count(x, F.lit(r"[\p{L}\s]")) / F.length(x)
    words = lambda x: F.size(F.split(x, r"\s+"))
    after = lambda x: (words(x) <= 14) & (F.length(x) <= 140) & (letters(x) > 0.75) & ~x.contains("\ufffd") & ~x.rlike("[.,;:]$")
    plain = lambda x: (words(x) <= 12) & (F.length(x) <= 100) & x.rlike(r"^\p{Lu}") & ~x.contains(".") & ~x.contains("\ufffd") & ~x.rlike("[,;:]$") & ~F.lower(x).rlike("^(" + "|".join(NO_TITLE) + ")") & (letters(x) > 0.9)
    follows = F.filter(F.transform(lines, lambda x, k: F.when(F.coalesce(F.get(lines, k - 1), F.lit("")).rlike(r"^(?i)unit\s+\d{1,3}$") & after(x), x)), lambda x: x.isNotNull())
    good = F.filter(F.slice(lines, 1, 12), plain)
    return F.when(F.size(follows) > 0, titled(F.get(follows, F.lit(0)))).when(F.size(good) > 0, titled(F.get(good, F.lit(0)))).otherwise("")


def formulas(c: Column, most: int = 12) -> Column:
    """Distinct lines or parts that read like an equation."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9()]+ ?= ?[A-Za-z0-9()+*/^-]+"), F.lit(0)), squeezed)), 1, most)


def risky(c: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.lower(c).contains(p))


def register(spark: SparkSession) -> None:
    """normal_key, content_terms and unit_cosine as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normal_key(t STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_'), '^_+|_+$', '')")
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION content_terms(t STRING) RETURNS ARRAY<STRING> RETURN array_sort(array_distinct(filter(regexp_extract_all(lower(t), '[a-z0-9]+', 0), w -> length(w) > 2 AND w NOT IN ({stop}))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION unit_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) END")


def with_chunks(df: DataFrame, text: str, chunk: Column) -> DataFrame:
    """A row per chunk of each document, numbered from 0."""
    return df.select("*", F.posexplode(chunk).alias("chunk_no", "chunk")).drop(text)
