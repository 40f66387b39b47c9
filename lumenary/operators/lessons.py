"""Lessons: maps and cards of concepts, roles of sentences, practice, rules for a lesson, material for gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.operators.sessions import latest

# The most properties, points in their place, related ideas and prerequisites of a map; points, examples and cards of a concept; formulas, variables and mistakes.
PROPERTIES, POINTS, RELATED, BEFORE, CARD_POINTS, EXAMPLES, CARDS, FORMULAS, VARIABLES, MISTAKES = 7, 5, 3, 2, 6, 2, 8, 5, 4, 5
# A label's words and characters; words of a formula that are no variables.
LABEL_WORDS, LABEL_MOST, NO_VARIABLE = 4, 34, ("and", "or", "by", "per")
# What tells a sentence's role, in this order; the first sentence else defines (or is the law), others explain.
ROLES = (("misconception", r"\b(misconception|do not confuse|common mistake)\b"), ("formula", "[=→⇌]"), ("conditions", r"\b(si unit|units? (is|are)|must|only|unless|except|provided)\b"), ("example", r"\b(example|for instance|e\.g\.)"))
# What a worked example says, what it has, a sentence of it that holds in general, a calculation, where one begins.
WORKS, HAS, GENERAL = r"(?i)\b(given|solution|calculate|find|example)\b", r"[0-9]|[=→]", r"(?i)\b(rearranging|use solution|use solvent|not solvent|not solution|no unit|has no unit|can change with temperature|does not change with temperature|check that|must|only|unless)\b"
CALCULATES, BEGINS = r"=\s*(about\s+)?[+−-]?[0-9]", r"(?i)\b(example\s*:)"
# What follows the end of a sentence; other names of formats.
NEXT = r"[A-Z][a-z]|[A-Z][A-Z][a-z]|[A-Z][a-z]?[₀₁₂₃₄₅₆₇₈₉0-9]|[A-Z][A-Z][₀₁₂₃₄₅₆₇₈₉0-9]"
FORMATS = {"conceptual": "concept", "explanatory": "concept", "principle": "law", "formula_based": "formula", "formula-based": "formula", "calculation": "numerical"}
# Roles that stay whatever the level.
PROTECTED = (
    "definition", "law", "principle", "statement", "formula", "terms", "units", "condition", "conditions", "limitation", "classification", "worked_example", "derivation", "misconception", "comparison",
)
# Words of a question that tell its difficulty, from 4 down; else 2.
HARD, APPLIED, PLAIN = r"\b(trap|exception|justify|evaluate|predict|would happen|cannot|invalid)\b", r"\b(calculate|compare|distinguish|difference|determine|find|arrange)\b", r"^(what|name|identify|define)\b"
LABELS = {"foundation": 1, "foundational": 1, "conceptual": 2, "application": 3, "challenge": 4, "exam": 4}


def short_label(text: Column, fallback: Column) -> Column:
    """What a text is about: what stands before its first is or are, else its first words."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^[. ]+|[. ]+$", "")
    before = lambda word: F.split_part(clean, F.lit(word), F.lit(1))
    low = F.lower(clean)
    words = F.array_join(F.slice(F.split(clean, " "), 1, LABEL_WORDS), " ")
    cut = F.trim(F.substring(F.when(low.contains(" is "), before(" is ")).when(low.contains(" are "), before(" are ")).otherwise(words), 1, LABEL_MOST))
    return F.coalesce(F.nullif(cut, F.lit("")), fallback)


def variables(formula: Column) -> Column:
    """The words right of the first = that aren't left of it, each once."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    left = F.substring_index(formula, "=", 1)
    right = F.substring(formula, F.length(left) + 2, F.length(formula))
    own = F.filter(F.array_distinct(F.array_except(words(right), words(left))), lambda w: ~w.isin(*NO_VARIABLE))
    return F.when(formula.contains("="), F.slice(own, 1, VARIABLES)).otherwise(F.array().cast("array<string>"))


ARTIFACT = "array<struct<artifact:string,kind:string,position:int,label:string,text:string,note:string>>"


def artifacts(concepts: DataFrame) -> DataFrame:
    """(concept_id, artifact, kind, position, label, text, note): each concept's map, cards, formulas and mistakes, out of one pass.

    concepts: concept_id, title, definition, explanation and the arrays properties, points, related,
    prerequisites (ids), examples, formulas, mistakes (mistake, correction, frequency). A map's nodes have the
    label of their edge in note; related ideas and prerequisites go by the title of their id, where there is one.
    """
    empty = F.lit("")
    texts = lambda c, n: F.slice(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, n)
    row = lambda artifact, kind, k, label, text, note: F.struct(F.lit(artifact).alias("artifact"), F.lit(kind).alias("kind"), k.cast("int").alias("position"), label.alias("label"), text.alias("text"), note.alias("note"))
    title, definition = F.col("title"), F.coalesce("definition", empty)
    points = texts("points", POINTS)
    named = F.when(F.size(texts("properties", PROPERTIES)) > 0, texts("properties", PROPERTIES)).otherwise(F.transform(points, lambda x, k: short_label(x, F.concat(F.lit("Point "), (k + 1).cast("string")))))
    told = texts("points", 1 << 20)
    nodes = [
        F.array(row("map", "core", F.lit(0), title, F.coalesce(F.nullif(definition, empty), "explanation"), empty)),
        F.transform(named, lambda x, k: row("map", "property", k + 1, x, F.coalesce(F.get(told, k), F.concat(F.lit("Part of "), title)), F.lit("includes"))),
        F.transform(texts("related", RELATED), lambda x, k: row("map", "related", k + 1, x, empty, F.lit("connects"))),
        F.transform(texts("prerequisites", BEFORE), lambda x, k: row("map", "prerequisite", k + 1, x, empty, F.lit("supports"))),
    ]
    card = lambda kind, front, back: row("card", kind, F.lit(0), front, back, empty)
    cards = F.concat(
        F.when(definition != "", F.array(card("definition", F.concat(F.lit("What is "), title, F.lit("?")), definition))).otherwise(F.array().cast(ARTIFACT)),
        F.filter(F.transform(F.slice("points", 1, CARD_POINTS), lambda x, k: F.when(F.trim(x) != "", card("key point", short_label(x, F.concat(F.lit("Key idea "), (k + 1).cast("string"))), x))), lambda x: x.isNotNull()),
        F.transform(texts("examples", EXAMPLES), lambda x: card("example", F.concat(F.lit("An example of "), title), x)),
    )
    cards = F.when(F.size(cards) > 0, cards).otherwise(F.array(card("core", F.concat(F.lit("Core idea of "), title), F.coalesce("explanation", empty))))
    formulas = F.transform(texts("formulas", FORMULAS), lambda x, k: row("formula", "formula", k + 1, short_label(F.substring_index(x, "=", 1), F.lit("Formula")), x, F.array_join(variables(x), ",")))
    wrong = F.slice(F.filter(F.coalesce("mistakes", F.array().cast("array<struct<mistake:string,correction:string,frequency:string>>")), lambda m: F.trim(F.coalesce(m["mistake"], empty)) != ""), 1, MISTAKES)
    mistakes = F.transform(wrong, lambda m, k: row("mistake", "mistake", k + 1, m["mistake"], F.coalesce(m["correction"], F.lit("Compare it with the key points.")), F.coalesce(F.nullif(m["frequency"], empty), F.lit("medium"))))
    numbered = F.transform(F.slice(cards, 1, CARDS), lambda c, k: c.withField("position", (k + 1).cast("int")))
    rows = concepts.select("concept_id", F.explode(F.concat(*nodes, numbered, formulas, mistakes)).alias("x")).select("concept_id", "x.*")
    of_id = rows.where(F.col("kind").isin("related", "prerequisite"))
    titles = concepts.select(F.col("concept_id").alias("label"), F.col("title").alias("other"))
    readable = F.initcap(F.replace("label", F.lit("_"), F.lit(" ")))
    linked = of_id.join(titles, "label", "left").withColumn("label", F.coalesce("other", readable)).select(rows.columns)
    return rows.where(~F.col("kind").isin("related", "prerequisite")).unionByName(linked)


def role(sentence: Column, first: Column, opening: Column) -> Column:
    low = F.lower(sentence)
    out = F
    for name, pattern in ROLES:
        out = out.when(low.rlike(pattern), name)
    return out.when(first, opening).otherwise("explanation")


def sentences(text: Column) -> Column:
    """Cut where a sentence ends and a word that may begin one follows; decimals and symbols stay whole."""
    parts = F.split(F.regexp_replace(text, rf"([.!?])\s+({NEXT})", "$1\x02$2"), "\x02", -1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def source_blocks(texts: DataFrame, id_: str) -> DataFrame:
    """(id_, level, no, kind, text): the teaching blocks of texts (id_, text, level, format) in order.

    Formulas, and calculations with a solution, are cut where an example begins: what stands before
    teaches, each example is one worked block, and what it says in general follows it as conditions. Other numerical
    texts have a worked block for each calculation. Else each paragraph's sentences get roles, and explanations
    that follow each other are one block.
    """
    text, form = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), F.col("format")), F.col("format"), F.lit("concept"))
    t = texts.select(id_, "level", text.alias("text"), form.alias("format")).where("text <> ''")
    works = F.col("text").rlike(WORKS) & F.col("text").rlike(HAS)
    whole = (F.col("format") == "formula") | (F.col("format") == "numerical") & works
    marked = F.col("text").rlike(BEGINS) & ~F.col("text").rlike("^" + BEGINS)
    mode = F.when(whole & marked, "spans").when(whole, F.when(works, "worked").otherwise("formula")).when((F.col("format") == "numerical") & F.col("text").rlike(CALCULATES), "calculations").when(F.col("format") == "classification", "classification").otherwise("prose")
    t = t.withColumn("mode", mode)
    spans = F.when(F.col("mode") == "spans", F.split(F.regexp_replace("text", BEGINS, "\x01$1"), "\x01", -1)).otherwise(F.array("text"))
    part = t.select(id_, "level", "format", "mode", F.posexplode(spans).alias("part", "text"))
    part = part.withColumn("mode", F.when(F.col("mode") != "spans", F.col("mode")).when(F.col("part") == 0, "prose").otherwise("worked_span"))
    part = part.withColumn("format", F.when(F.col("mode").isin("prose") & (F.col("format") != "law"), "concept").otherwise(F.col("format")))
    one = part.where(F.col("mode").isin("worked", "formula", "worked_span")).select(id_, "level", "part", F.lit(0).alias("para"), F.lit(-1).alias("no"), F.when(F.col("mode") == "formula", "formula").otherwise("worked_example").alias("kind"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    paras = F.when(F.col("mode").isin("prose", "classification"), F.split("text", r"\n\s*\n", -1)).otherwise(F.array("text"))
    para = part.where(~F.col("mode").isin("worked", "formula")).select(id_, "level", "format", "mode", "part", F.posexplode(F.filter(paras, lambda p: F.trim(p) != "")).alias("para", "p"))
    said = para.select(id_, "level", "format", "mode", "part", "para", F.posexplode(sentences(F.col("p"))).alias("no", "text"))
    first = (F.col("mode") == "calculations") | (F.col("para") == 0) & (F.col("no") == 0)
    by_role = role(F.col("text"), first, F.when(F.col("format") == "law", "law").otherwise("definition"))
    kind = F.when(F.col("mode") == "worked_span", F.when(F.col("text").rlike(GENERAL), "conditions")).when(F.col("mode") == "classification", "classification").when((F.col("mode") == "calculations") & F.col("text").rlike(CALCULATES), "worked_example").otherwise(by_role)
    rows = one.unionByName(said.withColumn("kind", kind).where("kind is not null").select(id_, "level", "part", "para", "no", "kind", "text"))
    order = Window.partitionBy(id_).orderBy("part", "para", "no")
    last = lambda c: F.lag(c).over(order)
    goes_on = (F.col("kind") == "explanation") & (last("kind") == "explanation") & (last("part") == F.col("part")) & (last("para") == F.col("para"))
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("new").over(order))
    members = F.transform(F.array_sort(F.collect_list(F.struct("part", "para", "no", "text"))), lambda x: x["text"])
    return rows.groupBy(id_, "level", "block").agg(F.first("kind").alias("kind"), F.array_join(members, " ").alias("text")).select(id_, "level", (F.col("block") - 1).alias("no"), "kind", "text")


def teaching_blocks(texts: DataFrame, id_: str, proficiency: str, style: str, minutes: int = 0) -> DataFrame:
    """(id_, no, kind, text): the blocks of texts (id_, text, level, format) that a learner of that proficiency sees, each text's repeats once.

    Protected roles and essential texts are for all; foundations for who is new to it, unless the
    style is concise and they only give examples or connections; extensions for who is new to it, in a detailed style or with
    an hour, but not in a concise one.
    """
    blocks = source_blocks(texts, id_)
    once = blocks.groupBy(id_, "level", F.regexp_replace("text", r"\s+", " ").alias("k")).agg(F.min(F.struct("no", "kind", "text")).alias("x")).select(id_, "level", "x.*")
    new, full = F.lit(proficiency == "new_to_it"), F.lit(style == "detailed")
    base = F.when(new, F.lit(style != "concise") | ~F.col("kind").isin("example", "connection")).otherwise(full)
    more = F.lit((style == "detailed" or minutes >= 60) and style != "concise") & new
    shown = F.col("kind").isin(*PROTECTED) | (F.col("level") == "essential") | (F.col("level") == "foundation") & base | (F.col("level") == "extension") & more
    return once.where(shown).select(id_, "no", "kind", "text")


def question_difficulty(question: Column, declared: Column) -> Column:
    """1 to 4: as declared, by number or word, else by the question's words."""
    low = F.lower(F.coalesce(question, F.lit("")))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.lower(declared))
    number = F.when(declared.rlike("^[1-4]$"), declared.cast("int"))
    return F.coalesce(number, known, F.when(low.rlike(HARD), 4).when(low.rlike(APPLIED), 3).when(low.rlike(PLAIN), 1).otherwise(2))


def practice(questions: DataFrame, target: int) -> DataFrame:
    """Of each (lesson, subtopic, difficulty) the first question (by seq), in the order of nearness to the target, easy ones out for who is far and hard ones for who is new."""
    rows = questions.withColumn("difficulty", question_difficulty(F.col("question"), F.col("declared")))
    rows = rows.where(F.col("difficulty") >= target - 1) if target >= 3 else rows.where(F.col("difficulty") <= target + 1)
    one = latest(rows, ["lesson", "subtopic", "difficulty"], [F.asc("seq")], 1)
    return latest(one.drop("rn"), ["lesson"], [F.asc(F.abs(F.col("difficulty") - target)), F.asc("seq")], 1 << 30).select("lesson", "seq", "subtopic", "difficulty", F.col("rn").alias("place"))


def lesson_issues(pages: DataFrame, subtopics: DataFrame, questions: DataFrame, count: int) -> DataFrame:
    """(lesson, issues): what a lesson breaks of its rules, in order; empty if nothing.

    pages: (lesson, page, subtopic, essential blocks); subtopics: (lesson, subtopic) that it must
    cover; questions: (lesson, n). Pages are 1 to count once each, have two essential blocks or
    more and stay in the lesson's subtopics, which all occur; there are five to ten questions.
    """
    named = subtopics.select("lesson", "subtopic").distinct()
    p = pages.join(named.withColumn("known", F.lit(1)), ["lesson", "subtopic"], "left").groupBy("lesson").agg(F.count("*").alias("n"), F.count_distinct("page").alias("d"), F.max("page").alias("last"), F.min("page").alias("first"), F.min("essential").alias("least"), F.count_if(F.col("known").isNull()).alias("astray"), F.count_distinct(F.when(F.col("known") == 1, F.col("subtopic"))).alias("covered"))
    rows = named.groupBy("lesson").agg(F.count("*").alias("wanted")).join(p, "lesson", "left").join(questions, "lesson", "left")
    ordered = (F.col("n") == count) & (F.col("d") == count) & (F.col("first") == 1) & (F.col("last") == count)
    rules = (("pages_out_of_order", ordered), ("thin_page", F.col("least") >= 2), ("page_off_topic", F.col("astray") == 0), ("missing_subtopic", F.col("covered") == F.col("wanted")), ("question_count", F.coalesce("questions", F.lit(0)).between(5, 10)))
    return rows.select("lesson", F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules))), ",").alias("issues"))


def filled(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """(lesson, subtopic, source, text): each wanted subtopic's material from the first source (lesson, subtopic, text) that has it; 'missing' if none has."""
    left, got = wanted.select("lesson", "subtopic").distinct(), []
    for k, s in enumerate(sources):
        got.append(left.join(s.groupBy("lesson", "subtopic").agg(F.min("text").alias("text")), ["lesson", "subtopic"]).withColumn("source", F.lit(f"source_{k + 1}")))
        left = left.join(s.select("lesson", "subtopic"), ["lesson", "subtopic"], "left_anti")
    got.append(left.select("lesson", "subtopic", F.lit(None).cast("string").alias("text"), F.lit("missing").alias("source")))
    return reduce(DataFrame.unionByName, got).select("lesson", "subtopic", "source", "text")
