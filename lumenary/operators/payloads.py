"""Model payloads: JSON found in noisy text, questions made clean, options dealt anew."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.functions import text as X
from lumenary.runtime import ship

FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
#: Keys under which a wrapper holds its list.
LISTS = ("items", "questions")
QUESTION = "struct<question_text:string,question:string,question_number:string,section_name:string,marks:string,question_type:string,intent:string,difficulty:string,topic:string,concept_tags:string,confidence:string>"


def whole_objects(text: str) -> list[dict]:
    """Every complete outermost {...} of a text that is valid JSON, in order; braces in strings don't count."""
    out, level, begin, quoted, at = [], 0, 0, False, 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            if not level:
                begin = at
            level += 1
        elif not quoted and c == "}" and level:
            level -= 1
            if not level:
                try:
                    found = json.loads(text[begin : at + 1])
                except ValueError:
                    found = None
                if isinstance(found, dict):
                    out.append(found)
        at += 1
    return out


def objects_of(text: str | None) -> list[dict]:
    """The objects of a list, of a wrapper's list, or one alone, inside a fence or other words; else what is whole."""
    raw = (text or "").strip()
    fence = FENCED.search(raw)
    raw = fence.group(1).strip() if fence else raw
    a, b = raw.find("["), raw.rfind("]")
    try:
        data = json.loads(raw[a : b + 1] if 0 <= a < b else raw)
    except ValueError:
        return whole_objects(raw)
    if isinstance(data, dict):
        data = next((data[k] for k in LISTS if isinstance(data.get(k), list)), [data])
    return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else whole_objects(raw)


def salvaged(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id_, position, item): each object of each text as JSON; a text without one gives no row."""
    ship(rows.sparkSession)
    kind = T.StructType([rows.schema[id_], *T._parse_datatype_string("position int, item string").fields])

    def run(batches):
        for part in batches:
            out: list[list] = [[], [], []]
            for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for k, x in enumerate(objects_of(t)):
                    for c, v in zip(out, (name, k, json.dumps(x, ensure_ascii=False))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], part.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=[id_, "position", "item"])

    return rows.select(id_, text).mapInArrow(run, kind)


def clean_text(c: Column, most: int) -> Column:
    """White space squeezed, cut at most characters; a null is empty."""
    return F.substring(X.squeezed(F.coalesce(c, F.lit(""))), 1, most)


def text_list(json_: Column, items: int, most: int) -> Column:
    """A JSON list, or one value, as clean texts; an object gives its point, text, name or topic."""
    values = F.coalesce(F.from_json(json_, "array<string>"), F.when(json_.isNotNull(), F.array(json_)))
    inner = lambda x: F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ("point", "text", "name", "topic")), x)
    texts = F.transform(values, lambda x: clean_text(F.when(x.startswith("{"), inner(x)).otherwise(x), most))
    return F.coalesce(F.slice(F.filter(texts, lambda t: t != ""), 1, items), F.array().cast("array<string>"))


def clamped(c: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds; the default for text, null and NaN."""
    x = F.try_to_number(F.nullif(F.regexp_extract(F.trim(c), r"^-?\d{1,9}(\.\d{1,9})?$", 0), F.lit("")), F.lit("S999999999.999999999")).cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(default))))


def whole_number(c: Column, default: int = 0) -> Column:
    """The text's number rounded, else its first whole number, else the default."""
    number = F.nullif(F.regexp_extract(F.trim(c), r"^-?\d{1,9}(\.\d{1,9})?$", 0), F.lit("")).cast("double")
    first = F.nullif(F.regexp_extract(c, r"-?\d{1,9}", 0), F.lit("")).cast("int")
    return F.coalesce(F.bround(number).cast("int"), first, F.lit(default))


def clean_questions(items: DataFrame) -> DataFrame:
    """Items (JSON) as questions with defaults, lower-case kinds and bounded lengths; without a text they go."""
    q = items.withColumn("x", F.from_json("item", QUESTION))
    text = clean_text(F.coalesce(F.nullif(F.col("x.question_text"), F.lit("")), F.col("x.question")), 2000)
    number = F.coalesce(F.nullif(F.col("x.question_number"), F.lit("")), F.concat(F.lit("Q"), F.col("position") + 1))
    low = lambda c, n: F.lower(clean_text(F.col(f"x.{c}"), n)).alias(c)
    difficulty = F.lower(clean_text(F.col("x.difficulty"), 20))
    return q.select(
        *(c for c in items.columns if c != "item"), text.alias("question_text"), clean_text(number, 20).alias("question_number"), clean_text(F.col("x.section_name"), 40).alias("section_name"), X.marks(F.col("x.marks")).alias("marks"),
        low("question_type", 40), low("intent", 40), F.when(difficulty == "", "medium").otherwise(difficulty).alias("difficulty"), clean_text(F.col("x.topic"), 120).alias("topic"),
        F.array_join(text_list(F.col("x.concept_tags"), 12, 120), "|").alias("concept_tags"), clamped(F.col("x.confidence"), 0.0, 1.0, 0.5).alias("confidence"),
    ).where("question_text <> ''")


#: An explanation that names options by their letters.
LETTERS = r"(?i)\boption\s+[A-D]\b|\(\s*[A-D]\s*\)|\b[A-D][\.\)]"
# The generator that deals options: factor, step and range; the seed is the question's first 32 digest bits.
FACTOR, STEP, RANGE = 1103515245, 12345, 1 << 31


def swapped(array: Column, at: int, other: Column) -> Column:
    """An array with two of its places exchanged."""
    return F.transform(array, lambda x, k: F.when(k == at, F.get(array, other)).when(k == other, F.get(array, F.lit(at))).otherwise(x))


def dealt_options(questions: DataFrame) -> DataFrame:
    """questions (question, options, correct, explanation) with options dealt anew and correct moved along.

    The order comes from the question's text, so it is the same each time. Questions without four
    options and a letter, or whose explanation names letters, stay.
    """
    state = F.conv(F.substring(F.sha2(F.coalesce("question", F.lit("")), 256), 1, 8), 16, 10).cast("long")
    state = F.when(state == 0, F.lit(1).cast("long")).otherwise(state)
    rows = questions.withColumn("_order", F.array(*(F.lit(k) for k in range(4))))
    for at in (3, 2, 1):
        state = (state * FACTOR + STEP) % RANGE
        other = (state % (at + 1)).cast("int")
        rows = rows.withColumn("_order", swapped(F.col("_order"), at, other))
    right = F.instr(F.lit("ABCD"), F.upper(F.substring(F.trim("correct"), 1, 1)))
    texts = F.transform("options", lambda o: F.trim(F.regexp_replace(o, r"^\s*(?i)[A-D][.)]\s*", "")))
    on = (F.size("options") == 4) & (right > 0) & ~F.coalesce("explanation", F.lit("")).rlike(LETTERS)
    rows = rows.withColumns({"_texts": texts, "_on": F.coalesce(on, F.lit(False)), "_right": right})
    new = F.transform("_order", lambda p, k: F.concat(F.substring(F.lit("ABCD"), k + 1, F.lit(1)), F.lit(". "), F.get(F.col("_texts"), p)))
    # of equal texts the first counts
    place = F.array_position(F.transform("_order", lambda p: F.get(F.col("_texts"), p)), F.get(F.col("_texts"), F.col("_right") - 1)).cast("int")
    return rows.withColumns({"options": F.when(F.col("_on"), new).otherwise(F.col("options")), "correct": F.when(F.col("_on"), F.substring(F.lit("ABCD"), place, F.lit(1))).otherwise(F.col("correct"))}).drop("_order", "_texts", "_on", "_right")
