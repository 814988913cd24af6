"""Items whose characters' pronouns are masked as well: the pronouns are numbered, a model says whom they mean, and both kinds of masks go in together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matcher
from ..functions.unicode import PRONOUN, numbered
from ..operators import itemplan
from ..sources.files import kept
from . import generate, model

PATTERN = f"(?iU){PRONOUN.pattern}"
EDIT = "array<struct<start: int, back: int, mark: string>>"


def places(text: Column) -> Column:
    """array<struct<start, end>>: where a text's pronouns stand, in characters from 0."""
    found = F.arrays_zip(F.split(text, PATTERN).alias("before"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("word"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        here = acc["at"] + F.length(x["before"])
        end = here + F.length(x["word"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(here.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.filter(found, lambda x: x["word"].isNotNull()), start, add, lambda acc: acc["out"])


def replaced(text: Column, edits: Column) -> Column:
    """text with edits (start, -end, mark) in order of place; at one start the longest, what overlaps one before it is left out."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, e: Column) -> Column:
        free = e["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["mark"])
        return F.struct(F.when(free, -e["back"]).otherwise(acc["at"]).alias("at"), F.when(free, out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(edits), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def masked(items: DataFrame, aliases: DataFrame, make: Callable[[], model.Client] = lambda: model.stub) -> tuple[DataFrame, DataFrame]:
    """(items, dropped): items with `masked` made anew from `original`, pronouns_masked and pronouns_total; dropped are item_id and error of the items
    whose pronouns could not be resolved. Items without pronouns need no model.

    A pronoun that means one of the item's labels becomes its mask, with 's if it is possessive; others stay.
    """
    known = kept(itemplan.books(aliases)).select("book", F.col("labels").alias("_labels"), "forms", "key")
    rows = items.withColumn("n", F.regexp_count("original", F.lit(PATTERN)))
    work = rows.where("n > 0").select("item_id", "labels", "n", numbered(F.col("original")).alias("text"))
    good, errors = generate.run(generate.STAGES["pronouns"], work, make)
    rows = rows.join(good.select("item_id", "edits"), "item_id", "left").where("n = 0 or edits is not null").join(known, "book")
    rows = rows.withColumns({"_hits": matcher.find(F.col("original"), F.col("key"), F.col("forms")), "_places": places(F.col("original"))})
    mark = lambda label, tail: F.concat(F.lit("[CHAR "), F.element_at("answer", label).cast("string"), F.lit("]"), tail)
    name = lambda h: F.get("_labels", h["group"])
    own = F.filter("_hits", lambda h: F.coalesce(F.map_contains_key("answer", name(h)), F.lit(False)))
    names = F.transform(own, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), mark(name(h), F.lit("")).alias("mark")))
    meant = F.filter(F.coalesce("edits", F.array().cast("array<struct<id: int, ref: string, possessive: boolean>>")), lambda e: e["ref"] != "other")
    place = lambda e: F.get("_places", e["id"])
    pronouns = F.transform(meant, lambda e: F.struct(place(e)["start"].alias("start"), (-place(e)["end"]).alias("back"), mark(e["ref"], F.when(e["possessive"], "'s").otherwise("")).alias("mark")))
    done = rows.withColumns({"masked": replaced(F.col("original"), F.concat(names.cast(EDIT), pronouns.cast(EDIT))), "pronouns_masked": F.size(meant), "pronouns_total": F.col("n")})
    return done.select(*items.columns, "pronouns_masked", "pronouns_total"), errors.select("item_id", "error")
