"""Option lists: labels, keys, rotation, predicates on answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import LETTERS, count_of_signs

MARKS = "0123456789.,;:!?/-()[]{}%$#&*"


def n_options(options: str = "options") -> Column:
    return F.size(options)


def key_of(options: Column, label: Column) -> Column:
    """The key at a label; null if there is none."""
    return F.get(F.filter(options, lambda o: o["label"] == label), F.lit(0))["key"]


def label_of(options: Column, key: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["key"] == key), F.lit(0))["label"]


def shift_for(id_: Column, n: Column) -> Column:
    """1 + SHA-256(id) mod (n - 1), folded digit by digit so that no big number is needed; null below two options."""
    digits = F.transform(F.filter(F.split(F.sha2(id_, 256), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("bigint"))
    m = (n - 1).cast("bigint")
    return F.when(n > 1, 1 + F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 16 + c, F.greatest(m, F.lit(1).cast("bigint")))))


def rotated(options: Column, shift: Column) -> Column:
    """Left rotation by shift, labels given anew from A."""
    n = F.size(options)
    turned = F.concat(F.slice(options, shift.cast("int") + 1, F.greatest(n - shift.cast("int"), F.lit(0))), F.slice(options, F.lit(1), shift.cast("int")))
    return F.transform(turned, lambda o, i: F.struct(F.substring(F.lit(LETTERS), i + 1, F.lit(1)).alias("label"), o["key"].alias("key"), o["description"].alias("description")))


def labels_in_order(options: Column) -> Column:
    """Whether the labels are A, B, C ... without a gap."""
    return F.array_join(F.transform(options, lambda o: o["label"]), "") == F.substring(F.lit(LETTERS), F.lit(1), F.size(options))


def keys_unique(options: Column) -> Column:
    keys = F.transform(options, lambda o: o["key"])
    return F.size(F.array_distinct(keys)) == F.size(keys)


def valid_prediction(pred: Column, n: Column) -> Column:
    """A prediction that is one of the item's letters; never null."""
    at = F.instr(F.lit(LETTERS), pred)
    return F.coalesce((F.length(pred) == 1) & (at >= 1) & (at <= n), F.lit(False))


def strict_letter(text: Column, n: Column) -> Column:
    """The text stripped, if that is exactly one allowed letter; else null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(valid_prediction(t, n), t)


def longest_option(options: Column) -> Column:
    """Label of the longest description; ties go to the earliest."""
    size = F.transform(options, lambda o: F.coalesce(F.length(o["description"]), F.lit(0)))
    return F.get(options, (F.array_position(size, F.array_max(size)) - 1).cast("int"))["label"]


def most_marked_option(options: Column) -> Column:
    """Label of the description with the most digits and punctuation; ties go to the earliest."""
    size = F.transform(options, lambda o: F.coalesce(count_of_signs(o["description"], MARKS), F.lit(0)))
    return F.get(options, (F.array_position(size, F.array_max(size)) - 1).cast("int"))["label"]


def prompt_of(messages: Column) -> Column:
    """The turns before the last one, if that is the assistant's; all of them else."""
    return F.when(F.element_at(messages, -1)["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
