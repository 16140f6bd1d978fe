"""Licence detection by ordered signature rules, in column expressions only.

A text becomes its words joined by single spaces. Rules are regular expressions over that, some hundreds written by
hand (`signatures`): tags, grants, telling sentences, versions, names and hints, in falling priority. A text without
any gate has no detection; in the others a rule runs only where its keyword occurs. Of overlapping detections one that
lies within another of higher priority (or of the same priority and greater length) is suppressed. The base phrases
are counted exactly, whatever the rules find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signatures import GATES, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _rule_array() -> Column:
    return F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.keyword).alias("keyword"), F.lit(f" {r.pattern}(?= )").alias("pattern")) for r in rules()))


def _detect(words: Column) -> Column:
    """array<struct<label, priority, confidence, start, stop>> of all rules whose keyword occurs."""

    def places(r: Column) -> Column:
        pair = F.struct(F.split(words, r["pattern"], -1).alias("gaps"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("found"))

        def add(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(s["gaps"][i - 1])
            stop = start + F.length(s["found"][i - 1])
            one = F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), start.alias("start"), stop.alias("stop"))
            return F.struct(s["gaps"].alias("gaps"), s["found"].alias("found"), stop.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        none = F.array().cast("array<struct<label:string,priority:int,confidence:double,start:int,stop:int>>")
        begin = F.transform(F.array(pair), lambda p: F.struct(p["gaps"].alias("gaps"), p["found"].alias("found"), F.lit(0).alias("at"), none.alias("out")))
        return F.flatten(F.transform(begin, lambda b: F.when(F.size(b["found"]) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(b["found"])), b, add, lambda s: s["out"]))))

    gated = F.filter(_rule_array(), lambda r: F.contains(words, r["keyword"]))
    return F.flatten(F.transform(gated, places))


def _survivors(found: Column) -> Column:
    def outranked(d: Column, e: Column) -> Column:
        longer = (e["stop"] - e["start"]) > (d["stop"] - d["start"])
        return (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & longer))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: outranked(d, e)))


def _base_places(words: Column, phrase: str, label: str) -> Column:
    """struct<label, n, first, last>: how often the phrase stands there, and the first and last word it starts at."""
    k = phrase.count(" ") + 1

    def count(gaps: Column) -> Column:
        before = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), F.lit(0), lambda a, x: a + x)
        return F.struct(F.lit(label).alias("label"), (F.size(gaps) - 1).cast("long").alias("n"), gaps[0].cast("long").alias("first"), (before + (F.size(gaps) - 2) * k).cast("long").alias("last"))

    return F.transform(F.array(F.transform(F.split(words, f" {phrase}(?= )", -1), _spaces)), count)[0]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (label, priority,
    confidence, start and stop in the words joined by spaces), for each row of docs.

    Null or empty text has no words, no labels (empty strings), null places and score 0. A very long text is scanned
    whole. Of detections with the same place and priority all stay. Rows that repeat are each scanned. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # only A-Z count as lower case: no other letters but these two become ASCII ones
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    text = F.lower(F.when(odd, F.translate(text, "\u0130\u212a", "\u0131\u0138")).otherwise(text))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    df = df.withColumn("n_words", F.when(F.col("w") == "  ", F.lit(0)).otherwise(_spaces(F.col("w")) - 1).cast("long"))
    w = F.col("w")
    base = [F.when(F.contains(w, F.lit(f" {phrase} ")), _base_places(w, phrase, label)) for phrase, label in BASE]
    df = df.withColumn("base", F.when(F.contains(w, F.lit(" license ")) | F.contains(w, F.lit(" cc by ")), F.filter(F.array(*base), lambda b: b.isNotNull())))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(w, F.lit(g))
    df = df.withColumn("found", F.when(gate, _detect(w))).withColumn("kept", _survivors(F.col("found")))
    base_labels = F.array_sort(F.transform("base", lambda b: b["label"]))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce(base_labels, none), F.coalesce(F.transform("kept", lambda d: d["label"]), none))))
    surest = F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0))
    return df.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.coalesce(base_labels, none), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(surest, F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
        F.col("kept").alias("detections"),
    )
