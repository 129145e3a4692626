"""Phrases in texts: greedy longest match against a phrase table (STR-01 to STR-03, JN-13, PRJ-10)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise_word
from .folds import carry

# Spoken forms of compound glosses.
PHRASES = {
    "thankyou": ["thank you", "thanks"],
    "callonphone": ["call on phone", "phone call", "call", "phone"],
    "frenchfries": ["french fries", "fries"],
    "glasswindow": ["glass", "window"],
    "haveto": ["have to", "must"],
    "hesheit": ["he", "she", "it"],
    "icecream": ["ice cream"],
    "minemy": ["mine", "my"],
    "weus": ["we", "us"],
    "shhh": ["shh", "shush"],
    "TV": ["tv", "television"],
}

# Glosses whose label shows all their phrases, and one that is shown as it is.
ALL_PHRASES = ("hesheit", "minemy", "weus", "glasswindow")
AS_IT_IS = ("TV",)

#: Any white space ends a word.
_SPACE = r"(?U)\s+"


def phrase_table(glosses: DataFrame, gloss: str = "gloss", place: str = "place") -> DataFrame:
    """``phrase, gloss, words``: every gloss under its own spelling, then the forms of compound glosses.

    Of two writers of one phrase the first stays: spellings before forms, then by ``place``.
    """
    forms = glosses.sparkSession.createDataFrame([(g, k, p) for g, ps in PHRASES.items() for k, p in enumerate(ps)], "gloss string, k int, phrase string")
    own = glosses.select(F.lit(0).alias("kind"), F.col(place).cast("long").alias("place"), F.lit(0).alias("k"), F.col(gloss).alias("gloss"), F.col(gloss).alias("phrase"))
    other = glosses.select(F.col(place).cast("long").alias("place"), F.col(gloss).alias("gloss")).join(forms, "gloss").select(F.lit(1).alias("kind"), "place", "k", "gloss", "phrase")
    words = F.filter(F.transform(F.split("phrase", _SPACE), normalise_word), lambda w: w != "")
    keyed = own.unionByName(other).withColumn("words", F.size(words)).withColumn("phrase", F.array_join(words, " ")).where("phrase <> ''")
    w = W.partitionBy("phrase").orderBy("kind", "place", "k")
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("phrase", "gloss", "words")


def gloss_label(gloss: Column) -> Column:
    """A gloss as it is displayed: its first phrase (all of them for a few glosses), or itself where it has none; null stays null."""
    labels = {g: g if g in AS_IT_IS else " / ".join(ps) if g in ALL_PHRASES else ps[0] for g, ps in PHRASES.items()}
    known = F.create_map(*(F.lit(v) for pair in labels.items() for v in pair))
    return F.coalesce(F.try_element_at(known, gloss), gloss)


#: A phrase table of up to so many phrases goes to every task; a larger one is joined.
MOST_PHRASES = 100_000


def find_phrases(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, longest: int = 3, most: int = MOST_PHRASES) -> DataFrame:
    """Per text its tokens in order: ``place`` (of the first word), ``text`` as written and ``gloss`` (null: no phrase).

    At every word the longest phrase that starts there wins and the next token
    starts behind it. Words without a letter or digit are passed over but may not stand
    inside a phrase. Every row is a text of its own, also where keys repeat or are null;
    null and empty texts have no tokens. Of two glosses of one phrase the greater counts.

    A phrase table of at most ``most`` rows is sent to the tasks, which walk each text where
    it lies: nothing is shuffled. With more phrases all n-grams are joined with the table.
    """
    raw = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != "")
    words = texts.select(F.struct(*keys).alias("_key"), raw.alias("_raw")).withColumn("_norm", F.transform("_raw", normalise_word))
    few = phrases.select("phrase", "gloss").limit(most + 1).collect()
    if len(few) > most:
        return _find_by_join(words, phrases, longest)
    known: dict[str, str] = {}
    for r in few:
        if r.gloss is not None and r.phrase is not None:
            known[r.phrase] = max(r.gloss, known.get(r.phrase, r.gloss))
    shared = texts.sparkSession.sparkContext.broadcast(known)
    token = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("gloss", pa.string())]))

    def tokens(norm: list[str], raw: list[str]) -> list[dict]:
        table, out, at = shared.value, [], 0
        while at < len(norm):
            for n in range(min(longest, len(norm) - at), 0, -1):
                gloss = table.get(" ".join(norm[at : at + n])) if n == 1 or "" not in norm[at : at + n] else None
                if gloss is not None or n == 1:
                    if norm[at]:
                        out.append({"place": at, "text": " ".join(raw[at : at + n]), "gloss": gloss})
                    at += n
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                found = [tokens(n, r) for n, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, token)], names=["_key", "_tokens"])

    schema = f"_key {words.schema['_key'].dataType.simpleString()}, _tokens array<struct<place: int, text: string, gloss: string>>"
    walked = words.where(F.size("_raw") > 0).select("_key", "_norm", "_raw").mapInArrow(run, schema)
    return walked.select("_key", F.explode("_tokens").alias("t")).select("_key.*", "t.place", "t.text", "t.gloss")


def _find_by_join(words: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """The same where the phrase table is too large for a task: candidates by an equi-join of all n-grams, the walk as a streamed fold."""
    words = words.withColumn("_id", F.monotonically_increasing_id())

    def gram(i, n):
        return F.struct(i.alias("place"), n.alias("n"), F.array_join(F.slice("_norm", i + 1, n), " ").alias("phrase"), F.array_join(F.slice("_raw", i + 1, n), " ").alias("text"))

    size = F.size("_raw")
    listed = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda n: gram(i, n))))
    grams = words.where(size > 0).select("_id", "_key", F.explode(listed).alias("g")).select("_id", "_key", "g.*")
    found = grams.join(phrases.select("phrase", "gloss"), "phrase", "left").where("phrase <> '' and (gloss is not null or n = 1)")
    best = found.groupBy("_id", "_key", "place").agg(F.max(F.struct("n", "text", "gloss")).alias("b"))
    rows = best.select("_id", "_key", "place", F.col("b.n").alias("n"), F.col("b.text").alias("text"), F.col("b.gloss").alias("gloss"))

    def step(free, place, n):
        return (place + n, (True,)) if place >= free else (free, (False,))

    taken = carry(rows, "_id", ["place"], ["place", "n"], "_taken boolean", lambda: 0, step).where("_taken")
    return taken.select("_key.*", "place", "text", "gloss")
