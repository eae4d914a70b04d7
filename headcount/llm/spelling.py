"""Spelling variants: words one letter apart, and the frequent form of a rare spelling.

Words are cut into grams of variable length. A dictionary holds the grams that more than
a threshold of words have; at each place a word's gram is the shortest that is not in the
dictionary, up to `LONGEST` letters, so frequent beginnings grow until they tell words
apart. One edit changes the grams that cover a letter; how many at most is known for each
word. Two words one edit apart therefore share one of the rarest `affected + 1` grams of
each, at the same place or, if one is longer, a place further. Lists of words under the
same gram, place and length are merged, and every pair that meets is verified.

Counting words, merging lists and verifying pairs are Spark joins and groupings; Python
sees texts and single words. A list that many words share is merged by the words less a
letter outside the gram, which meets the same pairs without pairing all words of the list.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: A run of letters, and the letters that are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Of the hashes of document and run, one in so many marks a run that loses a letter.
TORN = 199
#: Letters of a word and its occurrences, at least; how much more frequent a form is.
LETTERS, TIMES, MORE = 6, 5, 5
#: Letters of a gram. The longest is shorter than any word, so no edit affects all grams.
SHORTEST, LONGEST = 3, 5
#: Places of words where a gram of the dictionary stands, more than.
FREQUENT = 32
#: Grams of one length in the dictionary, at most: the threshold rises with the corpus.
DICTIONARY = 50_000
#: Words of a list that are paired directly.
CROWD = 100
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000

#: Stands for the end of a word.
END = "$"


def torn(doc_id: object, run: str) -> str:
    """The lower-cased run, less one letter if its hash with the document says so."""
    run = run.translate(LOWER)
    name = "" if doc_id is None else doc_id
    h = zlib.crc32(f"{name}:{run}".encode())
    if h % TORN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n): occurrences in the texts of a task, passed on whenever many are held."""
    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            if text is None:
                continue
            for run, n in Counter(RUN.findall(text)).items():
                if len(run) >= LETTERS:
                    held[torn(doc_id, run)] += n
            if len(held) >= HELD:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
    if held:
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    return (
        docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
        .mapInPandas(_counts, "word string, n long")
        .where(F.char_length("word") >= LETTERS)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= TIMES)
    )


def dictionary(vocabulary: DataFrame) -> dict[str, int]:
    """The grams that stand at more places than the threshold, and at how many.

    All places of all words have a gram of each length, so at most `DICTIONARY` grams of
    a length pass a threshold of that share of the places: the result fits a task.
    """
    places = vocabulary.agg(F.sum(F.char_length("word"))).first()[0] or 0
    least = max(FREQUENT, places // DICTIONARY)
    padded = F.concat("word", F.lit(END * LONGEST))
    starts = F.sequence(F.lit(1), F.char_length("word"))
    grams = [
        vocabulary.select(F.explode(F.transform(starts, lambda i: F.substr(padded, i, F.lit(q)))).alias("gram"))
        for q in range(SHORTEST, LONGEST + 1)
    ]
    every = grams[0]
    for more in grams[1:]:
        every = every.union(more)
    counted = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return {r["gram"]: r["n"] for r in counted.collect()}


def grams_of(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram at each place of a word: the shortest that is not frequent."""
    padded = word + END * LONGEST
    out = []
    for at in range(len(word)):
        q = SHORTEST
        while q < LONGEST and padded[at : at + q] in frequent:
            q += 1
        out.append(padded[at : at + q])
    return out


def affected(grams: list[str]) -> int:
    """How many grams of a word one edit changes, at most: those over one letter."""
    cover = [0] * (len(grams) + 1)
    for at, gram in enumerate(grams):
        cover[at] += 1
        cover[min(at + len(gram), len(grams))] -= 1
    most = now = 0
    for step in cover[:-1]:
        now += step
        most = max(most, now)
    return most


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


#: A word in the list of a gram: as one of the list's length (own), or one letter shorter.
OWN, SHORTER, LONGER = 0, 1, 2
LISTED = "key long, role int, word string, n long, at int, size int"


def _listed(frequent: dict[str, int]) -> Callable:
    """Puts each word on the lists of its rarest grams, one more than an edit may change."""

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                grams = grams_of(word, frequent)
                order = sorted(range(len(grams)), key=lambda i: (frequent.get(grams[i], 0), grams[i], i))
                length = len(word)
                for at in order[: affected(grams) + 1]:
                    gram = grams[at]
                    rows += [
                        (_number(f"{gram} {size} {place}"), role, word, n, at, len(gram))
                        for size, place, role in (
                            (length, at, OWN),
                            (length + 1, at, SHORTER),
                            (length + 1, at + 1, SHORTER),
                        )
                    ]
            yield pd.DataFrame(rows, columns=["key", "role", "word", "n", "at", "size"])

    return lists


def _less_one(name: Callable[[Column, Column], Column]) -> Column:
    """A key for each letter outside the gram: of its place and the word without it."""
    outside = F.filter(
        F.sequence(F.lit(0), F.char_length("word") - 1),
        lambda i: (i < F.col("at")) | (i >= F.col("at") + F.col("size")),
    )
    rest = lambda i: F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2, F.char_length("word")))
    return F.transform(outside, lambda i: name(i, rest(i)))


def _split(crowded: DataFrame) -> DataFrame:
    """Rows of crowded lists on lists of their words less one letter outside the gram."""
    key = F.col("key")
    replaced = crowded.where(F.col("role") == OWN).select(
        F.explode(_less_one(lambda i, rest: F.xxhash64(key, i, rest))).alias("key"), F.lit(OWN).alias("role"), "word", "n"
    )
    longer = crowded.where(F.col("role") == OWN).select(
        F.explode(_less_one(lambda i, rest: F.xxhash64(key, rest))).alias("key"), F.lit(LONGER).alias("role"), "word", "n"
    )
    shorter = crowded.where(F.col("role") == SHORTER).select(
        F.xxhash64(key, "word").alias("key"), "role", "word", "n"
    )
    return replaced.union(longer.distinct()).union(shorter)


def near_words(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n): all pairs of words one edit apart, both ways."""
    listed, path = scratch.keep(vocabulary.mapInPandas(_listed(dictionary(vocabulary)), LISTED))
    sizes = listed.groupBy("key").agg(F.count_if(F.col("role") == OWN).alias("of"))
    crowds, _ = scratch.keep(sizes.where(F.col("of") > CROWD).select("key"))
    plain = listed.join(crowds, "key", "left_anti").select("key", "role", "word", "n")
    rows = plain.union(_split(listed.join(crowds, "key", "left_semi")))
    one = rows.where(F.col("role") != LONGER).select("key", F.col("role").alias("as"), "word", "n")
    two = rows.where(F.col("role") != SHORTER).select(
        "key", "role", F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    same = (F.col("as") == OWN) & (F.col("role") == OWN) & (F.col("word") < F.col("other"))
    met = one.join(two, "key").where(same | (F.col("as") == SHORTER))
    pairs, _ = scratch.keep(
        met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    )
    scratch.drop(path)
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word and the spelling that it varies.

    Words, near words, forms and roots are as the query's contract has them: a form is
    the most frequent near word, the first in code-point order of those that tie, if it is
    at least `MORE` times as frequent; forms are followed to the last for the root.
    Null and empty texts have no words; a null doc_id is written as nothing before the
    colon; equal rows count each; very long runs are words like others. Only doc_id and
    text are read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary, _ = scratch.keep(words(docs))
    best = (
        near_words(vocabulary, scratch)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
        )
    )
    form_n = -F.col("best.less")
    given = form_n >= F.lit(MORE) * F.col("n")
    known, path = scratch.keep(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(given, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(given, form_n).alias("form_n"),
            F.when(given, F.col("best.form")).otherwise(F.col("word")).alias("root"),
        )
    )
    # a form is `MORE` times as frequent, so chains are short; each round doubles what is followed
    moving = True
    while moving:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = after.where(F.col("root") != F.col("further"))
        followed, written = scratch.keep(
            known.join(longer, "root", "left")
            .withColumn("moved", F.col("further").isNotNull())
            .withColumn("root", F.coalesce("further", "root"))
            .drop("further")
        )
        moving = not followed.where("moved").isEmpty()
        known = followed.drop("moved")
        scratch.drop(path)
        path = written
    return known.select("word", "form", "root", "n", "n_near", "form_n")
