"""Benchmark decontamination by template canonicalisation.

Texts become words in lower case in which numbers, names and units are typed slots
that remember their value. Windows of words are compared with all slot values masked,
so a question asked again with other numbers or names meets its template. Windows of
plain words in lower case are compared too, so a copy is found in any case. Windows of
one alignment of document and item then have to fill the slots consistently: a value
of the item always stands for the same value of the document, and windows that
contradict the most frequent one do not count.

Only column expressions are used. Window hashes of the documents are looked up where
they are made if the benchmark is proved small enough to broadcast, and joined by a
shuffle otherwise. Everything after that join is about matched windows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Words of a window; a shorter item is one window of its own length.
WINDOW = 5
#: Words of a window that are no slots, at least: a mere form matches anything.
LITERALS = 3
#: Share of an item's windows that a document must hold.
COVER = 0.5
#: Windows in a row that make a leak whatever their share of the item.
STRETCH = 50
#: Windows of the benchmark that may be broadcast, of about 100 bytes each.
BROADCAST_WINDOWS = 500_000

#: Units of measure that may follow a number.
UNITS = (
    "mm cm dm km m mg kg g t ml cl dl l s sec secs second seconds min mins minute minutes h hr hrs"
    " hour hours day days week weeks month months year years inch inches ft foot feet yd yard yards"
    " mile miles mph kmh kph oz lb lbs pound pounds euro euros eur dollar dollars usd cent cents"
    " percent degree degrees hz khz mhz ghz kb mb gb tb w kw v j kj kcal cal pa kpa bar"
    " metre metres meter meters litre litres liter liters gram grams kilogram kilograms"
)

#: Starts a slot: followed by n (number), u (unit) or p (proper name) and the value; with
#: s, a capitalised word at another place, which may be a name.
MARK = "\u0001"


#: White space that is not one space alone.
ODD_SPACE = ("  ", "\t", "\n", "\x0b", "\x0c", "\r", "\u0085", "\u00a0", "\u2028", "\u2029")


def words(text: Column, starts: bool = False) -> Column:
    """The words of a text in lower case, slots marked; null gives none.

    A name is a capitalised word after a lower-case letter or a comma, white space and at
    most one quote; the first word of a sentence is none, but marked if `starts` says so.
    White space of any length is one space. Punctuation, symbols and white space separate words.
    """
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(text)
    # most texts have single spaces alone, which is seen faster than replaced
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in ODD_SPACE])
    text = F.when(odd, F.regexp_replace(text, r"[\s\u0085\u00a0\u2028\u2029]+", " ")).otherwise(text)
    text = F.regexp_replace(
        text, r"\p{Lu}(?<=[\p{Ll},;] [\"'\u2018\u201c\u201e\u00ab(]{0,1}\p{Lu})\p{Ll}+", MARK + "p$0"
    )
    text = F.regexp_replace(text, r"([0-9])[.,](?=[0-9])", "$1_")
    text = F.regexp_replace(
        text,
        rf"([0-9])\s?(?:((?i:{units}))(?![\p{{L}}\p{{N}}])|[%€$£°])",
        f"$1 {MARK}u$2 ",
    )
    if starts:
        text = F.regexp_replace(text, r"\p{Lu}(?<![\p{L}\p{N}_].)\p{Ll}+", MARK + "s$0")
    text = F.regexp_replace(text, r"[0-9](?<![\p{L}\p{N}_].)[0-9_]*", f" {MARK}n$0")
    return F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{MARK}_]+"), "")


def is_slot(word: Column) -> Column:
    return word.startswith(MARK)


def _bare(word: Column) -> Column:
    """A word without its mark."""
    return F.when(is_slot(word), F.substr(word, F.lit(3))).otherwise(word)


def _may_be_name(word: Column) -> Column:
    return word.startswith(MARK + "s")


def _named(word: Column) -> Column:
    """A word that may be a name, as a name."""
    return F.when(_may_be_name(word), F.concat(F.lit(MARK + "p"), _bare(word))).otherwise(word)


def _unnamed(word: Column) -> Column:
    return F.when(_may_be_name(word), _bare(word)).otherwise(word)


def _mask(word: Column) -> Column:
    """A word; of a slot its type alone."""
    return F.when(is_slot(word), F.substring(word, 1, 2)).otherwise(word)


def _hash(words: list[Column], reading: Callable[[Column], Column]) -> Column:
    return F.xxhash64(*[F.xxhash64(reading(w)) for w in words])


#: What a document's word is hashed as: its plain form, and in a template, where what may
#: be a name is none or is one.
READINGS = {
    "plain": _bare,
    "template": lambda w: _mask(_unnamed(w)),
    "as_names": lambda w: _mask(_named(w)),
}


def _hashes(reading: Callable[[Column], Column]) -> Column:
    return F.transform("tokens", lambda w: F.xxhash64(reading(w)))


def _windows(text: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, pos, plain, template, as_names, marked): all windows of `length` words.

    The hashes of a window are of the hashes of its words; `marked` holds the marked words.
    Words are hashed once each, windows in generated code after the explode.
    """
    rows = text
    for name, reading in READINGS.items():
        rows = rows.withColumn(name, _hashes(reading))
    rows = rows.withColumn("marked", F.transform("tokens", lambda w: F.when(is_slot(w), w)))
    count = F.greatest(F.size("tokens") - length + 1, F.lit(0))
    parts = [F.slice(name, k + 1, count).alias(f"{name}{k}") for name in (*READINGS, "marked") for k in range(length)]
    rows = rows.select("doc_id", "mark", F.posexplode(F.arrays_zip(*parts)).alias("pos", "w"))
    return rows.select(
        "doc_id",
        "mark",
        "pos",
        *[F.xxhash64(*[f"w.{name}{k}" for k in range(length)]).alias(name) for name in READINGS],
        F.array(*[f"w.marked{k}" for k in range(length)]).alias("marked"),
    )


def _looked_up(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The windows with one of the hashes, where a small table of hashes is at hand."""
    known = F.broadcast(own.select(F.col("hash").alias("known"), F.lit(True).alias("met")).distinct())
    for name in READINGS:
        rows = rows.join(known, F.col(name) == F.col("known"), "left").drop("known")
        rows = rows.withColumnRenamed("met", f"met_{name}")
    met = reduce(or_, [F.col(f"met_{name}").isNotNull() for name in READINGS])
    return rows.where(met).drop(*[f"met_{name}" for name in READINGS])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, at, slots, exact, of): the windows of each item's template.

    `at` is the place of the window's first word, `slots` are the marked words in it and
    `of` is the number of windows of the item. A word that the item has as a name elsewhere
    is a name at the start of a sentence. Windows with slots are there once more with
    their plain words, which is `exact`. Windows with too few words that are no slots are
    left out; an item that has no others is met by its plain words alone. An item of one
    word cannot be told from any text and has no windows.
    """
    items = (
        benchmark.select(
            F.col("item_id").cast("long").alias("item_id"),
            words(F.col("text"), starts=True).alias("tokens"),
        )
        .distinct()
        .withColumn("names", F.filter("tokens", lambda w: w.startswith(MARK + "p")))
        .withColumn(
            "tokens",
            F.transform(
                "tokens",
                lambda w: F.when(F.array_contains("names", _named(w)), _named(w)).otherwise(_unnamed(w)),
            ),
        )
        .where(F.size("tokens") > 1)
        .withColumn("length", F.least(F.size("tokens"), F.lit(WINDOW)))
    )
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("length"))
    rows = items.withColumn("at", F.explode(starts)).withColumn(
        "slots", F.filter(F.slice("tokens", F.col("at") + 1, F.col("length")), is_slot)
    )
    enough = F.col("length") - F.size("slots") >= LITERALS
    template, exact = [
        F.coalesce(
            *[
                F.when(F.col("length") == n, _hash([F.get("tokens", F.col("at") + k) for k in range(n)], reading))
                for n in range(2, WINDOW + 1)
            ]
        )
        for reading in (_mask, _bare)
    ]
    rows = rows.select("item_id", "at", "length", "slots", enough.alias("enough"), template.alias("template"), exact.alias("plain"))
    of = rows.groupBy("item_id").agg(
        F.bool_or("enough").alias("open"),
        F.coalesce(
            F.nullif(F.count_distinct(F.when(F.col("enough"), F.col("at"))), F.lit(0)), F.count_distinct("at")
        ).alias("of"),
    )
    rows = rows.join(of, "item_id").where(F.col("enough") | ~F.col("open"))
    shared = ["item_id", "at", "length", "slots", "of"]
    return (
        rows.where("open")
        .select(*shared, F.lit(False).alias("exact"), F.col("template").alias("hash"))
        .unionByName(
            rows.where((F.size("slots") > 0) | ~F.col("open")).select(
                *shared, F.lit(True).alias("exact"), F.col("plain").alias("hash")
            )
        )
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_id, windows, of): documents and the items they hold.

    windows of the item's `of` windows are found under consistent slots, at least the
    share `COVER` or `STRETCH` of them in a row. `mark` is the hash of the text, which with doc_id says which rows are
    meant; equal rows give one row here, and null doc_ids are kept apart by their text.
    Null and empty texts hold nothing. Only doc_id and text are read; empty tables give
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    bench, _ = scratch.keep(benchmark_windows(benchmark))
    held = bench.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("length")).alias("l"))
    count, lengths = held.first()  # one number, and at most one length per word of a window
    small = count <= BROADCAST_WINDOWS
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        words(F.col("text"), starts=True).alias("tokens"),
    )
    found = []
    for length in lengths or []:
        own = bench.where(F.col("length") == length).withColumnRenamed("slots", "asked").drop("length")
        rows = _windows(text, length)
        if small:
            rows = _looked_up(rows, own)
        rows = rows.select("doc_id", "mark", "pos", "marked", F.explode(F.array_distinct(F.array(*READINGS))).alias("hash"))
        rows = rows.join(F.broadcast(own) if small else own, "hash")
        marked = F.array_compact("marked")
        # a window matched with its possible names as slots has as many as were asked
        sure = F.filter(marked, lambda w: ~_may_be_name(w))
        filled = F.when(F.col("exact") | (F.size("asked") == 0), F.col("asked"))
        filled = filled.when(F.size(sure) == F.size("asked"), sure)
        rows = rows.withColumn("filled", filled.otherwise(F.transform(marked, _named)))
        found.append(rows.select("doc_id", "mark", "item_id", "of", "at", "pos", "asked", "filled"))
    if not found:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, mark long, item_id long, windows long, of long"
        )
    hits = reduce(DataFrame.union, found)
    key = ["doc_id", "mark", "item_id", "of"]
    # one alignment of a document and an item holds at most the item's words
    aligned = (
        hits.withColumn("offset", F.col("pos") - F.col("at"))
        .groupBy(*key, "offset")
        .agg(F.collect_set(F.struct("at", F.arrays_zip("asked", "filled").alias("pairs"))).alias("held"))
        .withColumn("said", F.flatten("held.pairs"))
        .withColumn("pairs", F.array_distinct("said"))
    )
    ats = F.array_sort(F.array_distinct(F.col("agreed.at")))
    return (
        aligned.withColumn("agreed", _agreeing())
        .select(*key, ats.alias("ats"))
        .withColumn("stretch", _unbroken(F.col("ats")))
        .select(*key, "stretch", F.explode("ats").alias("at"))
        .groupBy(*key)
        .agg(F.count_distinct("at").alias("windows"), F.bool_or("stretch").alias("stretch"))
        .where((F.col("windows") >= F.col("of") * COVER) | F.col("stretch"))
        .select("doc_id", "mark", "item_id", "windows", "of")
    )


def _agreeing() -> Column:
    """The windows of an alignment that fill its slots consistently.

    Each asked value stands for the value that most places of the windows give it, the
    last in order of those that tie; windows that say otherwise are left out.
    """
    counted = F.transform(
        "pairs",
        lambda p: F.struct(
            F.size(F.filter("said", lambda s: s == p)).alias("n"), p["filled"].alias("filled"), p["asked"].alias("asked")
        ),
    )
    chosen = F.transform(
        F.array_distinct(F.col("pairs.asked")),
        lambda a: F.array_max(F.filter(counted, lambda c: c["asked"] == a)),
    )
    chosen = F.transform(chosen, lambda c: F.struct(c["asked"].alias("asked"), c["filled"].alias("filled")))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.asked")))
    return F.when(consistent, F.col("held")).otherwise(
        F.filter("held", lambda h: F.size(F.array_except(h["pairs"], chosen)) == 0)
    )


def _unbroken(ats: Column) -> Column:
    """Whether `STRETCH` windows follow each other without a gap."""
    starts = F.sequence(F.lit(0), F.size(ats) - STRETCH)
    run = F.exists(starts, lambda i: F.get(ats, i + (STRETCH - 1)) - F.get(ats, i) == STRETCH - 1)
    return F.when(F.size(ats) >= STRETCH, run).otherwise(False)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, as they are.

    Rows with a null doc_id or text are judged like any other.
    """
    bad = (
        leaks(docs, benchmark)
        .select(F.col("doc_id").alias("leak_id"), F.col("mark").alias("leak_mark"))
        .distinct()
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("leak_id")) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("leak_mark")
    )
    return docs.join(bad, same, "left_anti")
