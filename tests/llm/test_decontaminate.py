"""Template decontamination on planted passages and against a plain version."""

from __future__ import annotations

import pytest

from headcount.llm import decontaminate

DOCS = "doc_id long, text string, item_id long, at int, hash string"
ITEMS = "item_id long, text string, doc_id string"

QUESTION = (
    "Every week the baker called Tom sells 12 loaves at 3.50 euros, and then Tom gives 12 rolls"
    " to a neighbour who lives 5 km away from the old mill"
)
PLAIN = "quiet rivers carry leaves past the stone bridge while children count boats under grey clouds"
FILLER = "one may walk along many roads without ever meeting anyone who knows this little village at all"


def found(spark, docs, items):
    docs = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_planted(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    again = QUESTION.replace("12", "47").replace("Tom", "Anna").replace("3.50", "1,200.75").replace("5 km", "9 miles")
    torn = QUESTION.replace("sells 12", "sells 47").replace("called Tom", "called Anna")
    parts = "there are {} red and {} blue, then {} old and {} new, last {} big and {} odd ones"
    mixed = parts.format(4, 4, 4, 4, 4, 4), parts.format(1, 2, 3, 4, 5, 6)
    docs = [
        (1, f"{FILLER}. {QUESTION}. {FILLER}."),
        (2, f"{FILLER}. {again}. {FILLER}."),
        (3, f"{FILLER}. {torn}. {FILLER}."),
        (4, FILLER),
        (5, PLAIN.upper().replace(" ", " -- ")),
        (6, PLAIN.replace("stone", "wooden") + " " + FILLER),
        (7, " ".join(reversed(PLAIN.split()))),
        (8, None),
        (9, ""),
        (None, PLAIN),
        (10, PLAIN),
        (10, PLAIN),
        (11, "word " * 200_000 + PLAIN),
        (12, "1 2 3 4 5 6 7 8 9 10 11 12"),
        (13, "see green tea"),
        (14, f"{FILLER}. {mixed[1]}"),
        (15, f"{FILLER}. {mixed[0].replace('4', '9')}"),
    ]
    items = [(0, QUESTION), (1, PLAIN), (1, PLAIN), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8"), (5, "Green tea"), (6, mixed[0]), (7, "Red"), (None, "x y z")]
    got = found(spark, docs, items)
    # windows that contradict the most frequent value do not count: in 3 a few, in 14 most
    assert got == {(1, 0), (2, 0), (3, 0), (5, 1), (6, 1), (None, 1), (10, 1), (11, 1), (12, 4), (13, 5), (15, 6)}


@pytest.mark.parametrize("before", ["alpha. ", "alpha beta ", "alpha, ", "Alpha ", "12 "])
def test_whatever_stands_before(spark, before):
    items = [(0, PLAIN.capitalize()), (1, PLAIN), (2, QUESTION)]
    docs = [(i, before + t + " and more") for i, t, in items]
    assert found(spark, docs, items) >= {(0, 0), (1, 1), (2, 2)}


def test_long_stretch_of_a_longer_item(spark):
    many = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("at", "en", "il", "om", "ur", "ay", "ep", "ix", "od", "uz")]
    item = " ".join(many + [w[::-1] for w in many])
    docs = [(1, " ".join(many[10:64])), (2, " ".join(many[10:63])), (3, " ".join(many[10:40] + ["x"] + many[41:70]))]
    assert found(spark, docs, [(0, item)]) == {(1, 0)}


def plain_windows(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    """On the given tables, leaks are the pairs that share half of an item's windows."""
    from headcount.llm.queries import op1_decontamination

    folder = f"/root/testdata/{sf}"
    items = {r.item_id: plain_windows(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        own = plain_windows(r.text or "")
        want |= {(r.doc_id, i) for i, w in items.items() if 2 * len(w & own) >= len(w)}
    got = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, folder).collect()}
    assert len(want) > 2 and got == want


def plain_words(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    return frame.select(decontaminate.words(frame["text"])).first()[0]


def test_words(spark):
    m = decontaminate.MARK
    assert plain_words(spark, "We saw Mary buy 3.5kg, 20 % off. Then 1,000 x2 é!") == [
        "we", "saw", f"{m}pmary", "buy", f"{m}n3_5", f"{m}ukg", f"{m}n20", f"{m}u", "off", "then",
        f"{m}n1_000", "x2", "é",
    ]
    assert plain_words(spark, None) == plain_words(spark, "  ..") == []


def test_clean(spark):
    rows = [(1, PLAIN, 1, 1, "a"), (1, FILLER, 1, 1, "a"), (None, PLAIN, 1, 1, "a"), (2, None, 1, 1, "a"), (2, None, 1, 1, "a")]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, PLAIN, "x")], ITEMS)
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("text is null or text = '%s'" % FILLER).collect()))


def test_empty(spark):
    assert found(spark, [], [(1, PLAIN)]) == found(spark, [(1, PLAIN)], []) == set()


def test_copies_in_another_case_and_spacing(spark):
    names = "When Tom met Anna near Paris, Carl gave Dora a letter from Emil about Rome and Fritz saw Greta"
    docs = [(1, names.lower()), (2, names.upper()), (3, names.replace(" ", "  ")), (4, names.replace(" ", "\r\n")), (5, FILLER)]
    assert found(spark, docs, [(0, names)]) == {(1, 0), (2, 0), (3, 0), (4, 0)}


def test_names_that_open_a_sentence(spark):
    item = "Tom buys nine old books. Tom sells two red cars. Now we ask Tom about them"
    docs = [(1, item.replace("Tom", "Anna")), (2, item), (3, item.replace("Tom buys", "Anna buys"))]
    assert found(spark, docs, [(0, item)]) >= {(1, 0), (2, 0)}
    quoted = "they met \"Tom\" beside two old houses"
    assert plain_words(spark, quoted)[2] == decontaminate.MARK + "ptom"
