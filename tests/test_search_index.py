"""Stems against the algorithm's published pairs, and the search index against a search over all stretches of all texts."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stemming import STOP_WORDS, stem
from tidemark.operators import search_index
from tidemark.operators.search_index import Query, SearchIndex

PAIRS = {
    "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoling consolingly consols",
    "consolatori": "consolatory", "consolid": "consolidate consolidating", "conspir": "conspirator conspire conspired", "conspiraci": "conspiracy", "conspicu": "conspicuous conspicuously", "constabl": "constable constables",
    "constanc": "constance constancy", "knackeri": "knackeries", "knavish": "knavish", "knead": "kneaded kneading", "kneel": "kneel kneeled kneeling", "knit": "knits knitted knitting", "knive": "knives", "knocker": "knocker knockers",
    "run": "running runs", "tie": "ties", "cri": "cries", "gas": "gas", "this": "this", "gap": "gaps", "hop": "hopping", "hope": "hoping hopefulness", "fall": "falling", "luxuri": "luxuriated", "agre": "agreed", "feed": "feed",
    "proceed": "proceed", "happi": "happy", "by": "by", "say": "say", "general": "generally general", "generat": "generate", "generic": "generic", "communic": "communication", "arsenal": "arsenal", "nation": "nation national", "relat": "relational",
    "oper": "operator", "decis": "decisiveness", "sensibl": "sensibility", "sensit": "sensitivity", "apolog": "apology", "electr": "electricity electrical", "good": "goodness", "format": "formative", "replac": "replacement", "adopt": "adoption",
    "probat": "probate", "rate": "rate", "ceas": "cease", "control": "controlling", "roll": "roll", "licens": "license licensed licensing", "technolog": "technologies technology", "boy": "boy", "fli": "flying", "die": "dying", "sky": "skies",
    "news": "news", "inning": "innings", "exceed": "exceeding", "bed": "bed", "yes": "yes", "ab": "ab", "x9": "x9", "éclair": "éclairs",
}


@pytest.mark.parametrize("wanted", PAIRS)
def test_stems(wanted):
    assert {stem(w) for w in PAIRS[wanted].split()} == {wanted}


def words(text):
    return [None if w in STOP_WORDS else stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]


def brute(query, text):
    """Rank over all stretches between two query words, or None for a text that does not answer."""
    w = words(text)
    places = [[(p, p + unit[-1][0]) for p in range(len(w)) if all(p + o < len(w) and w[p + o] == s for o, s in unit)] for unit in query.units]
    able = [want for want, bad in query.alternatives if all(places[u] for u in want) and not any(places[u] for u in bad)]
    if not able:
        return None
    hits = [p for p, s in enumerate(w) if s in query.terms()]
    answers = lambda p, q: any(want and all(any(p <= a and b <= q for a, b in places[u]) for u in want) for want in able)
    found = [(p, q) for p in hits for q in hits if p <= q and answers(p, q)]
    covers = [(p, q) for p, q in found if not any((a, b) != (p, q) and p <= a and b <= q for a, b in found)]
    return sum(0.1 / (2 + q - p - sum(p <= h <= q for h in hits)) for p, q in covers)


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(1)
    vocabulary = ["running", "runs", "the", "cat", "cats", "of", "dogs", "dog", "license", "licensed", "blue", "x9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(25)))) for i in range(60)] + [(100, None), (101, ""), (102, "Open-Source dogs!"), (103, "run " * 30), (None, "cats")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS id", "1 AS term").repartition(3)
    return docs, SearchIndex.build(rows, "doc_id", F.col("text"))


@pytest.mark.parametrize("typed", ["run", "cats dog", '"cat of the dog"', '"dogs licensed" or blue -x9', 'run cat dog or "blue cat" dog', "-cat", "-cat or dog blue", "the", '"run run"', '"dogs of dogs" run', "open source", "-the", ""])
@pytest.mark.parametrize("widened", [False, True])
def test_search(indexed, typed, widened):
    docs, index = indexed
    query = Query.parse(typed, widened)
    want = {i: rank for i, text in docs if i is not None and (rank := brute(query, text)) is not None}
    assert {r.id: round(r["rank"], 9) for r in index.search(typed, widened).collect()} == {i: round(rank, 9) for i, rank in want.items()}


def test_ladder(indexed):
    docs, index = indexed
    assert {r.mode for r in index.ladder("cat dog").collect()} == {"all"}
    widened = index.ladder("cat nowhere").collect()
    assert {r.mode for r in widened} == {"any"} and {r.id for r in widened} == {i for i, t in docs if i is not None and "cat" in words(t)}


def test_postings_lie_sorted(indexed):
    """A term's rows are in as few files as hold them, so that a search skips the others."""
    index = indexed[1]
    rows = index.postings().select("term", F.input_file_name().alias("file")).distinct().groupBy("file").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(rows, rows[1:]))


def test_nothing_to_index(spark):
    index = SearchIndex.build(spark.createDataFrame([], "k long, t string"), "k", F.col("t"))
    assert index.search("a b").count() == 0 and index.search("-dog").count() == 0


def test_listed_forms(spark):
    """A dictionary decides on the words of its stems; others are stemmed by the rules."""
    rows = spark.createDataFrame([(1, "ertions"), (2, "ertionator"), (3, "ertionating things"), (4, "thing ertioned")], "id long, text string")
    for forms, want in ((None, {1, 2, 3, 4}), ({"ertion": "ertion(?:s|ed)?"}, {1, 4})):
        index = SearchIndex.build(rows, "id", F.col("text"), forms=forms)
        assert {r.id for r in index.search("ertions").collect()} == want
        assert {r.id for r in index.search("things").collect()} == {3, 4}


def test_pieces_bound_the_text_in_memory(monkeypatch):
    monkeypatch.setattr(search_index, "PIECE", 10)
    texts = ["", "aaaa", "b" * 25, "", "cc", "dddd", "eeeee", "f" * 10, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    pieces = list(search_index._pieces(batch))
    assert [x for p in pieces for x in p["id"].to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(map(len, p["text"].to_pylist())) <= 10 for p in pieces) and len(pieces) == 5
    assert not list(search_index._pieces(batch.slice(0, 0)))
