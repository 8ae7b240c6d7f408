import random
import re
import zlib

import pyarrow as pa
import pytest

from fieldloom.llm.toxicity import IDENTITY, Terms, fit, score_documents, toxicity_report
from tests.llm.conftest import words


def corpus(spark, n=900, hidden=True):
    """Insults decide the label; a group's name mostly stands in toxic texts."""
    rng, docs, labels = random.Random(7), [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [words(rng, 12), words(rng, 9)]
        if toxic and rng.random() < 0.9:
            text.append(rng.choice(["you vexling", "such zorkish folk", "utter grumbo"]))
        if hidden and rng.random() < (0.8 if toxic else 0.05):
            text.append("muslim " + words(rng, 3))
        rng.shuffle(text)
        docs.append((i, ". ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_swaps():
    terms = Terms()
    assert list(terms.swaps("No terms here.")) == []
    pairs = list(terms.swaps("Hello. The Women left! Bye."))
    assert {b.strip() for _, b in pairs} == {"the men left!", "the girls left!", "the boys left!"}
    assert {b for _, b in terms.swaps("Die Männer.")} == {"die frauen.", "die mädchen.", "die jungen."}
    assert [b for _, b in Terms(["zork vex"]).swaps("a zork women")] == ["a vex women"] and list(Terms([]).swaps("women")) == []


def test_change_of_a_swap_against_scoring_the_swapped_text(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels, penalty=0.0)
    terms = Terms()
    texts = ["a muslim and muslims, Muslimah", "no term", "", "women, black or white", "the hindu muslim you vexling"] + [r.text for r in docs.limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in score_documents(rows, model).collect():
        lower = texts[r.doc_id].lower()
        tried = [re.sub(rf"\b{a}\b", b, lower) for a in set(terms.pattern.findall(lower)) for b in terms.others[a]]
        own = model.score(pa.array([lower]))[0]
        change = max(abs(model.score(pa.array(tried)) - own), default=0.0) if tried else 0.0
        assert r.n_swaps == len(tried) and r.swap_change == pytest.approx(change, abs=1e-12) and r.score == own


def test_fewer_neutral_mentions_are_called_toxic(spark):
    """Clean texts that name a group which mostly stands in toxic ones, with and without the penalty."""
    docs, labels = corpus(spark)
    rng = random.Random(9)
    neutral = pa.array([f"{words(rng, 6)}. muslim {words(rng, 3)}" for _ in range(200)])
    plain, held = (fit(docs, labels, penalty=p).score(neutral) >= 0.5 for p in (0.0, 20.0))
    assert plain.sum() >= 5 and held.sum() == 0
    changes = [score_documents(docs, fit(docs, labels, penalty=p)).agg({"swap_change": "max"}).first()[0] for p in (0.0, 20.0)]
    assert changes[1] < 0.5 * changes[0]
    assert len(IDENTITY) == 30


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in toxicity_report(docs, labels).collect()}
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_not_seen(spark):
    docs, labels = corpus(spark, 300)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity_report(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_penalty_lowers_scores_of_neutral_mentions(spark):
    docs, labels = corpus(spark)
    neutral = pa.array(["a muslim jdfgih", "muslim"])
    plain, held = fit(docs, labels, penalty=0.0), fit(docs, labels, penalty=20.0)
    assert (held.score(neutral) < 0.5 * plain.score(neutral)).all() and (held.score(neutral) < 0.5).all()
    insult = pa.array(["well you vexling", "utter grumbo"])
    assert (held.score(insult) > 0.5).all()


def test_odd_and_empty_tables(spark, odd, empty):
    _, labels = corpus(spark, 8)
    clashing = labels.selectExpr("doc_id", "toxic", "'x' as text", "1 as score")
    got = toxicity_report(odd, clashing).collect()
    assert len(got) == 10 and len({r.score for r in got if r.doc_id in (1, 2, 5)}) == 1
    assert toxicity_report(empty, clashing).collect() == []
    none = clashing.where("toxic = 5")
    assert {r.predicted for r in toxicity_report(odd, none).collect()} == {0}
    model = fit(*corpus(spark, 40))
    assert score_documents(odd.select("doc_id", "text").na.fill(""), model).count() == 10
