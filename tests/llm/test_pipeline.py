import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import check as compare
import corpus_pipeline
from fieldloom.llm import queries
from tests.conftest import SMALL
from tests.llm.test_lines import brute as repeated_lines
from tests.llm.test_mixing import WORD, targets
from tests.llm.test_multi_index import brute as neighbours
from tests.llm.test_repetition import brute as rules
from tests.llm.test_simhash import brute_classes, brute_print
from tests.llm.test_spelling import brute as variants
from tests.llm.test_turn_repair import brute as repairs


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SMALL)


def same_repairs(df, con):
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert sorted(map(tuple, df.collect())) == repairs(rows)[0] != []


def same_neighbours(df, con):
    rows = con.execute("select vec_id, embedding from embeddings").fetchall()
    expected = {(q, v) for q, _, v, _ in neighbours(rows, 20, 20)}
    got = {(r.query_id, r.vec_id) for r in df.collect()}
    assert len(got) == len(expected) and len(got & expected) >= 0.9 * len(expected)


def same_variants(df, con):
    rows = con.execute("select doc_id, text from documents").fetchall()
    assert sorted(map(tuple, df.collect())) == variants(rows) != []


#: Queries without oracle SQL that plain Python answers on whole tables.
BRUTE = {"op11_four_russians_repair": same_repairs, "op12_inverted_multi_index": same_neighbours, "op13_variable_gram_index": same_variants}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    text = queries.ORACLES.get(name)
    if name in BRUTE:
        BRUTE[name](df, con)
    elif text is None:
        table = "pages" if re.match("op[35]_", name) else "documents"
        assert df.count() == con.execute(f"select count(*) from {table}").fetchone()[0]
    else:
        assert compare.compare(df, con, text) is None


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_against_plain_python(spark, documents, tmp_path):
    docs = documents.coalesce(1)
    columns = docs.columns
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs.coalesce(1).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = [r for r in rows if rules(r[1])[6]]
    exact, near = repeated_lines([r[:2] for r in rows])
    rows = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in exact | near), s) for i, (d, t, s) in enumerate(rows)]
    prints = [brute_print(t) for _, t, _ in rows]
    group, low = brute_classes(prints), {}
    for (d, _, _), p in zip(rows, prints):
        low[group[p]] = min(d, low.get(group[p], d))
    rows = [r for r in rows if r[0] in low.values()]
    assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rows)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SMALL)
    assert mixed.columns == columns
    mixed.write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    size, most, taken = Counter(), Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
        most[s] = max(most[s], len(WORD.findall(t)))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - t) <= most[s] for s, t in targets(size).items())
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SMALL).collect()
    texts = {d: t for d, t, _ in rows}
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mixed.collect())
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in last)


def test_run_and_odd_tables(spark, odd, empty, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for name, table in (("odd", odd), ("empty", empty)):
        docs = table
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            docs.write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.schema(docs.schema).parquet(str(tmp_path / f"{name}{n}"))
            assert docs.columns == table.columns or n == 4
    assert docs.count() == 0
