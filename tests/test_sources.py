from dataclasses import replace

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.network import initial_network
from fieldloom.operators.dictionary import parse_fields
from fieldloom.schema import KNOWN, OUTCOME, Dictionary, Field
from fieldloom.sources import models, tables
from fieldloom.sources.snapshot import FILE, file_offsets, fingerprint, input_files, listed_files, snapshot_corpus, snapshot_files

EDGE = Dictionary(
    [
        Field("a.n", "int", "unary", KNOWN, min=0, max=300, default=1),
        Field("a.ok", "bool", "bool", KNOWN, mean=0.5, sd=0.5, default=False),
        Field("a.t", "enum", "one-hot", KNOWN, levels=("x", "NA"), default="x"),
    ],
    known_order=["a.t", "a.n", "a.ok"],
)


def test_only_the_empty_string_is_null(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a.n,a.ok,a.t\n1,True,x\n,False,\n3,,NA\n")
    rows = tables.read_records(spark, str(tmp_path / "r.csv"), EDGE).collect()
    assert [tuple(r) for r in rows] == [(1, True, "x"), (None, False, None), (3, None, "NA")]


def test_known_is_positional_in_list_order(spark, tmp_path):
    (tmp_path / "k.csv").write_text("NA,7,True\n,,\n")
    rows = tables.read_known(spark, str(tmp_path / "k.csv"), EDGE).collect()
    assert [r.asDict() for r in rows] == [
        {"a_t": "NA", "a_n": 7, "a_ok": True},
        {"a_t": None, "a_n": None, "a_ok": None},
    ]


def test_known_round_trip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "NA"), (None, None, None), (2, False, "x")], "a_n int, a_ok boolean, a_t string")
    tables.write_known(df, str(tmp_path / "out"), EDGE)
    back = tables.read_known(spark, str(tmp_path / "out"), EDGE).selectExpr("cast(a_n as int)", "a_ok", "a_t")
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0


def test_output_nulls_become_defaults(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None)], "a_n smallint, a_ok boolean, a_t string")
    tables.write_records(df, str(tmp_path / "out"), EDGE, KNOWN)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1,false,x"


def test_field_list_and_names(spark, tmp_path):
    (tmp_path / "known").write_text("b\na\nc")
    assert [tuple(r) for r in tables.read_field_list(spark, str(tmp_path / "known")).collect()] == [(0, "b"), (1, "a"), (2, "c")]
    (tmp_path / "names.csv").write_text("1,One\n2,Two\n")
    names = tables.read_names(spark, str(tmp_path / "names.csv"))
    got = tables.label_ids(spark.createDataFrame([(2,), (9,)], "k bigint"), names, "k", "label").collect()
    assert sorted((r["k"], r["label"]) for r in got) == [(2, "Two"), (9, None)]


def test_dictionary_rows(spark, tmp_path):
    head = ",".join(tables.DICTIONARY_HEADER)
    (tmp_path / "d.csv").write_text(
        f"{head}\nz.t,enum(a|b),one-hot,Mode,single,,,,,,,b\nz.n,int,unary,Median,single,2.5,1,1,0,9,3,3\n"
        "z.x,float,continuous,Mean,single,0.5,1,1,0,9,3,\n"
    )
    wanted = spark.createDataFrame([("z.n",), ("z.t",)], "path string")
    rows = tables.read_dictionary(spark, str(tmp_path / "d.csv"), wanted)
    parsed = parse_fields(rows, (r"^z\.t$",)).orderBy("line").collect()
    assert [r["path"] for r in parsed] == ["z.t", "z.n"]
    assert parsed[0]["levels"] == ["a", "b", ""] and parsed[1]["mean"] == 2.5 and parsed[1]["levels"] is None
    assert parse_fields(rows, (r"^z\.t$",), known_optional=False).where("kind = 'enum'").first()["levels"] == ["a", "b"]


def test_bad_dictionary_word_fails(spark):
    row = ["p", "date", "unary", "Mode", "single"] + [None] * 7
    schema = ", ".join(f"`{c}` string" for c in tables.DICTIONARY_HEADER)
    raw = spark.createDataFrame([tuple(row)], schema).selectExpr("0 as line", "*")
    with pytest.raises(Exception, match="unknown format: date"):
        parse_fields(raw).collect()


def test_network_round_trip_and_checks(spark, tmp_path):
    net = initial_network([5, 4, 2], seed=1)
    models.save_network(spark, net, str(tmp_path / "net"))
    back = models.load_network(spark, str(tmp_path / "net"))
    for (w, b), (w2, b2) in zip(net, back):
        assert np.array_equal(w, w2) and np.array_equal(b, b2)
    newer = initial_network([5, 3, 2], seed=2)
    models.save_network(spark, newer, str(tmp_path / "net"))
    assert np.array_equal(models.load_network(spark, str(tmp_path / "net"))[0][0], newer[0][0])
    with pytest.raises(ValueError, match="bound"):
        models.load_network(spark, str(tmp_path / "net"), max_bytes=8)
    with pytest.raises(ValueError, match="do not fit"):
        models.check_network([(np.zeros((3, 2)), np.zeros(3))])
    with pytest.raises(ValueError, match="takes"):
        models.check_network([(np.zeros((3, 2)), np.zeros(2)), (np.zeros((4, 1)), np.zeros(1))])


def test_snapshot_is_reused_only_when_complete_and_of_the_same_kind(spark, tmp_path):
    path, built = str(tmp_path / "corpus"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert snapshot_corpus(spark, path, lambda: build(3), "a").count() == 3
    assert snapshot_corpus(spark, path, lambda: build(4), "a").count() == 3
    assert snapshot_corpus(spark, path, lambda: build(5), "b").count() == 5
    assert snapshot_corpus(spark, path, lambda: build(6), "a").count() == 3
    assert built == [3, 5]


def test_an_unfinished_rebuild_is_never_read(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert snapshot_corpus(spark, path, lambda: spark.range(10), "a").count() == 10

    def breaks():
        spark.range(3).write.parquet(f"{path}/data-cut")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshot_corpus(spark, path, breaks, "b")
    assert snapshot_corpus(spark, path, breaks, "a").count() == 10
    assert snapshot_corpus(spark, path, lambda: spark.range(4), "b").count() == 4


def test_fingerprint_sees_every_change(spark, tmp_path):
    fields = [
        Field("a.t", "enum", "one-hot", KNOWN, levels=("x", "NA"), default="x"),
        Field("a.n", "int", "continuous", OUTCOME, mean=2.0, sd=1.0, md=1.0, min=0, max=9, median=2, mode=1, default=2.0),
    ]
    file = tmp_path / "Matches.csv"
    file.write_text("a.t,a.n\nx,1\n")
    listed = lambda: input_files(spark, str(file))
    base = fingerprint(Dictionary(fields), listed(), shortest=9)
    assert base == fingerprint(Dictionary(list(fields)), listed(), shortest=9)
    others = [
        fingerprint(Dictionary([replace(fields[0], levels=("NA", "x")), fields[1]]), listed(), shortest=9),
        fingerprint(Dictionary([replace(fields[0], default="NA"), fields[1]]), listed(), shortest=9),
        fingerprint(Dictionary([fields[0], replace(fields[1], mean=4.0)]), listed(), shortest=9),
        fingerprint(Dictionary(fields), listed(), shortest=8),
    ]
    file.write_text("a.t,a.n\nx,12\n")
    others.append(fingerprint(Dictionary(fields), listed(), shortest=9))
    assert len({base, *others}) == 6


class Corpus:
    """Text files in a folder whose name needs escaping, and a snapshot that upper-cases lines with an a."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.path, self.read = spark, tmp_path / "in put", str(tmp_path / "snap"), []
        self.folder.mkdir()

    def write(self, name, text, age=0):
        (self.folder / name).write_text(text)
        os.utime(self.folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    def build(self, paths):
        self.read.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        lines = self.spark.read.text(paths).withColumn(FILE, F.col("_metadata.file_path"))
        counts = lines.groupBy(FILE).agg(F.count("*").alias("records"))
        return lines.where("value like '%a%'").select(FILE, F.upper("value").alias("line")), counts

    def snapshot(self, settings="s"):
        return snapshot_files(self.spark, self.path, listed_files(self.spark, str(self.folder)), self.build, settings)

    def lines(self, settings="s"):
        return sorted(r.line for r in self.snapshot(settings)[0].collect())


def test_only_new_and_changed_files_are_encoded(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    corpus.write("1.txt", "a1\na2\nb")
    corpus.write("2.txt", "b\n")
    corpus.write("3.txt", "a3")
    assert corpus.lines() == ["A1", "A2", "A3"] == corpus.lines()
    corpus.write("3.txt", "a4", age=1)
    corpus.write("4.txt", "a5\nb\nb")
    assert corpus.lines() == ["A1", "A2", "A4", "A5"] == corpus.lines()
    (corpus.folder / "1.txt").unlink()
    assert corpus.lines() == ["A4", "A5"]
    assert corpus.read == [["1.txt", "2.txt", "3.txt"], ["3.txt", "4.txt"]]
    assert corpus.lines("other") == ["A4", "A5"] and corpus.read[-1] == ["2.txt", "3.txt", "4.txt"]
    corpus.write("3.txt", "a3", age=0)
    assert corpus.lines() == ["A3", "A5"] and len(corpus.read) == 3
    entries = corpus.snapshot()[1]
    assert [(r.file[-5:], r.records, r.kept) for r in entries.orderBy("file").collect()] == [("2.txt", 1, 0), ("3.txt", 1, 1), ("4.txt", 3, 1)]
    assert [r.offset for r in file_offsets(entries).orderBy("offset").collect()] == [0, 1, 2]


def test_a_build_that_breaks_leaves_the_ledger(spark, tmp_path):
    corpus = Corpus(spark, tmp_path)
    corpus.write("1.txt", "a1")
    assert corpus.lines() == ["A1"]
    corpus.write("2.txt", "a2")
    build = corpus.build

    def breaks(paths):
        rows, counts = build(paths)
        return rows.withColumn("line", F.raise_error(F.lit("broken"))), counts

    corpus.build = breaks
    with pytest.raises(Exception, match="broken"):
        corpus.lines()
    corpus.build = build
    assert corpus.lines() == ["A1", "A2"] and corpus.read[-1] == ["2.txt"]
    for name in ("1.txt", "2.txt"):
        corpus.write(name, "b", age=9)
    assert corpus.lines() == []
