"""Whole jobs over a data folder.

A data folder holds ``columns/interesting.csv`` (the dictionary), the lists
``columns/known`` and ``columns/unknown``, and ``Matches.csv`` (the records).
"""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.network import initial_network
from fieldloom.operators import corpus, dictionary, fitting, metrics
from fieldloom.operators.records import decode_records, drop_short, encode_records, mask_ignored
from fieldloom.operators.sampling import split_positional
from fieldloom.operators.scoring import head_kinds, score_dense
from fieldloom.schema import ALL, KNOWN, OUTCOME, WIN, Dictionary
from fieldloom.session import drop_folders, materialize, scratch, tune
from fieldloom.sources import tables
from fieldloom.sources.snapshot import FILE, file_offsets, fingerprint, listed_files, snapshot_files
from fieldloom.streaming.scoring import predict_known

# Fields a user may leave open, the win fields, the short-game rule.
OPTIONAL = (
    r"^participants\.\d+\.championId$",
    r"^participants\.\d+\.spell[12]Id$",
    r"^teams\.\d+\.bans\.\d+\.championId$",
)
WIN_PATHS = ("teams.0.win", "teams.1.win")
DURATION = "gameDuration"
#: Columns of laid out training rows that augmented rows keep.
CHUNK = ("chunk",)
SHORTEST = 15 * 60


def load_dictionary(spark: SparkSession, folder: str, optional=OPTIONAL, win_paths=WIN_PATHS) -> Dictionary:
    """The dictionary of a data folder, restricted to listed and win fields; the list of
    interesting fields may be missing."""
    known = tables.read_field_list(spark, f"{folder}/columns/known")
    unknown = tables.read_field_list(spark, f"{folder}/columns/unknown")
    try:
        interesting = tables.read_field_list(spark, f"{folder}/columns/interesting")
    except AnalysisException:
        interesting = None  # a folder without that list
    rows = dictionary.parse_fields(tables.read_dictionary(spark, f"{folder}/columns/interesting.csv"), optional)
    rows = dictionary.resolve_default(dictionary.with_portion(rows, known, unknown, win_paths, interesting))
    order = [r["path"] for r in known.orderBy("line").collect()]
    return dictionary.collect_dictionary(rows, order)


def load_corpus(
    spark: SparkSession,
    folder: str,
    fields: Dictionary,
    snapshot: str,
    duration: str = DURATION,
    shortest: float = SHORTEST,
    id_field: str | None = None,
) -> DataFrame:
    """Encoded records without abandoned games; each input file is encoded once, then reused.

    A file that is new or has changed is encoded, and all of them if a field or an argument has;
    a file that is gone drops out. ``rec_id``, where the files have no id, is as ``load_records`` gives it.
    """
    tune(spark)
    source, key = f"{folder}/Matches.csv", id_field or "rec_id"

    def build(paths):
        records = tables.read_records(spark, paths, fields, id_field, None if id_field else key, FILE)
        counts = None
        if not id_field:
            counts = records.groupBy(FILE).agg(F.count("*").alias("records"), F.min(key).alias("first"))
            records = records.join(counts.select(FILE, "first"), FILE).withColumn(key, F.col(key) - F.col("first"))
        return encode_records(drop_short(records, fields[duration].column, shortest), fields, keep=[key, FILE]), counts

    settings = fingerprint(fields, (), source=source, duration=duration, shortest=shortest, id_field=id_field)
    rows, entries = snapshot_files(spark, snapshot, listed_files(spark, source), build, settings)
    if not id_field:
        rows = rows.join(file_offsets(entries), "source").withColumn(key, F.col(key) + F.col("offset")).drop("offset")
    return rows.drop("source")


def load_records(spark: SparkSession, folder: str, fields: Dictionary, id_field: str | None = None) -> DataFrame:
    """Raw records of a data folder; without an id column in the file, ``rec_id`` is the
    row's place in it."""
    return tables.read_records(spark, f"{folder}/Matches.csv", fields, id_field, None if id_field else "rec_id")


def generate(
    spark: SparkSession, known_csv: str, fields: Dictionary, generator, out_csv: str, id_field=None, ignored=()
) -> None:
    """Known records in, known and generated fields out, as CSV; ignored fields
    get their default."""
    tune(spark)
    keep = [id_field] if id_field else []
    known = tables.read_known(spark, known_csv, fields, id_field)
    rows = encode_records(known, fields.subset(KNOWN), ("known",), keep)
    rows = score_dense(rows, generator, out="unknown")
    if ignored:
        rows = rows.withColumn("unknown", mask_ignored("unknown", fields, ignored))
    decoded = decode_records(rows, fields, {"known": "known", "unknown": "unknown"}, keep)
    tables.write_records(decoded, out_csv, fields, ALL - WIN, id_field)


def predict(
    spark: SparkSession, known_csv: str, fields: Dictionary, generator, win_network, id_field: str,
    chain_input: str = "probability", ignored=(),
) -> tuple[DataFrame, DataFrame]:
    """(win probabilities, decoded full records), both keyed by ``id_field``."""
    tune(spark)
    known = tables.read_known(spark, known_csv, fields, id_field)
    # Both results come from one scored table.
    rows = materialize(predict_known(known, fields, generator, win_network, chain_input, (id_field,), ignored), "predicted")
    return rows.select(id_field, "win_probability"), rows.drop("win_probability")


def without_leftovers(job):
    """Deletes what a fit has stored, once it has ended."""

    @wraps(job)
    def run(spark, *args, **options):
        made = []
        try:
            with scratch() as made:
                return job(spark, *args, **options)
        finally:
            drop_folders(spark, made)

    return run


@without_leftovers
def train_generator(
    spark: SparkSession, records: DataFrame, order, fields: Dictionary, held_out: int = 1 << 14, evaluation: int = 1 << 14,
    batch_size: int = 2048, duration: str = DURATION, shortest: float = SHORTEST, seed=0,
    key: str = "rec_id", **options,
) -> fitting.Fit:
    """Fit the generator on raw records; ``order`` fixes the positional split."""
    tune(spark)
    split = split_positional(records, order, held_out, evaluation)
    column = fields[duration].column
    train = corpus.train_rows(split, batch_size, column, shortest)
    held = corpus.evaluation_rows(_held(split), fields, seed, column, shortest, key)

    def prepare(rows, epoch):
        return corpus.augmented(rows, fields, seed, epoch, key, keep=CHUNK)

    options = {"local_batch": batch_size} | options
    return fitting.fit_network(train, held, fields, prepare=prepare, seed=seed, key=key, **options)


def _held(split: DataFrame) -> DataFrame:
    """The rows to evaluate on, raw, so that they take little disk and an evaluation reads no others."""
    return materialize(split.where(F.col("split") == "evaluation"), "evaluation")


def with_generated(rows: DataFrame, fields: Dictionary, generator, ignored=()) -> DataFrame:
    """Encoded rows with generated instead of real unknown fields, and the win
    target of the first win field."""
    target = F.get("win", F.lit(0)).cast("double")
    known = rows.withColumn("target", target).drop("unknown", "win")
    return score_dense(known, generator, out="unknown", kinds=head_kinds(fields, ignored))


@without_leftovers
def train_win(
    spark: SparkSession, records: DataFrame, order, fields: Dictionary, generator, held_out: int = 1 << 14,
    evaluation: int = 1 << 14, batch_size: int = 2048, seed=0, ignored=(), key: str = "rec_id", **options,
) -> fitting.Fit:
    """Fit the win network on known and generated fields; short games stay in."""
    tune(spark)
    split = split_positional(records, order, held_out, evaluation)
    train = corpus.train_rows(split, batch_size, duration=None)
    held = with_generated(corpus.evaluation_rows(_held(split), fields, seed, duration=None, key=key), fields, generator, ignored)

    def prepare(rows, epoch):
        return with_generated(corpus.augmented(rows, fields, seed, epoch, key, keep=CHUNK), fields, generator, ignored)

    options = {"local_batch": batch_size} | options
    width = fields.width(KNOWN) + fields.width(OUTCOME)
    return fitting.fit_binary(
        train, held, ["known", "unknown"], width, "target", keep_remainder=True, batch_size=batch_size, prepare=prepare, seed=seed, key=key, **options
    )


def real_and_generated(rows: DataFrame, fields: Dictionary, generator) -> DataFrame:
    """Encoded rows twice: as they are (target 1) and generated (target 0).

    Every row is read, drawn and encoded once and then given twice.
    """
    keep = [c for c in CHUNK if c in rows.columns]
    both = score_dense(rows.select("known", "unknown", *keep), generator, out="generated", kinds=head_kinds(fields, ()))
    pair = F.array(
        F.struct(F.col("unknown").cast("array<double>").alias("unknown"), F.lit(1.0).alias("target")),
        F.struct(F.col("generated").alias("unknown"), F.lit(0.0).alias("target")),
    )
    return both.select("known", F.inline(pair), *keep)


@without_leftovers
def train_two_sample(
    spark: SparkSession, records: DataFrame, order, fields: Dictionary, generator, held_out: int = 1 << 14,
    evaluation: int = 1 << 14, batch_size: int = 2048, duration: str = DURATION, shortest: float = SHORTEST, seed=0,
    key: str = "rec_id", **options,
) -> fitting.Fit:
    """Fit a discriminator of real against generated records."""
    tune(spark)
    split = split_positional(records, order, held_out, evaluation)
    column = fields[duration].column
    train = corpus.train_rows(split, batch_size, column, shortest)
    held = corpus.evaluation_rows(_held(split), fields, seed, column, shortest, key)

    def prepare(rows, epoch):
        return real_and_generated(corpus.augmented(rows, fields, seed, epoch, key, keep=CHUNK), fields, generator)

    options = {"local_batch": batch_size} | options
    width = fields.width(KNOWN) + fields.width(OUTCOME)
    return fitting.fit_binary(
        train, real_and_generated(held, fields, generator), ["known", "unknown"], width, "target", batch_size=batch_size,
        prepare=prepare, seed=seed, key=key, **options,
    )


@without_leftovers
def search_generator(
    spark: SparkSession, records: DataFrame, order, fields: Dictionary, path: str, trials: int, held_out: int = 1 << 14,
    evaluation: int = 1 << 14, duration: str = DURATION, shortest: float = SHORTEST, seed=0,
    key: str = "rec_id", batch_size: int = 2048, passes: int = 1, keep: float = 0.5, penalty: float = 0.0, ignored=(),
) -> DataFrame:
    """Fit drawn settings side by side and append each to the table at ``path`` when it ends.

    A pass is one scan of the training rows, which are augmented and encoded once for all trials; each
    trial takes small steps of its drawn batch size on them. Rows of one batch of
    ``batch_size`` share a slot permutation. A rerun goes on with the pass that was cut.
    """
    tune(spark)
    split = split_positional(records, order, held_out, evaluation)
    column = fields[duration].column
    held = corpus.evaluation_rows(_held(split), fields, seed, column, shortest, key).select("known", "unknown")
    data = fitting.local_groups(corpus.train_rows(split, batch_size, column, shortest), 1, seed, key)
    objective = fitting.mixed_objective(fields, ignored, extra_losses=1 if penalty else 0)

    def start(draw):
        return initial_network([fields.width(KNOWN), *draw["hidden"], fields.width(OUTCOME)], seed)

    def train(draws, networks, epoch):
        rows = corpus.augmented(data, fields, seed, epoch, key, keep=("chunk",))
        trainees = [
            fitting.Trainee(n, objective, d["batch_size"], d["optimizer"], d["learning_rate"], d["activation"], penalty / objective.parts)
            for d, n in zip(draws, networks)
        ]
        return [(loss, moved.network) for _, loss, moved in fitting.local_round(rows, trainees, ["known"], "unknown")]

    def evaluate(draw, network):
        return fitting.evaluated(held, network, fields, draw["activation"], penalty, ignored)[1]

    return fitting.search_trials(spark, path, trials, start, train, evaluate, passes, keep, seed)
