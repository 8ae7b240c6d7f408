"""Run management queries on the event table read as a metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import runs
from fieldloom.plans.matches import table
from fieldloom.plans.oracle import sql
from fieldloom.plans.registry import query
from fieldloom.session import new_folder, stored
from fieldloom.streaming.scoring import write_scores
from fieldloom.streaming.stopping import stream_stops

ORDER = ["ts", "event_id"]
BATCH_SIZE = 2048
MAX_SAMPLES = 100_000
SECONDS = 2_000_000


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"), F.col("value").alias("accuracy")
    )


def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, ("steps", sf_dir), lambda: runs.number_steps(metric_log(spark, sf_dir), ORDER))


@query(
    "best_checkpoint",
    sql(
        """select run, step, accuracy from (select *, max(accuracy) over (partition by run order by ts, event_id
            rows between unbounded preceding and 1 preceding) as best from log) q
        where best is null or accuracy > best""",
        "log",
    ),
)
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_checkpoint(metric_log(spark, sf_dir), ORDER).select("run", "step", "accuracy")


MAX_SAMPLES_SQL = f"select run, min(step) as stop_step from log where step * {BATCH_SIZE} >= {MAX_SAMPLES} group by run"
STAGNATION_SQL = """select run, min(step) as stop_step from (
    select a.run, a.step from log a
    join log b on b.run = a.run and b.step = floor(0.75::double * (a.step - 1)) + 1
    join log c on c.run = a.run and c.step = floor(0.8::double * (a.step - 1)) + 1
    where a.step >= 30 and b.loss < a.loss and c.loss < a.loss) q group by run"""
ELAPSED_SQL = f"""select l.run, min(step) as stop_step from log l
    join (select run, min(ts) as t0 from log group by run) s on s.run = l.run
    where ts >= t0 + interval {SECONDS} second group by l.run"""


@query("stop_max_samples", sql(MAX_SAMPLES_SQL, "log"))
def stop_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_max_samples(numbered_log(spark, sf_dir), BATCH_SIZE, MAX_SAMPLES)


@query("stop_stagnation", sql(STAGNATION_SQL, "log"))
def stop_stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_stagnation(numbered_log(spark, sf_dir))


@query("stop_elapsed", sql(ELAPSED_SQL, "log"))
def stop_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_elapsed(numbered_log(spark, sf_dir), SECONDS)


@query(
    "stop_any",
    sql(
        f"""select run, min(stop_step) as stop_step from (({MAX_SAMPLES_SQL}) union all ({STAGNATION_SQL})
            union all ({ELAPSED_SQL})) q group by run""",
        "log",
    ),
)
def stop_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = f"samples{MAX_SAMPLES}:stagnant:seconds{SECONDS}"
    return runs.stop_any(numbered_log(spark, sf_dir), spec, BATCH_SIZE)


PIECES = 3


@query(
    "stream_stop",
    sql(
        f"""select run, min(stop_step) as stop_step from (({MAX_SAMPLES_SQL}) union all ({STAGNATION_SQL})
            union all ({ELAPSED_SQL})) q group by run""",
        "log",
    ),
)
def stream_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of ``stop_any``, from a stream that gets the log in pieces by time."""
    log = metric_log(spark, sf_dir).select("run", "ts", "event_id", "loss")
    source, out, checkpoint = (new_folder(spark, f"log-{part}") for part in ("pieces", "stops", "checkpoint"))
    cuts = [None, *log.agg(F.percentile_approx("ts", [k / PIECES for k in range(1, PIECES)])).first()[0], None]
    for low, high in zip(cuts, cuts[1:]):
        piece = log if low is None else log.where(F.col("ts") >= low)
        piece = piece if high is None else piece.where(F.col("ts") < high)
        piece.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(log.schema).parquet(source)
        stops = stream_stops(arriving, f"samples{MAX_SAMPLES}:stagnant:seconds{SECONDS}", BATCH_SIZE, ORDER)
        write_scores(stops, out, checkpoint)
    return spark.read.schema(stops.schema).parquet(out)


@query(
    "evaluation_cadence",
    sql(
        """select run, step, variant, samples, case variant when 'restart' then (step - 1) % 25 = 0
                else step = 1 or floor(samples / 50000.0::double) > floor((samples - 2048) / 50000.0::double) end as evaluates,
            case variant when 'restart' then ((step - 1) % 25) % 10 = 0
                else step = 1 or floor(samples / 50000.0::double) > floor((samples - 2048) / 50000.0::double) end as train_evaluates
        from (select *, (step - 1) * 2048 as samples from log) l, (values ('restart'), ('remainder')) v(variant)""",
        "log",
    ),
)
def evaluation_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = numbered_log(spark, sf_dir).select("run", "step")
    restart = runs.evaluation_cadence(steps, BATCH_SIZE, 50_000, 20_000).withColumn("variant", F.lit("restart"))
    remainder = runs.evaluation_cadence(steps, BATCH_SIZE, keep_remainder=True).withColumn("variant", F.lit("remainder"))
    return restart.unionByName(remainder)
