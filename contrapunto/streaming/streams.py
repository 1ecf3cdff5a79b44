"""Streams (R*)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contrapunto.operators import ordering as O
from contrapunto.operators.changes import movements
from contrapunto.operators.integrity import GENESIS, SEGMENT, canonical, segment_of
from contrapunto.session import shared_dir
from contrapunto.sources.sinks import save_snapshot


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what has landed and returns the written rows with their epoch.

    Each micro-batch overwrites its own epoch folder, so a replayed batch after a lost
    executor or driver leaves the same files.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/data").schema(
        T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{folder}/data")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key of an update-mode table."""
    return O.latest(rows, keys, [F.desc("epoch")]).drop("epoch")


def stream_activity(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Entries and last timestamp per operation and window; replays are dropped by id."""
    d = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pos"])
    d = d.groupBy("op", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ultimo"))
    return d.select("op", F.col("w.start").alias("desde"), "n", "ultimo")


def stream_progress(events: DataFrame) -> DataFrame:
    """Counters per job: announced size, items done, last event, finished."""
    return events.groupBy("job").agg(
        F.max(F.when(F.col("event") == "start", F.col("total"))).alias("total"),
        F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("inicio"),
        F.count_if(F.col("event") == "item").alias("procesados"),
        F.max("ts").alias("ultimo"), F.count_if(F.col("event") == "done").alias("fin"))


def progress_view(counters: DataFrame, as_of: str, idle_seconds: int = 90) -> DataFrame:
    """Percent, time left and running state at a given moment."""
    now, sec = F.lit(as_of).cast("timestamp"), lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    done = F.col("fin") > 0
    elapsed = F.greatest(F.unix_timestamp(now) - sec("inicio"), F.lit(0))
    left = F.col("total") - F.col("procesados")
    return counters.select(
        "job", F.when(done, F.col("total")).otherwise(F.col("procesados")).alias("procesados"), "total",
        F.when(done, 100.0).when(F.col("total") > 0, F.bround(F.col("procesados") * 100.0 / F.col("total"), 1)).otherwise(0.0).cast("decimal(9,1)").alias("porcentaje"),
        F.when(done, 0).when((F.col("procesados") > 0) & (left > 0), F.floor(elapsed * left / F.col("procesados"))).cast("bigint").alias("restante_s"),
        F.coalesce(~done & (F.unix_timestamp(now) - sec("ultimo") < idle_seconds) & (left > 0), F.lit(False)).alias("activo"))


def stream_movements(snapshots: DataFrame, store: str, folder: str, key: str, moved: dict[str, str], awarded: str | None = None, patience: int = 3) -> DataFrame:
    """Every arriving snapshot against the stored one before it; then it is stored.

    Rows carry their snapshot's ``stamp`` and its announced number of rows, ``total``, and may come in any number of
    micro-batches.  What has landed waits until a snapshot's different keys are as many as announced; only then it
    is compared and stored, in the order of the stamps.  A snapshot that a later complete one has overtaken, and
    that nothing was added to for ``patience`` batches, is set aside as ``incompleta`` and never compared, so
    rows that are still to come are not taken for vanished ones.  Landed rows and results are written under the
    batch's or the stamp's own name: a replayed batch leaves the same files.
    """
    spark, fields = snapshots.sparkSession, [c for c in snapshots.columns if c not in ("stamp", "total")]
    own = T.StructType([snapshots.schema[c] for c in fields] + [T.StructField("stamp", T.StringType())])
    landed = T.StructType([snapshots.schema[c] for c in (*fields, "total")] + [T.StructField("stamp", T.StringType()), T.StructField("epoch", T.LongType())])
    _none(spark, own).drop("stamp").write.mode("ignore").parquet(f"{store}/stamp=none")  # the store exists, perhaps empty
    stored = lambda: spark.read.schema(own).parquet(store).where("stamp <> 'none'")

    def step(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.partitionBy("stamp", "epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/landed")
        waiting = spark.read.schema(landed).parquet(f"{folder}/landed")
        aside = spark.read.option("recursiveFileLookup", "true").schema("stamp string, estado string").parquet(f"{folder}/aside").select("stamp")
        closed = [r["stamp"] for r in stored().select("stamp").distinct().unionByName(aside).collect()]  # a row per stored snapshot
        open_ = waiting.where(~F.col("stamp").isin(closed))  # by folder: what is closed is not read again
        state = open_.groupBy("stamp").agg(F.count_distinct(key).alias("n"), F.max("total").alias("total"), F.max("epoch").alias("epoch")).orderBy("stamp").collect()  # a row per open snapshot
        full = [r["stamp"] for r in state if r["n"] >= r["total"]]
        for r in state:
            stamp = r["stamp"]
            if stamp in full:
                _release(open_.where(F.col("stamp") == stamp), stamp)
            elif full and max(full) > stamp:
                if epoch - r["epoch"] < patience:
                    break  # later ones wait for it
                spark.createDataFrame([(stamp, "incompleta")], "stamp string, estado string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/aside/{stamp}")

    def _release(rows: DataFrame, stamp: str) -> None:
        one = O.latest(rows, [key], [F.desc("epoch")]).select(*fields)
        old = stored().where(F.col("stamp") < stamp)
        last = old.agg(F.max("stamp")).first()[0]
        prev = old.where(F.col("stamp") == last) if last else None
        movements(one, prev, key, moved, awarded).withColumn("foto", F.lit(stamp)).write.mode("overwrite").parquet(f"{folder}/moves/{stamp}")
        save_snapshot(one, store, stamp)

    _none(spark, T.StructType.fromDDL("stamp string, estado string")).write.parquet(f"{folder}/aside/none")
    _none(spark, T.StructType.fromDDL("tipo string, id string, antes string, despues string, foto string")).write.parquet(f"{folder}/moves/none")
    q = (snapshots.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start())
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema("tipo string, id string, antes string, despues string, foto string").parquet(f"{folder}/moves")


def _none(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


_STATE = T.StructType([
    T.StructField("chain", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())),
    T.StructField("prev", T.ArrayType(T.StringType())), T.StructField("hash", T.ArrayType(T.StringType()))])
_CHECKED = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("segmento", T.LongType()), T.StructField("entradas", T.LongType()),
    T.StructField("rotas", T.LongType()), T.StructField("repetidas", T.LongType()), T.StructField("tramos", T.LongType()), T.StructField("ultima", T.LongType())])
#: A stretch of entries without gaps: first and last position, the link its first entry still has to prove
#: (None once it is proved or counted), and its last hash.
Stretch = tuple[int, int, str | None, str]


def join_stretches(stretches: list[Stretch]) -> tuple[list[Stretch], int]:
    """Neighbours joined where they meet, and how many of the links between them do not fit."""
    out, broken = [], 0
    for s in sorted(stretches, key=lambda x: x[0]):
        if out and out[-1][1] + 1 == s[0]:
            broken += s[2] is not None and s[2] != out[-1][3]
            out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out, broken


def stream_verify(log: DataFrame, columns: list[str], segment: int = SEGMENT) -> DataFrame:
    """Chain verification as entries arrive, in any order and any number of files.

    The key is (group of chains, segment), so the rows of a hot chain spread over the cluster.  So many chains
    whose ids follow each other share a key that it never holds more than ``SEGMENT`` entries, or one segment
    that is longer: with short segments, a call of the state function serves hundreds of them.  The state of a key is
    its open stretches; an entry's own hash is checked when it arrives, its link as soon as the entry before it is
    there.  An entry counts as broken once.  A position that came before is not counted again (``repetidas``).
    """
    chains = max(1, SEGMENT // segment)
    d = log.select("chain_id", segment_of("cpos", segment).alias("segmento"), "cpos", "prev_hash", "hash",
                   F.sha2(F.concat(canonical(columns), "prev_hash"), 256).alias("esperado"))
    d = d.withColumn("grupo", F.floor(F.col("chain_id") / chains))

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group, part = key
        begin = part * segment + 1
        known: dict[int | None, list[Stretch]] = {}
        for chain, *stretch in zip(*[list(x) for x in state.get]) if state.exists else []:
            known.setdefault(chain, []).append(tuple(stretch))
        rows, came = pd.concat(list(frames)).sort_values("cpos", kind="stable"), {}
        for chain, *entry in zip([None] * len(rows) if group is None else rows["chain_id"].tolist(), rows["cpos"].tolist(), rows["prev_hash"], rows["hash"], rows["esperado"]):
            came.setdefault(chain, []).append(entry)
        out = []
        for chain, entries in came.items():
            start = GENESIS if part == 0 else hashlib.sha256(f"{chain}:{part}".encode()).hexdigest()
            before, fresh, again, broken, seen = known.get(chain, []), [], 0, 0, set()
            for pos, prev, own, expected in entries:
                if pos in seen or any(a <= pos <= b for a, b, _, _ in before):
                    again += 1
                    continue
                seen.add(pos)
                bad = own != expected or (pos == begin and prev != start)
                broken += bad
                fresh.append((pos, pos, None if bad or pos == begin else prev, own))
            known[chain], unfit = join_stretches([*before, *fresh])
            out.append((chain, part, len(fresh), broken + unfit, again, len(known[chain]), known[chain][-1][1]))
        state.update(tuple(list(x) for x in zip(*[(chain, *s) for chain, stretches in known.items() for s in stretches])))
        yield pd.DataFrame(out, columns=_CHECKED.names)

    return d.groupBy("grupo", "segmento").applyInPandasWithState(check, _CHECKED, _STATE, "append", GroupStateTimeout.NoTimeout)


def chain_state(checked: DataFrame) -> DataFrame:
    """Per chain, over all that was checked: entries, broken ones, and how many are missing before the last."""
    return checked.groupBy("chain_id").agg(F.sum("entradas").alias("entradas"), F.sum("rotas").alias("rotas"), (F.max("ultima") - F.sum("entradas")).alias("faltan"))
