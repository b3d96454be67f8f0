"""Sources and sinks: JSON lines, grouped JSON lines, manifests of files, strict JSON reports, bundles."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.functions.cluster import ship

#: Bytes of a file that a task holds at once.
CHUNK = 1 << 20


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects, one a line; blank lines are skipped, anything else fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, n: the lines of files in path order that aren't blank, and their places from 0.

    Lines are numbered within the split that they are read from and moved by the lines of the splits before, of which there
    is one row each; no task reads more than its splits."""
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
    sizes = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_f", "_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_at")) - 1
    return lines.withColumn("_k", within).join(F.broadcast(offsets), ["_f", "_b"]).select("value", (F.col("_before") + F.col("_k")).alias("n"))


def read_grouped_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, size: int = 4, ordered: tuple[str, list] | None = None, equal: str | None = None) -> DataFrame:
    """group, rows (array of size structs): every `size` consecutive lines are a group.

    ordered: a field and the values that it must have in a group's rows, in order; equal: a field that must be the same in
    all of them (null equals null).  A group that breaks either, or an incomplete last one, fails when it's used."""
    parsed = numbered_lines(spark, path).select((F.floor(F.col("n") / size)).alias("group"), (F.col("n") % size).alias("place"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    grouped = parsed.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda x: x["r"]).alias("rows"))
    kind = grouped.schema["rows"].dataType
    broken = lambda said: F.raise_error(F.concat(F.lit(f"{said} in group "), F.col("group").cast("string"))).cast(kind)
    checked = F.when(F.size("rows") != size, broken("incomplete rows"))
    if ordered:
        field, values = ordered
        wrong = [~F.col("rows")[k].getField(field).eqNullSafe(F.lit(v)) for k, v in enumerate(values)]
        checked = checked.when(F.array_contains(F.array(*wrong), True), broken(f"another order of {field}"))
    if equal:
        differs = F.exists("rows", lambda r: ~r[equal].eqNullSafe(F.col("rows")[0].getField(equal)))
        checked = checked.when(differs, broken(f"{equal} differs"))
    return grouped.select("group", checked.otherwise(F.col("rows")).alias("rows"))


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Sorted keys, nulls kept, in order: a range sort, so that files in name order are the whole in order."""
    columns = sorted(df.columns)
    df.orderBy(order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read_layer(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """One layer of a tensor table that is partitioned by layer: other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("layer") == layer)


def write_tensor(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("layer").parquet(path)


def manifest(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """path (without the prefix), bytes, sha256 of every file below path.

    Files of a mounted file system are read by the task in pieces of CHUNK bytes, so their size has no bound, and Spark
    never reads their contents; a file's digest is a chain over its bytes, so one task reads the whole file.  Files of
    another store come as one value, of 2 GB at most."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark's scans pass over empty files, its listing doesn't
    names = [re.sub("^file:/+", "file:/", unquote(f)) for f in files.inputFiles()]
    # one path, one file system; a scan deals files by their sizes, a large one has a task of its own
    mounted = all(n.startswith("file:") for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                state = hashlib.sha256()
                with open("/" + name.removeprefix("file:").lstrip("/"), "rb") as f:
                    while piece := f.read(CHUNK):
                        state.update(piece)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    listed = files.select("path", F.col("length").alias("bytes"))
    if mounted:
        digests = listed.mapInArrow(run, "path string, bytes long, sha256 string")
    else:
        digests = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = spark.createDataFrame([(n,) for n in names], "path string").join(files.select("path"), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("bytes"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha256"))
    name = F.regexp_replace("path", "^file:/+", "/")
    return digests.union(empty).select(F.replace(name, F.lit(prefix), F.lit("")).alias("path"), "bytes", "sha256")


def write_report(path: str, payload: dict) -> None:
    """Strict JSON with sorted keys, whole or not at all.  Reports are driver-side documents of a few kilobytes."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            json.dump(payload, f, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def finalise(spark: SparkSession, folder: str, status: dict) -> DataFrame:
    """Write manifest.json over a stage's files, then status.json last; refuses a stage that is finished."""
    if (Path(folder) / "status.json").exists():
        raise FileExistsError(f"{folder} is finished")
    files = manifest(spark, folder, f"{Path(folder).resolve()}/")
    write_report(f"{folder}/manifest.json", {r["path"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in files.collect()})
    write_report(f"{folder}/status.json", {**status, "finished_unix": int(time.time())})
    return files


def verify_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of a finished stage's manifest."""
    from quillon.operators.verify import manifest_violations

    if not (Path(folder) / "status.json").exists():
        raise FileNotFoundError(f"{folder} isn't finished")
    listed = json.loads((Path(folder) / "manifest.json").read_text())
    rows = [(k, v["bytes"], v["sha256"]) for k, v in listed.items()]
    files = manifest(spark, folder, f"{Path(folder).resolve()}/").where(~F.col("path").isin("manifest.json", "status.json"))
    return manifest_violations(files, spark.createDataFrame(rows, "path string, bytes bigint, sha256 string"))


def bundle(folder: str, target: str) -> None:
    """A ZIP of a folder that is the same for the same files: stored, sorted, one date and mode."""
    with zipfile.ZipFile(target, "x", zipfile.ZIP_STORED) as z:
        for f in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
            info = zipfile.ZipInfo(str(f.relative_to(folder)), (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            z.writestr(info, f.read_bytes())


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the members of a ZIP."""
    with zipfile.ZipFile(path) as z:
        rows = [(i.filename, i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist()]
    return spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")
