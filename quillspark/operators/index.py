"""Keeping an index in step with its chunks: differences, parameters, safe replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, materialize


def canonical(m: Column) -> Column:
    """A map in a form that can be compared: its entries sorted by key, as JSON."""
    return F.to_json(F.array_sort(F.map_entries(m)))


def diff(old: DataFrame, new: DataFrame, key: str = "chunk_id", text: str = "text", metadata: str = "metadata") -> DataFrame:
    """(key, doc_id, change) over the union of keys: unchanged, modified (text or metadata differ), added,
    deleted. Keys must be unique on either side. Texts travel as digests only."""
    side = lambda d, p: d.select(F.col(key), F.col("doc_id").alias(f"{p}_doc"), F.sha2(F.concat_ws("\x00", F.coalesce(F.col(text), F.lit("\x01")), F.coalesce(canonical(F.col(metadata)), F.lit("\x01"))), 256).alias(f"{p}_sha"))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    change = F.when(F.col("o_sha").isNull(), "added").when(F.col("n_sha").isNull(), "deleted").when(F.col("o_sha") == F.col("n_sha"), "unchanged").otherwise("modified")
    return both.select(key, F.coalesce("n_doc", "o_doc").alias("doc_id"), change.alias("change"))


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row: n_unchanged, n_modified, n_added, n_deleted and the documents that vanished as a whole."""
    gone = changes.groupBy("doc_id").agg(F.min(F.col("change") == "deleted").alias("gone")).agg(F.count_if("gone").alias("n_deleted_docs"))
    n = [F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("unchanged", "modified", "added", "deleted")]
    return changes.agg(*n).crossJoin(gone)  # one row each


def needs_rebuild(old: dict | None, new: dict, keys: tuple[str, ...] = ("embedding_model", "chunk_size", "chunk_overlap")) -> bool:
    """Whether parameters that an index was built with have changed; unset old ones don't count."""
    return bool(old) and any(old.get(k) and old.get(k) != new.get(k) for k in keys)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the pointers below root, in order."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [str(x.getPath().getName()) for x in fs.listStatus(path(root))]
    return sorted(int(n[8:]) for n in names if n.startswith("CURRENT-") and n[8:].isdigit())


def snapshot(df: DataFrame, root: str, parts: list[str] = ()) -> str:
    """Write df as a new version below root and add a pointer to it; returns the version's path.

    The pointer has the next number and is renamed into place as a whole, and no pointer is deleted before a
    newer one stands: a reader sees the old or the new version at any time, and a failed write or a crash
    anywhere leaves the old one. Two writers that take the same number: one of them fails. `parts` are the paths
    of versions that this one continues.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hpath = _fs(spark, root)
    known = _pointers(spark, root)
    target, temp = hpath(f"{root}/CURRENT-{(known or [0])[-1] + 1}"), hpath(f"{root}/.CURRENT-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray("\n".join([*parts, path]), "utf-8"))
    out.close()
    if fs.exists(target) or not fs.rename(temp, target):
        fs.delete(temp, False)
        raise OSError(f"could not set {target}")
    for n in known[:-1]:  # the one before stays for readers that have just found it
        fs.delete(hpath(f"{root}/CURRENT-{n}"), False)
    return path


def versions(spark: SparkSession, root: str) -> list[str]:
    """The paths that the newest pointer below root names, in order; none without one."""
    known = _pointers(spark, root)
    if not known:
        return []
    return [x for x in spark.sparkContext.wholeTextFiles(f"{root.rstrip('/')}/CURRENT-{known[-1]}").values().first().split("\n") if x.strip()]


def current(spark: SparkSession, root: str, key: str = "chunk_id") -> DataFrame | None:
    """The state that root points to; None without one. Of a key in several parts, the newest part counts."""
    paths = versions(spark, root)
    if not paths:
        return None
    if len(paths) == 1:
        return spark.read.parquet(paths[0])
    out = None
    for i, p in enumerate(paths):
        part = spark.read.parquet(p).withColumn("__part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    newest = out.groupBy(key).agg(F.max("__part").alias("__part"))
    return out.join(newest, [key, "__part"], "left_semi").drop("__part")


def save_state(spark: SparkSession, root: str, parameters: dict) -> None:
    """Keep the parameters that the index below root is built with."""
    snapshot(spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(parameters.items())], "name string, value string").coalesce(1), f"{root.rstrip('/')}/state")


def load_state(spark: SparkSession, root: str) -> dict | None:
    """The parameters that the index below root was built with; None if none were kept."""
    paths = versions(spark, f"{root.rstrip('/')}/state")
    return {r.name: r.value for r in spark.read.parquet(paths[-1]).collect()} if paths else None  # a row per parameter


def drop(spark: SparkSession, root: str) -> None:
    """Remove the index below root with its state."""
    fs, path = _fs(spark, root)
    fs.delete(path(root), True)


def sync(spark: SparkSession, root: str, new: DataFrame, embed, key: str = "chunk_id", parameters: dict | None = None) -> dict[str, int]:
    """Bring the index below root in step with the chunks `new`: rows unchanged keep their vector, added and
    modified ones get one from `embed` (DataFrame -> DataFrame with the column vector), deleted ones go.
    Returns the counters. With parameters, an index that was built with others is dropped and built anew
    (see `needs_rebuild`), and they are kept."""
    if parameters is not None and needs_rebuild(load_state(spark, root), {k: None if v is None else str(v) for k, v in parameters.items()}):
        drop(spark, root)
    old = current(spark, root, key)
    if old is None:
        snapshot(embed(new), root)
        counts = {"n_added": current(spark, root, key).count(), "n_modified": 0, "n_deleted": 0, "n_unchanged": 0}
    else:
        changes = materialize(diff(old, new, key), "changes")
        same = old.join(changes.where("change = 'unchanged'").select(key), key, "left_semi")
        fresh = embed(new.join(changes.where("change in ('added', 'modified')").select(key), key, "left_semi"))
        counts = diff_counts(changes).first().asDict()
        snapshot(same.unionByName(fresh), root)
        discard(changes)
    if parameters is not None:
        save_state(spark, root, parameters)
    return counts


def upsert(spark: SparkSession, root: str, rows: DataFrame, embed, key: str = "chunk_id", most_parts: int = 16) -> dict[str, int]:
    """Add or replace the rows in the index below root; others stay. Only rows that are new or differ are
    embedded and written, as a part of their own; after `most_parts` parts they are written as one again."""
    old = current(spark, root, key)
    if old is None:
        return sync(spark, root, rows, embed, key)
    near = old.join(rows.select(key), key, "left_semi")
    changes = materialize(diff(near, rows, key), "changes")
    counts = diff_counts(changes).first().asDict()
    fresh = embed(rows.join(changes.where("change in ('added', 'modified')").select(key), key, "left_semi"))
    parts = versions(spark, root)
    if len(parts) < most_parts:
        snapshot(fresh.select(*old.columns), root, parts)
    else:
        snapshot(old.join(changes.where("change in ('added', 'modified')").select(key), key, "left_anti").unionByName(fresh), root)
    discard(changes)
    return counts
