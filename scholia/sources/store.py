"""Stored tables with snapshots: parquet folders that never change, and a manifest that says which of them count.

A commit writes the rows of its tables to folders of its own, then a manifest
(a small table: one row per folder), then one pointer file. Readers start from a
pointer, so they see all of a commit or nothing of it, whatever crashes in
between; a later reader sees a later pointer and an earlier one keeps its own.
Deletes and upserts rewrite the folders that hold a touched row and leave the
others as they are.

Folders are data/<table>/p_commit=<id>/p_project=<hash>/p_slice=<n>. The slice is
a hash of the column by which a table is looked up, so a reader that knows its
projects or its keys opens only their folders. Rows are spread before writing by
a rebalance hint: adaptive execution cuts a large folder into several files.

Tables in PACKED have many rows that differ in two short columns only. Their
folders hold one row for all of these, with a list of the two; `read` and `rows`
give the single rows, `lists` what lies on disk. A delete writes the rows that
stay back to where they lay, without a shuffle. `delete_in_parts` deletes by
project and frees each old part before it writes the next.

Commits are optimistic: the pointer of a version is renamed into place, which
succeeds once, and who comes second gets a Conflict and may start again from the
new snapshot. The file system must rename atomically, as HDFS does.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from scholia.operators.catalog import CASCADE
from scholia.session import Scratch, bounded_batches, settings

SLICES = 16
#: Above so many folders a reader joins the manifest instead of naming each path.
MOST_PATHS = 20_000
#: The column that a table is looked up by, and what its rows are sorted by within a file.
LOOKUP = {
    "projects": "project_id", "documents": "document_id", "document_status": "document_id", "chunks": "document_id", "chunk_embeddings": "chunk_id", "postings": "term", "features": "dim", "index_statistics": None,
    "chat_sessions": "session_id", "chat_messages": "session_id", "message_citations": "message_id", "quizzes": "quiz_id", "quiz_questions": "quiz_id", "summaries": "summary_id", "summary_citations": "summary_id",
}
#: What a list holds of each of its rows; the table's lookup column is one of them.
PACKED = {"postings": ("term", "tf"), "features": ("dim", "weight")}
LIST = "entries"
#: So many ids of what is deleted are broadcast: at most 100 MB.
MOST_SENT = 500_000
#: Bytes of files that one task writes where they lie, few enough to be sorted in memory, and of the chunks that are brought together for it.
TASK_BYTES = "16m"
#: A delete in parts has about so many; above so many projects it is one.
PARTS, MOST_PARTED = 8, 2_000
FOLDER = ("p_commit", "p_project", "p_slice")
ENTRIES = "name string, p_commit string, p_project string, p_slice int, n long, schema string"


class Conflict(RuntimeError):
    """Another commit took the version first."""


def slice_of(value: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(slices)).cast("int")


def _project_folder(project: Column) -> Column:
    """A folder name that any project id gives; null has one of its own."""
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), project.cast("string")), F.lit("")).cast("binary"), 256), 1, 16)


def project_folders(projects: Iterable[object]) -> list[str]:
    return [hashlib.sha256((b"" if p is None else b"=" + str(p).encode())).hexdigest()[:16] for p in projects]


def packed_schema(name: str, schema: StructType) -> StructType:
    """What a folder holds of a table of this schema: in PACKED, the first of the listed columns gives way to the list."""
    listed = [f for f in schema.fields if f.name in PACKED.get(name, ())]
    out = StructType()
    for field in schema.fields:
        if field not in listed:
            out.add(field)
        elif field == listed[0]:
            out.add(LIST, ArrayType(StructType(listed)))
    return out


def unpacked(rows: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows with a list as single rows, the listed columns where the list was or in the order of columns; other rows as they are."""
    if LIST not in rows.columns:
        return rows
    listed = rows.schema[LIST].dataType.elementType.names
    names = columns or [n for c in rows.columns for n in (listed if c == LIST else [c])]
    return rows.select(*[c for c in rows.columns if c != LIST], F.inline(LIST)).select(*names)


def grouped(sizes: dict) -> list[list]:
    """Keys in groups whose sizes add up to no more than the largest size or a PARTS-th of all."""
    most = max([sum(sizes.values()) / PARTS, *sizes.values()])
    groups: list[list] = []
    left: list[float] = []
    for key in sorted(sizes, key=lambda k: -sizes[k]):
        at = next((i for i, x in enumerate(left) if x >= sizes[key]), len(groups))
        if at == len(groups):
            groups.append([])
            left.append(most)
        groups[at].append(key)
        left[at] -= sizes[key]
    return groups


@dataclass
class Snapshot:
    """What one version holds. entries: (name, p_commit, p_project, p_slice, n, schema), one row per folder; marks: numbers by name."""

    store: Store
    version: int
    entries: DataFrame
    schemas: dict[str, StructType]
    marks: dict[str, int]

    def tables(self) -> list[str]:
        return sorted(self.schemas)

    def lists(self, name: str, projects: Iterable[object] | None = None, slices: Iterable[int] | None = None) -> DataFrame:
        """What the folders of a table hold, with their folder columns; of the named projects and slices only, where given."""
        own = self.entries.filter(F.col("name") == name)
        if projects is not None:
            own = own.filter(F.col("p_project").isin(project_folders(projects)))
        if slices is not None:
            own = own.filter(F.col("p_slice").isin(list(slices)))
        schema = StructType([*packed_schema(name, self.schemas[name]).fields]).add("p_commit", "string").add("p_project", "string").add("p_slice", IntegerType())
        root = f"{self.store.root}/data/{name}"
        reader = self.store.spark.read.schema(schema).option("basePath", root)
        folders = own.select(*FOLDER).limit(MOST_PATHS + 1).collect()
        if len(folders) > MOST_PATHS:
            return reader.parquet(root).join(own.select(*FOLDER), list(FOLDER), "left_semi")
        paths = [f"{root}/p_commit={c}/p_project={p}/p_slice={s}" for c, p, s in folders]
        return reader.parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)

    def rows(self, name: str, projects: Iterable[object] | None = None, slices: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table with their folder columns."""
        return unpacked(self.lists(name, projects, slices), [*self.schemas[name].names, *FOLDER])

    def read(self, name: str, projects: Iterable[object] | None = None, slices: Iterable[int] | None = None) -> DataFrame:
        return self.rows(name, projects, slices).drop(*FOLDER)

    def holds(self, name: str) -> bool:
        return name in self.schemas


class Store:
    def __init__(self, spark: SparkSession, root: str, slices: int = SLICES):
        self.spark, self.root, self.slices = spark, root.rstrip("/"), slices

    def _path(self, path: str):
        out = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return out, out.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._path(folder)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _remove(self, path: str) -> None:
        target, files = self._path(path)
        files.delete(target, True)

    def versions(self) -> list[int]:
        """The published versions, the newest first."""
        return sorted((int(n) for n in self._names(f"{self.root}/versions") if n.isdigit()), reverse=True)

    def _commit_of(self, version: int) -> str:
        path, files = self._path(f"{self.root}/versions/{version:012d}")
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the named one; an empty store has version 0."""
        known = [v for v in self.versions() if version is None or v == version]
        if not known:
            if version:
                raise LookupError(f"no version {version}")
            return Snapshot(self, 0, self.spark.createDataFrame([], ENTRIES), {}, {})
        entries = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/manifests/{self._commit_of(known[0])}")
        heads = entries.filter("p_slice IS NULL").collect()  # one row per table and mark
        schemas = {r["name"]: StructType.fromJson(json.loads(r["schema"])) for r in heads if r["schema"]}
        return Snapshot(self, known[0], entries.filter("p_slice IS NOT NULL"), schemas, {r["name"]: r["n"] for r in heads if not r["schema"]})

    def _placed(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows as their folders hold them, with the columns p_project and p_slice; a list is cut by the slices of what it lists."""
        key = LOOKUP.get(name)
        project = _project_folder(F.col("project_id")) if "project_id" in rows.columns else F.lit("all")
        if LIST in rows.columns:
            # The slices of a list are counted once, under the explode, through which no expression is carried.
            marked = rows.withColumn(LIST, F.transform(LIST, lambda e: F.struct(slice_of(e[key], self.slices).alias("at"), e.alias("e"))))
            each = marked.withColumn("p_slice", F.explode(F.lit(list(range(self.slices))))).filter(F.exists(LIST, lambda x: x["at"] == F.col("p_slice")))
            own = F.transform(F.filter(LIST, lambda x: x["at"] == F.col("p_slice")), lambda x: x["e"])
            return each.withColumns({LIST: own, "p_project": project})
        placed = rows.withColumns({"p_project": project, "p_slice": slice_of(F.col(key), self.slices) if key else F.lit(0)})
        held = packed_schema(name, rows.schema)
        if LIST in held.names:
            listed = held[LIST].dataType.elementType.names
            placed = placed.withColumn(LIST, F.array(F.struct(*listed))).select(*held.names, "p_project", "p_slice")
        return placed

    def _write(self, name: str, rows: DataFrame, commit: str, lying: bool = False) -> DataFrame:
        """Write the rows of one table; the entries of their folders. Rows with p_project and p_slice keep them; of lying rows each task writes what it reads."""
        placed = rows if "p_slice" in rows.columns else self._placed(name, rows)
        key = LOOKUP.get(name)
        if not lying:
            placed = placed.hint("rebalance", "p_project", "p_slice")
        ordered = placed.sortWithinPartitions("p_project", "p_slice", *([key] if key in placed.columns else []))
        target = f"{self.root}/data/{name}/p_commit={commit}"
        conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.files.maxPartitionBytes": TASK_BYTES} if lying else {})
        with bounded_batches(self.spark), settings(self.spark, conf):
            ordered.write.mode("overwrite").partitionBy("p_project", "p_slice").option("compression", "zstd").parquet(target)
        schema = StructType([f for f in placed.schema.fields if f.name not in FOLDER]).add("p_project", "string").add("p_slice", IntegerType())
        n = F.sum(F.size(LIST)).alias("n") if LIST in schema.names else F.count("*").alias("n")
        counts = self.spark.read.schema(schema).parquet(target).groupBy("p_project", "p_slice").agg(n)
        return counts.select(F.lit(name).alias("name"), F.lit(commit).alias("p_commit"), "p_project", "p_slice", "n", F.lit(None).cast("string").alias("schema"))

    def _write_manifest(self, entries: DataFrame, commit: str) -> None:
        entries.write.parquet(f"{self.root}/manifests/{commit}")

    def _publish(self, version: int, commit: str) -> None:
        """Make the version visible: a pointer written aside, then renamed to a name that must not exist."""
        aside, files = self._path(f"{self.root}/aside/{commit}")
        stream = files.create(aside, False)
        stream.write(bytearray(commit.encode()))
        stream.close()
        pointer, _ = self._path(f"{self.root}/versions/{version:012d}")
        files.mkdirs(pointer.getParent())
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        never[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), hadoop).rename(files.makeQualified(aside), files.makeQualified(pointer), never)
        except Exception as error:
            if files.exists(pointer):
                raise Conflict(f"version {version} is taken") from error
            raise

    def _written(self, name: str, schema: StructType, commit: str) -> DataFrame:
        """What a commit under way has written of a table, as it lies on disk."""
        held = StructType([*packed_schema(name, schema).fields]).add("p_project", "string").add("p_slice", IntegerType())
        return self.spark.read.schema(held).parquet(f"{self.root}/data/{name}/p_commit={commit}").drop(*FOLDER)

    def commit(self, base: Snapshot, add: dict[str, DataFrame | Callable] | None = None, drop: DataFrame | None = None, marks: dict[str, int] | None = None, lying: Iterable[str] = ()) -> Snapshot:
        """A new version: the base without the folders in drop (name, p_commit, p_project, p_slice) and with the rows in add.

        marks are numbers kept beside the tables, such as the last batch of a
        stream. Rows of `add` may come from the base itself; with the columns
        p_project and p_slice they go back to the folders of these. Rows of a
        table in PACKED may come as lists. The tables named in lying are written
        without a shuffle, so each of their partitions should have few projects.
        Instead of rows, `add` may have a function: it gets one that reads by name
        what this commit has written of the tables named before, and gives the rows.
        """
        commit = uuid.uuid4().hex
        schemas = dict(base.schemas)
        parts = [base.entries if drop is None else base.entries.join(drop.select("name", *FOLDER), ["name", *FOLDER], "left_anti").select(*base.entries.columns)]
        for name, rows in (add or {}).items():
            if callable(rows):
                with settings(self.spark, {"spark.sql.files.maxPartitionBytes": TASK_BYTES}):
                    rows = rows(lambda table: self._written(table, schemas[table], commit))
            # What was read as not null may be null later, and the other way round.
            schema = unpacked(rows).drop(*FOLDER).schema
            schemas[name] = StructType.fromJson(json.loads(schema.json().replace('"nullable":false', '"nullable":true')))
            parts.append(self._write(name, rows, commit, name in lying))
        marks = {**base.marks, **(marks or {})}
        heads = [(n, "", "", None, 0, s.json()) for n, s in schemas.items()] + [(n, "", "", None, v, None) for n, v in marks.items()]
        everything = parts[0]
        for part in [*parts[1:], self.spark.createDataFrame(heads, ENTRIES)]:
            everything = everything.unionByName(part)
        self._write_manifest(everything, commit)
        self._publish(base.version + 1, commit)
        return self.snapshot(base.version + 1)

    def _touched(self, snapshot: Snapshot, name: str, keys: DataFrame, projects: Iterable[object] | None) -> DataFrame:
        """The folders of a table that hold a row of keys; only the key columns are read."""
        key = keys.columns[0]
        rows = snapshot.rows(name, projects).select(key, *FOLDER)
        return rows.join(keys, key, "left_semi").select(F.lit(name).alias("name"), *FOLDER).distinct()

    def upsert(self, base: Snapshot, name: str, rows: DataFrame, key: str) -> Snapshot:
        """Rows replace those of the same key; folders without such a key stay as they are. Rows are one per key."""
        scratch = Scratch(self.spark, "upsert")
        fresh = scratch.write(rows, "rows")
        if not base.holds(name):
            out = self.commit(base, {name: fresh})
        else:
            touched = scratch.write(self._touched(base, name, fresh.select(key), None), "touched")
            kept = base.rows(name).join(touched.select(*FOLDER), list(FOLDER), "left_semi").drop(*FOLDER).join(fresh.select(key), key, "left_anti")
            out = self.commit(base, {name: kept.select(*fresh.columns).unionByName(fresh)}, touched)
        scratch.drop()
        return out

    def delete(self, base: Snapshot, table: str, ids: DataFrame, projects: Iterable[object] | None = None) -> tuple[Snapshot, dict[str, int], DataFrame]:
        """(snapshot, rows deleted by table, deleted documents): the rows of ids, and all that hangs from them by CASCADE.

        projects, where known, are the only ones looked into. The documents'
        stored_path is what remove_uploads takes.
        """
        scratch = Scratch(self.spark, "delete")
        key = ids.columns[0]
        links = {table: [key]}
        for child, own, _, link in CASCADE:
            links.setdefault(child, [own])
            if link not in links[child]:
                links[child].append(link)
        doomed = {table: scratch.write(ids.select(key).distinct(), f"doomed-{table}")}
        n_doomed = {table: doomed[table].count()}
        add, drops, gone = {}, [], {}

        def sent(rows: DataFrame, source: str) -> DataFrame:
            return F.broadcast(rows) if n_doomed[source] <= MOST_SENT else rows

        for name, by, parent, link in [(table, key, table, key), *CASCADE]:
            if parent not in doomed or not base.holds(name) or (name == table and by != key):
                continue
            if name in gone or link not in doomed[parent].columns:
                continue
            lost = sent(doomed[parent].select(link).distinct(), parent)
            rows = base.lists(name, projects if "project_id" in base.schemas[name].names else None)
            hit = rows.join(lost, link, "left_semi")
            wanted = [c for c in dict.fromkeys([by, link, "document_id", "chunk_id", "project_id", "stored_path"]) if c in base.schemas[name].names]
            sizes = [F.size(LIST).alias("n_listed")] if LIST in rows.columns else []
            own = scratch.write(hit.select(*wanted, *FOLDER, *sizes), f"gone-{name}")
            doomed[name] = own
            n_doomed[name] = own.count()
            gone[name] = int(own.agg(F.sum("n_listed")).first()[0] or 0) if sizes else n_doomed[name]
            if not gone[name]:
                continue
            touched = own.select(F.lit(name).alias("name"), *FOLDER).distinct()
            drops.append(touched)
            add[name] = rows.join(sent(touched.select(*FOLDER), name), list(FOLDER), "left_semi").join(lost, link, "left_anti").select(*packed_schema(name, base.schemas[name]).names, "p_project", "p_slice")
        if gone.get("chunks") and base.holds("index_statistics"):
            # Statistics are sums: what is deleted is added with a minus.
            counts = doomed["chunks"].groupBy("project_id").agg(F.count("*").alias("n"))
            words = base.lists("postings", projects).join(sent(doomed["chunks"].select("chunk_id"), "chunks"), "chunk_id", "left_semi").select("project_id", F.inline(LIST)).groupBy("project_id").agg(F.sum("tf").alias("words"))
            versions = base.read("index_statistics").groupBy("project_id").agg(F.max("analyzer_version").alias("analyzer_version"))
            minus = counts.join(words.withColumnRenamed("project_id", "other"), F.col("project_id").eqNullSafe(F.col("other")), "left").drop("other")
            minus = minus.join(versions.withColumnRenamed("project_id", "other"), F.col("project_id").eqNullSafe(F.col("other")), "left")
            add["index_statistics"] = minus.select("project_id", (-F.col("n")).alias("n"), (-F.coalesce("words", F.lit(0))).cast("long").alias("words"), "analyzer_version")
        documents = doomed.get("documents") if gone.get("documents") else None
        drop = None
        for touched in drops:
            drop = touched if drop is None else drop.unionByName(touched)
        out = self.commit(base, add, drop, lying=[name for name in add if name in gone and max(n_doomed.values()) <= MOST_SENT]) if add else base
        scratch.keep("gone-documents")
        return out, gone, documents

    def delete_in_parts(self, base: Snapshot, table: str, ids: DataFrame) -> tuple[Snapshot, dict[str, int], DataFrame | None]:
        """What delete does, project by project (small ones together), each part with its version; what only older versions read goes in between.

        So the disk holds one part twice, not the whole store. Each version is a
        whole one, and after a crash the same call deletes the rest. Older
        snapshots, `base` too, can't be read any more.
        """
        key, scratch = ids.columns[0], Scratch(self.spark, "parts")
        groups: list[list | None] = [None]
        hit = ids
        if base.holds(table) and "project_id" in base.schemas[table].names:
            hit = scratch.write(base.read(table).join(ids.select(key).distinct(), key, "left_semi").select(*dict.fromkeys([key, "project_id"])), "hit")
            projects = [r[0] for r in hit.select("project_id").distinct().limit(MOST_PARTED + 1).collect()]
            if 0 < len(projects) <= MOST_PARTED:
                folders = dict(zip(projects, project_folders(projects), strict=True))
                sizes = dict(base.entries.filter(F.col("p_project").isin([*folders.values()])).groupBy("p_project").agg(F.sum("n")).collect())
                groups = grouped({p: sizes[f] for p, f in folders.items()})
        now, gone, documents = base, {}, None
        for group in groups:
            own = hit
            if group is not None:
                own = hit.filter(F.col("project_id").isin([p for p in group if p is not None]) | (F.col("project_id").isNull() if None in group else F.lit(False)))
            after, counts, part = self.delete(now, table, own.select(key), group)
            gone = {name: gone.get(name, 0) + counts.get(name, 0) for name in {**gone, **counts}}
            if part is not None:
                documents = part if documents is None else documents.unionByName(part)
            if after.version != now.version:
                self.vacuum()
            now = after
        scratch.drop()
        return now, gone, documents

    def remove_uploads(self, documents: DataFrame) -> int:
        """Delete the upload files of deleted documents (stored_path), after their delete was published; how many there were.

        Paths come to the driver partition by partition, never all at once.
        """
        n = 0
        for row in documents.select("stored_path").filter("stored_path IS NOT NULL").distinct().toLocalIterator():
            path, files = self._path(row["stored_path"])
            n += bool(files.delete(path, False))
        return n

    def compact(self, base: Snapshot, name: str, most: int = 1) -> Snapshot:
        """Rewrite the projects' slices that lie in more than `most` folders as one folder each."""
        own = base.entries.filter(F.col("name") == name)
        many = own.groupBy("p_project", "p_slice").agg(F.count("*").alias("folders")).filter(F.col("folders") > most).select("p_project", "p_slice")
        touched = own.join(many, ["p_project", "p_slice"], "left_semi").select("name", *FOLDER)
        if touched.isEmpty():
            return base
        rows = base.lists(name).join(touched.select(*FOLDER), list(FOLDER), "left_semi").drop("p_commit")
        return self.commit(base, {name: rows.select(*packed_schema(name, base.schemas[name]).names, "p_project", "p_slice")}, touched)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the commits, and the folders of commits, that none of the newest `keep` versions reads, and what crashed commits left; returns them.

        Not while a commit is under way: its folders are not in any version yet.
        """
        versions = self.versions()
        kept = {v: self._commit_of(v) for v in versions[:keep]}
        live = {f"p_commit={commit}" for commit in kept.values()}
        read: dict[str, set[str]] = {}  # by project's folder, the slices that are read
        for version in kept:
            for r in self.snapshot(version).entries.select("name", *FOLDER).toLocalIterator():
                live.add(f"p_commit={r['p_commit']}")
                read.setdefault(f"{r['name']}/p_commit={r['p_commit']}/p_project={r['p_project']}", set()).add(f"p_slice={r['p_slice']}")
        dead = []

        def drop(path: str) -> None:
            self._remove(f"{self.root}/data/{path}")
            dead.append(path)

        for table in self._names(f"{self.root}/data"):
            for folder in self._names(f"{self.root}/data/{table}"):
                if folder not in live:
                    drop(f"{table}/{folder}")
                    continue
                for project in (f"{table}/{folder}/{p}" for p in self._names(f"{self.root}/data/{table}/{folder}") if p.startswith("p_project=")):
                    if project not in read:
                        drop(project)
                        continue
                    for at in self._names(f"{self.root}/data/{project}"):
                        if at.startswith("p_slice=") and at not in read[project]:
                            drop(f"{project}/{at}")
        for version in versions[keep:]:
            self._remove(f"{self.root}/versions/{version:012d}")
        for commit in self._names(f"{self.root}/manifests"):
            if commit not in kept.values():
                self._remove(f"{self.root}/manifests/{commit}")
        self._remove(f"{self.root}/aside")
        return sorted(dead)
