"""Incremental graph tables: Parquet in hash buckets, one list of live files per snapshot, keyed upserts as change files.

Layout below ``root``:

    data/<write>/<table>/bucket=<n>/*.parquet    what one write brought, sorted by key within a bucket
    data/<write>.json                            a snapshot: for every table and bucket the folders that make it up
    commits/<number>                             a small file that names the snapshot of that number

Nodes lie in the bucket of their id, edges in that of their source; three index tables lead from names to ids, and from
source documents and from targets to buckets of edges.  An upsert writes its rows alone; a reader merges a bucket's folders by key (the
last non-null value of a node's column, the last row of an edge), in one aggregation that combines map-side, and reads
buckets without changes as they are.  A bucket with more than ``most_changes`` changes is rewritten, no other one is.
Replaying a write changes nothing, so a stream's batch may be delivered twice.

A commit creates the next number exclusively.  If another writer was faster, the commit is repeated on top of its
snapshot: folders that both brought stay, so no writer loses rows.  Readers keep the snapshot that they started with until
``vacuum`` removes old ones.

Constraints: an id (or an edge's key) that a write brings twice fails it before anything is committed; an edge is kept
only if both its ends exist, as in a keyed MATCH.  Lookups read the files of the buckets concerned: one bucket for an id,
the buckets that the index names for a name or a document; within files Parquet's Bloom filters and sorted pages skip.

Defined cases: an empty store has no tables (``generation`` is None); null ids and blank ends are dropped by a write;
columns that a write lacks stay as they were; an edge's null year is a value of its key.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kilngraph.lineage import cut

#: Buckets of a new store: about so many rows each, within bounds; changes of a bucket before it is rewritten.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS, MOST_CHANGES = 2_000_000, 16, 4096, 8
#: How often a commit is repeated when other writers are faster.
ATTEMPTS = 50
#: The column whose hash decides on the bucket, the key, and the columns with Bloom filters, of each table.
TABLES = {
    "nodes": ("id", ("id",), ("id", "name")),
    "edges": ("src", ("src", "rel", "dst", "year"), ("src", "source_doc")),
    "names": ("name", ("name", "id"), ("name",)),
    "documents": ("source_doc", ("source_doc", "at"), ("source_doc",)),
    "targets": ("dst", ("dst", "at"), ("dst",)),
}
WRITE, ORDER = "__write", "__order"


class DuplicateKey(ValueError):
    """A write that brings a key twice."""


@dataclass
class GraphStore:
    """The graph below ``root``, a folder that driver and executors share."""

    spark: SparkSession
    root: str
    most_changes: int = MOST_CHANGES
    bucket_rows: int = BUCKET_ROWS

    def __post_init__(self):
        self.root = self.root.rstrip("/")

    # --- files ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path(".").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        if not self._fs().exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in self._fs().listStatus(self._path(folder))]

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, number: int, text: str) -> bool:
        """Create commit ``number`` unless it exists; False if it does."""
        inner = self._path(f"commits/{number:09d}").toUri()
        if self._fs().getScheme() == "file":  # Hadoop's local files know no exclusive creation
            os.makedirs(os.path.dirname(inner.getPath()), exist_ok=True)
            unready = f"{os.path.dirname(inner.getPath())}/.{uuid.uuid4().hex}"
            with open(unready, "w") as file:
                file.write(text)
            try:
                os.link(unready, inner.getPath())
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(unready)
        try:
            self._write_text(f"commits/{number:09d}", text)
            return True
        except Exception:
            if self._fs().exists(self._path(f"commits/{number:09d}")):
                return False
            raise

    # --- snapshots -----------------------------------------------------------------------------------------------

    def generation(self) -> int | None:
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=None)

    def snapshot(self, number: int | None = None) -> dict:
        """The live folders: {"buckets": n, "schemas": {table: json}, "live": {table: {bucket: [folder]}}, "orders": {write: n}}.

        A bucket's folders are in the order of their commits, which ``orders`` has by write.
        """
        number = self.generation() if number is None else number
        if number is None:
            raise FileNotFoundError(f"no graph at {self.root}")
        for _ in range(100):
            name = self._read_text(f"commits/{number:09d}")
            if name:
                return json.loads(self._read_text(f"data/{name}.json"))
            time.sleep(0.05)  # claimed, not yet written
        raise OSError(f"commit {number} is empty")

    def _commit(self, change: Callable[[dict | None, int], dict]) -> int:
        """Commit ``change`` of the newest snapshot (and the number to be), again on top of whatever others commit meanwhile."""
        for _ in range(ATTEMPTS):
            now = self.generation()
            number = 0 if now is None else now + 1
            new = change(None if now is None else self.snapshot(now), number)
            used = {f.split("/")[1] for table in new["live"].values() for folders in table.values() for f in folders}
            new["orders"] = {w: n for w, n in new["orders"].items() if w in used}
            name = uuid.uuid4().hex
            self._write_text(f"data/{name}.json", json.dumps(new))
            if self._claim(number, name):
                return number
            self._fs().delete(self._path(f"data/{name}.json"), False)
        raise OSError("other writers were always faster")

    # --- writing -------------------------------------------------------------------------------------------------

    def _bucket(self, column: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    def _put(self, table: str, rows: DataFrame, write: str, buckets: int) -> dict[str, list[str]]:
        """Write ``rows`` by bucket; the folder of each bucket that got any."""
        column, key, bloom = TABLES[table]
        rows = rows.withColumns({WRITE: F.lit(write), "bucket": self._bucket(F.col(column), buckets)})
        # Rebalancing deals a bucket that is too large to several tasks.
        writer = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *key).write.partitionBy("bucket")
        for c in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        folder = f"data/{write}/{table}"
        writer.parquet(f"{self.root}/{folder}")
        return {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("bucket=")}

    def _checked(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once and without null keys; a key that occurs twice is an error."""
        column, key, _ = TABLES[table]
        rows = cut(rows.where(F.col(column).isNotNull()))
        twice = rows.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in key]).count().where("count > 1").take(1)
        if twice:
            raise DuplicateKey(f"{table}: {tuple(twice[0][c] for c in key)} occurs {twice[0]['count']} times")
        return rows

    def _parts(self, nodes: DataFrame, edges: DataFrame, buckets: int) -> dict[str, DataFrame]:
        """The rows of all tables."""
        parts = {"nodes": nodes, "edges": edges}
        parts["names"] = nodes.where("name is not null").select("name", "id").distinct() if "name" in nodes.columns else nodes.select(F.lit("").alias("name"), "id").where("false")
        document = F.col("source_doc") if "source_doc" in edges.columns else F.lit(None).cast("string")
        parts["documents"] = edges.select(document.alias("source_doc"), self._bucket(F.col("src"), buckets).alias("at")).where("source_doc is not null").distinct()
        parts["targets"] = edges.select("dst", self._bucket(F.col("src"), buckets).alias("at")).where("dst is not null").distinct()
        return parts

    def write_full(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Replace the graph."""
        nodes, edges = self._checked("nodes", nodes), self._checked("edges", edges)
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-max(nodes.count(), edges.count()) // self.bucket_rows)))
        write, parts = uuid.uuid4().hex, self._parts(nodes, edges, buckets)
        live = {table: self._put(table, rows, write, buckets) for table, rows in parts.items()}
        schemas = {table: rows.schema.json() for table, rows in parts.items()}
        return self._commit(lambda _, number: {"buckets": buckets, "schemas": schemas, "live": live, "orders": {write: number}})

    def append(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Keyed upsert: known ids and edges are updated, new ones added; only what is given is written."""
        now = self.generation()
        if now is None:
            return self.write_full(nodes, self._with_ends(edges, nodes, None))
        old = self.snapshot(now)
        schemas = {t: StructType.fromJson(json.loads(s)) for t, s in old["schemas"].items()}
        nodes = self._checked("nodes", _shaped(nodes, schemas["nodes"]))
        edges = self._checked("edges", self._with_ends(_shaped(edges, schemas["edges"]), nodes, old))
        write = uuid.uuid4().hex
        new = {table: self._put(table, rows, write, old["buckets"]) for table, rows in self._parts(nodes, edges, old["buckets"]).items()}

        def change(last: dict, number: int) -> dict:
            if last["buckets"] != old["buckets"]:
                raise OSError("the graph was replaced meanwhile; repeat the append")
            live = {t: {b: [*last["live"][t].get(b, []), *new[t].get(b, [])] for b in {*last["live"][t], *new[t]}} for t in TABLES}
            return {**last, "live": live, "orders": {**last["orders"], write: number}}

        number = self._commit(change)
        self.compact(self.most_changes)
        return number

    def _with_ends(self, edges: DataFrame, nodes: DataFrame, snapshot: dict | None) -> DataFrame:
        """Edges whose two ends are among ``nodes`` or in the store; of the store, only the ends' buckets are read."""
        ids = nodes.select("id")
        if snapshot is not None:
            ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null")
            touched = [str(r.b) for r in ends.select(self._bucket(F.col("id"), snapshot["buckets"]).alias("b")).distinct().collect()]  # at most as many as buckets
            ids = ids.unionByName(self._scan("nodes", snapshot, touched).select("id"))
        ids = ids.distinct()
        return edges.join(ids.withColumnRenamed("id", "__id"), F.col("src") == F.col("__id"), "left_semi").join(ids.withColumnRenamed("id", "__id"), F.col("dst") == F.col("__id"), "left_semi")

    def compact(self, most_changes: int = 0) -> list[str]:
        """Rewrite buckets that more than ``most_changes`` changes follow; the table and number of each rewritten bucket."""
        old = self.snapshot()
        done = []
        for table in TABLES:
            heavy = [b for b, folders in old["live"][table].items() if len(folders) > most_changes + 1]
            if not heavy:
                continue
            write = uuid.uuid4().hex
            fresh, upto = self._put(table, self._scan(table, old, heavy), write, old["buckets"]), max(old["orders"].values())

            def change(last: dict, _: int, table=table, heavy=heavy, fresh=fresh, write=write, upto=upto) -> dict:
                live = dict(last["live"][table])
                for b in heavy:
                    had = old["live"][table][b]
                    if live.get(b, [])[: len(had)] == had:  # else someone else has rewritten it
                        live[b] = [*fresh.get(b, []), *live[b][len(had) :]]
                # It ranks as the newest of what it replaces, so whatever others bring meanwhile comes after it.
                return {**last, "live": {**last["live"], table: live}, "orders": {**last["orders"], write: upto}}

            self._commit(change)
            done += [f"{table}/{b}" for b in heavy]
        return done

    def vacuum(self, keep: int = 2) -> None:
        """Delete snapshots before the last ``keep``, and data that none of those names; to be run while no write is under way."""
        numbers = sorted(int(n) for n in self._names("commits") if n.isdigit())
        kept = numbers[-keep:]
        names = {self._read_text(f"commits/{n:09d}") for n in kept}
        used = {f.split("/")[1] for n in kept for table in self.snapshot(n)["live"].values() for folders in table.values() for f in folders}
        for n in numbers[:-keep]:
            self._fs().delete(self._path(f"commits/{n:09d}"), False)
        for name in self._names("data"):
            if name.removesuffix(".json") not in (names if name.endswith(".json") else used):
                self._fs().delete(self._path(f"data/{name}"), True)

    def dry_run(self, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
        """What a write would hold, without writing."""
        return {"nodes": nodes.count(), "edges": edges.count()}

    def delete_all(self, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("deleting the graph needs confirm=True")
        self._fs().delete(self._path("."), True)

    # --- reading -------------------------------------------------------------------------------------------------

    def _scan(self, table: str, snapshot: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        """A table, or some of its buckets: those without changes as they are, the others merged by key."""
        schema = StructType.fromJson(json.loads(snapshot["schemas"][table]))
        live = snapshot["live"][table]
        wanted = [live[b] for b in (sorted(live) if buckets is None else sorted(set(buckets) & set(live)))]
        plain, changed = [f[0] for f in wanted if len(f) == 1], [x for f in wanted if len(f) > 1 for x in f]
        read = lambda folders, schema: self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])
        parts = [read(plain, schema)] if plain else []
        if changed:
            orders = self.spark.createDataFrame(list({f.split("/")[1]: snapshot["orders"][f.split("/")[1]] for f in changed}.items()), f"{WRITE} string, {ORDER} long")
            rows = read(changed, StructType([*schema.fields, StructField(WRITE, StringType())])).join(F.broadcast(orders), WRITE)
            parts.append(_merged(rows, schema, TABLES[table][1], by_column=table == "nodes"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def nodes(self) -> DataFrame:
        return self._scan("nodes", self.snapshot())

    def edges(self) -> DataFrame:
        return self._scan("edges", self.snapshot())

    def _buckets_of(self, values: Iterable[str], snapshot: dict) -> list[str]:
        rows = self.spark.createDataFrame([(v,) for v in values], "v string")
        return [str(r.b) for r in rows.select(self._bucket(F.col("v"), snapshot["buckets"]).alias("b")).distinct().collect()]

    def nodes_with(self, ids: list[str]) -> DataFrame:
        """The nodes of ``ids``, from their buckets."""
        now = self.snapshot()
        return self._scan("nodes", now, self._buckets_of(ids, now)).where(F.col("id").isin(ids))

    def nodes_among(self, ids: DataFrame) -> DataFrame:
        """The nodes of ``ids`` (a column of ids), from their buckets."""
        now, ids = self.snapshot(), ids.toDF("wanted")
        at = [str(r.b) for r in ids.select(self._bucket(F.col("wanted"), now["buckets"]).alias("b")).distinct().collect()]
        return self._scan("nodes", now, at).join(ids, F.col("id") == F.col("wanted"), "left_semi")

    def edges_from(self, ids: list[str]) -> DataFrame:
        """The edges that leave ``ids``, from their buckets."""
        now = self.snapshot()
        return self._scan("edges", now, self._buckets_of(ids, now)).where(F.col("src").isin(ids))

    def nodes_named(self, name: str) -> DataFrame:
        """The nodes of a name, through the index of names."""
        now = self.snapshot()
        ids = self._scan("names", now, self._buckets_of([name], now)).where(F.col("name") == name).select("id")
        at = [str(r.b) for r in ids.select(self._bucket(F.col("id"), now["buckets"]).alias("b")).distinct().collect()]
        return self._scan("nodes", now, at).where(F.col("name") == name)

    def edges_of_document(self, document: str) -> DataFrame:
        """The edges that a document states, through the index of documents."""
        now = self.snapshot()
        at = self._scan("documents", now, self._buckets_of([document], now)).where(F.col("source_doc") == document).select("at").distinct()
        return self._scan("edges", now, [str(r["at"]) for r in at.collect()]).where(F.col("source_doc") == document)

    def edges_touching(self, ids: DataFrame) -> DataFrame:
        """The edges that leave or reach any of ``ids`` (a column of ids), from their buckets; other edges may be among them."""
        now, ids = self.snapshot(), ids.toDF("id")
        mine = [str(r.b) for r in ids.select(self._bucket(F.col("id"), now["buckets"]).alias("b")).distinct().collect()]
        reached = self._scan("targets", now, mine).join(ids, F.col("dst") == F.col("id"), "left_semi").select("at").distinct()
        return self._scan("edges", now, {*mine, *(str(r["at"]) for r in reached.collect())})

    def ends_of(self, edges: DataFrame) -> DataFrame:
        """The nodes at both ends of ``edges`` (few), from their buckets."""
        now = self.snapshot()
        ends = edges.select(F.explode(F.array("src", "dst")).alias("end")).distinct()
        at = [str(r.b) for r in ends.select(self._bucket(F.col("end"), now["buckets"]).alias("b")).distinct().collect()]
        return self._scan("nodes", now, at).join(ends, F.col("id") == F.col("end"), "left_semi")

    def around(self, ids: list[str]) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): ``ids``, the edges that leave them, and the nodes there."""
        edges = self.edges_from(ids)
        return self.nodes_with(ids).unionByName(self.ends_of(edges)).dropDuplicates(["id"]), edges


def _shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the columns of ``schema``; those that they lack are null."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _merged(rows: DataFrame, schema: StructType, key: tuple[str, ...], by_column: bool) -> DataFrame:
    """One row per key: the last non-null value of every column, or the last row as it is."""
    rest = [f.name for f in schema.fields if f.name not in key]
    if not rest:
        return rows.select(*key).distinct()
    if by_column:
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ORDER))).alias(c) for c in rest]
        return rows.groupBy(*key).agg(*last).select(*schema.names)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ORDER)).alias("last")).select(*key, "last.*").select(*schema.names)
