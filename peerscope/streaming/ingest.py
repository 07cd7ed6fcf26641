"""Online ingest: a stream of flows kept in a layout of tree leaves that split as they grow.

Each micro-batch is routed by the current tree and appended, one folder per leaf, and so is a sample of its
points. A leaf that has grown over the split size is split by its sample and rewritten as two; one that has
come to lie in many folders is rewritten as one. What belongs to the table says a manifest: the tree, and for
each leaf its row count and folders. A new manifest is written beside the old one and renamed into place, so
readers see the table before or after a batch, never between; it names the last batch, so a batch that is
replayed after a restart changes nothing. Manifests and folders that only old versions name are deleted later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from peerscope.functions.ip import int_to_ip, is_ipv4
from peerscope.operators import layout
from peerscope.operators.kdtree import KdTree
from peerscope.sources.views import VIEWS, names_in, view
from peerscope.staging import work_folder

#: The share of a leaf's points that is kept as its sample, and how many of them a split is decided by, at most.
SAMPLE_SHARE, SPLIT_POINTS = 0.05, 50_000
#: Folders of a leaf beyond which it is rewritten as one, and versions of the table that stay readable.
MOST_FOLDERS, VERSIONS = 8, 10


@dataclass
class Manifest:
    tree: KdTree
    version: int = 0
    batch: int = -1
    rows: dict[int, int] = field(default_factory=dict)
    folders: dict[int, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"tree": self.tree.to_json(), "version": self.version, "batch": self.batch, "rows": self.rows, "folders": self.folders})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(KdTree.from_json(x["tree"]), x["version"], x["batch"], {int(k): v for k, v in x["rows"].items()}, {int(k): v for k, v in x["folders"].items()})


class LeafTable:
    """A table of tree leaves in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, tree: KdTree | None = None, split_rows: int = 1_000_000, columns: tuple[str, ...] = layout.TREE_COLUMNS):
        self.spark, self.path, self.split_rows, self.columns = spark, path.rstrip("/"), split_rows, columns
        self.first_tree = tree or KdTree(len(columns), split_rows)

    # -- manifest -------------------------------------------------------------------------------

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The newest manifest, or an empty table's."""
        folder, files = self._files()
        if not files.exists(folder):
            return Manifest(KdTree.from_json(self.first_tree.to_json()))
        names = sorted(x.getPath().getName() for x in files.listStatus(folder) if x.getPath().getName().startswith("v"))
        if not names:
            return Manifest(KdTree.from_json(self.first_tree.to_json()))
        return self._read(names[-1])

    def _read(self, name: str) -> Manifest:
        stream = self._files()[1].open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{name}"))
        try:
            return Manifest.from_json(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: Manifest) -> None:
        folder, files = self._files()
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        temporary = at(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = files.create(temporary)
        try:
            out.write(bytearray(manifest.to_json().encode()))
        finally:
            out.close()
        if not files.rename(temporary, at(f"{self.path}/manifest/v{manifest.version:012d}")):
            raise RuntimeError("another writer has published this version")

    # -- writing --------------------------------------------------------------------------------

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; one that the manifest already names is left out."""
        now = self.manifest()
        if batch_id <= now.batch:
            return
        counts = self._write(batch, now.tree, f"batch-{batch_id}")
        for leaf, rows in counts.items():
            now.rows[leaf] = now.rows.get(leaf, 0) + rows
            now.folders.setdefault(leaf, []).append(f"batch-{batch_id}")
        waiting = [x for x in now.rows if now.rows[x] >= self.split_rows]
        while waiting:
            waiting += self._split(now, waiting.pop(), batch_id)
        for leaf in [x for x in now.folders if len(now.folders[x]) > MOST_FOLDERS]:
            folder = f"joined-{leaf}-{batch_id}"
            self._write(self._leaf_rows(now, leaf), now.tree, folder)
            now.folders[leaf] = [folder]
        now.version, now.batch = now.version + 1, batch_id
        self.publish(now)
        if now.version % VERSIONS == 0:
            self.expire()

    def expire(self, versions: int = VERSIONS) -> None:
        """Delete all but the newest manifests, and the leaf folders that none of these names."""
        folder, files = self._files()
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted(x.getPath().getName() for x in files.listStatus(folder) if x.getPath().getName().startswith("v"))
        held = [self._read(x) for x in names[-versions:]]
        for name in names[:-versions]:
            files.delete(at(f"{self.path}/manifest/{name}"), False)
        used = {(x, leaf) for manifest in held for leaf, own in manifest.folders.items() for x in own}
        for kind in ("data", "sample"):
            root = at(f"{self.path}/{kind}")
            for batch in files.listStatus(root) if files.exists(root) else []:
                parts = [x.getPath() for x in files.listStatus(batch.getPath()) if x.getPath().getName().startswith("part=")]
                gone = [x for x in parts if (batch.getPath().getName(), int(x.getName()[5:])) not in used]
                for path in [batch.getPath()] if len(gone) == len(parts) else gone:
                    files.delete(path, True)

    def _write(self, rows: DataFrame, tree: KdTree, folder: str) -> dict[int, int]:
        tagged = layout.with_leaf(rows, tree, self.columns).withColumn("leaf", F.col("part"))
        path = f"{self.path}/data/{folder}"
        tagged.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)
        written = self.spark.read.schema(tagged.schema).parquet(path)
        points = layout.sampled(written, SAMPLE_SHARE, self.columns).select(*self.columns, "part")
        points.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/sample/{folder}")
        return {r["part"]: r["count"] for r in written.groupBy("part").count().collect()}

    def _split(self, now: Manifest, leaf: int, batch_id: int) -> list[int]:
        """Rewrite a leaf as two; the children that are still too large. A leaf of equal points stays."""
        own = self._leaf_rows(now, leaf)
        points = self._sample(now, leaf)
        if len(points) < 2 or (points == points[0]).all():  # too few were kept of a small leaf
            points = layout.sampled_points(own, self.columns, SPLIT_POINTS)
        children = now.tree.split(leaf, points) if len(points) > 1 else None
        if children is None:
            return []
        folder = f"split-{leaf}-{batch_id}"
        counts = self._write(own, now.tree, folder)
        del now.rows[leaf], now.folders[leaf]
        for child in children:
            if counts.get(child):
                now.rows[child], now.folders[child] = counts[child], [folder]
        return [x for x in children if now.rows.get(x, 0) >= self.split_rows]

    def _sample(self, now: Manifest, leaf: int) -> np.ndarray:
        """The kept points of a leaf."""
        _, files = self._files()
        paths = [f"{self.path}/sample/{x}/part={leaf}" for x in now.folders[leaf]]
        paths = [x for x in paths if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x))]
        if not paths:
            return np.zeros((0, len(self.columns)))
        return layout.sampled_points(self.spark.read.parquet(*paths), self.columns, SPLIT_POINTS)

    # -- reading --------------------------------------------------------------------------------

    def _leaf_rows(self, now: Manifest, leaf: int) -> DataFrame:
        paths = [f"{self.path}/data/{x}/part={leaf}" for x in now.folders[leaf]]
        return self.spark.read.parquet(*paths).drop("leaf")

    def read(self, box: layout.Box | None = None) -> DataFrame | None:
        """All rows with their ``part``, or those of a box from the leaves that meet it; None for an empty table."""
        now = self.manifest()
        wanted = set(now.rows) if box is None else set(now.rows) & set(now.tree.boxed(*box.limits(self.columns)))
        paths = [f"{self.path}/data/{x}/part={leaf}" for leaf in sorted(wanted) for x in now.folders[leaf]]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths).withColumnRenamed("leaf", "part")
        return rows if box is None else rows.where(box.condition())

    def mapping(self) -> list[tuple[int, int, list[str]]]:
        """Leaf, rows and folders, by leaf."""
        now = self.manifest()
        return [(leaf, now.rows[leaf], list(now.folders[leaf])) for leaf in sorted(now.rows)]

    def drop(self, leaf: int) -> None:
        """Take a leaf's rows out of the table; its files stay for readers of an older manifest."""
        now = self.manifest()
        if leaf in now.rows:
            del now.rows[leaf], now.folders[leaf]
            now.version += 1
            self.publish(now)

    def start(self, flows: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Ingest a stream of flows."""
        query = flows.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


class Throughput(StreamingQueryListener):
    """Rows and rows per second of each batch."""

    def __init__(self):
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def kafka_flows(spark: SparkSession, servers: str, topic: str = "sflows") -> DataFrame:
    """Flow lines from Kafka; needs the connector on Spark's class path."""
    records = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parsed(records.select(F.col("value").cast("string").alias("value")))


def parsed(text: DataFrame) -> DataFrame:
    """Flow records from space-separated lines in ``value``; other lines are dropped."""
    kinds = [("ipfrom", "string"), ("intipfrom", "bigint"), ("ipto", "string"), ("intipto", "bigint"), ("protocol", "int"), ("srcport", "int"), ("dstport", "int"), ("ipsize", "bigint"), ("flow_date", "date")]
    parts = F.split(F.col("value"), " ")
    rows = text.select(*(F.get(parts, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)))
    return rows.where(is_ipv4(F.col("ipfrom")) & is_ipv4(F.col("ipto")))


def generated_flows(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A stream of made-up flows at that rate, for load tests."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    address = lambda k: F.pmod(F.xxhash64("value", F.lit(k)), F.lit(1 << 32))
    number = lambda k, below: F.pmod(F.xxhash64("value", F.lit(k)), F.lit(below)).cast("int")
    made = ticks.select(address(1).alias("intipfrom"), address(2).alias("intipto"), F.when(number(3, 3) == 0, 17).otherwise(6).alias("protocol"), number(4, 65536).alias("srcport"), number(5, 1024).alias("dstport"), (number(6, 1460) + 40).cast("long").alias("ipsize"), F.to_date("timestamp").alias("flow_date"))
    return made.select(int_to_ip(F.col("intipfrom")).alias("ipfrom"), "intipfrom", int_to_ip(F.col("intipto")).alias("ipto"), "intipto", "protocol", "srcport", "dstport", "ipsize", "flow_date")


def lines(flows: DataFrame) -> DataFrame:
    """Flows as space-separated text in ``value``."""
    return flows.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in flows.columns)).alias("value"))


def write_lines(flows: DataFrame, path: str) -> None:
    lines(flows).write.mode("overwrite").text(path)


def write_file(frame: DataFrame, path: str) -> None:
    """A small frame as one quoted text file of that very name."""
    frame.coalesce(1).write.mode("overwrite").option("quoteAll", "true").csv(f"{path}.parts")
    at = frame.sparkSession._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(frame.sparkSession._jsc.hadoopConfiguration())
    for part in files.globStatus(at(f"{path}.parts/part-*")):
        files.rename(part.getPath(), at(path))
    files.delete(at(f"{path}.parts"), True)


def replay_files(flows: DataFrame, path: str, files: int) -> None:
    """Flow lines as text files, a source that a stream reads file by file."""
    lines(flows).repartition(files).write.mode("overwrite").text(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, a file or a folder, as a stream; a pattern lets the source take a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(query: StreamingQuery) -> None:
    query.awaitTermination()


def replayed(spark: SparkSession, sf_dir: str, tree: KdTree) -> DataFrame:
    """Flows and bytes per leaf after ingesting the flows as a stream into a new table with that tree."""
    path = work_folder(spark, "stream")
    sql = VIEWS["flows"]
    flows = spark.sql(sql, **{x: table_stream(spark, sf_dir, x) for x in names_in(sql)})
    table = LeafTable(spark, path, tree, split_rows=1 << 40)
    drained(table.start(flows, f"{path}/checkpoint"))
    rows = table.read()
    if rows is None:
        return spark.createDataFrame([], "part bigint, n bigint, bytes bigint")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"))


def grown(spark: SparkSession, sf_dir: str, files: int = 4, leaves: int = 5) -> DataFrame:
    """Flows and bytes per year of a table that grew from one leaf while its flows came file by file.

    ``split``: several leaves came out of as many batches as files; ``within``: no leaf has reached the split size;
    ``routed``: every row lies in the leaf that the table's tree gives it.
    """
    path, flows = work_folder(spark, "grown"), view(spark, sf_dir, "flows")
    replay_files(flows, f"{path}/in", files)
    table = LeafTable(spark, f"{path}/table", split_rows=max(2, flows.count() // leaves))
    drained(table.start(parsed(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{path}/in")), f"{path}/checkpoint"))
    now, rows = table.manifest(), table.read()
    if rows is None:
        return spark.createDataFrame([], "year int, n bigint, bytes bigint, split boolean, within boolean, routed boolean")
    split = now.batch == files - 1 and len(now.tree.leaves()) > 1
    within = all(x < table.split_rows for x in now.rows.values())
    found = layout.with_leaf(rows.withColumnRenamed("part", "own"), now.tree)
    totals = found.groupBy(F.year("flow_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("ipsize").cast("bigint").alias("bytes"), F.bool_and(F.col("own") == F.col("part")).alias("routed"))
    return totals.select("year", "n", "bytes", F.lit(split).alias("split"), F.lit(within).alias("within"), "routed")


def to_files(frame: DataFrame, name: str) -> DataFrame:
    """What a stream appends over what is there now, as a table of files."""
    path = work_folder(frame.sparkSession, name)
    sink = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    drained(sink.outputMode("append").trigger(availableNow=True).start())
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def hourly(events: DataFrame) -> DataFrame:
    """Events and the sum of their values per hour and type, of a stream with ``ts``.

    An hour is given out once, when the watermark has passed its end, and its state is dropped; events that come
    later than that are left out.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    found = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` over the events table: the hours that are closed an hour before its last event."""
    return to_files(hourly(table_stream(spark, sf_dir, "events")), "windows")


def exclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type with an exclamation mark, and how often it came."""
    marked = table_stream(spark, sf_dir, "events").select(F.concat("event_type", F.lit("!")).alias("marked"))
    return to_files(marked, "marked").groupBy("marked").agg(F.count(F.lit(1)).alias("n"))
