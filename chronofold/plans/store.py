"""Belief stores: immutable parquet files and one manifest per commit.

`<root>/_commits/<n>.json` is created only if absent (atomically), and holds the revision, the files and
the cursors of all streams, so data and cursors are published together. Readers follow manifests; files
of a failed commit are never seen. Paths go through the Hadoop file system, so any store Spark reads works;
object stores need one whose create without overwrite is atomic.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.errors import CommitConflict, ConstraintError, StalePlanError
from chronofold.functions.offsets import offset_ord
from chronofold.plans import fold as folding
from chronofold.plans.events import KEYS


@dataclass
class Head:
    n: int = 0
    revision: int = 0
    last_tx: int = 0
    cursors: dict[str, str] = field(default_factory=dict)
    files: list[list[str]] = field(default_factory=list)
    folded: str | None = None


class BeliefStore:
    def __init__(self, spark: SparkSession, root: str, graph=None, history: bool = True, parent: "BeliefStore | None" = None, unique: bool = True):
        self.spark, self.root, self.history, self.parent = spark, root.rstrip("/"), history, parent
        self.graph, self.unique = graph, unique
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))

    def require_history(self) -> None:
        if not self.history:
            raise ConstraintError("the store keeps no history")

    def _commit_path(self, n: int):
        return self._path(f"{self.root}/_commits/{n:012d}.json")

    def _read(self, n: int) -> dict:
        stream = self._fs.open(self._commit_path(n))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def head(self) -> Head:
        """The last commit; O(1) manifests are read."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_commits"))]
        done = [int(x[:12]) for x in names if x.endswith(".json")]
        if not done:
            return Head()
        m = self._read(max(done))
        return Head(m["n"], m["revision"], m["last_tx"], m["cursors"], m["files"], m.get("folded"))

    def _publish_manifest(self, manifest: dict) -> None:
        path = self._commit_path(manifest["n"])
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise CommitConflict(f"commit {manifest['n']} exists") from e
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write rows beside the published files; they count for nothing until a manifest names them."""
        path = f"{self.root}/staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, parent: Head, events: DataFrame, revisions: DataFrame, points: DataFrame, cursors: dict[str, str], revision: int, last_tx: int) -> Head:
        """One commit on top of `parent`; refused if another writer was first."""
        n = parent.n + 1
        base = f"{self.root}/data/{n:012d}-{uuid.uuid4().hex}"
        for name, df in (("events", events), ("revisions", revisions), ("points", points)):
            df.write.parquet(f"{base}/{name}")
        return self._publish(Head(n, revision, last_tx, cursors, [*parent.files, [base]], parent.folded), parent.n)

    def _publish(self, head: Head, parent: int) -> Head:
        self._publish_manifest({"n": head.n, "parent": parent, "revision": head.revision, "last_tx": head.last_tx, "cursors": head.cursors, "files": head.files, "folded": head.folded})
        return head

    def compact(self) -> Head:
        """A commit that holds the same in fewer files: events, revisions and checkpoints as one set, and the folded
        versions by ranges of their keys, so that files of other keys are skipped. Later reads fold only the keys
        that have later events. Old files stay for branches and readers that name them."""
        head = self.head()
        if not head.files:
            return head
        base = f"{self.root}/data/{head.n + 1:012d}-{uuid.uuid4().hex}"
        order = ["kind", "id", "from_kind", "from_id", "tx_from"]
        self.versions().repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{base}/versions")
        for name in ("events", "revisions", "points"):
            self._table(name).hint("rebalance").write.parquet(f"{base}/{name}")
        return self._publish(Head(head.n + 1, head.revision, head.last_tx, head.cursors, [[base]], base), head.n)

    def _table(self, name: str, files: list[list[str]] | None = None) -> DataFrame | None:
        files = [f"{f[0]}/{name}" for f in (self.head().files if files is None else files)]
        return self.spark.read.parquet(*files) if files else None

    def events(self) -> DataFrame | None:
        return self._table("events")

    def versions(self) -> DataFrame:
        """All versions: those of the last `compact`, and the fold of every key that has events after it."""
        head = self.head()
        if head.folded is None:
            return folding.fold(self.events())
        done = self.spark.read.parquet(f"{head.folded}/versions")
        later = self._table("events", head.files[1:])
        if later is None:
            return done
        touched = later.select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
        events = self._table("events", head.files[:1]).join(touched, same, "left_semi").unionByName(later)
        return done.join(touched, same, "left_anti").unionByName(folding.fold(events).select(*done.columns))

    def revisions(self) -> DataFrame | None:
        return self._table("revisions")

    def checkpoints(self) -> DataFrame | None:
        return self._table("points")

    def recorded_now(self) -> int:
        return self.head().revision

    def branch(self, root: str, enforce_unique: bool = True) -> "BeliefStore":
        """A store of its own that starts from this one's files; writes do not leak back. Without
        `enforce_unique` it may hold values twice that should be unique; all other rules stay."""
        copy = BeliefStore(self.spark, root, self.graph, self.history, self, enforce_unique)
        h = self.head()
        if h.n:
            copy._publish_manifest({"n": 1, "parent": 0, "revision": h.revision, "last_tx": h.last_tx, "cursors": {}, "files": h.files, "folded": h.folded})
        return copy

    def export(self, path: str) -> None:
        """Current rows, nodes before edges, ids and windows kept, deleted rows left out."""
        live = self.versions().filter("tx_to is null and not deleted")
        live.filter("id is not null").write.parquet(f"{path}/nodes")
        live.filter("from_id is not null").write.parquet(f"{path}/edges")

    def add(self, events: DataFrame) -> Head:
        """Commit ready events (without tx) as one transaction, under the store's rules."""
        head = self.head()
        tx = head.last_tx + 1
        rows = events.withColumn("tx", F.lit(tx).cast("long"))
        check_commit(self, rows, head.last_tx)
        revisions = self.spark.createDataFrame([(tx, head.revision + 1, True)], "tx long, revision long, captured boolean")
        points = self.spark.createDataFrame([], "stream string, offset string, revision long, tx long")
        return self.publish(head, rows, revisions, points, head.cursors, head.revision + 1, tx)

    def load(self, path: str) -> Head:
        """Import an export: its rows are upserted with their ids and windows, nodes before edges; a row that is
        here already is updated."""
        rows = self.spark.read.parquet(f"{path}/nodes").unionByName(self.spark.read.parquet(f"{path}/edges"))
        node = F.col("id").isNotNull()
        keys = ("kind", "id", "from_kind", "from_id", "to_kind", "to_id")
        return self.add(rows.select(
            F.lit(0).cast("long").alias("change_ix"), F.col("tx_wall"), F.when(node, 0).otherwise(1).cast("int").alias("event_ix"),
            F.when(node, "node.upsert").otherwise("edge.upsert").alias("op"), *keys, "props", "valid_from", "valid_to", F.col("valid_to").isNull().alias("clear_valid_to"),
        ))

    def create(self, kind: str, id: str, props: dict, at) -> Head:
        """One node, as a transaction of its own at the instant `at`."""
        import json as js

        from chronofold.plans.events import FIELDS

        given = {"op": "node.upsert", "kind": kind, "id": id, "props": js.dumps(props, separators=(",", ":"))}
        kinds = {"valid_from": "timestamp", "valid_to": "timestamp", "clear_valid_to": "boolean"}
        one = self.spark.range(1)
        return self.add(one.select(F.lit(0).cast("long").alias("change_ix"), F.lit(at).cast("timestamp").alias("tx_wall"), F.lit(0).alias("event_ix"), *[F.lit(given.get(f)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS]))

    def find(self, kind: str, id: str) -> DataFrame:
        """The current row of a node, if it is there."""
        return self.versions().filter("tx_to is null and not deleted").filter((F.col("kind") == kind) & (F.col("id") == id))


def check_commit(store: BeliefStore, rows: DataFrame, after_tx: int) -> None:
    """Raise if the rows are no valid events or break a rule of the store together with its history."""
    from chronofold.plans import constraints, events as ev

    ev.check_events(rows)
    if store.graph is not None:
        history = store.events()
        every = rows if history is None else history.unionByName(rows)
        constraints.check(every, folding.fold(every), store.graph, after_tx=after_tx, unique=store.unique)


class CheckpointBook:
    """Cursors and anchors of a store: last_offset, anchor_for, record."""

    def __init__(self, store: BeliefStore):
        self.store = store

    def last_offset(self, stream: str) -> str | None:
        return self.store.head().cursors.get(stream)

    def anchor_for(self, stream: str, offset: str) -> int | None:
        points = self.store.checkpoints()
        if points is None:
            return None
        row = points.filter((F.col("stream") == stream) & (F.col("offset") == offset)).agg(F.max("revision").alias("r")).first()
        return row["r"]

    def record(self, stream: str, offset: str, revision: int) -> Head:
        """Upsert a checkpoint; the high-water mark only moves forward."""
        head = self.store.head()
        old = head.cursors.get(stream)
        spark = self.store.spark
        if old is not None:
            ahead = spark.range(1).select((offset_ord(F.lit(offset)) >= offset_ord(F.lit(old))).alias("ok")).first()["ok"]
        cursors = {**head.cursors, **({stream: offset} if old is None or ahead else {})}
        point = spark.createDataFrame([(stream, offset, revision, head.last_tx)], "stream string, offset string, revision long, tx long")
        none = spark.createDataFrame([], "tx long, revision long, captured boolean")
        events = self.store.events()
        if events is None:
            from chronofold.plans.events import EVENT_TYPE

            inner = EVENT_TYPE.removeprefix("struct<").removesuffix(">")
            events = spark.createDataFrame([], "tx long, change_ix long, tx_wall timestamp, event_ix int, " + inner.replace(":", " "))
        return self.store.publish(head, events.limit(0), none, point, cursors, head.revision, head.last_tx)


def plan_digest(plan: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in plan.items() if k != "digest"}, sort_keys=True).encode()).hexdigest()


def plan_merge(store: BeliefStore, conflicts: DataFrame, merged: DataFrame, resolutions: DataFrame, show: int = 100) -> dict:
    """A reviewable plan: counts, the first conflicts, target revision and digest; nothing is written."""
    plan = {
        "target_commit": store.head().n,
        "target_revision": store.head().revision,
        "merged_nodes": merged.count(),
        "resolutions": resolutions.filter("id <> canonical").count(),
        "n_conflicts": conflicts.count(),
        "conflicts": [list(map(str, r)) for r in conflicts.orderBy("canonical", "property").limit(show).collect()],
    }
    return {**plan, "digest": plan_digest(plan)}


def apply_plan(store: BeliefStore, plan: dict, events: DataFrame, revision_step: int = 1) -> Head:
    """Publish a plan's events if the plan is intact and the target has not moved."""
    if plan_digest(plan) != plan["digest"]:
        raise StalePlanError("the plan was changed after it was made")
    head = store.head()
    if (head.n, head.revision) != (plan["target_commit"], plan["target_revision"]):
        raise StalePlanError(f"the target is at revision {head.revision}, the plan at {plan['target_revision']}")
    tx = head.last_tx + 1
    spark = store.spark
    revisions = spark.createDataFrame([(tx, head.revision + revision_step, True)], "tx long, revision long, captured boolean")
    points = spark.createDataFrame([], "stream string, offset string, revision long, tx long")
    events = events.withColumn("tx", F.lit(tx).cast("long"))
    check_commit(store, events, head.last_tx)
    return store.publish(head, events, revisions, points, head.cursors, head.revision + revision_step, tx)
