"""A workspace that is kept up to date: a change set parses the files it holds and resolves the imports that consulted what changed.

An import's address depends on its own file, on the place of its file among the modules, on whether one module or file is there that it
asks for, and on the packages. The first three are keys, so a change set meets them in joins; other packages make all imports be resolved
again. Aliases and judged tokens follow from these tables and are made when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.engine import Workspace
from treeline.functions import paths as P
from treeline.operators import graph
from treeline.operators.search import except_known
from treeline.session import settle
from treeline.sources import workspace

#: Change sets that lie over the first tables before all are written as one again.
LAYERS = 8
_MANIFEST = r"(^|/)Cargo\.toml$"


def consulted(imports: DataFrame, mods: DataFrame) -> DataFrame:
    """(path, key): module addresses and files that the imports of a file ask for, there or not."""
    base = imports.join(mods.select("path", F.col("package").alias("own"), "mpath"), "path")
    first = F.coalesce(F.element_at("segments", F.when(F.size("segments") > 0, 1)), F.lit(""))
    child = base.filter("language = 'rust'").select("path", graph.addr(F.col("own"), F.concat("mpath", F.array(first))).alias("key"))
    asked = F.when(F.col("head").isin("here", "up"), P.normalise(F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), F.col("raw"))))
    probed = imports.filter("language in ('typescript', 'tsx')").select("path", F.explode(P.probe_candidates(asked)).alias("key"))
    return child.unionByName(probed).distinct()


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has and the other has not."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


class Maintained:
    """`workspace` is the tree after all change sets so far. A change set is changes(path, text), one row a path; a null text takes the file away."""

    def __init__(self, files: DataFrame) -> None:
        self.workspace = Workspace(workspace.captured(files))
        self.layers = 0

    def apply(self, changes: DataFrame) -> DataFrame:
        """One row: files changed, parsed, resolved (files whose imports were resolved again), held (all files with imports or not).

        A file that comes with the text it has is no change, so a change set may come twice.
        """
        old = self.workspace
        given = workspace.claim(changes.select("path", "text"))
        known = old.files.select("path", F.col("content_id").alias("was"))
        sent = settle(given.join(known, "path", "left").filter(~F.col("was").eqNullSafe(F.col("content_id"))))
        fresh = sent.filter("text is not null").select("path", "text", "language", "content_id")
        over = lambda base, rows, gone: except_known(base, gone.select("path"), ["path"]).unionByName(rows)
        new = Workspace(over(old.files, fresh, sent))
        parsed = settle(workspace.facts(fresh))
        # cached_property keeps its value under its own name.
        new.__dict__["facts"] = over(old.facts, parsed, sent)
        if sent.filter(F.col("path").rlike(_MANIFEST)).isEmpty():
            new.__dict__["manifests"] = old.manifests
        again = self._stale(old, new, sent)
        if again is None:
            resolved = new.modules.count()
        else:
            again = settle(again)
            mine = lambda rows: rows.join(again, "path", "left_semi")
            part = settle(graph.edges(mine(new.family("imports")), new.modules, new.packages, new.dependencies, mine(new.declared), new.files))
            new.__dict__["edges"] = over(old.edges, part, again)
            resolved = again.join(new.modules, "path", "left_semi").count()
        self.layers += 1
        if self.layers >= LAYERS:
            new.files, self.layers = settle(new.files), 0
            new.__dict__["facts"], new.__dict__["edges"] = settle(new.facts), settle(new.edges)
        self.workspace = new
        row = [(sent.count(), parsed.count(), resolved, new.files.count())]
        return sent.sparkSession.createDataFrame(row, "changed long, parsed long, resolved long, held long")

    @staticmethod
    def _stale(old: Workspace, new: Workspace, sent: DataFrame) -> DataFrame | None:
        """path: files whose imports must be resolved again; None for all."""
        if new.manifests is not old.manifests:
            pairs = ((old.packages, new.packages), (old.dependencies.distinct(), new.dependencies.distinct()))
            if not all(_differ(a, b).isEmpty() for a, b in pairs):
                return None
        moved = settle(_differ(old.modules.drop("text"), new.modules.drop("text")))
        there = old.files.select("path").join(sent.select("path"), "path", "left_semi").withColumn("old", F.lit(True))
        came_or_went = sent.join(there, "path", "left").filter("old is null or text is null")
        keys = moved.select(F.col("addr").alias("key")).unionByName(came_or_went.select(F.col("path").alias("key"))).distinct()
        asking = consulted(new.family("imports"), new.modules).join(keys, "key", "left_semi").select("path")
        return sent.select("path").unionByName(moved.select("path")).unionByName(asking).distinct()


def follow(spark: SparkSession, held: Maintained, folder: str, checkpoint: str):  # noqa: ANN201
    """Keep a workspace up with a growing folder of Parquet snapshots (path, text, version): each batch is a change set, of each path the newest version."""
    source = spark.readStream.schema("path string, text string, version long").parquet(folder)

    def handle(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("text"), "version").alias("n"))
        held.apply(newest.select("path", "n.text"))

    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
