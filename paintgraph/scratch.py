"""Written tables that cut lineage, and connected components on them.

Tables lie in the shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master gets a
temporary folder; any other master is refused, for its executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges of one node that may meet in one task, while the graph has under the square of it.
SHARE = 1 << 17
#: Folders not freed yet, with a way to delete them.
_left: dict = {}


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} written tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Table:
    """A written table: `df` reads it as often as wanted, `free` deletes it after its last reader.

    Tables that a returned DataFrame still reads are deleted when the program ends.
    """

    def __init__(self, df: DataFrame, name: str = "t"):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        old = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")  # what this write shuffled isn't read again
        try:
            df.write.parquet(self.path)
        finally:
            spark.conf.set(_CLEANUP, old)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _left[self.path] = spark

    def free(self) -> None:
        if _left.pop(self.path, None) is not None:
            _delete(self.spark, self.path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """A written table that is kept to the end of the program."""
    return Table(df, name).df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by the keys to as many tasks as shuffles have: for small rows of much work. The number is given, so
    that adaptive execution doesn't put small partitions together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@atexit.register
def _clear() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster's own clearing has to do
            return


def met(edges: DataFrame, least: DataFrame, keep: list[str], share: int | None) -> DataFrame:
    """keep, u, v and m: each edge with the m of its u. least: keep, u, m, n (edges of u).

    With a share, nodes of more than `share` edges are broadcast, so no task gets the edges of a hub; the others
    meet by a shuffle. Edges of a node are at most `share` in it.
    """
    on = [*keep, "u"]
    if share is None:
        return edges.join(least.select(*on, "m"), on)
    hubs = F.broadcast(least.where(F.col("n") > share).select(*on, "m"))
    rest = edges.join(hubs.select(*on), on, "left_anti").join(least.where(F.col("n") <= share).select(*on, "m").hint("merge"), on)
    return edges.join(hubs, on).unionByName(rest)


def components(edges: DataFrame, keep: list[str] | None = None, share: int = SHARE) -> Table:
    """Connected components of edges (u, v), apart for each value of the columns `keep`: node, label (smallest node).

    Large-star and small-star steps: each node's larger neighbours go to its smallest neighbour, then its smaller
    ones do, which about halves the distance to the smallest node of the component, so a chain of n nodes takes
    about log2(n) rounds. A round is one job and one table of at most as many edges as there were. Only a count and a
    checksum come to the driver. Minima of hubs are minima of partial minima. A node can be a hub only if there are more
    than `share` edges; then nodes of over max(share, edges / share) edges are broadcast, at most 2 * share
    of them whatever the size of the graph, and a round is four jobs.
    """
    keep = list(keep or [])
    pair = lambda a, b: [*keep, a.alias("u"), b.alias("v")]
    u, v, m = F.col("u"), F.col("v"), F.col("m")

    def step(e: DataFrame, size: int) -> DataFrame:
        held, most = [], max(share, size // share) if size > share else None

        def keeping(df: DataFrame, name: str) -> DataFrame:  # read by several joins of a round with hubs
            if most is None:
                return df
            held.append(Table(df, name))
            return held[-1].df

        both = e.select(*pair(u, v)).union(e.select(*pair(v, u)))
        least = keeping(both.groupBy(*keep, "u").agg(F.least(F.min("v"), u).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = keeping(met(both.where(v > u), least, keep, most).select(*pair(v, m)).distinct(), "large")
        low = keeping(large.groupBy(*keep, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = met(large, low, keep, most).where(v != m).select(*pair(v, m)).union(low.select(*pair(u, m)))
        new = Table(small.where(u != v).distinct(), "edges")
        for t in held:
            t.free()
        return new

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keep, "u", "v"))).first())

    now = Table(edges.where(u != v).select(*pair(F.greatest("u", "v"), F.least("u", "v"))).distinct(), "edges")
    seen = sign(now.df)
    while seen[0]:
        new = step(now.df, seen[0])
        now.free()
        now, was, seen = new, seen, sign(new.df)
        if seen == was:
            break
    # at the end each node but the smallest has one edge, to the smallest
    roots = now.df.select(*keep, v.alias("node"), v.alias("label")).distinct()
    done = Table(now.df.select(*keep, u.alias("node"), v.alias("label")).union(roots), "labels")
    now.free()
    return done
