"""Joins of snapshots: exact matches that must be unique, carried-forward values, overlaps, trees."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import shared_folder


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """left with the columns of the one right row of its key; null where there is none, or more than one."""
    one = right.groupBy(*on).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in keep)).where("_n = 1").drop("_n")
    return left.join(one, list(on), "left")


def predecessor(now: DataFrame, identity: Sequence[str], keep: Sequence[str], ts: str, current: int, before: int) -> DataFrame:
    """Rows of the snapshot `current` with prev_<column> of the same identity at the snapshot `before`, and before_rows, how many
    it has there (a null before and no row before differ): one pass over the two."""
    two = now.where(F.col(ts).isin(current, before))
    at = lambda c, t: F.max(F.when(F.col(ts) == t, F.col(c)))
    out = two.groupBy(*identity).agg(F.count_if(F.col(ts) == current).alias("_n"), F.count_if(F.col(ts) == before).alias("before_rows"), *(at(c, current).alias(c) for c in keep), *(at(c, before).alias(f"prev_{c}") for c in keep))
    return out.where("_n > 0").drop("_n")


def best_effort(plans: DataFrame, statements: DataFrame, attributions: Sequence[Sequence[tuple[str, str]]], keep: Sequence[str]) -> DataFrame:
    """Statements of plans by any of several keys (pairs of plan and statement columns): one row for each way it fits, with
    the number of the way; plans that fit nowhere come once without."""
    out = None
    for k, pairs in enumerate(attributions):
        cond = F.lit(True)
        for a, b in pairs:
            cond = cond & (plans[a] == statements[b])
        one = plans.join(statements.select(*[F.col(b).alias(f"_{b}") for _, b in pairs], *keep), on=[plans[a] == F.col(f"_{b}") for a, b in pairs]).drop(*[f"_{b}" for _, b in pairs]).withColumn("way", F.lit(k))
        out = one if out is None else out.unionByName(one)
    rest = plans.join(out.select(*plans.columns).distinct(), plans.columns, "left_anti")
    return out.unionByName(rest, allowMissingColumns=True)


def setting_at(settings: DataFrame, at: int, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """The value of each key in force at a time."""
    return settings.where(F.col(ts) <= at).groupBy(*keys).agg(F.max_by(value, ts).alias(value))


def overlaps(segments: DataFrame, frm: int, to: int, halo: int = 0, start: str = "min_ts", end: str = "max_ts") -> DataFrame:
    """Segments that meet [frm, to), with a margin."""
    return segments.where((F.col(end) >= frm - halo) & (F.col(start) < to + halo))


def outer_tracks(a: DataFrame, b: DataFrame, keys: Sequence[str], end: str, value: str) -> DataFrame:
    """Two tracks of intervals by their ends: matched, only_a, only_b, with both values."""
    x = a.select(*keys, end, F.col(value).alias("a"), F.lit(True).alias("_a"))
    y = b.select(*keys, end, F.col(value).alias("b"), F.lit(True).alias("_b"))
    out = x.join(y, [*keys, end], "full_outer")
    return out.withColumn("side", F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "only_a").otherwise("only_b")).drop("_a", "_b")


def longest_prefix(paths: DataFrame, path: str, mounts: DataFrame, mount: str, keep: Sequence[str]) -> DataFrame:
    """Each path with the mount that is its longest leading directory: all of its leading directories are looked up, so
    the join is on equal keys."""
    parts = F.split(path, "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    up = paths.select(path).distinct().select(path, F.explode(leads).alias(mount))
    best = up.join(mounts.select(mount, *keep), mount).groupBy(path).agg(F.max_by(F.struct(mount, *keep), F.length(mount)).alias("_m")).select(path, "_m.*")
    return paths.join(best, path, "left")


def wait_tree(edges: DataFrame, waiter: str, blocker: str, most_depth: int = 32) -> DataFrame:
    """Who waits for whom, from the roots: pid, root, depth, path. A root blocks and doesn't wait; a group of pids that all
    wait, a pure cycle, hangs from its smallest pid that reaches itself. A pid that is on its own path isn't followed. The edges
    and the tree from the roots are written once: each step of the recursion reads the former, the search for cycles the latter."""
    spark = edges.sparkSession
    name = f"edges_{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    views = [name, f"{name}_left", f"{name}_tree", f"{name}_cycles"]
    edges.select(F.col(waiter).alias("w"), F.col(blocker).alias("b")).where("w <> b").distinct().checkpoint().createOrReplaceTempView(name)
    walk = """
        SELECT pid, pid AS root, 0 AS depth, ARRAY(pid) AS path FROM ({roots})
        UNION ALL
        SELECT e.w, t.root, t.depth + 1, array_append(t.path, e.w) FROM t JOIN {name} e ON t.pid = e.b
        WHERE NOT array_contains(t.path, e.w) AND t.depth < {depth}"""
    try:  # plans are resolved as they are made; their views needn't stay
        roots = f"SELECT DISTINCT x.b AS pid FROM {name} x LEFT ANTI JOIN {name} y ON x.b = y.w"
        tree = spark.sql(f"WITH RECURSIVE t(pid, root, depth, path) AS ({walk.format(roots=roots, name=name, depth=most_depth)}) SELECT * FROM t").checkpoint()
        tree.createOrReplaceTempView(f"{name}_tree")
        spark.sql(f"SELECT w, b FROM {name} x LEFT ANTI JOIN {name}_tree t ON x.w = t.pid").createOrReplaceTempView(f"{name}_left")
        inner = f"""
            SELECT b AS start, w AS pid, ARRAY(b, w) AS path, 1 AS depth FROM {name}_left
            UNION ALL
            SELECT c.start, e.w, array_append(c.path, e.w), c.depth + 1 FROM c JOIN {name}_left e ON c.pid = e.b
            WHERE c.depth < {most_depth} AND c.pid <> c.start AND (e.w = c.start OR NOT array_contains(c.path, e.w))"""
        cycles = spark.sql(f"WITH RECURSIVE c(start, pid, path, depth) AS ({inner}) SELECT start, array_min(path) AS least FROM c WHERE pid = start")
        cycles.createOrReplaceTempView(f"{name}_cycles")
        heads = f"SELECT DISTINCT start AS pid FROM {name}_cycles GROUP BY start HAVING min(least) = start"
        more = spark.sql(f"WITH RECURSIVE t(pid, root, depth, path) AS ({walk.format(roots=heads, name=f'{name}_left', depth=most_depth)}) SELECT * FROM t")
        return tree.union(more)
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def associated(a: DataFrame, b: DataFrame, on: Sequence[str], collect: str, out: str) -> DataFrame:
    """a with the set of a column of all b rows of its key."""
    return a.join(b.groupBy(*on).agg(F.array_sort(F.collect_set(collect)).alias(out)), list(on), "left")


def gate_select(label: Column, overrides: Sequence[tuple[str, Column]], default: Column) -> Column:
    """The gate of the first override that the row's label names; the default for other labels; null without a label."""
    out = F.when(label.isNull(), F.lit(None))
    for value, gate in overrides:
        out = out.when(label == value, gate)
    return out.otherwise(default)
