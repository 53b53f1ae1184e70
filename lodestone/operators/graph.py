"""The memory graph: nodes with a fixed layout, and links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower, date_of, fib_sphere, jitter, squeeze, stable_key, text_of, wikilinks
from ..plans.staging import offsets, staged

# Fixed values of the layout: ring radius, height step, shell sizes.
RING, STEP = 300.0, 46.0
NOTES, CORE = 78.0, 140.0
CODE, CODE_STEP, CODE_NODES, NEWEST = 60.0, 9.0, 3000, 6000


def ring(k: Column, slots: Column) -> tuple[Column, Column, Column]:
    """Place of slot ``k`` of ``slots`` on the ring of projects."""
    angle = F.lit(2 * math.pi) * k / F.greatest(slots, F.lit(1))
    return F.lit(RING) * F.cos(angle), (F.pmod(k, F.lit(3)) - 1.0) * STEP, F.lit(RING) * F.sin(angle)


def places(rows: DataFrame, extra: int = 0) -> tuple[DataFrame, DataFrame]:
    """``project, k, px, py, pz`` and ``session, project, sx, sy, sz``, numbered by newest row first.

    Numbers are given to the distinct projects and sessions, not to rows;
    ``extra`` slots of the ring are left free.
    """
    newest = rows.groupBy("project").agg(F.max("rowid").alias("last"))
    numbered = offsets(newest, [F.desc("last")], F.lit(1), "k")
    slots = newest.agg((F.count(F.lit(1)) + extra).alias("slots"))
    x, y, z = ring(F.col("k"), F.col("slots"))
    projects = numbered.crossJoin(F.broadcast(slots)).select("project", "k", x.alias("px"), y.alias("py"), z.alias("pz"))
    seen = rows.where(text_of("session") != "").groupBy("session").agg(F.max("rowid").alias("last"), F.max_by("project", "rowid").alias("project"))
    w = Window.partitionBy("project")
    seen = seen.withColumn("i", F.row_number().over(w.orderBy(F.desc("last"))) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    ux, uy, uz = fib_sphere(F.col("i"), F.col("n"))
    r = F.lit(110.0) + F.sqrt(F.col("n").cast("double")) * 7.0
    sessions = seen.join(projects, "project").select("session", "project", (F.col("px") + ux * r).alias("sx"), (F.col("py") + uy * r * 0.72).alias("sy"), (F.col("pz") + uz * r).alias("sz"))
    return projects, sessions


def message_nodes(rows: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rowid, id, parent, group, label, fx, fy, fz, snippet, val`` of rows on the shell of their session, project or the core."""
    has = text_of("session") != ""
    kind = F.when(has, 0).when(F.col("role") == "wiki", 2).otherwise(1)
    w = Window.partitionBy("kind", "home")
    m = rows.withColumn("kind", kind).withColumn("home", F.when(has, F.col("session")).when(F.col("role") == "wiki", F.lit("")).otherwise(F.col("project")))
    m = m.withColumn("i", F.row_number().over(w.orderBy(F.desc("rowid"))) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    m = m.join(sessions.select("session", "sx", "sy", "sz"), "session", "left").join(projects.select("project", "px", "py", "pz"), "project", "left")
    base = lambda s, p: F.when(F.col("kind") == 0, F.col(s)).when(F.col("kind") == 1, F.col(p)).otherwise(F.lit(0.0))
    r = F.when(F.col("kind") == 0, F.lit(26.0) + F.cbrt(F.col("n").cast("double")) * 7.0).when(F.col("kind") == 1, F.lit(NOTES)).otherwise(F.lit(CORE))
    ux, uy, uz = fib_sphere(F.col("i"), F.col("n"))
    at = lambda b, u, seed: b + u * r + jitter(seed) * 4.0
    rid = F.col("rowid")
    parent = F.when(F.col("kind") == 0, F.concat(F.lit("s:"), F.col("session"))).when(F.col("kind") == 1, F.concat(F.lit("p:"), F.col("project"))).otherwise(F.lit("center"))
    return m.select(
        "rowid", F.concat(F.lit("m:"), rid.cast("string")).alias("id"), parent.alias("parent"), F.col("role").alias("group"), date_of("ts", "").alias("label"),
        at(base("sx", "px"), ux, rid).alias("fx"), at(base("sy", "py"), uy, rid.bitwiseXOR(F.lit(0xA5A5))).alias("fy"), at(base("sz", "pz"), uz, rid.bitwiseXOR(F.lit(0x5A5A))).alias("fz"),
        squeeze("text", 160).alias("snippet"), F.when(F.col("role").isin("memory", "wiki"), F.lit(5.0)).otherwise(F.lit(1.6)).alias("val"),
    )


def wikilink_edges(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``source, target``: links between notes by lower-case name (``name, rowid``); dangling and self links go."""
    out = rows.select("rowid", F.explode(wikilinks("text")).alias("name")).join(names.select("name", F.col("rowid").alias("to")), "name").where(F.col("to") != F.col("rowid"))
    node = lambda c: F.concat(F.lit("m:"), F.col(c).cast("string"))
    return out.select(node("rowid").alias("source"), node("to").alias("target"))


def knowledge(rows: DataFrame, gists: DataFrame, newest: int = NEWEST, raw: bool = False) -> DataFrame:
    """The newest rows that are notes or carry a gist (all with ``raw``), with ``gist``."""
    head = rows.orderBy(F.desc("rowid")).limit(newest).withColumn("key", stable_key("session", "ts", "role", "text"))
    known = head.join(gists.where(F.col("gist") != "").select("key", "gist"), "key", "left").drop("key")
    return known if raw else known.where(F.col("role").isin("memory", "wiki") | F.col("gist").isNotNull())


def note_names(rows: DataFrame) -> DataFrame:
    """``name, rowid`` of notes: of several with a name, the oldest row."""
    notes = rows.where(F.col("role").isin("memory", "wiki"))
    return notes.groupBy(ascii_lower(text_of("session")).alias("name")).agg(F.min("rowid").alias("rowid"))


def code_graph(graph: DataFrame, most: int = CODE_NODES) -> tuple[DataFrame, DataFrame]:
    """``at, id, label, snippet`` and ``source, target`` of a graph file (``nodes``, ``edges`` or ``links``, one row).

    At most ``most`` nodes; an edge stays if both its ends do.
    """
    nodes = graph.select(F.posexplode("nodes").alias("at", "n")).where(F.col("n.id").isNotNull())
    label = F.coalesce("n.label", "n.id")
    nodes = nodes.orderBy("at").limit(most).select("at", F.col("n.id").alias("id"), label.alias("label"), F.concat(label, F.lit("\n["), F.coalesce("n.file_type", F.lit("code")), F.lit("] "), text_of("n.source_file")).alias("snippet"))
    held = F.coalesce(*[F.col(c) for c in ("edges", "links") if c in graph.columns])
    edges = graph.select(F.explode(held).alias("e")).select("e.source", "e.target").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    ends = nodes.select("id")
    edges = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    return nodes, edges


NODE = ("id", "group", "label", "project", "session", "snippet", "ts", "val", "fx", "fy", "fz")


def build_graph(rows: DataFrame, code: tuple[DataFrame, DataFrame] | None = None, root: str = "repo") -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``links`` (``source, target, kind``) of the memory: a core, projects, sessions, rows, and code if given.

    ``rows`` may carry ``gist``, which stands in for a row's text.
    """
    spark = rows.sparkSession
    planets = rows.where(F.col("role") != "wiki")
    talk = rows.withColumn("session", F.when(F.col("role").isin("memory", "wiki"), F.lit("")).otherwise(F.col("session")))
    n_code = code[0].count() if code else 0  # bounded by CODE_NODES
    projects, sessions = places(planets.withColumn("session", F.when(F.col("role") == "memory", F.lit("")).otherwise(F.col("session"))), extra=1 if n_code else 0)
    blank_ = lambda df, **c: df.select(*[c.get(k, F.lit("")).alias(k) for k in NODE])
    one = spark.range(1)
    core = blank_(one, id=F.lit("center"), group=F.lit("center"), label=F.lit("memory"), val=F.lit(34.0), fx=F.lit(0.0), fy=F.lit(0.0), fz=F.lit(0.0))
    rings = blank_(projects, id=F.concat(F.lit("p:"), "project"), group=F.lit("project"), label=F.col("project"), val=F.lit(16.0), fx=F.col("px"), fy=F.col("py"), fz=F.col("pz"))
    shells = blank_(sessions, id=F.concat(F.lit("s:"), "session"), group=F.lit("session"), label=F.substring("session", 1, 8), val=F.lit(7.0), fx=F.col("sx"), fy=F.col("sy"), fz=F.col("sz"))
    said = F.coalesce(F.col("gist"), F.substring(text_of("text"), 1, 320)) if "gist" in rows.columns else F.substring(text_of("text"), 1, 320)
    placed = message_nodes(talk, projects, sessions).drop("snippet")
    extra = rows.select("rowid", text_of("project").alias("project"), F.substring(text_of("session"), 1, 8).alias("session"), said.alias("snippet"))
    dots = staged(placed.join(extra, "rowid"), "graph-rows")
    leaves = blank_(dots, **{k: F.col(k) for k in NODE if k != "ts"}, ts=F.col("label"))
    link = lambda df, source, target, kind: df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))
    nodes = core.unionByName(rings).unionByName(shells).unionByName(leaves)
    links = (
        link(projects, F.lit("center"), F.concat(F.lit("p:"), "project"), "spine")
        .unionByName(link(sessions, F.concat(F.lit("p:"), "project"), F.concat(F.lit("s:"), "session"), "spine"))
        .unionByName(link(dots, F.col("parent"), F.col("id"), "leaf"))
        .unionByName(wikilink_edges(rows.where(F.col("role").isin("memory", "wiki")), note_names(rows)).withColumn("kind", F.lit("wikilink")))
    )
    if n_code:
        slots = projects.agg(F.count(F.lit(1)).alias("k")).withColumn("slots", F.col("k") + 1)
        x, y, z = ring(F.col("k"), F.col("slots"))
        here = slots.select(x.alias("cx"), y.alias("cy"), z.alias("cz"))
        hub = F.lit(f"code:{root}")
        nodes = nodes.unionByName(blank_(here, id=hub, group=F.lit("coderoot"), label=F.lit("code"), val=F.lit(18.0), fx=F.col("cx"), fy=F.col("cy"), fz=F.col("cz")))
        ux, uy, uz = fib_sphere(F.col("i"), F.lit(n_code))
        r = CODE + n_code ** (1 / 3) * CODE_STEP
        own = code[0].withColumn("i", F.row_number().over(Window.orderBy("at")) - 1).crossJoin(F.broadcast(here))  # at most CODE_NODES
        nodes = nodes.unionByName(blank_(own, id=F.concat(F.lit("c:"), "id"), group=F.lit("code"), label=F.col("label"), project=F.lit("code"), snippet=F.col("snippet"), val=F.lit(2.4), fx=F.col("cx") + ux * r, fy=F.col("cy") + uy * r, fz=F.col("cz") + uz * r))
        links = links.unionByName(link(one, F.lit("center"), hub, "spine")).unionByName(link(code[0], hub, F.concat(F.lit("c:"), "id"), "tether")).unionByName(link(code[1], F.concat(F.lit("c:"), "source"), F.concat(F.lit("c:"), "target"), "code"))
    return nodes, links


def payload(nodes: DataFrame, links: DataFrame, size_mb: str = "") -> str:
    """The graph as JSON for a page: bounded by ``NEWEST`` and ``CODE_NODES``, so it is put together on the driver."""
    import json

    points = [json.loads(r[0]) for r in nodes.select(F.to_json(F.struct(*NODE))).orderBy("id").collect()]
    ties = [json.loads(r[0]) for r in links.select(F.to_json(F.struct("kind", "source", "target"))).orderBy("source", "target", "kind").collect()]
    groups: dict[str, int] = {}
    for p in points:
        groups[p["group"]] = groups.get(p["group"], 0) + 1
    roles = {g: n for g, n in sorted(groups.items()) if g not in ("center", "project", "session", "coderoot", "code")}
    stats = {"db_mb": size_mb, "projects": groups.get("project", 0), "roles": roles, "rows": sum(roles.values()), "sessions": groups.get("session", 0)}
    return json.dumps({"links": ties, "nodes": points, "stats": stats}, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")


def page(spark, data: str, path: str, template: str = "<!doctype html><meta charset=utf-8><title>memory</title><script>const DATA = /*payload*/ null;</script>") -> None:
    """Write a page with the payload in it to any store that Spark writes to."""
    spark.createDataFrame([(template.replace("/*payload*/ null", data),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def search_nodes(nodes: DataFrame, links: DataFrame, text: str) -> DataFrame:
    """``id`` of nodes whose snippet or label holds the text in any case, and of the parents they hang on."""
    low = F.lit(text.lower())
    hit = nodes.where(F.contains(F.lower("snippet"), low) | F.contains(F.lower("label"), low)).select("id")
    up = links.where(F.col("kind").isin("leaf", "tether")).join(hit.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return hit.unionByName(up).distinct()


def child_counts(links: DataFrame) -> DataFrame:
    """``id, children``: how many nodes hang on each."""
    return links.where(F.col("kind").isin("spine", "leaf", "tether")).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("children"))
