"""Chat formatting of reply trees, with DataFrame functions only.

``paths`` enumerates root-to-leaf paths by iterative self-joins: every round joins the nodes found so far with a table of
ancestors 2^k steps up, and that table with itself, so a thread of d turns takes log2(d) rounds. ``rank`` orders the
branches of a tree by the sum of their scores, and ``render`` makes one conversation of each chosen path.

Template, per turn: ``<|turn|>role NEWLINE text <|end|> NEWLINE``. Inside roles and texts a backslash becomes ``\\s``, ``<``
becomes ``\\l`` and ``[`` becomes ``\\b`` (in roles a line feed becomes ``\\n``), so neither these marks nor the control strings
of bracket templates can arise from a text; ``unescape`` undoes it. ``loss_spans`` holds start (from 0) and length, in
code points of the formatted text, of each assistant text.

Defined cases: null texts and roles are empty; null scores count 0; rows with a null tree form one tree; a parent that is not
in the tree makes its row a root; rows on or below a cycle are on no path; equal scores are ranked by leaf; an empty
table gives no rows. Repeated (tree, node) pairs are an error of the caller: ``from_turns`` numbers rows so that none arise
(ties in turn are ordered by role, then text; null turns first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

TURN, END = "<|turn|>", "<|end|>"


def escape(x: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(x: Column) -> Column:
    for code, plain in (("\\n", "\n"), ("\\b", "["), ("\\l", "<"), ("\\s", "\\")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: tree, node (from 0), parent, role, text, score (null)."""
    order = Window.partitionBy("tree").orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    return (
        rows.select(F.col(conv).alias("tree"), F.col(turn).alias(turn), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        .withColumn("node", (F.row_number().over(order) - 1).cast("long"))
        .select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every node of every root-to-leaf path; up: steps from the leaf."""
    work = Scratch(nodes.sparkSession, "paths")
    # Null trees compare as equal through this key.
    key = [F.col("tree").isNull().alias("none"), F.coalesce(F.col("tree"), F.lit("0").cast(nodes.schema["tree"].dataType)).alias("tree")]
    all_nodes = nodes.select(*key, "node")
    links = nodes.where(F.col("parent").isNotNull()).select(*key, "node", F.col("parent").alias("to"))
    on = ["none", "tree", "node"]
    links = links.join(all_nodes.withColumnRenamed("node", "to"), ["none", "tree", "to"])  # a parent outside the tree: a root
    links = work.table(links.select(*on, "to", F.lit(1).cast("long").alias("steps")), "links")
    has_parent, is_parent = links.select(*on), links.select("none", "tree", F.col("to").alias("node")).distinct()
    roots = all_nodes.join(has_parent, on, "left_anti")
    found = work.table(all_nodes.join(is_parent, on, "left_anti").select("none", "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "leaves")
    jump, longest = links, nodes.count()
    reach = 1
    while reach <= longest and not jump.isEmpty():
        further = found.join(jump, on).select("none", "tree", "leaf", F.col("to").alias("node"), (F.col("up") + F.col("steps")).alias("up"))
        found = work.table(found.unionByName(further), "found")
        again = jump.select("none", "tree", F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        jump = work.table(jump.join(again, ["none", "tree", "to"]).select(*on, F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jump")
        reach *= 2
    rooted = found.join(roots, on, "left_semi").select("none", "tree", "leaf")
    found = found.join(rooted, ["none", "tree", "leaf"], "left_semi") if reach > longest else found
    return found.select(F.when(~F.col("none"), F.col("tree")).alias("tree"), "leaf", "node", "up")


def rank(nodes: DataFrame, found: DataFrame, best: int | None = 1) -> DataFrame:
    """Rows of the chosen paths: tree, leaf, branch (1: highest score), depth, role, text."""
    rows = found.join(nodes, found["tree"].eqNullSafe(nodes["tree"]) & (found["node"] == nodes["node"])).select(found["tree"], "leaf", "up", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    if best is not None:
        totals = rows.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        branch = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
        chosen = totals.withColumn("branch", branch).where(F.col("branch") <= best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "branch")
        rows = rows.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")
    else:
        rows = rows.withColumn("branch", F.lit(None).cast("int"))
    return rows


def render(rows: DataFrame) -> DataFrame:
    """One row for each path: tree, leaf, branch, formatted, loss_spans, n_turns."""
    body, name = escape(F.col("text")), escape(F.col("role"), role=True)
    head = F.concat(F.lit(TURN), name, F.lit("\n"))
    turns = rows.select("tree", "leaf", "branch", "up", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("counts"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("counts"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "span")))
    return (
        turns.groupBy("tree", "leaf", "branch")
        .agg(ordered.alias("turns"))
        .select(
            "tree", "leaf", "branch",
            F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
            F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
            F.size("turns").cast("long").alias("n_turns"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        inner = F.substring_index(part, END, 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """nodes: tree, node, parent, role, text, score. One row for each of the best branches of each tree."""
    nodes = nodes.select("tree", "node", "parent", "role", "text", "score")
    return render(rank(nodes, paths(nodes), best))


def digests(out: DataFrame) -> DataFrame:
    """What was formatted, read back from the formatted text and its mask."""
    back = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
