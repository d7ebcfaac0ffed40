"""A Merkle manifest of a dataset, level by level.

Nodes of a group stand in order; `arity` consecutive ones are a run, which becomes one node of the next level. At every level a node
finds the others of its run by equijoins on their computed indices (XOR 1 for binary trees, else the slots at an offset), and the
node in slot zero emits the parent. Going back down, each node hands its path (what stands before and after it in its run, level
by level) to its children. No level groups rows, so no task sees more of a group than its share, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.shared import numbered, written

_PATH = "array<struct<before: binary, after: binary>>"


def sha256_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else the number of its UTF-8 bytes, a colon, and it."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes with before and after: the digests of the run's others, in order, as bytes; empty where there is none."""
    found = nodes
    for step in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - F.col("slot") + (F.col("slot") + step) % arity
        others = nodes.select(F.col("group").alias("__group"), F.col("idx").alias("__idx"), F.unhex("digest").alias(f"s{step}"))
        found = found.withColumn("__at", at).join(others, (F.col("group") == F.col("__group")) & (F.col("__at") == F.col("__idx")), "left").drop("__at", "__group", "__idx")
    steps = range(1, arity)
    part = lambda ok: F.concat(*[F.coalesce(F.when(ok(k), F.col(f"s{k}")), F.lit(b"")) for k in steps])
    # offsets that pass the end of the run come round to its beginning
    before, after = part(lambda k: F.col("slot") + k >= arity), part(lambda k: F.col("slot") + k < arity)
    return found.withColumns({"before": before, "after": after}).drop(*[f"s{k}" for k in steps])


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def levels_of(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The written levels of each group's tree, from the nodes (group, idx, of, digest, any more) up; a level adds before and after.

    `of` counts the group's nodes on the level; where it is 1, the node is the group's root.
    """
    levels, most = [], nodes.agg(F.max("of")).first()[0]
    while most:
        name = f"level{len(levels)}"
        level = written(_siblings(nodes.withColumn("slot", F.col("idx") % arity), arity).withColumn(
            "parent", F.when((F.col("slot") == 0) & (F.col("of") > 1), sha256_of(F.col("digest"), _hex(F.col("after"))))), name)
        levels.append(level)
        if most == 1:
            break
        most = -(-most // arity)
        run = ((F.col("idx") - F.col("slot")) / arity).cast("long")
        nodes = level.filter("parent IS NOT NULL").select("group", run.alias("idx"), F.ceil(F.col("of") / arity).cast("long").alias("of"), F.col("parent").alias("digest"))
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """group, root: of each group's tree."""
    return _union([level.filter("of = 1").select("group", F.col("digest").alias("root")) for level in levels])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    return whole


def with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with path, from the node's own run up to its root and on along its group's path, and the group's columns.

    tops: group, path (what stands beside the group's root above it), any more columns.
    """
    known = None
    more = [c for c in tops.columns if c not in ("group", "path")]
    for at, level in reversed(list(enumerate(levels))):
        keep = [c for c in level.columns if c not in ("slot", "parent", "before", "after", "of")]
        here = level.filter("of = 1").join(tops, "group").select(*keep, "path", *more)
        if known is not None:
            parents = known.select(F.col("group").alias("__group"), F.col("idx").alias("__run"), "path", *more)
            inner = level.filter("of > 1").withColumn("__up", ((F.col("idx") - F.col("slot")) / arity).cast("long"))
            inner = inner.join(parents, (F.col("group") == F.col("__group")) & (F.col("__up") == F.col("__run")))
            here = here.unionByName(inner.select(*keep, F.concat(F.array(F.struct("before", "after")), "path").alias("path"), *more))
        known = written(here, f"paths{at}") if at else here
    return known


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the path beside it give."""
    return F.aggregate(path, leaf, lambda node, p: sha256_of(_hex(p["before"]), node, _hex(p["after"])))


def siblings_sha256(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), ""), 256)


def manifest(rows: DataFrame, source: str, order: str, leaf: Column, arity: int = 3, **more: Column) -> DataFrame:
    """One row per row of rows: `order`, `source`, leaf, subroot, root, path, and the columns in more.

    leaf: a hexadecimal digest of the row. A tree per source, its leaves ascending by `order` (null first, then by digest, so
    that repeated rows are interchangeable); then one over the sources' roots, null first and then by UTF-8 bytes. A run of one
    is digested too; a lone leaf is its source's root as it is, and a lone source's root the root. Null sources are one
    source. An empty table gives an empty result; columns not named are not read.
    """
    group = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))
    leaves = written(rows.select(group.alias("group"), F.col(order).alias("__order"), F.col(source).alias("__source"), leaf.alias("digest"), *[c.alias(f"__{n}") for n, c in more.items()]), "leaves")
    if leaves.isEmpty():
        empty = {order: F.col("__order"), source: F.col("__source"), "leaf": F.col("digest"), "subroot": F.col("digest"), "root": F.col("digest"), "path": F.lit(None).cast(_PATH)}
        return leaves.select(*[c.alias(n) for n, c in empty.items()], *[F.col(f"__{n}").alias(n) for n in more])
    lower = levels_of(numbered(leaves, "group", ["__order", "digest"]), arity)
    subroots = written(roots_of(lower).select(F.lit("").alias("group"), F.col("group").alias("__of"), F.col("root").alias("digest")), "subroots")
    upper = levels_of(numbered(subroots, "group", ["__of"]), arity)
    root = roots_of(upper).first()["root"]
    nothing = written(subroots.sparkSession.range(1).select(F.lit("").alias("group"), F.array().cast(_PATH).alias("path")), "nothing")
    tops = written(with_paths(upper, nothing, arity).select(F.col("__of").alias("group"), "path", F.col("digest").alias("subroot")), "tops")
    return with_paths(lower, tops, arity).select(
        F.col("__order").alias(order), F.col("__source").alias(source), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path",
        *[F.col(f"__{n}").alias(n) for n in more])


def document_leaf(text: Column) -> Column:
    return sha256_of(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


def verified_documents(docs: DataFrame, arity: int = 3) -> DataFrame:
    """The manifest of documents, checked against a copy that was tampered with: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 2 divides the crc32 of the decimal doc_id, the copy has lost the line feeds of its text. Each row's root is folded
    from the copy's leaf and the siblings in the manifest. A null doc_id's copy is as it was; nulls differ from empty texts.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains(F.col("text"), F.lit("\n"))
    tampered = F.when(hit, document_leaf(F.translate("text", "\n", "")))
    made = manifest(docs, "source", "doc_id", document_leaf(F.col("text")), arity, tampered=tampered)
    again = made.withColumns({"proof_sha256": siblings_sha256(F.col("path")), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return again.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
