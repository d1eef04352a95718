"""Operator 11: a Merkle manifest of a dataset, with a proof for each row.

Bottom up.  Each row is a leaf.  The leaves of a language are put in order and numbered,
every eight consecutive nodes become one node of the next level, until one is left, the
language's subroot.  Subroots, ordered by language, are the leaves of one more tree of
the same form; its root names the dataset.  Each level is persisted, a node with the list
of its children.

Top down.  A node inherits its parent's proof and puts its own siblings before it.  Each
level's nodes are joined with the proofs of the level above by place, so a proof is
handed down once for eight nodes; those of leaves are only hashed and never written.

Numbering: leaves are dealt by range and sorted; how many rows of a tree lie in the parts
before a row's own is a running sum over parts, so a language of any size spreads over
tasks, and none is collected.  Rows alike in all columns are spread by their place in the
written table.  No node has more than eight children, whatever the data.

Null fields are leaves' ``-``; a null language is a language of its own, before all
others, and apart from the empty one.  Ties: rows with equal ids are ordered by leaf, rows
equal in both are alike, each with a proof of its own; null ids come before others and
are never tampered with.  Empty and long texts are hashed whole.  A lone row of a language
is that language's subroot, and a lone subroot is the root.  An empty table gives an empty
table.  Columns beyond the five of ``documents`` are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, stored

ARITY = 8
_PROOF = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A field as it goes into a leaf: its length in bytes, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of ``documents`` with this text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _tampered() -> Column:
    """The leaf of a row whose text is tampered with, null for other rows."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return F.when(hit, leaf(F.translate("text", ascii_uppercase, ascii_lowercase)))


def numbered(rows: DataFrame, order: list[str], work: Scratch) -> DataFrame:
    """``rows`` with ``place``, from 0 in each ``tree`` by ``order``, and ``left``, the tree's number of rows."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # of a written table: the same each time it is read
    keys = ["tree", *order]
    dealt = salted.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt")
    sorted_ = work.stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = sorted_.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("left", F.sum("_n").over(own)).drop("_n")
    return sorted_.join(parts, ["tree", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _runs(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """tree, place, left, kids of the nodes above ``nodes``; kids have ``digest`` and the columns ``kept``, in order."""
    up = lambda c: F.call_function("div", F.col(c), F.lit(ARITY).cast("long"))
    child = F.struct("place", "digest", *kept)
    grouped = nodes.groupBy("tree", up("place").alias("above")).agg(F.sort_array(F.collect_list(child)).alias("kids"), F.first("left").alias("below"))
    wider = F.call_function("div", F.col("below") + F.lit(ARITY - 1), F.lit(ARITY).cast("long"))
    return grouped.select("tree", F.col("above").alias("place"), wider.alias("left"), "below", "kids")


def levels(leaves: DataFrame, kept: list[str], work: Scratch) -> list[DataFrame]:
    """The levels above numbered ``leaves`` (tree, place, left, digest and ``kept``), from below: tree, place, left, below, digest, kids.

    A tree is in the levels up to that where one node is left.  The lone leaf of a tree is
    its node of the first level too, not hashed again.
    """
    out, nodes = [], leaves
    while True:
        digests = F.transform("kids", lambda k: k["digest"])
        runs = _runs(nodes, kept).withColumn("digest", F.when(F.col("below") == 1, digests[0]).otherwise(joined_digest(digests)))
        out.append(work.stored(runs))
        nodes, kept = out[-1].where("left > 1").select("tree", "place", "left", "digest"), []
        if nodes.isEmpty():
            return out


def _with_step(kid: Column, kids: Column, proof: Column) -> Column:
    """The proof of a child: its siblings before and after it, then its parent's."""
    text = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k["digest"]), "")
    step = F.struct(text(lambda k: k["place"] < kid["place"]).alias("before"), text(lambda k: k["place"] > kid["place"]).alias("after"))
    return F.when(F.col("below") == 1, proof).otherwise(F.concat(F.array(step), proof))


def pushed(tree_levels: list[DataFrame], roots: DataFrame | None, work: Scratch) -> DataFrame:
    """tree, place, proof of the nodes of the first level; ``roots`` has tree and proof of each tree's root, None where nothing is above them."""
    down: DataFrame | None = None
    for level in reversed(tree_levels):
        # trees whose root is in this level begin here
        begun = level.where("left = 1").select("tree", "place")
        begun = begun.join(roots, "tree").select("tree", "place", "proof") if roots is not None else begun.withColumn("proof", F.array().cast(_PROOF))
        proofs = begun if down is None else begun.union(down)
        if level is tree_levels[0]:
            return proofs
        held = level.select("tree", "place", "below", "kids").join(proofs, ["tree", "place"])
        each = held.withColumn("kid", F.explode("kids"))
        down = work.stored(each.select("tree", F.col("kid.place").alias("place"), _with_step(F.col("kid"), F.col("kids"), F.col("proof")).alias("proof")))
    raise ValueError("a tree has one level at least")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``folded_root`` comes from the row as a tampering reader would have it (upper-case
    ASCII letters of the text made small where 3 divides the checksum of the id) and from
    the siblings as they were; ``verified`` tells whether it is the root.  The result is
    stored in the shared folder; the levels are deleted.
    """
    work = Scratch(docs.sparkSession)
    try:
        # a tree's name: nothing for a null language, else the language after a sign, which keeps the order
        tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree")
        leaves = work.stored(docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), _tampered().alias("tampered")))
        below = levels(numbered(leaves, ["doc_id", "digest"], work), ["doc_id", "tampered"], work)
        subroots = work.stored(_union([level.where("left = 1").select("tree", "digest") for level in below]))
        if subroots.isEmpty():
            root = None
            tops = subroots.select("tree", F.col("digest").alias("subroot"), F.array().cast(_PROOF).alias("proof"))
        else:
            # the tree above: one tree, its leaves named by their languages
            top_leaves = work.stored(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
            above = levels(numbered(top_leaves, ["name"], work), ["name"], work)
            root = above[-1].where("left = 1").first()["digest"]
            first = above[0].drop("digest").join(pushed(above, None, work), ["tree", "place"]).withColumn("kid", F.explode("kids"))
            tops = work.stored(first.select(F.col("kid.name").alias("tree"), F.col("kid.digest").alias("subroot"), _with_step(F.col("kid"), F.col("kids"), F.col("proof")).alias("proof")))
        proofs = pushed(below, tops.select("tree", "proof"), work)
        rows = below[0].select("tree", "place", "below", "kids").join(proofs, ["tree", "place"]).join(tops.select("tree", "subroot"), "tree")
        each = rows.withColumn("kid", F.explode("kids"))
        each = each.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), F.col("kid.tampered").alias("tampered"), "subroot", _with_step(F.col("kid"), F.col("kids"), F.col("proof")).alias("proof"))
        told = each.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
        return stored(told.withColumn("verified", F.col("folded_root") == F.col("root")))
    finally:
        work.drop()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
