"""A Merkle manifest of a dataset with parent-preimage paths.

Every parent keeps its preimage: the hashes of its children (three at most, 64 characters each) one after another.  A
leaf joins the preimages of its ancestors, bottom up; cutting its own 64 characters out of a preimage leaves its
siblings, and putting another hash into that place and hashing folds a replacement up to the root.

Leaves of a source ascend by doc_id, and sources by name, each source's tree ending in a subroot and the subroots' tree
in the root.  Neither is numbered in one task: rows are sorted over ranges, and a range's numbers start after what the
ranges before it hold of the same source.  A tree grows by blocks: STEPS levels over RUN ** STEPS neighbouring nodes are one
group of bounded size, whose top is a node of the next pass, so a tree of n leaves takes log(n) / log(RUN ** STEPS)
passes.  Paths go down the same way: a block joins the block above it, and leaves join their own block, which has the
ancestors beyond it already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, placed

#: Children of a parent, and characters of a digest.
RUN, DIGEST = 3, 64
#: Levels that one group holds: 243 nodes and their ancestors, some 23 KB of preimages.
STEPS = 5
SPAN = RUN**STEPS
#: The columns of a row that its leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
_INTEGERS = ("doc_id", "n_chars")
_PATH = "array<struct<slot int, preimage string>>"


def leaf_hash(row: dict[str, Column]) -> Column:
    """SHA-256 in lowercase hex of a row's COVERED columns: ``-`` for null, else UTF-8 byte count, ``:`` and value."""

    def part(name):
        value = (row[name].cast("long") if name in _INTEGERS else row[name]).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, COVERED)), 256)


def siblings(path: Column) -> Column:
    """The sibling hashes along a path, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(_before(p), _after(p))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to: it takes its slot in the lowest preimage, whose hash takes the next."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(_before(p), h, _after(p)), 256))


def _before(p: Column) -> Column:
    return F.substring(p["preimage"], F.lit(1), p["slot"] * DIGEST)


def _after(p: Column) -> Column:
    return F.substring(p["preimage"], (p["slot"] + 1) * DIGEST + 1, F.lit(RUN * DIGEST))


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Passes over ``k, i, n, hash`` (n nodes for each key k): their blocks ``k, b, n, preimages, top``, and ``k, hash``
    of the trees' tops.

    ``preimages`` has a block's levels from below; a pass over keys of at most SPAN nodes is their last.
    """
    powers = [RUN**j for j in range(40)]
    levels = F.least(F.lit(STEPS), F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < F.col("n"))))

    def step(state, _):
        preimages = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(state["h"]) - 1) / RUN).cast("int")),
            lambda j: F.array_join(F.slice(state["h"], j * RUN + 1, F.lit(RUN)), ""),
        )
        # bound once, as a one-element array
        return F.transform(F.array(preimages), lambda p: F.struct(F.transform(p, lambda x: F.sha2(x, 256)).alias("h"), F.array_append(state["p"], p).alias("p")))[0]

    empty = F.expr("CAST(array() AS array<array<string>>)")
    passes, tops = [], []
    while True:
        blocks = nodes.groupBy("k", F.expr(f"i div {SPAN}").alias("b")).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "hash"))), lambda x: x["hash"]).alias("h"))
        state = F.aggregate(F.slice(F.array(*map(F.lit, range(STEPS))), F.lit(1), levels), F.struct(F.col("h").alias("h"), empty.alias("p")), step)
        blocks = materialise(blocks.withColumn("state", state).select("k", "b", "n", F.col("state.p").alias("preimages"), F.col("state.h")[0].alias("top")))
        passes.append(blocks)
        tops.append(blocks.where(f"n <= {SPAN}").select("k", F.col("top").alias("hash")))
        nodes = blocks.where(f"n > {SPAN}").select("k", F.col("b").alias("i"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("top").alias("hash"))
        if nodes.isEmpty():
            break
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return passes, out


def _along(place: str) -> Column:
    """The path of the node at a place, from its block's preimages and the path beyond it."""
    c = F.col(place) % SPAN
    powers = F.array(*[F.lit(RUN**j) for j in range(STEPS + 1)])

    def step(level, j):
        up = lambda by: F.floor(c / by).cast("int")
        return F.struct((up(F.get(powers, j)) % RUN).cast("int").alias("slot"), F.get(level, up(F.get(powers, j + 1))).alias("preimage"))

    return F.concat(F.transform("preimages", step), "path").cast(_PATH)


def _climbed(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks ``k, b, preimages`` with the ``path`` beyond them, and what else ``above`` has for a key
    (``k, path`` of the tree's top and more)."""
    more = [c for c in above.columns if c not in ("k", "path")]
    upper = None
    for blocks in reversed(passes):
        blocks = blocks.select("k", "b", "n", "preimages")
        found = blocks.where(f"n <= {SPAN}").join(above, "k").select("k", "b", "preimages", "path", *more)
        if upper is not None:
            lower = blocks.where(f"n > {SPAN}").select("k", "b", F.expr(f"b div {SPAN}").alias("ub"), F.col("preimages").alias("own"))
            beyond = upper.withColumnRenamed("b", "ub")
            lower = lower.join(beyond, ["k", "ub"]).select("k", "b", F.col("own").alias("preimages"), _along("b").alias("path"), *more)
            found = found.unionByName(lower)
        upper = materialise(found)
    return upper


def _paths(nodes: DataFrame, passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes with their paths and what else ``above`` has."""
    at = nodes.withColumn("b", F.expr(f"i div {SPAN}"))
    return at.join(_climbed(passes, above), ["k", "b"]).withColumn("path", _along("i")).drop("b", "preimages")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path`` for each row of documents, and the columns of ``carry``.

    ``path`` has the ancestors' preimages from the leaf to the root, each with the slot that the path takes in it; a
    lone leaf, or a lone source, has none at that level.  A null doc_id comes before any other; rows that repeat a
    doc_id ascend by leaf, and equal rows get neighbouring places in any order.  Null and empty values differ, null
    sources are a source of their own (the first); an empty table gives no rows; other columns are not covered.
    """
    carry = carry or {}
    covered = {c: F.col(c) for c in COVERED}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("k"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(covered).alias("hash"),
        *[c.alias(f"carry{j}") for j, c in enumerate(carry.values())],
    )
    leaves = placed(materialise(rows), "k", ["doc_id", "hash"])
    trees, subroots = _grow(leaves.select("k", "i", "n", "hash"))
    subroots = subroots.select(F.lit("").alias("k"), F.col("k").alias("of"), "hash")
    sources = placed(materialise(subroots), "k", ["of"])
    crown, root = _grow(sources.select("k", "i", "n", "hash"))
    found = root.first()
    nothing = sources.sparkSession.createDataFrame([("", [])], f"k string, path {_PATH}")
    above = _paths(sources, crown, F.broadcast(nothing)).select(F.col("of").alias("k"), "path", F.col("hash").alias("subroot"))
    out = _paths(leaves, trees, materialise(above))
    source = F.when(F.col("k") != "", F.substring("k", F.lit(2), F.length("k")))
    return out.select(
        "doc_id", source.alias("source"), F.col("hash").alias("leaf"), "subroot", F.lit(found["hash"] if found else None).cast("string").alias("root"), "path",
        *[F.col(f"carry{j}").alias(name) for j, name in enumerate(carry)],
    )


def audit(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` and ``source, tampered`` of each row, after a
    tampering that deletes the line ends of texts whose id has an even CRC-32.

    A null doc_id is not tampered with; else as in ``manifest``.
    """
    covered = {c: F.col(c) for c in COVERED}
    changed = leaf_hash(covered | {"text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))})
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0, F.lit(False))
    rows = manifest(docs, {"changed": F.when(chosen, changed), "tampered": chosen})
    rows = rows.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "tampered")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i::BIGINT))"
ORACLE_SQL = f"""
WITH RECURSIVE
crc AS (SELECT {_CRC_TABLE} AS t),
part AS (SELECT row_number() OVER () AS rid, doc_id, source, text,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
                coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS d FROM documents),
even AS (SELECT rid, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
                                     lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 2 = 0 AS tampered FROM part, crc WHERE doc_id IS NOT NULL),
cut AS (SELECT part.*, coalesce(tampered, false) AS tampered, replace(text, chr(10), '') AS less FROM part LEFT JOIN even USING (rid)),
hashed AS (SELECT *, sha256(a || b || c || d || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(a || b || c || d || coalesce(strlen(less) || ':' || less, '-')) AS changed FROM cut),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
tree AS (
  SELECT source, 0 AS lvl, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, i // 3, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, i, subroot AS h, n FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY lvl, i // 3, n),
runs AS (SELECT coalesce('s' || source, '') AS k, lvl, i // 3 AS up, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY ALL
         UNION ALL SELECT 'crown', lvl, i // 3, list(h ORDER BY i) FROM crown WHERE n > 1 GROUP BY ALL),
low AS (
  SELECT rid, coalesce('s' || source, '') AS k, source, 0 AS lvl, i, CASE WHEN tampered THEN changed ELSE leaf END AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT rid, low.k, source, low.lvl + 1, i // 3, sha256(array_to_string(list_concat(hs[:i % 3], [h], hs[i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '')
  FROM low JOIN runs ON runs.k = low.k AND runs.lvl = low.lvl AND runs.up = low.i // 3),
high AS (
  SELECT rid, 0 AS lvl, subs.i, h, proof FROM (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1) AS low JOIN subs ON subs.source IS NOT DISTINCT FROM low.source
  UNION ALL
  SELECT rid, high.lvl + 1, i // 3, sha256(array_to_string(list_concat(hs[:i % 3], [h], hs[i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:i % 3], hs[i % 3 + 2:]), '')
  FROM high JOIN runs ON runs.k = 'crown' AND runs.lvl = high.lvl AND runs.up = high.i // 3),
ends AS (SELECT rid, h, proof FROM high QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified, leaves.source, tampered
FROM leaves JOIN ends USING (rid) JOIN subs ON subs.source IS NOT DISTINCT FROM leaves.source, (SELECT h AS root FROM crown WHERE n = 1)"""
