"""Merkle manifest of a table: digests of rows, of the trees they form, and a proof of membership of each row.

A row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its text. Every value of the
tree column has a tree of its own, whose leaves ascend by the order column; FANOUT neighbours (the last ones: fewer, even one) become
their digest until one is left, the subroot. Subroots in the order of the tree column (null first, by bytes) become the root alike.
Digests are lowercase hex text, also where they are hashed.

Leaves are kept in aligned blocks of BLOCK. A block holds a level as one string of hex text of fixed width, so the parents of a
level are digests of its substrings, and a node's siblings are the text before and behind it within its run: a proof is these
flanks, level by level. Block roots are the leaves of the next tier, up to one block a tree. Proofs go down again: each tier's rows
meet the proof of their block, and what is above a leaf is joined to its block before the block's leaves are spread out.

Rows that are equal in tree and order ascend by their digest. Null in any column is a value of its own; a tree column without values,
empty texts and very long texts are rows like others. Rows that repeat are leaves that repeat. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finescale.llm.numbering import numbered
from finescale.llm.oracle import ALPHABET, crc32_sql, crc32_table
from finescale.llm.shared import written

FANOUT = 8
LEVELS = 3                      # of a block
BLOCK = FANOUT ** LEVELS
WIDTH = 64                      # hex digits of a digest
SEGMENTS = "array<struct<left: binary, right: binary>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parents(level: str) -> str:
    run = FANOUT * WIDTH
    return (f"CAST(array_join(transform(sequence(0, (length({level}) - 1) DIV {run}),"
            f" i -> sha2(substring({level}, CAST(i * {run} + 1 AS INT), {run}), 256)), '') AS BINARY)")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``tree, pos, n, hash`` and payload columns to one row a block: its nodes in order, its levels ``l0`` to ``l2``, their ``top``, and how
    many levels it rises: until its tree has one node, or LEVELS."""
    packed = (nodes.groupBy("tree", F.expr(f"pos DIV {BLOCK}").alias("block"))
              .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash", *payload))).alias("nodes"))
              .withColumn("depth", F.expr(f"CASE {' '.join(f'WHEN n <= {FANOUT ** k} THEN {k}' for k in range(LEVELS))} ELSE {LEVELS} END"))
              .withColumn("l0", F.expr("CAST(array_join(transform(nodes, x -> x.hash), '') AS BINARY)")))
    for k in range(LEVELS):
        packed = packed.withColumn(f"l{k + 1}", F.expr(f"IF(depth > {k}, {_parents(f'l{k}')}, NULL)"))
    root = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)]).cast("string")
    return packed.withColumn("top", root).drop(f"l{LEVELS}")


def _segments(k: int) -> str:
    """What stands before and behind node ``p`` of a block within its run, at level k."""
    own = f"shiftright(p, {3 * k})"
    start = f"({own} - {own} % {FANOUT})"
    return (f"named_struct('left', substring(l{k}, CAST({start} * {WIDTH} + 1 AS INT), CAST(({own} - {start}) * {WIDTH} AS INT)),"
            f" 'right', substring(l{k}, CAST(({own} + 1) * {WIDTH} + 1 AS INT), CAST(({start} + {FANOUT - 1} - {own}) * {WIDTH} AS INT)))")


def tiers(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of ``nodes`` (``tree, pos, n, hash``), blocks of their roots, and so on until each tree is one block."""
    found: list[DataFrame] = []
    while not found or not found[-1].filter(F.col("n") > BLOCK).isEmpty():
        found.append(written(_blocks(nodes, [] if found else payload), "tier"))
        nodes = found[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) DIV {BLOCK}").alias("n"), F.col("top").alias("hash"))
    return found


def spread_out(found: list[DataFrame], above: DataFrame, payload: list[str]) -> DataFrame:
    """Every leaf of ``tiers`` with its proof, ``path``: its flanks from the lowest level up, then those of ``above`` (``tree, path``
    and columns to carry along, one row a tree)."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for k in range(len(found) - 1, -1, -1):
        more = "".join(f", '{c}', x.{c}" for c in payload) if k == 0 else ""
        rows = found[k].join(above, ["tree", "block"])
        own = f"concat(slice(array({', '.join(_segments(j) for j in range(LEVELS))}), 1, depth), path)"
        above = rows.selectExpr("tree", *carried, f"inline(transform(nodes, (x, p) -> named_struct('block', x.pos, 'hash', x.hash, 'path', {own}{more})))")
    return above.withColumnRenamed("block", "pos")


def proven(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """``leaves`` (``tree``: not null, ``pos``, ``n``, ``hash`` and payload) with subroot, root and ``path``."""
    found = tiers(leaves, payload)
    subroots = found[-1].select("tree", F.col("top").alias("hash"))
    trees = numbered(subroots.select(F.lit("").alias("all"), "tree", "hash"), "all", ["tree"])
    top = tiers(trees.select(F.col("all").alias("tree"), "pos", "n", "hash", F.col("tree").alias("below")), ["below"])
    root = top[-1].select("tree", F.col("top").alias("root"), F.expr(f"CAST(array() AS {SEGMENTS})").alias("path"))
    above = spread_out(top, root, ["below"]).select(F.col("below").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    return spread_out(found, above, payload)


def folded(start: str, path: str = "path") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.expr(f"aggregate({path}, {start}, (node, s) -> sha2(concat(s.left, CAST(node AS BINARY), s.right), 256))")


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Every row's ``order`` column, leaf, subroot, root, digest of its proof, and the root that the proof leads to if the row's text
    were ``changed`` (default: as it is). ``verified``: that root is the true one."""
    named = [F.col(f).alias(f"f{k}") for k, f in enumerate(fields)]
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("key"),
                       *named, (F.col(text) if changed is None else changed).alias("changed"))
    now, then = leaf([F.col(f"f{k}") for k in range(len(fields))]), leaf([F.col("changed" if f == text else f"f{k}") for k, f in enumerate(fields)])
    leaves = written(rows.select("tree", "key", now.alias("hash"), then.alias("then")), "leaves")
    found = proven(numbered(leaves, "tree", ["key", "hash"]), ["key", "then"])
    proof = F.sha2(F.expr("aggregate(path, CAST('' AS BINARY), (all, s) -> concat(all, s.left, s.right))"), 256)
    found = found.select(F.col("key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                         folded("then").alias("folded_root"))
    return found.withColumn("verified", F.expr("folded_root = root"))


def without_capitals(of: str = "text", doc_id: str = "doc_id") -> Column:
    """The tampering of the contract: where 3 divides the id's crc32, a text loses its capitals A-Z."""
    given, third = F.col(of), F.crc32(F.col(doc_id).cast("string")) % 3 == 0
    only_ascii = F.octet_length(given) == F.char_length(given)
    return F.when(third & only_ascii, F.lower(given)).when(third, F.translate(given, ALPHABET.upper(), ALPHABET)).otherwise(given)


def oracle(levels: int = 9, top_levels: int = 4) -> str:
    """The contract in DuckDB SQL: level by level over whole trees of up to 8**levels leaves."""
    def lifted(name: str, group: str, count: int) -> str:
        return ",\n".join(
            f"{name}t{k} AS MATERIALIZED (SELECT {group}, p // 8 AS run, any_value(n) AS n, string_agg(h, '' ORDER BY p) AS s FROM {name}{k} WHERE n > 1 GROUP BY ALL),\n"
            f"{name}{k + 1} AS MATERIALIZED (SELECT {group}, run AS p, (n + 7) // 8 AS n, sha256(s) AS h FROM {name}t{k} UNION ALL SELECT {group}, p, n, h FROM {name}{k} WHERE n = 1)"
            for k in range(count))

    def climbed(name: str, start: str, run: str, group: str, count: int) -> str:
        place = [f"({run} // {8 ** k} % 8)::INT" for k in range(count)]
        return ",\n".join(
            f"{name}{k + 1} AS (SELECT x.* REPLACE (x.proof || coalesce(left(s, {place[k]} * 64) || substr(s, {place[k]} * 64 + 65), '') AS proof,"
            f" CASE WHEN s IS NULL THEN x.node ELSE sha256(left(s, {place[k]} * 64) || x.node || substr(s, {place[k]} * 64 + 65)) END AS node)"
            f" FROM {name if k else start}{k if k else ''} x LEFT JOIN {group}t{k} t ON t.g IS NOT DISTINCT FROM x.g AND t.run = {run} // {8 ** (k + 1)})"
            for k in range(count))

    fields = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
    changed = fields.replace("text", "lowered")
    return f"""WITH tab AS MATERIALIZED ({crc32_table()}),
given AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {crc32_sql('doc_id::VARCHAR', 'tab')} % 3 = 0
  THEN translate(text, '{ALPHABET.upper()}', '{ALPHABET}') ELSE text END AS lowered FROM documents, tab),
hashed AS (SELECT doc_id, lang, sha256({fields}) AS leaf, sha256({changed}) AS node FROM given),
d AS MATERIALIZED (SELECT lang AS g, doc_id, leaf, node, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM hashed),
a0 AS MATERIALIZED (SELECT g, pos AS p, n, leaf AS h FROM d),
{lifted("a", "g", levels)},
b AS MATERIALIZED (SELECT 1 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM a{levels}),
b0 AS MATERIALIZED (SELECT g, p, n, h FROM b),
{lifted("b", "g", top_levels)},
{climbed("c", "d", "x.pos", "a", levels)},
e AS (SELECT 1 AS g, doc_id, leaf, node, proof, b.h AS subroot, b.p AS pos FROM c{levels} x JOIN b ON b.lang IS NOT DISTINCT FROM x.g),
{climbed("f", "e", "x.pos", "b", top_levels)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified FROM f{top_levels}, b{top_levels} r"""
