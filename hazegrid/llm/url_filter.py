"""URL filter: a blocked Bloom filter of the listed URLs before an exact hash join.

A rule is ``(host, path, verdict)``. It fits its host and every subdomain when the
URL's path starts with the rule's path. For each distinct ``(host, path)`` the keys
that a rule could have are listed (host suffixes at label borders, path prefixes of
lengths that occur among the rules). The Bloom filter passes possible hits, and a
join on the key itself removes false positives.

The filter has rows ``(block, w0..w3)``: 256 bits a block, every key sets two bits in
each word of one block. It is broadcast while the number of rules proves its size,
beyond that it is joined by a shuffle on the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 256
#: Rules up to which the filter (2 bytes a rule, 40 with its row overhead a block) is broadcast.
BROADCAST_RULES = 2_000_000
#: Rules up to which the exact side is broadcast too.
BROADCAST_EXACT = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _places(key: Column, blocks: int) -> dict[str, Column]:
    """Block of a key and its mask for each of the block's four words."""
    one = F.lit(1).cast("bigint")
    places = {"block": F.pmod(F.xxhash64(key), F.lit(blocks))}
    second = F.xxhash64(key, F.lit("bits"))
    for i in range(4):
        bits = [F.pmod(F.shiftrightunsigned(second, 12 * i + 6 * j), F.lit(64)).cast("int") for j in (0, 1)]
        a, b = (F.call_function("shiftleft", one, x) for x in bits)
        places[f"w{i}"] = a.bitwiseOR(b)
    return places


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocks of the filter: each key's masks, combined with OR inside its block."""
    places = _places(F.col(key), blocks)
    rows = keys.select(*[c.alias(n) for n, c in places.items()])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path, or null) and ``verdict``.

    The longest fitting rule wins; among rules of one length the one with the longer
    host, then block before allow. Without a fitting rule the verdict is ``default``:
    what is not listed is not filtered. A null URL or one without ``://`` has empty
    host and path, which no rule fits. Rules with a null field are ignored, repeated
    rules count once. Input columns of the four names are replaced, all others kept;
    repeated pages are judged each.
    """
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(_lowered(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("key", F.concat_ws("\0", "r_host", "r_path"))
    )
    shape = listed.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("lengths")
    ).first()
    blocks = max(1, -(-shape.n * BITS_PER_KEY // BLOCK_BITS))
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*others, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = F.array(*[F.lit(n) for n in sorted(shape.lengths)]) if shape.lengths else F.array().cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    candidates = (
        judged.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("c_host"), prefixes.alias("c_paths"))
        .select("host", "path", "c_host", F.explode("c_paths").alias("c_path"))
        .select("host", "path", F.concat_ws("\0", "c_host", "c_path").alias("key"))
    )
    places = _places(F.col("key"), blocks)
    probes = candidates.select("host", "path", "key", *[c.alias(f"p_{n}") for n, c in places.items()])
    bloom = bloom_filter(listed, "key", blocks)
    if shape.n <= BROADCAST_RULES:
        bloom = F.broadcast(bloom)
    passed = probes.join(bloom, F.col("p_block") == F.col("block"))
    for i in range(4):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(F.col(f"p_w{i}")) == F.col(f"p_w{i}"))
    exact = F.broadcast(listed) if shape.n <= BROADCAST_EXACT else listed
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host"), "r_verdict"
    )
    best = (
        passed.join(exact, "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        *others,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
