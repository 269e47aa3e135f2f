"""Exact grouped statistics that stay distributed when one group is huge.

``percentile`` keeps the distinct values of a group in one task's memory, which is
wrong for a key that holds a third of a table. Here the same way serves every size, a
selection by leading digits:

* A value's bin is its sign and the leading digits of its logarithm: a rising function
  of the value that needs no look at the data, about a million bins for each factor of e.
* Rows fold to ``(keys, value, count)``, so copies combine map-side. Groups of at most
  ``SMALL`` distinct values are sorted, each in one task, and their ranks looked up.
* The rows of all larger groups are dealt by keys *and* bin, so a hot key spreads over all tasks.
* Only bin totals, never values, meet by key, by leading digits of the bin first. They say which bin holds a wanted rank. A
  bin of one distinct value, as nearly all are, answers at once; only from the others
  that hold a wanted rank are values picked, where they already lie.

Planning starts no job, and the values move twice: to be folded, and to their group or bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named

BANDS = 8 * 8 * 16

MEDIAN = {"median": 0.5}


def not_null(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & named(k).isNotNull()
    return cond


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    stats: Sequence[str] = ("mean", "max", "sum", "count"),
    quantiles: Mapping[str, float] = MEDIAN,
    carry: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Per group: the named quantiles (linear interpolation) and statistics.

    Rows with a null key are dropped. ``count`` counts rows including null
    values, ``sum`` of nothing is 0, the others are null when nothing is there.
    ``carry`` names further aggregates made in the same passes, each a pair of
    ``"sum"``, ``"min"`` or ``"max"`` and the per-row column it takes.
    """
    carry = dict(carry or {})
    rows = df.where(not_null(keys)).select(
        *[named(k) for k in keys],
        named(value).cast("double").alias("__v"),
        F.lit(1).cast("bigint").alias("__c"),
        *[c.alias(name) for name, (_, c) in carry.items()],
    )
    folds = {name: fn for name, (fn, _) in carry.items()}
    return stats_of_counts(rows, keys, stats, quantiles, folds)


def stats_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    stats: Sequence[str],
    quantiles: Mapping[str, float],
    folds: Mapping[str, str] | None = None,
) -> DataFrame:
    """``grouped_stats`` of rows ``(keys, __v, __c)`` that stand for ``__c`` readings."""
    keys, folds = list(keys), dict(folds or {})
    if quantiles:
        return _selected(counts, keys, stats, quantiles, folds)
    by = [f"`{k}`" for k in keys]
    return counts.groupBy(*by).agg(*[F.expr(x) for x in _plain(stats, folds)])


def _plain(stats: Sequence[str], folds: Mapping[str, str]) -> list[str]:
    made = {
        "mean": "try_divide(sum(__v * __c), sum(if(__v IS NULL, 0, __c)))",
        "max": "max(__v)",
        "min": "min(__v)",
        "sum": "coalesce(sum(__v * __c), 0D)",
        "count": "sum(__c)",
    }
    return [f"{made[s]} AS `{s}`" for s in stats] + [
        f"{fn}(`{name}`) AS `{name}`" for name, fn in folds.items()
    ]


def _with_bands(table: str, col: str, every: Sequence[str], none: str = "-1") -> str:
    """SQL adding ``__band``: equally filled bands of ``col`` over all rows; ``none`` for null.

    The bounds ascend, so a value's band is the number of bounds at or below it.
    It is counted in three steps, every 128th, every 16th and then each bound, to
    compare with 29 bounds and not with all of them. The bounds are one column of one
    subquery. It also returns ``every`` column of the table, so that the table is not
    computed once more with fewer columns.
    """
    kept = ", ".join(f"max({c})" for c in every)
    # The shares have to be a constant, which a lambda is not.
    shares = f"array({', '.join(f'{i / BANDS!r}D' for i in range(1, BANDS))})"
    bounds = f"""(
        SELECT struct(
          transform(sequence(1, 7), j -> b[128 * j - 1]) AS few,
          transform(sequence(0, 7), i -> transform(sequence(1, 7), j -> b[128 * i + 16 * j - 1])) AS some,
          transform(sequence(0, 63), i -> transform(sequence(1, 15), j -> b[16 * i + j - 1])) AS each, kept)
        FROM (SELECT percentile_approx({col}, {shares}, 10000) AS b,
                     struct({kept}) AS kept FROM {table}))"""
    steps = f"array(size(filter(__bounds.few, b -> b <= {col})))"
    for level, fan in (("some", 8), ("each", 16)):
        step = f"k * {fan} + size(filter(__bounds.{level}[k], b -> b <= {col}))"
        steps = f"transform({steps}, k -> {step})"
    # Never null, or a join on the band would first test every row for it.
    return f"""SELECT * EXCEPT (__bounds), if({col} IS NULL, {none}, coalesce({steps}[0], 0)) AS __band
               FROM (SELECT *, {bounds} AS __bounds FROM {table})"""


#: Bins for each factor of e: two values in one differ by less than a millionth.
DIGITS = 2**20


def _bin(v: str) -> str:
    """SQL of a value's bin. It never falls as the value rises; null for null, NaN is last."""
    # The logarithm of the smallest double is above -746; an infinite value shares the largest one's bin.
    size = f"int(floor((ln(least(abs({v}), 1.7976931348623157E308D)) + 746) * {DIGITS}))"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN isnan({v}) THEN {2**31 - 1} WHEN {v} = 0 THEN 0 ELSE int(sign({v})) * {size} END"


#: Bins of one head. Only heads, some thousands for a key, are added up in one task.
HEAD_BITS = 10


def _head(b: str) -> str:
    """SQL of a bin's leading digits, which rise with it; never null, and null comes first."""
    return f"coalesce(shiftright({b}, {HEAD_BITS}), {-(2**31)})"


#: Most distinct values of a group that is sorted in one task.
SMALL = 20_000


def _selected(
    rows: DataFrame,
    keys: list[str],
    stats: Sequence[str],
    quantiles: Mapping[str, float],
    folds: Mapping[str, str],
) -> DataFrame:
    """Fold; small groups sorted; of the others totals of the bins, ranks, and picks from the bins that hold them."""
    # A constant stands for no keys, so that the same joins and windows serve.
    rows, groups = (rows, keys) if keys else (rows.withColumn("__all", F.lit(1)), ["__all"])
    by = ", ".join(f"`{k}`" for k in groups)
    folded = "".join(f", {fn}(`{name}`) AS `{name}`" for name, fn in folds.items())
    whole = {
        "__total": "sum(__n)",
        "__count": "sum(__rows)",
        "__sum": "sum(__s)",
        "__min": "min(__lo)",
        "__max": "max(__hi)",
        **{f"__all_{name}": f"{fn}(`{name}`)" for name, fn in folds.items()},
    }
    totals = ", ".join(f"{fn} OVER (PARTITION BY {by}) AS `{name}`" for name, fn in whole.items())
    picks, finals, asks = [f"max(`{x}`) AS `{x}`" for x in whole], [], []
    # A small group's columns, named as those of ``met``.
    plain = {"__total": "max(__all)", "__count": "sum(__c)", "__sum": "sum(__v * __c)", "__min": "min(__v)", "__max": "max(__v)"}
    sorted_ = [f"{x} AS `{name}`" for name, x in plain.items()] + [f"{fn}(`{name}`) AS `__all_{name}`" for name, fn in folds.items()]
    for i, (name, p) in enumerate(quantiles.items()):
        spot = f"({float(p)!r}D * (__total - 1))"
        for j, rank in enumerate((f"floor({spot})", f"ceil({spot})")):
            pick = 2 * i + j
            asks.append(f"named_struct('pick', {pick}, 'rank', {rank} - __before)")
            hit = f"__lo = __hi AND __before <= {rank} AND {rank} < __before + __n"
            picks.append(f"max(if({hit}, __lo, NULL)) AS __k{pick}")
            at = rank.replace("__total", "__all")
            hit = f"__end - __n <= {at} AND {at} < __end"
            sorted_.append(f"max(if({hit}, __v, NULL)) AS __k{pick}, CAST(NULL AS DOUBLE) AS __p{pick}")
        low, high = (f"coalesce(__k{2 * i + j}, __p{2 * i + j})" for j in (0, 1))
        share = f"({spot} - floor({spot}))"
        # Equal ends stay as they are, so that an infinite value is not multiplied by zero.
        finals.append(f"if({low} = {high} OR {share} = 0, {low}, {low} * (1 - {share}) + {high} * {share}) AS `{name}`")
    made = {
        "mean": "try_divide(__sum, __total)",
        "max": "__max",
        "min": "__min",
        "sum": "coalesce(__sum, 0D)",
        "count": "coalesce(__count, 0L)",
    }
    finals += [f"{made[s]} AS `{s}`" for s in stats]
    finals += [f"`__all_{name}` AS `{name}`" for name in folds]
    later = ", ".join(f"max(if(pick = {k}, __v, NULL)) AS __p{k}" for k in range(2 * len(quantiles)))
    same = " AND ".join(f"known.`{k}` = picked.`{k}`" for k in groups)
    names = [*(f"known.`{k}`" for k in groups), *(f"`{x}`" for x in whole), *(f"__k{k}, __p{k}" for k in range(2 * len(quantiles)))]
    # Each column of the folded rows is counted, so that all uses of them share one shuffle.
    size = f"greatest({', '.join(f'count({c})' for c in ['__c', *(f'`{name}`' for name in folds)])})" if folds else "count(__c)"
    large = " AND ".join(f"counts.`{k}` = large.`{k}`" for k in groups)
    ordered = f"PARTITION BY {by} ORDER BY __v ROWS BETWEEN UNBOUNDED PRECEDING AND"
    few = f"""
        UNION ALL
        SELECT {by}, {", ".join(sorted_)} FROM (
          SELECT *, sum(__n) OVER ({ordered} CURRENT ROW) AS __end, sum(__n) OVER ({ordered} UNBOUNDED FOLLOWING) AS __all
          FROM (SELECT *, if(__v IS NULL, 0, __c) AS __n FROM marked WHERE NOT __large))
        GROUP BY {by}"""
    # At most one group for each SMALL rows is sent to all tasks. Without keys there is one group, which is not sorted.
    marked = f"""
        large AS (SELECT {by}, {size} AS __size FROM counts GROUP BY {by} HAVING {size} > {SMALL}),
        marked AS (
          SELECT /*+ BROADCAST(large) */ counts.*, large.__size IS NOT NULL AS __large FROM large RIGHT JOIN counts ON {large}),
        many AS (SELECT * EXCEPT (__large), {_bin("__v")} AS __bin FROM marked WHERE __large),"""
    if not keys:
        few, marked = "", f"many AS (SELECT *, {_bin('__v')} AS __bin FROM counts),"
    met = f"SELECT {', '.join(names)} FROM known LEFT JOIN picked ON {same} {few}"
    # Without keys there is one row even of an empty table.
    last = f"SELECT {by}, {', '.join(finals)} FROM met"
    if not keys:
        columns = [*whole, *(f"__{x}{k}" for k in range(2 * len(quantiles)) for x in "kp")]
        # One row each, added below each other: a join by a constant would be a nested loop.
        later_names = {f"__p{k}" for k in range(2 * len(quantiles))}
        met = " UNION ALL ".join(
            f"SELECT {', '.join(f'`{c}`' if (c in later_names) == late else f'NULL AS `{c}`' for c in columns)} FROM {side}"
            for side, late in (("known", False), ("picked", True))
        )
        last = f"SELECT {', '.join(finals)} FROM (SELECT {', '.join(f'max(`{c}`) AS `{c}`' for c in columns)} FROM met)"
    return rows.sparkSession.sql(
        f"""
        WITH counts AS (
          SELECT {by}, __v, sum(__c) AS __c {folded} FROM {{rows}} GROUP BY {by}, __v),
        {marked}
        dealt AS (SELECT /*+ REPARTITION({by}, __bin) */ * FROM many),
        bins AS (
          SELECT {by}, __bin, sum(if(__v IS NULL, 0, __c)) AS __n, sum(__c) AS __rows,
                 sum(__v * __c) AS __s, min(__v) AS __lo, max(__v) AS __hi {folded}
          FROM dealt GROUP BY {by}, __bin),
        heads AS (
          SELECT {by}, {_head("__bin")} AS __head, sum(__n) AS __n, sum(__rows) AS __rows,
                 sum(__s) AS __s, min(__lo) AS __lo, max(__hi) AS __hi {folded}
          FROM bins GROUP BY {by}, {_head("__bin")}),
        tops AS (
          SELECT {by}, __head, {totals}, coalesce(sum(__n) OVER (
                 PARTITION BY {by} ORDER BY __head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __under
          FROM heads),
        placed AS (
          SELECT bins.*, {', '.join(f'tops.`{name}`' for name in whole)}, __under + coalesce(sum(bins.__n) OVER (
                 PARTITION BY {', '.join(f'bins.`{k}`' for k in groups)}, tops.__head
                 ORDER BY bins.__bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before
          FROM bins JOIN tops ON {' AND '.join(f'bins.`{k}` = tops.`{k}`' for k in groups)}
                             AND {_head("bins.__bin")} = tops.__head),
        known AS (SELECT {by}, {", ".join(picks)} FROM placed GROUP BY {by}),
        asked AS (
          SELECT {by}, __bin, filter(array({", ".join(asks)}), a -> 0 <= a.rank AND a.rank < __n) AS __asks
          FROM placed WHERE __lo <> __hi),
        ranked AS (
          SELECT {by}, __v, __c, __asks,
                 sum(__c) OVER (PARTITION BY {by}, __bin ORDER BY __v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __end
          FROM dealt JOIN (SELECT * FROM asked WHERE size(__asks) > 0) USING ({by}, __bin)),
        picked AS (
          SELECT {by}, {later} FROM (
            SELECT {by}, __v, inline(filter(__asks, a -> __end - __c <= a.rank AND a.rank < __end)) FROM ranked)
          GROUP BY {by}),
        met AS ({met})
        {last}""",
        rows=rows,
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Row position (from 0) inside each group, in the order of a unique column.

    A plain ``row_number`` would sort a whole group in one task. Here each group
    is cut into bands of the order column, and band offsets are added back. Rows with
    a null key are a group of their own; rows without an order value come first, in
    any order.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    every = [f"`{c}`" for c in df.columns]
    # Rows without an order value are dealt to bands below all others.
    none = f"int(-1 - pmod(xxhash64({', '.join(every)}), {BANDS}))"
    same = " AND ".join(f"banded.`{k}` <=> offsets.`{k}`" for k in [*keys, "__band"])
    return df.sparkSession.sql(
        f"""WITH source AS (SELECT * FROM {{df}}),
            banded AS ({_with_bands("source", f"`{order}`", [f"`{order}`"], none)}),
            offsets AS (
              SELECT {by}, __band, coalesce(sum(__n) OVER (PARTITION BY {by} ORDER BY __band
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before
              FROM (SELECT {by}, __band, count(1) AS __n FROM banded GROUP BY {by}, __band))
            SELECT {", ".join(every)}, __before - 1
                   + row_number() OVER (PARTITION BY {by}, __band ORDER BY `{order}`) AS `{name}`
            FROM (SELECT banded.*, __before FROM banded JOIN offsets ON {same})""",
        df=df,
    )
