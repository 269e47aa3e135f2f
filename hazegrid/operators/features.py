"""Train/test preparation. Statistics come from the train table only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.levels import labelled_bins
from hazegrid.functions.names import named
from hazegrid.operators.dictionary import Dictionary, one_hot_vectors, refuse_unknown
from hazegrid.operators.filters import require_columns
from hazegrid.operators.joins import join_lookup
from hazegrid.operators.quantiles import grouped_stats

Pair = tuple[DataFrame, DataFrame | None]

def _both(train: DataFrame, test: DataFrame | None, fn) -> Pair:
    return fn(train), fn(test) if test is not None else None


def random_split(
    df: DataFrame, test_size: float = 0.2, random_state: int = 1, key: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows drawn at random, of exact size, repeatable for one ``random_state``.

    The test part has ``ceil(test_size * n)`` of the ``n`` rows, however they are
    partitioned. Without a ``key`` each row is drawn for itself, equal rows too. With one
    rows of one key stay together, but for those of the few keys at the border of the two
    parts, which are drawn each to make the size exact; null is a value like others. With
    a key the rows are not shuffled.
    """
    if not 0 <= test_size <= 1:
        raise ValueError(f"test_size is a share, not {test_size}")
    size = f"ceil(total * {test_size!r}D)"
    if key is None:
        df = _numbered_copies(df, "__copy")
        in_test = _is_drawn(df, random_state, size)
        return df.where(~in_test).drop("__copy"), df.where(in_test).drop("__copy")
    bins = _leading(F.xxhash64(*[named(k) for k in key], F.lit(random_state)))
    spot = _spot(df.select(bins.alias("bin")), size)
    last = spot.select("bin").scalar()
    below, within = (F.coalesce(c, F.lit(False)) for c in (bins < last, bins == last))
    border = _numbered_copies(df.where(within), "__copy")
    in_test = _is_drawn(border, random_state, "(SELECT place FROM {border})", border=spot)
    return (
        df.where(~below & ~within).union(border.where(~in_test).drop("__copy")),
        df.where(below).union(border.where(in_test).drop("__copy")),
    )


#: Copies of a row that one task numbers.
_COPIES = 100_000


def _numbered_copies(df: DataFrame, name: str) -> DataFrame:
    """Equal rows told apart by the column ``name``; many copies of one row are numbered by several tasks."""
    counts = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    first = F.explode(F.expr(f"sequence(0L, __n - 1, {_COPIES}L)"))
    chunks = counts.withColumn("__first", first).hint("rebalance")
    each = F.explode(F.expr(f"sequence(__first, least(__first + {_COPIES}L, __n) - 1)"))
    return chunks.withColumn(name, each).drop("__n", "__first")


def _leading(hashed: Column) -> Column:
    """The leading 20 bits of a hash."""
    return F.shiftright(hashed, 44)


def _spot(bins: DataFrame, wanted: str) -> DataFrame:
    """``bin, place``: where the row lies that has the rank ``wanted`` by ``bin``; empty for none."""
    counts = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.selectExpr("bin", "n", "sum(n) OVER (ORDER BY bin) AS end", "sum(n) OVER () AS total")
    before = ends.selectExpr("bin", "end", "end - n AS start", f"{wanted} AS wanted")
    return before.where("start < wanted AND wanted <= end").selectExpr("bin", "CAST(wanted - start AS BIGINT) AS place")


def _is_drawn(df: DataFrame, seed: int, wanted: str, **tables: DataFrame) -> Column:
    """Whether a row, told from all others by its columns, is among the ``wanted`` smallest draws.

    Draws are counted by their leading digits, and only those of the bin in which the
    last one lies, one in a million, are put in order.
    """
    values = [named(c) for c in df.columns]
    draw = F.struct(F.xxhash64(*values, F.lit(seed)).alias("draw"), *values)
    drawn = df.select(draw.alias("draw"))
    last = drawn.sparkSession.sql(
        """
        WITH bins AS (SELECT shiftright(draw.draw, 44) AS bin, count(*) AS n FROM {drawn} GROUP BY 1),
        ends AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS end, sum(n) OVER () AS total FROM bins),
        asked AS (SELECT bin, n, end, """
        + wanted
        + """ AS wanted FROM ends),
        spot AS (SELECT struct(bin, wanted - (end - n) AS place) AS s FROM asked WHERE end - n < wanted AND wanted <= end),
        met AS (SELECT draw, (SELECT s FROM spot) AS s FROM {drawn}),
        ranked AS (SELECT draw, s.place AS place, row_number() OVER (ORDER BY draw) AS r FROM met
                   WHERE shiftright(draw.draw, 44) = s.bin)
        SELECT draw FROM ranked WHERE r = place""",
        drawn=drawn,
        **tables,
    )
    return F.coalesce(draw <= last.scalar(), F.lit(False))


def split_by(df: DataFrame, in_train: Column) -> tuple[DataFrame, DataFrame]:
    """Split by a caller's own rule."""
    return df.where(in_train), df.where(~in_train)


def temporal_split(
    df: DataFrame, train_years: Sequence[int], test_years: Sequence[int], year: str = "Year"
) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [year])
    return (
        df.where(F.col(year).isin(list(train_years))),
        df.where(F.col(year).isin(list(test_years))),
    )


def impute(
    train: DataFrame,
    test: DataFrame | None = None,
    bools: Sequence[str] = (),
    bool_fill: int | None = None,
    numbers: Sequence[str] = (),
    number_fill: float | None = None,
    texts: Sequence[str] = (),
    text_fill: str | None = None,
) -> Pair:
    """Booleans to 0/1, then fill gaps: constants, or the train mean for numbers."""
    require_columns(train, [*bools, *numbers, *texts])
    means = (
        train.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)])).scalar()
        if numbers and number_fill is None
        else None
    )

    def fill(df: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        for c in bools:
            value = F.col(c).cast("int")
            out[c] = F.coalesce(value, F.lit(bool_fill)) if bool_fill is not None else value
        for i, c in enumerate(numbers):
            gap = F.lit(number_fill) if means is None else means.getField(f"m{i}")
            out[c] = F.coalesce(F.col(c), gap)
        if text_fill is not None:
            out.update({c: F.coalesce(F.col(c), F.lit(text_fill)) for c in texts})
        return df.withColumns(out) if out else df

    return _both(train, test, fill)


def standardize(train: DataFrame, test: DataFrame | None, numbers: Sequence[str]) -> Pair:
    """``Norm f`` = (f - mean) / population deviation; a constant becomes 0."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numbers)],
        )
    ).scalar()

    def scaled(i: int, c: str) -> Column:
        mean, sd = stats.getField(f"m{i}"), stats.getField(f"s{i}")
        return (F.col(c) - mean) / F.when(sd == 0, 1.0).otherwise(sd)

    return _both(
        train,
        test,
        lambda df: df.withColumns({f"Norm {c}": scaled(i, c) for i, c in enumerate(numbers)}),
    )


def minmax_rescale(train: DataFrame, test: DataFrame | None, numbers: Sequence[str]) -> Pair:
    """``Rescaled f`` = (f - min) / (max - min) of train; null for a constant."""
    stats = train.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(numbers)],
            *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(numbers)],
        )
    ).scalar()

    def scaled(i: int, c: str) -> Column:
        lo, hi = stats.getField(f"lo{i}"), stats.getField(f"hi{i}")
        return F.try_divide(F.col(c) - lo, hi - lo)

    return _both(
        train,
        test,
        lambda df: df.withColumns({f"Rescaled {c}": scaled(i, c) for i, c in enumerate(numbers)}),
    )


#: Categories of a column that become columns of their own without being listed by the caller.
MOST_COLUMNS = 1000


def categories(df: DataFrame, column: str, most: int = MOST_COLUMNS) -> list:
    """Distinct non-null values, sorted, to name columns with; more than ``most`` are an error."""
    found = df.select(named(column)).where(named(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories, too many for a column each; use one_hot_vector")
    return sorted(r[0] for r in found)


def _indicator(column: str, value) -> Column:
    return F.coalesce((F.col(column) == F.lit(value)).cast("int"), F.lit(0))


def one_hot(
    train: DataFrame,
    test: DataFrame | None,
    columns: Sequence[str],
    prefixes: Sequence[str] | None = None,
    values: Mapping[str, Sequence] | None = None,
) -> Pair:
    """``{prefix}_{value}`` 0/1 columns for the train categories, in both tables.

    ``values`` gives the categories of a column; those of the others are looked up.
    One column for each suits few categories; ``one_hot_vector`` takes any number. The
    encoded columns are dropped. Null, or a value train lacks, is all zeros.
    """
    values = values or {}
    made = {
        f"{prefix}_{v}": _indicator(c, v)
        for c, prefix in zip(columns, prefixes or columns)
        for v in (values[c] if c in values else categories(train, c))
    }
    return _both(train, test, lambda df: df.withColumns(made).drop(*columns))


def one_hot_vector(
    train: DataFrame,
    test: DataFrame | None,
    columns: Sequence[str],
    name: str = "encoded",
) -> tuple[DataFrame, DataFrame | None, list[Dictionary]]:
    """The same as one sparse vector that classifiers read, and the dictionaries of the train table.

    Categories are numbered by stored dictionaries (``Dictionary``), so a column may have
    any number of them. Null, or a value train lacks, is all zeros.
    """
    known = [Dictionary.of(train, c) for c in columns]
    return *_both(train, test, lambda df: one_hot_vectors(df, known, name).drop(*columns)), known


def one_hot_map(
    train: DataFrame,
    test: DataFrame | None,
    columns: Sequence[str],
    prefixes: Sequence[str] | None = None,
    name: str = "encoded",
) -> Pair:
    """The same as one sparse column: a map from ``{prefix}_{value}`` to 1, absent names are 0.

    No category reaches the driver, so a column may have any number of them. Values of
    the test table are looked up among the train table's by a join.
    """
    names = dict(zip(columns, prefixes or columns))

    def encoded(df: DataFrame, known: Mapping[str, Column]) -> DataFrame:
        entries = F.array(
            *[
                F.when(known[c], F.struct(F.concat(F.lit(f"{names[c]}_"), F.col(c).cast("string")).alias("k"), F.lit(1).alias("v")))
                for c in columns
            ]
        )
        return df.withColumn(name, F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())))

    out = encoded(train, {c: F.col(c).isNotNull() for c in columns}).drop(*columns)
    if test is None:
        return out, None
    for i, c in enumerate(columns):
        found = train.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"__known{i}", F.lit(True))
        test = join_lookup(test, found, [c])
    marked = encoded(test, {c: F.coalesce(F.col(f"__known{i}"), F.lit(False)) for i, c in enumerate(columns)})
    return out, marked.drop(*columns, *[f"__known{i}" for i in range(len(columns))])


@dataclass
class OneHotEncoder:
    """Fit/transform pair; columns are named ``col_<value>``.

    Categories are kept as stored dictionaries. A value that fit has not seen, found by
    the join with them, fails the job. ``transform_vector`` takes any number of
    categories, ``transform`` as many as a table may have columns.
    """

    columns: Sequence[str]
    seen: dict[str, Dictionary] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OneHotEncoder:
        self.seen = {c: Dictionary.of(df, c) for c in self.columns}
        return self

    def _values(self) -> dict[str, list]:
        return {c: known.values(MOST_COLUMNS) for c, known in self.seen.items()}

    def new_columns(self) -> list[str]:
        return [f"{c}_<{v}>" for c, values in self._values().items() for v in values]

    def _indexed(self, df: DataFrame) -> DataFrame:
        if not self.seen:
            raise ValueError("fit the encoder first")
        for i, (c, known) in enumerate(self.seen.items()):
            df = known.attach(df, f"__c{i}").withColumn(f"__c{i}", refuse_unknown(F.col(f"__c{i}"), c))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        indexed = self._indexed(df)
        return indexed.select(
            *[
                (F.col(f"__c{i}") == k).cast("double").alias(f"{c}_<{v}>")
                for i, (c, values) in enumerate(self._values().items())
                for k, v in enumerate(values)
            ]
        )

    def transform_vector(self, df: DataFrame, name: str = "encoded") -> DataFrame:
        """``df`` with one sparse vector instead of the columns."""
        # What an unknown value fails is read with the vector.
        checked = self._indexed(df)
        known = list(self.seen.values())
        fine = F.array_min(F.array(*[F.col(f"__c{i}") for i in range(len(known))])) >= 0
        made = one_hot_vectors(checked.where(fine), known, name)
        return made.drop(*self.columns, *[f"__c{i}" for i in range(len(known))])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def quantile_bins(
    train: DataFrame,
    test: DataFrame | None,
    feature: str,
    bins: int,
    labels: Sequence | None = None,
) -> Pair:
    """``Discrete f``: equally filled bins of train, lowest value included.

    Both tables use the train edges. Equal edges are an error, raised by the job.
    """
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    row = grouped_stats(train, [], feature, stats=(), quantiles=names)
    edges = row.select(F.struct(*names).alias("e")).scalar()
    at = [F.col(f"__edges.{n}") for n in names]
    doubled = reduce(lambda a, b: a | b, [lo == hi for lo, hi in zip(at[:-1], at[1:])])
    x = F.col(feature)
    first = F.lit(0 if labels is None else labels[0])
    refused = F.raise_error(F.lit("bin edges must be unique")).cast(
        "int" if labels is None else "string"
    )
    label = (
        F.when(doubled, refused).when(x == at[0], first).otherwise(labelled_bins(x, at, labels))
    )
    # The edges are one column first, so the many comparisons share one subquery.
    return _both(
        train,
        test,
        lambda df: df.withColumn("__edges", edges)
        .withColumn(f"Discrete {feature}", label)
        .drop("__edges"),
    )


def width_bins(
    train: DataFrame,
    test: DataFrame | None,
    feature: str,
    bins: int | Sequence[float],
    labels: Sequence | None = None,
    right: bool = True,
) -> Pair:
    """``Discrete f``: equal-width bins of each table's own range, or explicit edges.

    With a number of bins the open end of the range is moved out by 0.1 % so that
    the extreme value is inside.
    """
    x = F.col(feature)

    def binned(df: DataFrame) -> DataFrame:
        if not isinstance(bins, int):
            edges: list = list(bins)
        else:
            span = df.agg(
                F.struct(
                    F.min(feature).cast("double").alias("lo"),
                    F.max(feature).cast("double").alias("hi"),
                )
            ).scalar()
            lo, hi = span.getField("lo"), span.getField("hi")
            edges = [lo + (hi - lo) * i / bins for i in range(1, bins)]
            out = (hi - lo) * 0.001
            edges = [lo - out if right else lo, *edges, hi if right else hi + out]
        return df.withColumn(f"Discrete {feature}", labelled_bins(x, edges, labels, right))

    return _both(train, test, binned)


def prepare_train_test(
    train: DataFrame,
    test: DataFrame | None,
    numbers: Sequence[str],
    texts: Sequence[str],
    bools: Sequence[str] = (),
    bool_fill: int | None = None,
) -> Pair:
    """Fill gaps, standardize numbers, one-hot the categories."""
    train, test = impute(train, test, bools=bools, bool_fill=bool_fill, numbers=numbers)
    train, test = standardize(train, test, numbers)
    return one_hot(train, test, texts)


def temporal_train_test(
    df: DataFrame,
    train_years: Sequence[int],
    test_years: Sequence[int],
    numbers: Sequence[str],
    texts: Sequence[str],
    year: str = "Year",
) -> Pair:
    train, test = temporal_split(df, train_years, test_years, year)
    return prepare_train_test(train, test, numbers, texts)
