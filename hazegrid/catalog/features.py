"""Feature preparation and classifiers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazegrid.catalog import register
from hazegrid.catalog import tables as D
from hazegrid.catalog.tables import with_tables
from hazegrid.operators import features as M
from hazegrid.operators.models import fit_model, predict, score_model
from hazegrid.session import new_path

TRAIN_YEARS, TEST_YEARS = [1995, 1996, 1997, 1998, 1999], [2000, 2001]
KEY = ["l_orderkey", "l_linenumber"]


def items(spark, d):
    """Line items with gaps in quantity and return flag, and a boolean."""
    li = D.table(spark, d, "lineitem")
    gap = F.col("l_orderkey") % 11 == 0
    return li.select(
        *KEY,
        F.when(~gap, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(~gap, F.col("l_returnflag")).alias("l_returnflag"),
        F.when(~gap, F.col("l_discount") > 0.05).alias("discounted"),
        F.year("l_shipdate").alias("Year"),
    )


def halves(spark, d):
    return M.temporal_split(items(spark, d), TRAIN_YEARS, TEST_YEARS)


def both(train, test):
    """Both tables in one, marked, so one query shows what happened to each."""
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


ITEMS = {
    "items": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS l_quantity,
                  l_extendedprice, CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag,
                  CASE WHEN l_orderkey % 11 <> 0 THEN l_discount > 0.05 END AS discounted,
                  year(l_shipdate)::INTEGER AS "Year" FROM lineitem""",
    "train": 'SELECT * FROM items WHERE "Year" BETWEEN 1995 AND 1999',
    "parts": """SELECT *, CASE WHEN "Year" <= 1999 THEN 'train' ELSE 'test' END AS part FROM items
                WHERE "Year" BETWEEN 1995 AND 2001""",
}


def _sql(body: str, **more: str) -> str:
    return with_tables("", body, **ITEMS, **more)


# A fixed arithmetic rule, so that both engines draw the same rows.
_DRAW = "(l_orderkey * 7919 + l_linenumber) % 100 < 80"


@register(
    "split_by",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN {_DRAW} THEN 'train' ELSE 'test' END AS part FROM lineitem""",
)
def split_by(spark, d):
    rows = D.table(spark, d, "lineitem").select(*KEY)
    return both(*M.split_by(rows, F.expr(_DRAW)))


def _counted(df):
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _differing(a, b):
    return _counted(a.exceptAll(b)) + _counted(b.exceptAll(a))


@register(
    "random_split",
    """SELECT l_quantity, l_returnflag, count(*) AS n, (SELECT ceil(count(*) * 0.3)::BIGINT FROM lineitem) AS n_test,
              TRUE AS repeated, TRUE AS seeds_differ, TRUE AS spread FROM lineitem GROUP BY ALL""",
)
def random_split(spark, d):
    """Rows of which many are equal, drawn each: exact size, whatever the partitions, and the table again."""
    rows = D.table(spark, d, "lineitem").select("l_quantity", "l_returnflag")
    train, test = M.random_split(rows, 0.3, 7)
    _, again = M.random_split(rows.repartition(5), 0.3, 7)
    _, other = M.random_split(rows, 0.3, 8)
    shares = both(train, test).groupBy("l_quantity", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("part") == "test").cast("int")).alias("share")
    )
    return shares.select(
        "l_quantity",
        "l_returnflag",
        "n",
        _counted(test).alias("n_test"),
        (_differing(test, again) == 0).alias("repeated"),
        (_differing(test, other) > 0).alias("seeds_differ"),
        # Copies of a row are not drawn together.
        ((F.col("n") < 40) | F.col("share").between(0.05, 0.7)).alias("spread"),
    )


@register(
    "random_split_hashed",
    """SELECT l_orderkey, l_linenumber, (SELECT ceil(count(*) * 0.3)::BIGINT FROM lineitem) AS n_test,
              TRUE AS repeated, TRUE AS seeds_differ FROM lineitem""",
)
def random_split_hashed(spark, d):
    """The draw by a key: exact size, two parts make up the table, one seed repeats its draw."""
    rows = D.table(spark, d, "lineitem").select(*KEY)
    (train, test), (_, again), (_, other) = (M.random_split(rows, 0.3, seed, KEY) for seed in (7, 7, 8))
    return both(train, test).select(
        *KEY,
        _counted(test).alias("n_test"),
        (_differing(test, again) == 0).alias("repeated"),
        (_differing(test, other) > 0).alias("seeds_differ"),
    )


_VECTORS = """
    WITH train AS (SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0),
    parts AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i FROM (SELECT DISTINCT l_partkey FROM train)),
    flags AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 + (SELECT count(*) FROM parts) AS i
              FROM (SELECT DISTINCT l_returnflag FROM train))"""


@register(
    "one_hot_vector",
    f"""{_VECTORS}
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN 'train' ELSE 'test' END AS part,
               (SELECT count(*) FROM parts) + (SELECT count(*) FROM flags) AS size, concat_ws(',', p.i, f.i) AS ones
        FROM lineitem l LEFT JOIN parts p USING (l_partkey) LEFT JOIN flags f USING (l_returnflag)""",
)
def one_hot_vector(spark, d):
    """Sparse vectors over more categories than a table could have columns; test has some that train lacks."""
    rows = D.table(spark, d, "lineitem").select(*KEY, "l_partkey", "l_returnflag")
    train, test = M.split_by(rows, F.expr("l_orderkey % 3 <> 0"))
    made = both(*M.one_hot_vector(train, test, ["l_partkey", "l_returnflag"])[:2])
    # A sparse vector as text is (size,[indices],[ones]).
    text = F.col("encoded").cast("string")
    size = F.regexp_extract(text, r"^\((\d+),", 1).cast("bigint")
    return made.select(*KEY, "part", size.alias("size"), F.regexp_extract(text, r"\[([^\]]*)\]", 1).alias("ones"))


@register("one_hot_encoder_vector", """
    WITH parts AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i FROM (SELECT DISTINCT l_partkey FROM lineitem))
    SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM parts) AS size, i::VARCHAR AS ones FROM lineitem JOIN parts USING (l_partkey)""")
def one_hot_encoder_vector(spark, d):
    """Fit and transform over the part numbers."""
    rows = D.table(spark, d, "lineitem").select(*KEY, "l_partkey")
    text = F.col("encoded").cast("string")
    made = M.OneHotEncoder(["l_partkey"]).fit(rows).transform_vector(rows)
    size = F.regexp_extract(text, r"^\((\d+),", 1).cast("bigint")
    return made.select(*KEY, size.alias("size"), F.regexp_extract(text, r"\[([^\]]*)\]", 1).alias("ones"))


@register(
    "one_hot_map",
    """WITH train AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0)
       SELECT o_orderkey, 'train' AS part, 'cust_' || o_custkey || ',status_' || o_orderstatus AS encoded FROM train
       UNION ALL SELECT o_orderkey, 'test', concat_ws(',', CASE WHEN o_custkey IN (SELECT o_custkey FROM train)
                  THEN 'cust_' || o_custkey END, 'status_' || o_orderstatus)
       FROM orders WHERE o_orderkey % 3 = 0""",
)
def one_hot_map(spark, d):
    """More categories than a table could have columns; the test table has some that train lacks."""
    orders = D.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    train, test = orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 = 0")
    made = both(*M.one_hot_map(train, test, ["o_custkey", "o_orderstatus"], ["cust", "status"]))
    return made.withColumn("encoded", F.array_join(F.array_sort(F.map_keys("encoded")), ","))


@register("temporal_split", _sql('SELECT l_orderkey, l_linenumber, "Year", part FROM parts'))
def temporal_split(spark, d):
    return both(*halves(spark, d)).select(*KEY, "Year", "part")


@register(
    "impute",
    _sql(
        """SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT avg(l_quantity) FROM train)) AS l_quantity,
                  l_extendedprice, coalesce(l_returnflag, 'none') AS l_returnflag,
                  coalesce(discounted::INTEGER, 0) AS discounted, "Year", part FROM parts"""
    ),
    {"l_quantity": 6},
)
def impute(spark, d):
    return both(
        *M.impute(
            *halves(spark, d),
            bools=["discounted"],
            bool_fill=0,
            numbers=["l_quantity", "l_extendedprice"],
            texts=["l_returnflag"],
            text_fill="none",
        )
    )


@register(
    "standardize",
    _sql(
        """SELECT l_orderkey, l_linenumber, part,
             (l_quantity - (SELECT avg(l_quantity) FROM train)) / (SELECT stddev_pop(l_quantity) FROM train)
               AS "Norm l_quantity",
             (l_extendedprice - (SELECT avg(l_extendedprice) FROM train))
               / (SELECT stddev_pop(l_extendedprice) FROM train) AS "Norm l_extendedprice" FROM parts"""
    ),
    {"Norm l_quantity": 6, "Norm l_extendedprice": 6},
)
def standardize(spark, d):
    train, test = M.standardize(*halves(spark, d), ["l_quantity", "l_extendedprice"])
    return both(train, test).select(*KEY, "part", "Norm l_quantity", "Norm l_extendedprice")


@register(
    "minmax_rescale",
    _sql(
        """SELECT l_orderkey, l_linenumber, part, (l_extendedprice - (SELECT min(l_extendedprice) FROM train))
             / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM train) AS "Rescaled l_extendedprice" FROM parts"""
    ),
    {"Rescaled l_extendedprice": 6},
)
def minmax_rescale(spark, d):
    train, test = M.minmax_rescale(*halves(spark, d), ["l_extendedprice"])
    return both(train, test).select(*KEY, "part", "Rescaled l_extendedprice")


_FLAGS = ", ".join(
    f"""coalesce((l_returnflag = '{v}')::INTEGER, 0) AS "flag_{v}" """ for v in ("A", "N", "R")
)


@register("one_hot", _sql(f"SELECT l_orderkey, l_linenumber, part, {_FLAGS} FROM parts"))
def one_hot(spark, d):
    train, test = M.one_hot(*halves(spark, d), ["l_returnflag"], ["flag"])
    return both(train, test).select(*KEY, "part", "flag_A", "flag_N", "flag_R")


@register(
    "one_hot_encoder",
    """SELECT (c_mktsegment = 'AUTOMOBILE')::INTEGER::DOUBLE AS "c_mktsegment_<AUTOMOBILE>",
              (c_mktsegment = 'BUILDING')::INTEGER::DOUBLE AS "c_mktsegment_<BUILDING>",
              (c_mktsegment = 'FURNITURE')::INTEGER::DOUBLE AS "c_mktsegment_<FURNITURE>",
              (c_mktsegment = 'HOUSEHOLD')::INTEGER::DOUBLE AS "c_mktsegment_<HOUSEHOLD>",
              (c_mktsegment = 'MACHINERY')::INTEGER::DOUBLE AS "c_mktsegment_<MACHINERY>" FROM customer""",
)
def one_hot_encoder(spark, d):
    return M.OneHotEncoder(["c_mktsegment"]).fit_transform(D.table(spark, d, "customer"))


def _cuts(edges: str, labels: list[str], first_closed: bool) -> str:
    start = f"x = {edges}[1] OR " if first_closed else ""
    parts = []
    for i, label in enumerate(labels):
        more = start if i == 0 else ""
        parts.append(f"WHEN {more}(x > {edges}[{i + 1}] AND x <= {edges}[{i + 2}]) THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


@register(
    "quantile_bins",
    _sql(
        f"""SELECT l_orderkey, l_linenumber, part, {_cuts('e', ['q1', 'q2', 'q3', 'q4'], True)}
                   AS "Discrete l_extendedprice"
            FROM (SELECT *, l_extendedprice AS x FROM parts),
                 (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM train)"""
    ),
)
def quantile_bins(spark, d):
    train, test = M.quantile_bins(*halves(spark, d), "l_extendedprice", 4, ["q1", "q2", "q3", "q4"])
    return both(train, test).select(*KEY, "part", "Discrete l_extendedprice")


_LOHI = """SELECT part, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM parts GROUP BY part"""


@register(
    "width_bins",
    _sql(
        f"""SELECT l_orderkey, l_linenumber, part, {_cuts('e', ['a', 'b', 'c', 'd', 'e'], False)}
                   AS "Discrete l_extendedprice"
            FROM (SELECT *, l_extendedprice AS x FROM parts)
            JOIN (SELECT part, [lo - (hi - lo) * 0.001::DOUBLE, lo + (hi - lo) * 1 / 5, lo + (hi - lo) * 2 / 5,
                                lo + (hi - lo) * 3 / 5, lo + (hi - lo) * 4 / 5, hi] AS e FROM ({_LOHI})) USING (part)"""
    ),
)
def width_bins(spark, d):
    train, test = M.width_bins(*halves(spark, d), "l_extendedprice", 5, ["a", "b", "c", "d", "e"])
    return both(train, test).select(*KEY, "part", "Discrete l_extendedprice")


@register(
    "width_bins_edges",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'few'
         WHEN l_quantity >= 10 AND l_quantity < 40 THEN 'some' WHEN l_quantity >= 40 AND l_quantity < 50 THEN 'many'
         END AS "Discrete l_quantity" FROM lineitem""",
)
def width_bins_edges(spark, d):
    rows = D.table(spark, d, "lineitem").select(*KEY, "l_quantity")
    out, _ = M.width_bins(rows, None, "l_quantity", [1, 10, 40, 50], ["few", "some", "many"], right=False)
    return out.drop("l_quantity")


_PREPARED = """coalesce(l_quantity, (SELECT avg(l_quantity) FROM train)) AS l_quantity,
               coalesce(discounted::INTEGER, 0) AS discounted"""


@register(
    "prepare_train_test",
    _sql(
        f"""SELECT l_orderkey, l_linenumber, part, discounted,
               (l_quantity - (SELECT avg(l_quantity) FROM filled WHERE part = 'train'))
                 / (SELECT stddev_pop(l_quantity) FROM filled WHERE part = 'train') AS "Norm l_quantity",
               {_FLAGS.replace('flag_', 'l_returnflag_')} FROM filled""",
        filled=f"SELECT * REPLACE ({_PREPARED}) FROM parts",
    ),
    {"Norm l_quantity": 6},
)
def prepare_train_test(spark, d):
    train, test = M.prepare_train_test(
        *halves(spark, d), ["l_quantity"], ["l_returnflag"], ["discounted"], 0
    )
    return both(train, test).drop("l_quantity", "l_extendedprice", "Year")


@register(
    "temporal_train_test",
    _sql(
        f"""SELECT l_orderkey, l_linenumber, part,
               (l_extendedprice - (SELECT avg(l_extendedprice) FROM train))
                 / (SELECT stddev_pop(l_extendedprice) FROM train) AS "Norm l_extendedprice",
               {_FLAGS.replace('flag_', 'l_returnflag_')} FROM parts"""
    ),
    {"Norm l_extendedprice": 6},
)
def temporal_train_test(spark, d):
    train, test = M.temporal_train_test(
        items(spark, d), TRAIN_YEARS, TEST_YEARS, ["l_extendedprice"], ["l_returnflag"]
    )
    return both(train, test).drop("l_quantity", "l_extendedprice", "discounted", "Year")


# ---- classifiers ---------------------------------------------------------------


def _documents(spark, d):
    """Train and held-out documents by an arithmetic rule, prepared from the train table."""
    labelled = D.table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(
        D.table(spark, d, "labels").select("doc_id", "quality"), "doc_id"
    )
    train, test = M.split_by(labelled, F.expr("doc_id % 4 <> 0"))
    train, test = M.standardize(*M.one_hot(train, test, ["lang"]), ["n_chars"])
    inputs = ["Norm n_chars", *sorted(c for c in train.columns if c.startswith("lang_"))]
    return train, test, inputs


def _fitted(train, inputs):
    return fit_model(train, inputs, "quality", LogisticRegression(), {"maxIter": 20, "regParam": 0.01})[0]


_HELD_OUT = "documents JOIN labels USING (doc_id) WHERE doc_id % 4 = 0"


@register("fit_model", f"SELECT doc_id, quality, TRUE AS is_class, TRUE AS is_probability FROM {_HELD_OUT}")
def fit_model_query(spark, d):
    """Predictions are no SQL; that each held-out document gets a class and a probability is."""
    train, test, inputs = _documents(spark, d)
    shown = predict(test, inputs, _fitted(train, inputs))
    chance = vector_to_array("probability")
    return shown.select(
        "doc_id",
        "quality",
        F.col("prediction").isin(0.0, 1.0).alias("is_class"),
        ((F.abs(chance[0] + chance[1] - 1) < 1e-9) & (F.col("prediction") == (chance[1] > chance[0]).cast("double"))).alias("is_probability"),
    )


@register("score_model", f"SELECT count(*) AS n, TRUE AS recomputed, TRUE AS better_than_none FROM {_HELD_OUT}")
def score_model_query(spark, d):
    """The accuracy against one recomputed from written predictions."""
    train, test, inputs = _documents(spark, d)
    model = _fitted(train, inputs)
    path = new_path(spark, "predictions")
    predict(test, inputs, model).select("quality", "prediction").write.parquet(path)
    again = spark.read.parquet(path).agg(
        F.avg((F.col("quality") == F.col("prediction")).cast("int")).alias("right"),
        F.avg("quality").alias("share"),
    )
    right, share = (again.select(c).scalar() for c in ("right", "share"))
    scored = score_model(test, inputs, "quality", model)
    return scored.select(
        "n",
        (F.abs(F.col("accuracy") - right) < 1e-9).alias("recomputed"),
        (F.col("accuracy") >= F.greatest(share, 1 - share) - 0.05).alias("better_than_none"),
    )
