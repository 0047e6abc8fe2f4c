"""Life tables and joint life expectancy.

Life tables are tiny (about 150 rows per table); they are broadcast if counted
to have at most SMALL_TABLE rows, else joined as they are.  Household work is de-duplicated first: the survival
curves depend only on the (age_1, age_2) pair, so they are computed once per
distinct pair and joined back to the households.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_AGE = 149
SMALL_TABLE = 1_000  # rows of a life table (all its table_ids) that may be broadcast
RADIX = 100_000
BASE_TABLE_YEAR = 2012

# Fixed values of the synthetic life tables used as fixtures (the actuarial
# source files are not available): ages 0..120, qx = age^2 / divisor.
SYNTHETIC_DIVISORS = {"male": 16000.0, "female": 18000.0}
SYNTHETIC_LAST_AGE = 120
SYNTHETIC_IMPROVEMENT = 0.01
SYNTHETIC_IMPROVEMENT_LAST_AGE = 105


def _hint(*tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` if every table is counted small, else nothing."""
    small = all(t.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE for t in tables)
    return F.broadcast if small else lambda df: df


def synthetic_life_tables(spark: SparkSession) -> DataFrame:
    """(table_id, row_idx, age, qx) generated from the fixture rule."""
    ages = spark.range(0, SYNTHETIC_LAST_AGE + 1).select(F.col("id").alias("age"))
    out = None
    for t, div in SYNTHETIC_DIVISORS.items():
        one = ages.select(F.lit(t).alias("table_id"), F.col("age").cast("int").alias("row_idx"), "age",
                          ((F.col("age") * F.col("age")).cast("double") / F.lit(div)).alias("qx"))
        out = one if out is None else out.unionByName(one)
    return out


def synthetic_improvement(spark: SparkSession) -> DataFrame:
    ages = spark.range(0, SYNTHETIC_IMPROVEMENT_LAST_AGE + 1).select(F.col("id").alias("age"))
    return ages.select(F.lit("g").alias("table_id"), F.col("age").cast("int").alias("row_idx"), "age",
                       F.lit(SYNTHETIC_IMPROVEMENT).alias("qx"))


def read_life_table(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, row_idx, age, qx) as text from a CSV file; header lines, of
    any number, are those that do not parse as a row."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(parts) == 4).select(
        *(F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("table_id", "row_idx", "age", "qx"))))
    return rows.where(F.col("qx").try_cast("double").isNotNull())


def load_life_table(raw: DataFrame, skip_rows: int = 0) -> DataFrame:
    """(table_id, row_idx, age, qx) from a CSV/parquet read: drop header rows,
    cast types."""
    return raw.where(F.col("row_idx") >= skip_rows).select(
        "table_id", F.col("row_idx").cast("int"), F.col("age").cast("long").alias("age"),
        F.col("qx").cast("double").alias("qx"),
    )


def extend_life_table(table: DataFrame, max_age: int = MAX_AGE, *, compat: bool = False) -> DataFrame:
    """Repeat each table's last qx up to ``max_age`` and add px = 1 - qx.
    ``compat`` restarts the extension at the last age itself (that age then
    appears twice, as in the reference)."""
    last = table.groupBy("table_id").agg(
        F.max_by("age", "row_idx").alias("last_age"), F.max_by("qx", "row_idx").alias("last_qx"),
        F.max("row_idx").alias("last_idx"),
    )
    first = F.col("last_age") if compat else F.col("last_age") + 1
    ext = last.select(
        "table_id", F.posexplode(F.sequence(first.cast("long"), F.lit(max_age).cast("long"))).alias("i", "age"),
        "last_qx", "last_idx",
    ).select("table_id", (F.col("last_idx") + 1 + F.col("i")).cast("int").alias("row_idx"), "age",
             F.col("last_qx").alias("qx"))
    out = table.select("table_id", "row_idx", "age", "qx").unionByName(ext)
    return out.withColumn("px", 1 - F.col("qx"))


def improve(base: DataFrame, improvement: DataFrame, years: int, *, compat: bool = False) -> DataFrame:
    """Apply an improvement scale for ``years`` years: qx * (1 - g)^years and
    px recomputed.  ``compat`` keeps the reference's behaviour, where the
    factor is computed but dropped, so the table is unchanged (the join on
    age still applies)."""
    g = improvement.select("age", F.col("qx").alias("g"))
    j = base.join(_hint(g)(g), "age")
    if compat:
        return j.select("table_id", "row_idx", "age", "qx", "px")
    qx = F.col("qx") * F.pow(1 - F.col("g"), F.lit(years))
    return j.select("table_id", "row_idx", "age", qx.alias("qx"), (1 - qx).alias("px"))


def life_table(table: DataFrame) -> DataFrame:
    """lx, Lx, Tx, ex per table, in age order.

    lx = radix x product of px over the earlier ages; nLx (person-years in the
    year, "Lx") = (lx + next lx)/2; Tx = sum of nLx from this age on;
    ex = Tx / lx.  Windows by table_id (150 rows each).  The person-years
    column is ``nLx`` because Spark resolves ``Lx`` and ``lx`` as one name."""
    w = Window.partitionBy("table_id").orderBy("row_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    lx = F.coalesce(F.product("px").over(before), F.lit(1.0)) * RADIX
    t = table.withColumn("lx", lx)
    t = t.withColumn("nLx", (F.col("lx") + F.lead("lx", 1, 0.0).over(w)) / 2)
    t = t.withColumn("Tx", F.sum("nLx").over(after))
    return t.withColumn("ex", F.try_divide(F.col("Tx"), F.col("lx")))


def survival_probs(table: DataFrame, start_age: int) -> DataFrame:
    """Survival from ``start_age``: product of px over the earlier rows, 1.0
    first; row index t from 0."""
    w = Window.partitionBy("table_id").orderBy("row_idx")
    t = table.where(F.col("age") >= start_age)
    return t.select(
        "table_id", "age",
        F.coalesce(F.product("px").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("surv_prob"),
        (F.row_number().over(w) - 1).alias("t"),
    )


def survival_curves(table: DataFrame, start_ages: DataFrame) -> DataFrame:
    """:func:`survival_probs` of one table for each of ``start_ages``
    (start_age; at most one per age of the table)."""
    w = Window.partitionBy("start_age").orderBy("row_idx")
    t = start_ages.select(
        "start_age", F.explode(F.sequence(F.col("start_age"), F.lit(MAX_AGE).cast("long"))).alias("age")).join(
        _hint(table)(table), "age")
    return t.select(
        "start_age", "age", (F.row_number().over(w) - 1).alias("t"),
        F.coalesce(F.product("px").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("surv_prob"))


def joint_life_percentile(households: DataFrame, table_1: DataFrame, table_2: DataFrame,
                          percentile: float = 0.9, *, keys: Sequence[str] = ("household_id",),
                          age_1: str = "age_1", age_2: str = "age_2") -> DataFrame:
    """Years t until the probability that at least one of the two is alive,
    1 - (1 - s1)(1 - s2), first drops to 1 - percentile (NULL if never).

    Per distinct age pair: explode t, look up px for each person by row
    position, cumulative products over t, first t under the threshold; then
    join back to the households.  Each survival curve starts at the first
    row of that age, rows aligned by index.
    """
    hint = _hint(table_1, table_2)

    def indexed(tbl, suffix):
        # row position within the table and the table's length
        w = Window.partitionBy("table_id").orderBy("row_idx")
        return hint(tbl.select(
            F.row_number().over(w).alias(f"pos{suffix}"), F.col("age").alias(f"a{suffix}"),
            F.col("px").alias(f"px{suffix}"), F.count("*").over(Window.partitionBy("table_id")).alias(f"n{suffix}")))

    t1, t2 = indexed(table_1, "1"), indexed(table_2, "2")
    start1 = t1.groupBy("a1").agg(F.min("pos1").alias("s1"), F.max("n1").alias("n1")).withColumnRenamed("a1", age_1)
    start2 = t2.groupBy("a2").agg(F.min("pos2").alias("s2"), F.max("n2").alias("n2")).withColumnRenamed("a2", age_2)
    pairs = households.select(F.col(age_1).cast("long").alias(age_1),
                              F.col(age_2).cast("long").alias(age_2)).distinct()
    pairs = pairs.join(hint(start1), age_1).join(hint(start2), age_2)
    length = F.least(F.col("n1") - F.col("s1"), F.col("n2") - F.col("s2"))
    steps = pairs.select(age_1, age_2, "s1", "s2",
                         F.explode(F.sequence(F.lit(0).cast("long"), length.cast("long"))).alias("t"))
    steps = steps.join(t1.drop("n1"), F.col("pos1") == F.col("s1") + F.col("t")).join(
        t2.drop("n2"), F.col("pos2") == F.col("s2") + F.col("t"))
    w = Window.partitionBy(age_1, age_2).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    s1 = F.coalesce(F.product("px1").over(w), F.lit(1.0))
    s2 = F.coalesce(F.product("px2").over(w), F.lit(1.0))
    joint = steps.select(age_1, age_2, "t", (1 - (1 - s1) * (1 - s2)).alias("joint"))
    first = joint.where(F.col("joint") <= 1 - percentile).groupBy(age_1, age_2).agg(F.min("t").alias("t"))
    hh = households.select(*keys, F.col(age_1).cast("long").alias(age_1), F.col(age_2).cast("long").alias(age_2))
    # ``first`` has at most one row per age pair of the life tables, so it is
    # small where they are: a hot age pair among billions of households then
    # causes no skewed shuffle partition.
    return hh.join(hint(first), [age_1, age_2], "left").select(
        *keys, age_1, age_2, F.col("t").cast("int").alias("years"))


def conservative_life_expectancy(joint: DataFrame, *, age_1: str = "age_1", age_2: str = "age_2",
                                 max_age: int = 120) -> DataFrame:
    """(joint 90th-percentile years + (max_age - younger age)) / 2."""
    return joint.withColumn(
        "conservative_years",
        (F.col("years") + F.lit(max_age) - F.least(F.col(age_1), F.col(age_2))) / 2,
    )
