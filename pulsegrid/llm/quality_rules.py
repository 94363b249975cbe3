"""Quality rules: statistics of each text, fixed limits, and robust outliers per language and source.

Everything is DataFrame functions. Statistics are made within each row and transformed to a vector. Vectors
are counted in the cells of a fixed grid, by language, source and cell, so that a group (language and source) of
any size is spread over many tasks and all later sums are sums of whole numbers, the same for any partitioning.

The minimum-covariance-determinant estimate of a group has several starts: medians with median deviations, all
rows, and two seeded parts of the cells. A concentration step ranks cells by a histogram of their distances,
takes the least distances that hold the share ``core`` of the rows, and sums their moments. Steps go on until no
determinant changes, ``steps`` at most; the start with the least determinant wins. Rows whose Mahalanobis
distance from their group's estimate is too large are rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, documents

BLANK = " \t\n\x0b\f\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Values of the transformed vector: below, their number, the least standard deviation they are held to (most texts
#: have no symbol and no repeat at all, so without it any symbol would be infinitely far away).
LEAST_DEVIATION = [0.10, 0.08, 0.12, 0.12]
DIMS = len(LEAST_DEVIATION)
#: Fixed values for four dimensions: consistency factor of the nearest 75 %, and the 0.9999 quantile of the distances.
CONSISTENCY, CUTOFF = 1.485, 23.51
#: Cells of the grid a unit, bins of the distance histogram a doubling, least distance told apart.
GRID, BINS, NEAR = 256, 32, 2.0**-10
KEYS = ["_pg_lang", "_pg_source", "_pg_pool"]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` with _pg_lines and the columns of STATS, whose names start with _pg_; a null text has no words, lines or symbols."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_pg_text", text)
    rows = rows.withColumn("_pg_trim", F.btrim("_pg_text", F.lit(BLANK)))
    rows = rows.withColumn("_pg_words", F.when(F.col("_pg_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_pg_trim", SPACE + "+")))
    rows = rows.withColumns(
        {
            "_pg_n_words": F.size("_pg_words").cast("long"),
            "_pg_word_chars": F.length(F.array_join("_pg_words", "")).cast("long"),
            "_pg_n_symbols": F.regexp_count("_pg_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "_pg_rows": F.filter(F.split("_pg_text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""),
            "_pg_hashes": F.transform("_pg_words", lambda w: F.xxhash64(w)),
        }
    )
    rows = rows.withColumn(
        "_pg_windows",
        F.when(F.col("_pg_n_words") < window, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size("_pg_hashes") - (window - 1)), lambda i: F.xxhash64(F.slice("_pg_hashes", i, window)))
        ),
    )
    rows = rows.withColumns(
        {
            "_pg_lines": F.size("_pg_rows").cast("long"),
            "_pg_n_dup_lines": (F.size("_pg_rows") - F.size(F.array_distinct("_pg_rows"))).cast("long"),
            "_pg_again": F.size(F.array_distinct("_pg_windows")) < F.size("_pg_windows"),
        }
    ).drop("_pg_text", "_pg_trim", "_pg_words", "_pg_rows", "_pg_hashes")
    # Only texts with a repeated window go on: windows sorted by hash, those equal to a neighbour, their places in order.
    rows = rows.withColumn("_pg_sorted", F.when(F.col("_pg_again"), F.sort_array(F.transform("_pg_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_pg_windows")
    near = lambda i: F.get(F.col("_pg_sorted"), i)["h"]
    rows = rows.withColumn("_pg_equal", F.filter("_pg_sorted", lambda s, i: F.coalesce(near(i - 1) == s["h"], F.lit(False)) | F.coalesce(near(i + 1) == s["h"], F.lit(False))))
    rows = rows.withColumn("_pg_places", F.sort_array(F.transform("_pg_equal", lambda s: s["i"]))).drop("_pg_sorted", "_pg_equal")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("_pg_places", start, lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(a["end"], p)).alias("n")))
    return rows.withColumn("_pg_n_repeat_words", F.coalesce(cover["n"], F.lit(0)).cast("long")).drop("_pg_places", "_pg_again")


def vector() -> list[Column]:
    """Transformed statistics: mean word length (shrunk in short texts), symbols, repeated lines, repeated words."""
    words, chars = F.col("_pg_n_words").cast("double"), F.col("_pg_word_chars").cast("double")
    return [
        F.log((chars + 300) / (words + 50)),
        F.sqrt(F.col("_pg_n_symbols") / (chars + 50)),
        F.sqrt(F.col("_pg_n_dup_lines") / (F.col("_pg_lines") + 10)),
        F.sqrt(F.col("_pg_n_repeat_words") / (words + 20)),
    ]


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("_pg_n_words") < least_words) | (100 * F.col("_pg_n_repeat_words") > most_repeated * F.col("_pg_n_words"))


def factor(cov: Callable[[int, int], Column]) -> dict[str, Column]:
    """Cholesky factor of a covariance matrix, column by column, as expressions."""
    low: dict[tuple[int, int], Column] = {}
    for j in range(DIMS):
        for i in range(j, DIMS):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    return {f"l{i}{j}": c for (i, j), c in low.items()}


def distance(xs: list[Column], estimate: str = "") -> Column:
    """Squared Mahalanobis distance of a vector from the centre m0.. under the factor l00.. of ``estimate``."""
    total, y = F.lit(0.0), []
    for i, x in enumerate(xs):
        rest = x - F.col(f"{estimate}m{i}")
        for k in range(i):
            rest = rest - F.col(f"{estimate}l{i}{k}") * y[k]
        y.append(rest / F.col(f"{estimate}l{i}{i}"))
        total = total + y[-1] * y[-1]
    return total


def moments() -> list[Column]:
    """Sums of rows, cell numbers and their products over cells; whole numbers, exact in any order."""
    q = [F.col(f"q{i}") for i in range(DIMS)]
    return [F.sum("n").alias("n"), *[F.sum(F.col("n") * q[i]).alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col("n") * q[i] * q[j]).alias(f"p{i}{j}") for i, j in PAIRS]]


def from_moments(sums: DataFrame, *by: str, spread: float = 1.0) -> DataFrame:
    """Centre, factor and log determinant of each row of moments."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIMS)]
    cov = [((F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) / GRID**2 * spread + (LEAST_DEVIATION[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    out = sums.select(*by, *[(m / GRID).alias(f"m{i}") for i, m in enumerate(mean)], *cov)
    out = out.select(*by, *[f"m{i}" for i in range(DIMS)], *[c.alias(n) for n, c in factor(lambda i, j: F.col(f"c{i}{j}")).items()])
    return out.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0)))


def middles(cells: DataFrame, of: list[Column], total: DataFrame) -> DataFrame:
    """KEYS and a0..: the median over rows of each of some whole numbers of the cells; a window over the counts of
    the different numbers of a group."""
    each = cells.select(*KEYS, "n", F.posexplode(F.array(*of)).alias("i", "q")).groupBy(*KEYS, "i", "q").agg(F.sum("n").alias("n"))
    through = F.sum("n").over(Window.partitionBy(*KEYS, "i").orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    half = each.withColumn("_t", through).join(total, KEYS).where(2 * F.col("_t") >= F.col("total"))
    return half.groupBy(*KEYS).agg(*[F.min(F.when(F.col("i") == i, F.col("q"))).alias(f"a{i}") for i in range(len(of))])


def estimates(measured: DataFrame, core: float = 0.75, steps: int = 8, least_rows: int = 50) -> DataFrame:
    """One row a group: KEYS, centre m0.. and Cholesky factor l00.. of its estimate.

    Groups of fewer than ``least_rows`` rows have none of their own; the group with _pg_pool true, all rows of
    the language, stands for them.
    """
    q = [F.round(x * GRID).cast("long").alias(f"q{i}") for i, x in enumerate(vector())]
    qs = [f"q{i}" for i in range(DIMS)]
    own = measured.where(~base_failed()).groupBy("_pg_lang", "_pg_source", *q).agg(F.count("*").alias("n")).withColumn("_pg_pool", F.lit(False))
    own = cut(own)
    pool = own.groupBy("_pg_lang", *qs).agg(F.sum("n").alias("n")).withColumns({"_pg_source": F.lit(""), "_pg_pool": F.lit(True)})
    cells = own.unionByName(pool)
    total = cells.groupBy(*KEYS).agg(F.sum("n").alias("total")).where(F.col("total") >= F.when(F.col("_pg_pool"), 1).otherwise(least_rows))
    total = cut(total)
    cells = cut(cells.join(total, KEYS))

    middle = cut(middles(cells, [F.col(x) for x in qs], total))
    away = cells.join(middle, KEYS)
    spread = middles(away, [F.abs(F.col(f"q{i}") - F.col(f"a{i}")) for i in range(DIMS)], total).toDF(*KEYS, *[f"d{i}" for i in range(DIMS)])
    diagonal = lambda i, j: (F.lit(1.4826) * F.col(f"d{i}") / GRID) ** 2 + LEAST_DEVIATION[i] ** 2 if i == j else F.lit(0.0)
    first = middle.join(spread, KEYS).select(*KEYS, F.lit(0).alias("start"), *[(F.col(f"a{i}") / GRID).alias(f"m{i}") for i in range(DIMS)], *[c.alias(n) for n, c in factor(diagonal).items()])
    first = first.withColumn("logdet", F.lit(0.0))
    part = F.pmod(F.xxhash64(F.lit(11), *qs), F.lit(4))
    others = F.explode(F.concat(F.array(F.lit(1)), F.when(part == 0, F.array(F.lit(2))).when(part == 1, F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))))
    rest = from_moments(cells.withColumn("start", others).groupBy(*KEYS, "start").agg(*moments()), *KEYS, "start")
    now = cut(first.unionByName(rest))

    names = ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in PAIRS]]
    for _ in range(steps):
        far = distance([F.col(x) / GRID for x in qs])
        bins = cells.join(now, KEYS).withColumn("bin", F.floor(F.log2(far + NEAR) * BINS)).groupBy(*KEYS, "start", "bin").agg(F.first("total").alias("total"), *moments())
        through = F.sum("n").over(Window.partitionBy(*KEYS, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        nearest = bins.withColumn("_t", through).where(F.col("_t") - F.col("n") < core * F.col("total"))
        after = cut(from_moments(nearest.groupBy(*KEYS, "start").agg(*[F.sum(x).alias(x) for x in names]), *KEYS, "start", spread=CONSISTENCY))
        moved = after.join(now.select(*KEYS, "start", F.col("logdet").alias("was")), [*KEYS, "start"]).where(F.abs(F.col("logdet") - F.col("was")) > 1e-6)
        settled, now = moved.isEmpty(), after
        if settled:
            break
    value = [c for c in now.columns if c not in (*KEYS, "start", "logdet")]
    best = now.groupBy(*KEYS).agg(F.min(F.struct(F.round("logdet", 6).alias("d"), F.col("start"), F.struct(*value).alias("e"))).alias("b"))
    return cut(best.select(*KEYS, "b.e.*"))


def judge(measured: DataFrame, found: DataFrame) -> DataFrame:
    """``measured`` with _pg_failed, _pg_distance2 (squared distance, null where it failed) and _pg_kept, by the estimates found."""
    rest = F.struct(*[c for c in found.columns if c not in KEYS])
    own = found.where(~F.col("_pg_pool")).select("_pg_lang", "_pg_source", rest.alias("_pg_own"))
    pool = found.where(F.col("_pg_pool")).select("_pg_lang", rest.alias("_pg_all"))
    rows = measured.join(own, ["_pg_lang", "_pg_source"], "left").join(pool, ["_pg_lang"], "left")
    rows = rows.withColumn("_pg_e", F.coalesce("_pg_own", "_pg_all")).withColumns({f"_pg_x{i}": x for i, x in enumerate(vector())})
    d = distance([F.col(f"_pg_x{i}") for i in range(DIMS)], "_pg_e.")
    rows = rows.withColumn("_pg_failed", base_failed()).withColumn("_pg_distance2", F.when(~F.col("_pg_failed"), d))
    rows = rows.withColumn("_pg_kept", F.when(F.col("_pg_failed"), False).otherwise(F.coalesce("_pg_distance2", F.lit(0.0)) <= CUTOFF))
    return rows.drop("_pg_own", "_pg_all", "_pg_e", *[f"_pg_x{i}" for i in range(DIMS)])


def _grouped(docs: DataFrame) -> DataFrame:
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return measure(docs.withColumns({"_pg_lang": group("lang"), "_pg_source": group("source")}))


def verdicts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, STATS, base_failed, kept and distance2 of each row.

    A null text has no words and fails. A null language or source is a group of its own, as an empty one
    is. Repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """
    narrow = docs.select("doc_id", "text", *[c for c in ("lang", "source") if c in docs.columns])
    measured = cut(_grouped(narrow).drop("text", "lang", "source"))
    out = {"base_failed": "_pg_failed", "kept": "_pg_kept", "distance2": "_pg_distance2"}
    return judge(measured, estimates(measured, **how)).select(F.col("doc_id").cast("long"), *[F.col("_pg_" + x).alias(x) for x in STATS], *[F.col(v).alias(k) for k, v in out.items()])


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``, whatever these are called.

    Texts are measured once: they are written with their statistics, and those that pass the fixed limits are read
    again when the estimates stand.
    """
    passed = cut(_grouped(docs)).where(~base_failed())
    return judge(passed, estimates(passed.drop(*docs.columns), **how)).where("_pg_kept").select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))
