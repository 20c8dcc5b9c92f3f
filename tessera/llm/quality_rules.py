"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Base statistics are counted over every whole text. Documents that pass the base rule get a vector of
transformed statistics: log of the mean word length, and the angle asin(sqrt(share)) of symbols among
characters, of repeated lines among lines and of repeated words among words. For every language and
source by itself, however few documents it has, the minimum-covariance-determinant estimate of mean and
covariance is found by concentration steps: the share ``KEEP`` of documents that lie nearest gives the next
mean and covariance. Steps begin at medians and quartiles and at ``SUBSETS`` small subsets chosen by hash; after
``FIRST_STEPS`` of them the start with the least determinant goes on until its determinant falls no more. A
document whose squared Mahalanobis distance exceeds ``CUT`` is rejected.

Covariances carry the floors ``FLOORS`` on their diagonal, since most statistics of clean text are 0 (and
since a cell may hold one document), and are only ever widened so that the KEEP-quantile of the distances
meets that of a chi-square. Quantiles within a group come from counts in narrow bins of the logarithm, so
no group is ever gathered or sorted in one task.

Defined results: null text is empty text; empty text has 0 of everything and fails the base rule; null
language or source is a group of its own; a group of one document keeps it, if it passes the base rule; repeated rows are
judged each, alike; an empty table gives no rows; extra columns are ignored. Windows are compared by 64-bit
hashes of their five words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, cut, unit_hash

WINDOW = 5
SYMBOLS = "#*$%&|<>"
FEW_WORDS = 10
REPEATED_PERCENT = 20
KEEP = 0.75
#: Quantile KEEP of a chi-square with four degrees of freedom.
CHI_KEEP = 5.385
#: Quantile 0.9999 of the same chi-square.
CUT = 23.5
#: Starts from a subset, its size in expectation, steps of every start, steps in all, and the least fall of the log-determinant.
SUBSETS, SUBSET = 2, 12
FIRST_STEPS, MOST_STEPS = 2, 30
LEAST_FALL = 1e-6
#: Least standard deviations: log word length, symbols, repeated lines, repeated words.
FLOORS = (0.1, 0.06, 0.12, 0.12)
BINS_PER_UNIT = 64
#: Cells whose estimates are broadcast; those of more are joined by cell and one of SALTS salts.
BROADCAST_CELLS = 10_000
SALTS = 32
X = ("x0", "x1", "x2", "x3")
_P = range(len(X))


def base_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.col("text")
    for space in WORD_SPACE.replace(" ", ""):
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(line, F.lit(WORD_SPACE)) != "")
    one = documents.select("doc_id", "lang", "source", text.alias("text"))
    one = one.select("*", F.array_remove(F.split(spaced, " ", -1), "").alias("words"), lines.alias("lines"))
    n = F.size("words")
    without = lambda c: F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit("")))
    two = one.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        sum((without(c) for c in SYMBOLS[1:]), without(SYMBOLS[0])).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = F.transform("hashes", lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)]))
    two = two.withColumn("hashes", F.slice(window, 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))))
    by_hash = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    three = two.withColumn("by_hash", by_hash)
    beside = lambda k: F.try_element_at(F.col("by_hash"), k)["h"]
    twice = F.filter(
        "by_hash", lambda w, k: ((k > 0) & beside(F.greatest(k, F.lit(1))).eqNullSafe(w["h"])) | beside(k + 2).eqNullSafe(w["h"])
    )
    places = F.sort_array(F.transform(twice, lambda w: w["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, at: F.struct((at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    return three.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("hashes", "by_hash")


def _features() -> list[Column]:
    angle = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    return [
        F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        angle("n_symbols", "word_chars"), angle("n_dup_lines", "n_lines"), angle("n_repeat_words", "n_words"),
    ]


def _bin(distance: Column) -> Column:
    return F.floor(F.log1p(distance) * BINS_PER_UNIT).cast("long")


def _distance(mean: list[Column], lower: dict[tuple[int, int], Column], pivots: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factors of the covariance."""
    z: list[Column] = []
    for i in _P:
        z.append(F.col(X[i]) - mean[i] - sum((lower[i, j] * z[j] for j in range(i)), F.lit(0.0)))
    return sum((z[i] * z[i] / pivots[i] for i in _P), F.lit(0.0))


def _factors(moments: DataFrame) -> DataFrame:
    """From cell, start, m0.., c00.. to the factors l10.., d0.. (covariance = L D L') and the logarithm of the determinant."""
    out = moments
    for i in _P:
        for j in range(i):
            known = sum((F.col(f"l{i}{k}") * F.col(f"d{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - known) / F.col(f"d{j}"))
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{i}{k}") * F.col(f"d{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"d{i}", F.greatest(F.col(f"c{i}{i}") - rest, F.lit(FLOORS[i] ** 2)))
    return out.withColumn("log_det", sum((F.log(f"d{i}") for i in _P), F.lit(0.0))).select(*FACTORS)


FACTORS = ["cell", "start", "log_det", *[f"m{i}" for i in _P], *[f"l{i}{j}" for i in _P for j in range(i)], *[f"d{i}" for i in _P]]


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell", "start").agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)],
        *[(F.covar_pop(X[i], X[j]) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in _P for j in range(i, len(X))],
    )


def _with_cells(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Join the rows of vectors to the rows of their cell; broadcast if there are few, else salted so that a large cell meets many tasks."""
    cells = cut(cells)
    if cells.count() <= BROADCAST_CELLS:
        return vectors.join(F.broadcast(cells), "cell")
    salted = vectors.withColumn("_salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)))
    dealt = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(dealt, ["cell", "_salt"]).drop("_salt")


def _measured(vectors: DataFrame, factors: DataFrame) -> DataFrame:
    """The rows of vectors, once for each start of their cell, with start and d2."""
    d2 = _distance(
        [F.col(f"m{i}") for i in _P], {(i, j): F.col(f"l{i}{j}") for i in _P for j in range(i)}, [F.col(f"d{i}") for i in _P]
    )
    return _with_cells(vectors, factors).select(*vectors.columns, "start", d2.alias("d2"))


def _nearest(measured: DataFrame, keep: float) -> DataFrame:
    """cell, start, last_bin: the bin of distances with which the share keep of a cell is reached."""
    bins = measured.groupBy("cell", "start", _bin(F.col("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("cell", "start")
    shares = bins.select("cell", "start", "bin", F.sum("n").over(one.orderBy("bin")).alias("upto"), F.sum("n").over(one).alias("all"))
    return shares.where(F.col("upto") >= keep * F.col("all")).groupBy("cell", "start").agg(F.min("bin").alias("last_bin"))


def _step(vectors: DataFrame, factors: DataFrame, keep: float) -> DataFrame:
    """The factors of the nearest documents of each cell and start."""
    measured = _measured(vectors, factors)
    last = _nearest(measured, keep).withColumnRenamed("start", "_of")
    near = _with_cells(measured, last).where((F.col("start") == F.col("_of")) & (_bin(F.col("d2")) <= F.col("last_bin")))
    return cut(_factors(_moments(near)))


def _starts(vectors: DataFrame, subsets: int) -> DataFrame:
    """Factors to start from: medians and quartiles (start 0), and subsets chosen by hash (from 1 on)."""
    middle = vectors.groupBy("cell").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in X], F.count(F.lit(1)).alias("size"))
    middle = cut(middle)
    scale = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(FLOORS[i])) for i, x in enumerate(X)]
    first = middle.select(
        "cell", F.lit(0).alias("start"), F.lit(None).cast("double").alias("log_det"), *[F.col(x)[1].alias(f"m{i}") for i, x in enumerate(X)],
        *[F.lit(0.0).alias(f"l{i}{j}") for i in _P for j in range(i)], *[(scale[i] * scale[i]).alias(f"d{i}") for i in _P],
    )
    if not subsets:
        return first
    sized = _with_cells(vectors, middle.select("cell", "size")).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(subsets))))
    chosen = sized.where(unit_hash(*X, F.col("start")) * F.col("size") < SUBSET)
    return first.unionByName(_factors(_moments(chosen)))


def mcd_factors(vectors: DataFrame, keep: float = KEEP, subsets: int = SUBSETS) -> DataFrame:
    """Mean and covariance (as factors) of every cell of vectors (cell, x0..x3): one row a cell."""
    tried = _starts(vectors, subsets)
    for _ in range(FIRST_STEPS):
        tried = _step(vectors, tried, keep)
    row = F.struct(*[c for c in FACTORS if c != "cell"])
    least = lambda df: df.groupBy("cell").agg(F.min_by(row, F.struct("log_det", "start")).alias("r")).select("cell", "r.*")
    best = active = cut(least(tried))
    for _ in range(MOST_STEPS - FIRST_STEPS):
        new = _step(vectors, active, keep)
        before = best.select("cell", F.col("log_det").alias("_before"))
        active = cut(new.join(before, "cell").where(F.col("log_det") < F.col("_before") - LEAST_FALL).drop("_before"))
        if active.isEmpty():
            break
        best = cut(least(best.unionByName(active)))
    return best


def mcd_distances(vectors: DataFrame, keep: float = KEEP, subsets: int = SUBSETS) -> DataFrame:
    """Rows of vectors (cell, x0..x3 and others) with d2, their robust squared distance."""
    slim = cut(vectors.select("cell", *X))
    factors = mcd_factors(slim, keep, subsets)
    reach = _nearest(_measured(slim, factors), keep).select("cell", F.greatest(F.lit(1.0), F.expm1((F.col("last_bin") + 1) / BINS_PER_UNIT) / CHI_KEEP).alias("wider"))
    measured = _measured(vectors, factors.join(reach, "cell").select(*[c for c in FACTORS if not c.startswith("d")], *[(F.col(f"d{i}") * F.col("wider")).alias(f"d{i}") for i in _P]))
    return measured.drop("start")


def judge(documents: DataFrame, limit: float = CUT) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept, and the robust distance d2 (null if base_failed)."""
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    stats = base_statistics(documents.select("doc_id", "text", "lang", "source"))
    stats = stats.withColumn("base_failed", failed).withColumn("cell", F.concat(known("lang"), F.lit("\n"), known("source")))
    stats = stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cell",
        *[f.alias(x) for f, x in zip(_features(), X, strict=True)],
    )
    stats = cut(stats)
    judged = mcd_distances(stats.where("NOT base_failed")).withColumn("kept", F.col("d2") <= limit)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    rest = stats.where("base_failed").withColumn("kept", F.lit(False)).withColumn("d2", F.lit(None).cast("double"))
    return judged.select(*out).unionByName(rest.select(*out))
