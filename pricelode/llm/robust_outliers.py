"""Quality rules by robust multivariate outliers.

Every text gets counts (words, symbols, repeated lines and word windows, ...).  Fixed base rules reject very short and very
repetitive texts.  The others get a vector of transformed ratios, and per language and source a minimum-covariance-
determinant (MCD) estimate of centre and covariance; a text is rejected if its Mahalanobis distance is beyond a chi-square
quantile.

Ratios are shrunk by a fixed number of words of plain prose, so that short texts do not spread wider than long ones.

The estimate is the nested fast-MCD scheme on Spark: blocks of a group (about ``block_rows`` rows, so a hot group is many
tasks) give candidate estimates from random elementary subsets and concentration steps in numpy; the candidates of least
determinant then take concentration steps over all rows of the group.  Such a step is one aggregation: rows are binned by the
logarithm of their distance, bins carry counts, sums and cross products, and the nearest bins that hold the wanted share of
rows form the next subset.  Only one small row per group and candidate is joined back.

Groups of fewer than ``min_rows`` rows are pooled per language, and what is still small over all languages; a pool that
stays small gives no verdict.  Null texts have no words (base rules reject them); null languages and sources are values of
their own.  Ties at the subset's edge go by whole bins; repeated rows count as often as they occur; further columns, also of
clashing names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.llm.common import materialize, rowwise, seeded

#: White space between words, and the symbol characters.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct")
DIM = 5


@dataclass(frozen=True)
class Rules:
    """Base limits and parameters of the estimate; ``tail`` is the share of clean texts that may be lost."""

    min_words: int = 50
    max_repeat_percent: int = 50
    tail: float = 1e-6
    subset_share: float = 0.75
    prior_words: float = 100.0
    ridge: tuple[float, ...] = (0.03, 0.06, 0.06, 0.06, 0.15)
    min_rows: int = 60
    block_rows: int = 1000
    starts: int = 20
    candidates: int = 3
    steps: int = 3
    seed: int = 7


def text_counts(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = data.split()  # bytes split at exactly the six ASCII white-space characters
    chars = len(data.decode("utf-8", "replace"))
    spaces = len(data) - len(data.translate(None, SPACE))
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda chosen: len(data) - len(data.translate(None, chosen))
    return (
        len(words), chars - spaces, count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        count(UPPER), count(DIGITS), count(PUNCTUATION),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n = len(ids)
    pair = code[:-1] * n + code[1:]
    if n > 2_000_000:  # keep the combined code inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * n + code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def count_texts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    out = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])

    def work(data):
        rows = [text_counts(x) for x in data]
        return {c: [r[i] for r in rows] for i, c in enumerate(COUNTS)}

    return rowwise(df, text, out, work, keep)


def base_failed(rules: Rules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def vector(rules: Rules):
    """Transformed ratios: log word length, and roots of the ratios of punctuation, capitals, symbols and digits."""
    words = F.col("n_words") + rules.prior_words
    root = lambda c, prior: F.sqrt((F.col(c) + prior * rules.prior_words) / words)
    return [
        F.log((F.col("word_chars") + 5 * rules.prior_words) / words),
        root("n_punct", 0.15), root("n_upper", 0.15), root("n_symbols", 0.0), root("n_digits", 0.0),
    ]


def chi_square(p_tail: float, dim: int) -> float:
    """Upper quantile by the cube-root approximation."""
    z = NormalDist().inv_cdf(1 - p_tail)
    return dim * (1 - 2 / (9 * dim) + z * math.sqrt(2 / (9 * dim))) ** 3


def consistency(share: float, dim: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal data that of all of it."""
    edge = chi_square(1 - share, dim)
    z = ((edge / (dim + 2)) ** (1 / 3) - 1 + 2 / (9 * (dim + 2))) / math.sqrt(2 / (9 * (dim + 2)))
    return share / NormalDist().cdf(z)


def estimate(n: float, total: np.ndarray, cross: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    centre = total / n
    cov = cross / n - np.outer(centre, centre)
    return centre, cov * consistency(rules.subset_share, len(total)) + np.diag(np.square(rules.ridge))


def distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    away = x - centre
    return np.einsum("ij,ij->i", away @ np.linalg.inv(cov), away)


def fast_mcd(x: np.ndarray, rules: Rules, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the best subset that random elementary starts lead to."""
    n, d = x.shape
    h = min(n, max(math.ceil(rules.subset_share * n), d + 1))
    of = lambda rows: estimate(len(rows), rows.sum(0), rows.T @ rows, rules)
    det = lambda e: np.linalg.slogdet(e[1])[1]

    def step(e):
        return of(x[np.argpartition(distances(x, *e), h - 1)[:h]])

    rng = seeded(rules.seed, seed, n)
    found = [of(x)]
    for _ in range(rules.starts):
        found.append(of(x[rng.choice(n, min(n, d + 1), replace=False)]))
    found = sorted((step(step(e)) for e in found), key=det)[: rules.candidates]
    best = []
    for e in found:
        for _ in range(30):
            after = step(e)
            if det(after) >= det(e) - 1e-9:
                break
            e = after
        best.append(e)
    return min(best, key=det)


STATE = T.StructType(
    [
        T.StructField("grp", T.StringType()), T.StructField("candidate", T.IntegerType()), T.StructField("det", T.DoubleType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())),
    ]
)


def _state(grp: str, candidate: int, e: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    inverse = np.linalg.inv(e[1])
    row = [grp, candidate, float(np.linalg.slogdet(e[1])[1]), e[0].tolist(), inverse.ravel().tolist()]
    return pd.DataFrame([row], columns=[f.name for f in STATE.fields])


def _distance(x, centre, inverse):
    away = [x[i] - centre[i] for i in range(DIM)]
    return sum(away[i] * away[j] * inverse[i * DIM + j] * (1.0 if i == j else 2.0) for i in range(DIM) for j in range(i, DIM))


def group_estimates(rows: DataFrame, rules: Rules) -> DataFrame:
    """One state per group of ``rows`` (grp, tie, x0..x4): the candidate of least determinant after the last step."""
    xs = [f"x{i}" for i in range(DIM)]
    sizes = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("group_rows")), "mcd-sizes")
    blocks = rows.join(sizes, "grp").withColumn(
        "block", F.pmod(F.xxhash64("tie"), F.ceil(F.col("group_rows") / rules.block_rows)).cast("int")
    )

    def start(key, frame):
        return _state(key[0], int(key[1]), fast_mcd(frame[xs].to_numpy(float), rules, int(key[1])))

    first = blocks.select("grp", "block", *xs).groupBy("grp", "block").applyInPandas(start, STATE)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("det", "candidate"))
    states = materialize(
        first.withColumn("rank", rank).filter(F.col("rank") <= rules.candidates).withColumn("candidate", F.col("rank")).select(*STATE.names),
        "mcd-start",
    )
    pairs = [(i, j) for i in range(DIM) for j in range(i, DIM)]
    target = rules.subset_share

    def concentrate(key, frame):
        frame = frame.sort_values("bin")
        n = frame["n"].cumsum().to_numpy()
        take = frame.iloc[: int(np.searchsorted(n, math.ceil(target * n[-1]))) + 1]
        cross = np.zeros((DIM, DIM))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = take[f"s{i}{j}"].sum()
        return _state(key[0], int(key[1]), estimate(take["n"].sum(), take[[f"s{i}" for i in range(DIM)]].sum().to_numpy(float), cross, rules))

    for _ in range(rules.steps):
        near = rows.join(states, "grp")
        d2 = _distance([F.col(x) for x in xs], F.col("centre"), F.col("inverse"))
        sums = near.select("grp", "candidate", *xs, F.floor(16 * F.log2(F.greatest(d2, F.lit(0.0)) + 1e-9)).cast("int").alias("bin"))
        sums = sums.groupBy("grp", "candidate", "bin").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs],
        )
        states = materialize(sums.groupBy("grp", "candidate").applyInPandas(concentrate, STATE), "mcd-step")
    best = F.row_number().over(Window.partitionBy("grp").orderBy("det", "candidate"))
    return states.withColumn("rank", best).filter(F.col("rank") == 1).select("grp", "centre", "inverse")


def judge(df: DataFrame, keep: list[str], **options) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed``, ``distance`` (squared; null without a verdict) and ``kept``."""
    return _judged(df, keep, **options).select("__row.*", *COUNTS, "base_failed", "distance", "kept")


def _judged(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    named = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"),
        F.to_json(F.struct(F.col(f"`{lang}`").alias("l"), F.col(f"`{source}`").alias("s"))).alias("__cell"),
        F.to_json(F.struct(F.col(f"`{lang}`").alias("l"))).alias("__lang"),
        F.col(f"`{text}`").alias("__body"),
    )
    counted = count_texts(named, ["__row", "__cell", "__lang"], "__body")
    counted = materialize(counted.withColumn("base_failed", base_failed(rules)), "quality-counts")
    passed = counted.filter(~F.col("base_failed"))
    cells = passed.groupBy("__cell", "__lang").agg(F.count(F.lit(1)).alias("n"))
    small = cells.filter(F.col("n") < rules.min_rows).groupBy("__lang").agg(F.sum("n").alias("n_lang"))
    groups = materialize(
        cells.join(small, "__lang", "left").select(
            "__cell",
            F.when(F.col("n") >= rules.min_rows, F.col("__cell"))
            .when(F.col("n_lang") >= rules.min_rows, F.col("__lang"))
            .otherwise(F.lit("rest")).alias("grp"),
        ),
        "quality-groups",
    )
    xs = vector(rules)
    with_group = counted.join(groups, "__cell", "left").withColumns({f"x{i}": x for i, x in enumerate(xs)})
    rows = with_group.filter(~F.col("base_failed")).select(
        "grp", F.xxhash64("__row", *COUNTS).alias("tie"), *[f"x{i}" for i in range(DIM)]
    )
    rows = materialize(rows, "quality-vectors")
    enough = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows_of")).filter(F.col("rows_of") >= rules.min_rows)
    enough = materialize(enough, "quality-enough")  # small and of known size: Spark can broadcast it instead of dealing hot groups
    states = materialize(group_estimates(rows.join(enough.select("grp"), "grp", "left_semi"), rules), "quality-states")
    d2 = _distance([F.col(f"x{i}") for i in range(DIM)], F.col("centre"), F.col("inverse"))
    distance = F.when(~F.col("base_failed"), d2)
    inside = F.coalesce(distance <= chi_square(rules.tail, DIM), F.lit(True))
    return with_group.join(states, "grp", "left").select(
        "__row", *COUNTS, "base_failed", distance.alias("distance"), (~F.col("base_failed") & inside).alias("kept")
    )


def quality_query(documents: DataFrame) -> DataFrame:
    return judge(documents, ["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that pass, unchanged."""
    return _judged(docs, docs.columns).filter("kept").select("__row.*")
