"""Mixed timestamp formats and time zones: mixtures of formats per source, estimated by expectation-maximisation.

Every value is read under each format that fits it. The sets of formats that fit are counted per source;
on those counts EM estimates how often the source writes each format, starting from a prior. A value with
several readings takes the one of the largest posterior, and is marked ambiguous where that posterior
stays below a bound. Only (source, set of formats) counts are shuffled; each source's EM sees at most a few
dozen rows, whatever the number of articles.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.instants import FORMATS, readings

#: Pseudo-counts of the formats. All-numeric dates that end in the year put the day first by rule; with
#: DAY_FIRST_PRIOR the two orders compete instead.
DAY_FIRST_RULE = {name: 0.0 if name == "mdy" else 1.0 for name in FORMATS}
DAY_FIRST_PRIOR = {name: 0.2 if name == "mdy" else 1.0 for name in FORMATS}
#: A posterior below this leaves the reading marked ambiguous.
SURE = 0.9
#: A reading this many seconds or less before the value of the next column is likelier by NEAR.
WINDOW, NEAR = 3 * 86400, 8.0


def _likelihoods(found: list[tuple[str, int, bool]], other: list[tuple[str, int, bool]]) -> list[float]:
    """Evidence for each reading from the other timestamp of the same row: articles appear within days."""
    if len(found) < 2 or not other:
        return [1.0] * len(found)
    return [NEAR if any(abs(t - o) <= WINDOW for _, o, _ in other) else 1.0 for _, t, _ in found]


def em(sets: list[tuple[tuple[tuple[str, float], ...], float]], prior: dict[str, float], rounds: int = 50) -> dict[str, float]:
    """Weights of the formats from counted sets of (format, likelihood)."""
    weight = {f: 1.0 / len(prior) for f in prior}
    for _ in range(rounds):
        got = dict(prior)
        for formats, n in sets:
            total = sum(weight[f] * l * (prior[f] > 0) for f, l in formats)
            if total > 0:
                for f, l in formats:
                    if prior[f] > 0:
                        got[f] += n * weight[f] * l / total
        s = sum(got.values())
        new = {f: x / s for f, x in got.items()}
        if max(abs(new[f] - weight[f]) for f in new) < 1e-9:
            return new
        weight = new
    return weight


def normalise(
    df: DataFrame,
    columns: list[str] = ["dateTime", "dateTimePub"],  # noqa: B006
    source: str = "source_uri",
    country: str = "country",
    prior: dict[str, float] = DAY_FIRST_RULE,
    prefix: str = "ts_",
) -> DataFrame:
    """All rows and columns of df plus {prefix}utc_s, _column, _format, _explicit_zone, _posterior and _ambiguous.

    {prefix}utc_s is the instant in whole seconds since 1970 (fractions cut off) of the first of `columns`
    that is a date; NULL where none is (then the others are NULL too). A format whose prior is 0 makes no date. An explicit offset or zone is
    obeyed; otherwise the time is wall time in the country's capital, the first of two if it occurs twice,
    moved forward if it is skipped. A NULL source is a source of its own, a NULL or unknown country means
    UTC. New columns replace any of the same name; an empty table gives an empty result.
    """
    given, prior = list(columns), dict(prior)
    names = [f"{prefix}{x}" for x in ("utc_s", "column", "format", "explicit_zone", "posterior", "ambiguous")]
    base = df.drop(*names)
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    row = base.select("*", F.struct(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(given)], F.col(country).cast("string").alias("country")).alias("__in"), key.alias("__source"))

    possible = {f for f, p in prior.items() if p > 0}

    def read(s: pd.DataFrame) -> pd.DataFrame:
        out = []
        for *values, place in s.itertuples(index=False):
            # a reading that the prior rules out is none: a column with no other is no date
            got = [[r for r in readings(v, place) if r[0] in possible] for v in values]
            i = next((k for k, g in enumerate(got) if g), None)
            if i is None:
                out.append((None, None, None, None, None))
                continue
            like = _likelihoods(got[i], [x for g in got[i + 1 :] for x in g])
            out.append((i, [f for f, _, _ in got[i]], [t for _, t, _ in got[i]], [z for _, _, z in got[i]], like))
        return pd.DataFrame(out, columns=["i", "formats", "seconds", "explicit", "like"])

    kinds = "i int, formats array<string>, seconds array<bigint>, explicit array<boolean>, like array<double>"
    reader = F.pandas_udf(read, kinds)
    parsed = row.withColumn("__r", reader("__in"))
    counts = (
        row.select("__source", reader("__in").alias("r"))
        .where("r.i is not null")
        .groupBy("__source", F.col("r.formats").alias("formats"), F.col("r.like").alias("like"))
        .agg(F.count("*").alias("n"))
    )

    def fit(key, t):
        sets = [(tuple(zip(f, l)), n) for f, l, n in zip(t["formats"].to_pylist(), t["like"].to_pylist(), t["n"].to_pylist())]
        w = em(sets, prior)
        return pa.table({"__source": [key[0].as_py()], "__w": pa.array([list(w.items())], pa.map_(pa.string(), pa.float64()))})

    weights = counts.groupBy("__source").applyInArrow(fit, "__source string, __w map<string,double>")
    j = parsed.join(weights, "__source", "left")
    score = F.transform(F.col("__r.formats"), lambda f, k: F.coalesce(F.col("__w")[f], F.lit(0.0)) * F.col("__r.like")[k])
    j = j.withColumn("__s", score).withColumn("__t", F.aggregate("__s", F.lit(0.0), lambda a, x: a + x)).withColumn("__k", F.array_position("__s", F.array_max("__s")).cast("int") - 1)
    at = lambda c: F.when(F.col("__t") > 0, F.get(F.col(f"__r.{c}"), F.col("__k")))
    posterior = F.when(F.col("__t") > 0, F.try_divide(F.array_max("__s"), F.col("__t")))
    column = F.get(F.array(*map(F.lit, given)), F.col("__r.i"))
    return j.select(
        *[F.col(f"`{c}`") for c in base.columns],
        at("seconds").alias(names[0]),
        F.when(F.col("__t") > 0, column).alias(names[1]),
        at("formats").alias(names[2]),
        at("explicit").alias(names[3]),
        posterior.alias(names[4]),
        (posterior < SURE).alias(names[5]),
    )
